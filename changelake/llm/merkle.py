"""Merkle manifest of a dataset: a hash tree over every row, a proof for each row, and the climb that checks it.

Rows are leaves. Per source the leaves, in order of id, are hashed in runs of 16 until one node is left, the subroot; the
subroots, in order of source, are hashed likewise to the root. The levels are built bottom-up, one aggregation each, and stored as
rows that name their parent and the hashes to their left and right in its run. A recursive query then climbs from the leaves
to the root. Leaves of one lowest run have all nodes above it in common, so they climb as one row: it carries a hash for each of
its leaves and one list of siblings for all, which makes the climb a sixteenth as wide as the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changelake.llm.common import narrowed, stored
from changelake.operators.ranks import ranked

#: Nodes hashed into one.
FAN = 16
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over the subroots; the sources' trees are numbered from 0.
TOP = -1

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of a row: each field as its length in UTF-8 bytes, a colon and its text, or a dash if it is null."""
    cells = [fields[name].cast("string") for name in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])


def tampered_text(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _A_Z, _a_z)


def is_tampered(doc_id: Column) -> Column:
    """Rows that the check alters: 5 divides the CRC-32 of the decimal id. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@contextmanager
def _unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """A recursive query may return as many rows as there are; by default Spark stops it with an error at a million."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, level, idx, hash, blocks, size) of one level, of trees with several nodes there, as runs with their hash.

    tree, level and idx are those of the run's node on the next level; blocks counts the lowest runs below, size the nodes of the tree
    on that level. At most 16 nodes meet in a row.
    """
    members = F.array_sort(F.collect_list(F.struct("p_idx", "tree", "level", "idx", "hash", "blocks"))).alias("members")
    size = F.ceil(F.max("size") / FAN).cast("bigint").alias("size")
    runs = nodes.groupBy("p_tree", "p_level", F.expr(f"p_idx div {FAN}").alias("run")).agg(members, F.sum("blocks").alias("blocks"), size)
    return runs.select(
        F.col("p_tree").alias("tree"), F.col("p_level").alias("level"), F.col("run").alias("idx"),
        F.sha2(F.array_join(F.transform("members", lambda m: m["hash"]), ""), 256).alias("hash"), "members", "blocks", "size",
    )


def _linked(runs: DataFrame) -> DataFrame:
    """One row for each member of a run: its key, its hash, the hashes around it, and its parent."""
    joined = lambda part: F.array_join(F.transform(part, lambda m: m["hash"]), "")
    members = F.transform(
        "members",
        lambda m, i: F.struct(
            m["tree"].alias("tree"), m["level"].alias("level"), m["idx"].alias("idx"), m["hash"].alias("hash"), m["blocks"].alias("blocks"),
            joined(F.slice("members", F.lit(1), i)).alias("left"),
            joined(F.slice("members", i + 2, F.lit(FAN))).alias("right"),
        ),
    )
    parents = runs.select(F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("idx").alias("p_idx"), F.col("blocks").alias("p_blocks"), members.alias("m"))
    return parents.select(F.inline("m"), "p_tree", "p_level", "p_idx", "p_blocks")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and start: the hash of the altered row where the row is altered, else null."""
    plain = narrowed(docs, **{c: c for c in FIELDS}).selectExpr(
        "cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(n_chars as bigint) n_chars", "cast(text as string) text"
    )
    given = {c: F.col(c) for c in FIELDS}
    altered = given | {"text": tampered_text(F.col("text"))}
    return plain.select("doc_id", "source", leaf_hash(given).alias("leaf"), F.when(is_tampered(F.col("doc_id")), leaf_hash(altered)).alias("start"))


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tree: lowest runs with their leaves (blocks), and nodes linked to their parents (links).

    blocks: tree, idx, lone, leaves (array of doc_id, leaf, start). links: tree, level, idx, copy, hash, left, right, p_tree, p_level,
    p_idx, p_copies, subroot; the root's parent is null. A node stands there in as many copies as 256 blocks each ask for, so that
    the climb's join deals the blocks of a hot source, and all blocks at the root, over many keys; copies make up less than a
    sixteenth of the blocks.
    """
    hashed = stored(leaves(docs), "merkle-leaves")
    placed = ranked(hashed, ["doc_id", "leaf"], by=["source"], name="place")
    member = F.struct("place", "doc_id", "leaf", "start")
    low = placed.groupBy("source", F.expr(f"place div {FAN}").alias("idx")).agg(F.array_sort(F.collect_list(member)).alias("leaves"))
    low = stored(low, "merkle-runs")
    sources = stored(low.groupBy("source").agg(F.sum(F.size("leaves")).alias("n")), "merkle-sources")
    trees = ranked(sources, ["source"], name="tree").select(F.col("source").alias("of"), "tree", "n")
    blocks = low.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("tree", "idx", (F.col("n") == 1).alias("lone"), "n", "leaves")
    blocks = stored(blocks, "merkle-blocks")

    joined = F.array_join(F.transform("leaves", lambda x: x["leaf"]), "")
    level = blocks.select(
        "tree", F.lit(1).alias("level"), "idx", F.when(F.col("lone"), joined).otherwise(F.sha2(joined, 256)).alias("hash"),
        F.lit(1).cast("bigint").alias("blocks"), F.ceil(F.col("n") / FAN).cast("bigint").alias("size"),
    )
    most = sources.agg(F.max("n"), F.count("*")).first()
    links, tops = [], []
    at, size = 1, -(-(most[0] or 0) // FAN)
    while size > 1:
        tops.append(level.where("size = 1"))
        runs = stored(_runs(level.where("size > 1").withColumns({"p_tree": F.col("tree"), "p_level": F.col("level") + 1, "p_idx": F.col("idx")})), "merkle-level")
        links.append(_linked(runs))
        level, at, size = runs.drop("members"), at + 1, -(-size // FAN)
    tops.append(level.where("size = 1"))
    columns = ["tree", "level", "idx", "hash", "blocks"]
    subroots = tops[0].select(*columns)
    for t in tops[1:]:
        subroots = subroots.unionByName(t.select(*columns))
    subroots = stored(subroots, "merkle-subroots")

    level = subroots.withColumns({"size": F.lit(most[1]).cast("bigint"), "p_tree": F.lit(TOP).cast("bigint"), "p_level": F.lit(1), "p_idx": F.col("tree")})
    size = most[1]
    while size > 1:
        runs = stored(_runs(level), "merkle-level")
        links.append(_linked(runs))
        level = runs.drop("members").withColumns({"p_tree": F.col("tree"), "p_level": F.col("level") + 1, "p_idx": F.col("idx")})
        size = -(-size // FAN)
    none = F.lit(None)
    root = level.select(
        *columns, F.lit("").alias("left"), F.lit("").alias("right"), none.cast("bigint").alias("p_tree"), none.cast("int").alias("p_level"),
        none.cast("bigint").alias("p_idx"), none.cast("bigint").alias("p_blocks"),
    )
    for part in links:
        root = root.unionByName(part)
    copies = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / (FAN * FAN)).cast("int")
    is_top = (F.col("tree") != TOP) & (F.coalesce(F.col("p_tree"), F.lit(TOP)) == TOP)
    rows = root.select(
        "tree", "level", "idx", "hash", "left", "right", "p_tree", "p_level", "p_idx", copies("p_blocks").alias("p_copies"), is_top.alias("subroot"),
        F.explode(F.sequence(F.lit(0), copies("blocks") - 1)).alias("copy"),
    )
    return blocks, stored(rows, "merkle-links")


_CLIMB = """
WITH RECURSIVE climb (tree, block, at_tree, at_level, at_idx, at_copy, folded, siblings, subroot, root) AS (
  SELECT tree, idx, tree, 1, idx, 0, folded, CAST('' AS BINARY), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {start}
  UNION ALL
  SELECT c.tree, c.block, n.p_tree, n.p_level, n.p_idx, CAST(pmod(xxhash64(c.tree, c.block), n.p_copies) AS INT),
    transform(c.folded, f -> CASE WHEN n.p_level IS NULL THEN f ELSE sha2(concat(n.left, f, n.right), 256) END),
    concat(c.siblings, unhex(n.left), unhex(n.right)),
    CASE WHEN n.subroot THEN n.hash ELSE c.subroot END,
    CASE WHEN n.p_level IS NULL THEN n.hash END
  FROM climb c JOIN {links} n
    ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_idx = n.idx AND c.at_copy = n.copy)
SELECT tree, block, folded, siblings, subroot, root FROM climb WHERE root IS NOT NULL
"""


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether a copy of the row with the marked texts altered folds to the root.

    Returns one row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Fields may be null (a dash
    in the leaf), empty or of any length; a null id counts as the smallest, is never altered, and rows of one id and source are
    ordered by their hash, so equal rows get equal leaves and places of their own. Extra columns are left alone. A
    source of one row is its own subroot, a table of one source its own root; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks, links = build(docs)
    around = lambda part: F.array_join(F.transform(part, lambda x: x["leaf"]), "")
    left = lambda i: around(F.slice("leaves", F.lit(1), i))
    right = lambda i: around(F.slice("leaves", i + 2, F.lit(FAN)))
    own = lambda x: F.coalesce(x["start"], x["leaf"])
    first = F.transform("leaves", lambda x, i: F.when(F.col("lone"), own(x)).otherwise(F.sha2(F.concat(left(i), own(x), right(i)), 256)))
    start = blocks.select("tree", "idx", first.alias("folded"))
    with _unlimited_rows(spark):
        climbed = stored(spark.sql(_CLIMB, start=start, links=links), "merkle-climbed")
    tail = F.lower(F.hex("siblings"))
    both = blocks.join(climbed.select("tree", F.col("block").alias("idx"), "folded", tail.alias("tail"), "subroot", "root"), ["tree", "idx"])
    proofs = F.transform(
        "leaves",
        lambda x, i: F.struct(
            x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"),
            F.sha2(F.concat(left(i), right(i), F.col("tail")), 256).alias("proof_sha256"), F.get("folded", i).alias("folded_root"),
        ),
    )
    rows = both.select("subroot", "root", F.inline(proofs))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(tree_levels: int = 8, top_levels: int = 6) -> str:
    """The twin, with its levels written out: 16 ** 8 rows a source and 16 ** 6 sources."""
    cells = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS)
    low = "translate(text, '" + _A_Z + "', '" + _a_z + "')"
    # CRC-32 bit by bit: a byte enters on the first of its eight steps
    steps = "list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [1000 + ascii(d)::BIGINT, 1, 1, 1, 1, 1, 1, 1])))"
    x = "(CASE WHEN b >= 1000 THEN xor(acc, b - 1000) ELSE acc END)"
    crc = f"xor(4294967295, list_reduce({steps}, lambda acc, b: xor({x} // 2, ({x} % 2) * 3988292384)))"
    ctes = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, sha256({cells}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({cells.replace(' || text,', f' || {low},')}) END AS start FROM documents)",
        "trees AS MATERIALIZED (SELECT source AS of_source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM leaves GROUP BY 1))",
        "p0 AS MATERIALIZED (SELECT row_number() OVER () AS k, *, tree AS tree0 FROM (SELECT tree, n AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, doc_id, leaf,"
        " leaf AS hash, coalesce(start, leaf) AS folded, '' AS proof FROM leaves JOIN trees ON source IS NOT DISTINCT FROM of_source))",
    ]
    for i in range(tree_levels + top_levels):
        before = f"p{i}"
        if i == tree_levels:
            ctes.append(
                f"q AS MATERIALIZED (SELECT k, doc_id, leaf, hash AS subroot, -1 AS tree, tree0 AS idx, (SELECT count(*) FROM trees) AS size, hash, folded, proof, tree0 FROM {before})"
            )
            before = "q"
        sub = "" if i < tree_levels else ", subroot"
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT tree, idx // 16 AS run, list(hash ORDER BY idx) AS hashes FROM (SELECT DISTINCT tree, idx, hash FROM {before} WHERE size > 1) GROUP BY 1, 2)"
        )
        left = "array_to_string(hashes[1:idx % 16], '')"
        right = "array_to_string(hashes[idx % 16 + 2:16], '')"
        ctes.append(
            f"p{i + 1} AS MATERIALIZED (SELECT k, doc_id, leaf{sub}, tree0, b.tree, CASE WHEN size > 1 THEN (size + 15) // 16 ELSE 1 END AS size, CASE WHEN size > 1 THEN idx // 16 ELSE idx END AS idx,"
            f" CASE WHEN size > 1 THEN sha256(array_to_string(hashes, '')) ELSE hash END AS hash,"
            f" CASE WHEN size > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded,"
            f" CASE WHEN size > 1 THEN proof || {left} || {right} ELSE proof END AS proof"
            f" FROM {before} b LEFT JOIN r{i} r ON b.tree = r.tree AND b.idx // 16 = r.run)"
        )
    last = f"p{tree_levels + top_levels}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = hash AS verified FROM {last}"


SQL = _sql()

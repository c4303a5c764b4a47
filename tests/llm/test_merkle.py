"""The manifest against a plain version that builds the tree in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F, types as T

from changelake.llm import merkle, plans
from tests import oracle

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
     T.StructField("text", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("leaf", T.StringType()), T.StructField("place", T.StringType())]
)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def fan(nodes, paths):
    """Root of a list of hashes; `paths` gets, for each, the list of (left, right) on the way up."""
    where = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_where = [], []
        for low in range(0, len(nodes), 16):
            run = nodes[low : low + 16]
            for j in range(len(run)):
                for i in where[low + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            up_where.append([i for j in range(len(run)) for i in where[low + j]])
        nodes, where = up, up_where
    return nodes[0]


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    out, roots, trees = [], [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths = [[] for _ in mine]
        roots.append(fan([leaf(r) for r in mine], paths))
        trees.append((mine, paths))
    tops = [[] for _ in sources]
    root = fan(roots, tops)
    for (mine, paths), sub, top in zip(trees, roots, tops, strict=True):
        for r, path in zip(mine, paths, strict=True):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if altered else leaf(r)
            for left, right in path + top:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path + top for x in left + right])
            out.append((r[0], leaf(r), sub, root, proof, node, node == root))
    return sorted(out, key=str)


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_equals_the_plain_tree(spark):
    rng = random.Random(5)
    rows = [(i, "hot", "en", 10, f"Text {i} É") for i in range(4200)]  # 4 levels, the last run of one
    rows += [(5000 + i, f"s{i % 23}", "de", None, rng.choice([None, "", "ABC", "abc"])) for i in range(300)]  # more than 16 sources
    rows += [(9000, "lone", None, 3, "Äb C"), (9001, None, "en", 1, "Z"), (None, None, "en", 1, "Null id"), (9002, "", "fr", 2, "empty source")]
    rows += [(7, "hot", "en", 10, "Text 7 É")] * 3 + [(7, "hot", "en", 11, "another of the same id")]  # repeated rows and ids
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("n", [16, 17, 257])
def test_sizes_of_one_source(spark, n):
    check(spark, [(i, "s", "en", 1, "A") for i in range(n)])


def test_few_rows(spark):
    check(spark, [(1, "a", "en", 1, "X"), (2, "b", "en", 1, "Y")])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(10, "s", "en", 5, "LONG Text " * 200_000)])


def test_an_altered_row_does_not_verify(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(60)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()}
    for i in range(60):
        assert got[i] == (not (zlib.crc32(str(i).encode()) % 5 == 0 and i % 2 == 1))
    assert len(set(got.values())) == 2


def test_copies_spread_the_upper_nodes(spark):
    """A node above n lowest runs stands in the links n / 256 times, and the climb finds one of them for each run."""
    docs = spark.range(16 * 700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    _, links = merkle.build(docs)
    counts = {(r["level"], r["n"]) for r in links.groupBy("level", "idx").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1, 1), (2, 1), (3, 1), (4, 3)}
    assert merkle.manifest(docs).where("not verified").count() == 0


def test_equals_the_twin(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert oracle.compare(plans.QUERIES["op11_merkle_manifest"](spark, sf_dir), oracle.connect(sf_dir), merkle.SQL) > 0

"""Line deduplication by distinct-site spread: a line found on many sites is boilerplate and stays in one document only.

A HyperLogLog sketch of the sites is kept for each line hash; sketches of parts merge by aggregation, so a line that a
third of all documents share costs one small sketch per task. Lines whose estimate lies near the threshold are counted exactly.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changelake.llm.common import packed, stored, text_or_empty

#: Sketches of 2 ** LG_K registers: a standard error of 1.04 / sqrt(2 ** LG_K), 1.6 per cent.
LG_K = 12


def _row_key() -> Column:
    """Tells rows apart by id and text; equal rows are treated alike."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text"))))


def _named(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{site_col}`").cast("string").alias("site")
    ).withColumn("text", text_or_empty())


def lines_of(named: DataFrame) -> DataFrame:
    """(doc_id, site, row_key, at, line): hash of every line that is not blank; at counts lines from 0."""
    exploded = named.select("doc_id", "site", _row_key().alias("row_key"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return exploded.where("trim(content) != ''").select("doc_id", "site", "row_key", "at", F.xxhash64(F.trim("content")).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int, near: float = 0.08) -> DataFrame:
    """(line, keeper) of lines found on at least `min_sites` distinct sites; keeper is the smallest id of a document with it.

    near: estimates within this share of the threshold (five standard errors), and within 1 of it, are replaced by exact counts.
    Null sites do not count.
    """
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("keeper"))
    low, high = min(min_sites - 1, min_sites * (1 - near)), max(min_sites + 1, min_sites * (1 + near))
    estimated = sketched.select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)
    estimated = stored(estimated, "lines-estimated")
    sure = estimated.where(F.col("sites") > high).select("line", "keeper")
    unsure = estimated.where(F.col("sites") <= high).select("line", "keeper")
    pairs = lines.select("line", "site").join(unsure.select("line"), "line").distinct()
    exact = pairs.groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(unsure.join(exact.select("line"), "line"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Every input row without the boilerplate lines: doc_id, n_lines, n_removed (both long) and the text that stays.

    A line is a part between line feeds; it is compared without the spaces around it, and blank ones are neither counted nor
    removed. A line on at least `min_sites` sites is removed from every document but those of the smallest id that have it, so
    that content spread by copying whole documents is not lost. Null texts count as empty and come back as such. Repeated rows
    are treated alike; rows with a null id keep a line only if no other document has it. Extra columns are ignored.
    """
    named = _named(docs, id_col, text_col, site_col)
    return _with_removed(named, _removed(named, min_sites)).select(
        "doc_id",
        F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("removed", F.array().cast("array<int>"))).cast("bigint").alias("n_removed"),
        _kept_text().alias("text"),
    )


def _removed(named: DataFrame, min_sites: int) -> DataFrame:
    """(row_key, removed): places of the lines to remove from a row; a list is never longer than its text has lines."""
    lines = stored(lines_of(named), "lines")
    spread = stored(spread_lines(lines, min_sites), "lines-spread")
    gone = lines.join(spread, "line").where("not (doc_id <=> keeper)")
    return stored(gone.groupBy("row_key").agg(F.collect_set("at").alias("removed")), "lines-removed")


def _with_removed(named: DataFrame, removed: DataFrame) -> DataFrame:
    return named.withColumn("row_key", _row_key()).join(removed, "row_key", "left")


def _kept_text() -> Column:
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    # a fold over one element names the parts, so that the text is split once
    kept = F.aggregate(F.array(parts), F.lit(""), lambda _, named: F.array_join(F.transform(left, lambda i: F.get(named, i)), "\n"))
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)


def without_boilerplate(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The rows and columns of `docs` (doc_id, text, source and any others) with boilerplate lines removed from text.

    If there is a column n_chars it is set to the new length. All rows stay, also those whose text becomes empty; null texts come
    back empty or null as they are, repeated rows as often as they stand there, other columns unchanged whatever
    their names. An empty table stays empty.
    """
    named = _named(docs, "doc_id", "text", "source")
    removed = _removed(named, min_sites)
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("-")), F.lit("|"), text_or_empty())))
    joined = packed(docs, row_key=key, text=F.col("text")).join(removed.select("row_key", "removed"), "row_key", "left").withColumn("text", _kept_text())
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB twin of dedup_lines at its defaults.
SQL = """
WITH lines AS (
  SELECT rowid_ AS r, doc_id, source, i AS place, l AS line
  FROM (SELECT rowid_, doc_id, source, ls, unnest(range(len(ls))) AS i, unnest(ls) AS l
        FROM (SELECT row_number() OVER () AS rowid_, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), spread AS (
  SELECT trim(line) AS line, min(doc_id) AS keeper FROM lines WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.r, l.doc_id, l.place, l.line, s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone
  FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line AND trim(l.line) <> ''
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY r
"""

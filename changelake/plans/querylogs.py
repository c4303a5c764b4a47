"""Query-log queries over SQL texts made from the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changelake.operators import querylog as ql
from changelake.plans.registry import Tables, as_doubles, register, spread

# Query texts, one per order by o_orderkey % 8.
TEXTS = (
    "SELECT titleType, COUNT(*) FROM imdb.title_basics GROUP BY titleType;",
    "select avg(averageRating) from title_ratings",
    "SELECT tconst FROM title_ratings WHERE tconst = 'x' LIMIT 1",
    "SELECT /* ANALYTICS */ tconst FROM title_ratings",
    "SELECT /* ANALYTICS */ MAX(numVotes) FROM title_ratings",
    "INSERT INTO title_ratings VALUES ('t', 8.5, 100)",
    "  SELECT COUNT(*) FROM t",
    "SELECT a FROM t WHERE b = 'group by'",
)

_CASES = " ".join("WHEN {} THEN '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(TEXTS))
_LOG = f"""
q AS (SELECT o_orderkey, CASE o_orderkey % 8 {_CASES} END || ' -- ' || CAST(o_custkey AS VARCHAR) AS sql,
  CASE WHEN o_orderstatus = 'O' THEN 'row' ELSE 'column' END AS backend, o_totalprice / 1000 AS elapsed, o_orderdate AS event_time FROM orders),
r AS (SELECT *, CASE WHEN regexp_matches(sql, '^SELECT.*\\b(COUNT|SUM|AVG|MIN|MAX|GROUP BY|HAVING)\\b', 'i') THEN 100
  WHEN regexp_matches(sql, '.*/\\*\\s*ANALYTICS\\s*\\*/.*', 'i') THEN 101 END AS rule_id FROM q)
"""


def query_log(t: Tables) -> DataFrame:
    kind = F.col("o_orderkey") % 8
    text = F.element_at(F.array(*[F.lit(s) for s in TEXTS]), (kind + 1).cast("int"))
    return spread(t.orders, "o_orderkey").select(
        "o_orderkey",
        F.concat(text, F.lit(" -- "), F.col("o_custkey").cast("string")).alias("sql"),
        kind.alias("query"),
        F.when(F.col("o_orderstatus") == "O", "row").otherwise("column").alias("backend"),
        (F.col("o_totalprice") / 1000).alias("elapsed"),
        F.col("o_orderdate").alias("event_time"),
    )


@register(
    "classify_queries",
    f"WITH {_LOG} SELECT o_orderkey, CAST(rule_id AS DOUBLE) AS rule_id, CASE WHEN rule_id IS NULL THEN 10 ELSE 20 END AS target_group FROM r",
)
def classify_queries(t: Tables) -> DataFrame:
    return as_doubles(ql.classify(query_log(t)).select("o_orderkey", "rule_id", "target_group"), "rule_id")


@register(
    "rule_hits",
    f"""WITH {_LOG} SELECT rule_id, count(*) AS hits, CASE rule_id WHEN 100 THEN 'Analytics → ClickHouse'
    ELSE 'Rule ' || CAST(rule_id AS VARCHAR) END AS description FROM r WHERE rule_id IS NOT NULL GROUP BY rule_id""",
)
def rule_hits(t: Tables) -> DataFrame:
    return ql.rule_hits(query_log(t))


@register("recent_queries", f"WITH {_LOG} SELECT o_orderkey, sql, elapsed, event_time FROM q ORDER BY event_time DESC, o_orderkey LIMIT 10")
def recent_queries(t: Tables) -> DataFrame:
    return ql.recent_queries(query_log(t), 10, tie_break=["o_orderkey"]).select("o_orderkey", "sql", "elapsed", "event_time")


@register(
    "slow_queries",
    f"WITH {_LOG} SELECT o_orderkey, sql, elapsed, event_time FROM q WHERE elapsed >= 250 AND event_time >= DATE '1996-01-01'",
)
def slow_queries(t: Tables) -> DataFrame:
    return ql.slow_queries(query_log(t), 250, since=F.lit("1996-01-01").cast("date")).select("o_orderkey", "sql", "elapsed", "event_time")


@register(
    "response_time_p95",
    f"WITH {_LOG} SELECT backend, round(quantile_cont(elapsed, 0.95), 6) AS percentile FROM q GROUP BY backend",
)
def response_time_p95(t: Tables) -> DataFrame:
    rows = ql.response_time(query_log(t), 0.95, by=["backend"], exact=True)
    return rows.select("backend", F.round("percentile", 6).alias("percentile"))


@register(
    "speedup",
    f"""WITH {_LOG}, m AS (SELECT o_orderkey % 8 AS query, avg(elapsed) FILTER (backend = 'row') AS slow_time,
    avg(elapsed) FILTER (backend = 'column') AS fast_time FROM q GROUP BY 1)
    SELECT query, round(slow_time, 6) AS slow_time, round(fast_time, 6) AS fast_time,
    round(slow_time / fast_time, 6) AS speedup, slow_time > fast_time AS faster FROM m""",
)
def speedup(t: Tables) -> DataFrame:
    rows = ql.speedup(query_log(t), "row", "column")
    rounded = [F.round(c, 6).alias(c) for c in ("slow_time", "fast_time", "speedup")]
    return rows.select("query", *rounded, "faster")

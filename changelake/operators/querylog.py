"""Query logs: rule-based classification, hits, slow queries and engine comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SqlColumn, DataFrame, functions as F

from changelake.operators.audit import exact_percentile, percentile


@dataclass(frozen=True)
class Rule:
    rule_id: int
    pattern: str
    group: int
    label: str = ""


# Routing rules, matched without regard to case, lowest id first.
RULES = (
    Rule(100, r"^SELECT.*\b(COUNT|SUM|AVG|MIN|MAX|GROUP BY|HAVING)\b", 20, "analytic query"),
    Rule(101, r".*/\*\s*ANALYTICS\s*\*/.*", 20, "analytics hint"),
)
TRANSACTION_GROUP = 10

# Report labels of rule ids; any other id is shown as "Rule <id>".
RULE_LABELS = {
    1: "COUNT → ClickHouse",
    2: "SUM → ClickHouse",
    3: "AVG → ClickHouse",
    4: "MAX/MIN → ClickHouse",
    5: "GROUP BY → ClickHouse",
    100: "Analytics → ClickHouse",
    999: "Default → MySQL",
}


def _first_match(text: SqlColumn, rules: Sequence[Rule], pick) -> SqlColumn:
    ordered = sorted(rules, key=lambda r: r.rule_id)
    return F.coalesce(*[F.when(text.rlike("(?i)" + r.pattern), F.lit(pick(r))) for r in ordered])


def classify(log: DataFrame, text: str = "sql", rules: Sequence[Rule] = RULES, default_group: int = TRANSACTION_GROUP) -> DataFrame:
    """Adds ``rule_id`` (null if no rule matches) and ``target_group``; the first matching rule wins."""
    by_id = {r.rule_id: r.group for r in rules}
    group = F.lit(default_group)
    for rule_id, number in by_id.items():
        group = F.when(F.col("rule_id") == rule_id, F.lit(number)).otherwise(group)
    found = log.withColumn("rule_id", _first_match(F.col(text), rules, lambda r: r.rule_id))
    return found.withColumn("target_group", group)


def rule_label(rule_id: str = "rule_id", labels: dict[int, str] = RULE_LABELS) -> SqlColumn:
    rid = F.col(rule_id)
    out = F.concat(F.lit("Rule "), rid.cast("string"))
    for number, label in labels.items():
        out = F.when(rid == number, label).otherwise(out)
    return out


def rule_hits(log: DataFrame, text: str = "sql", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Hits per rule that was hit at all, by rule id."""
    hits = classify(log, text, rules).groupBy("rule_id").agg(F.count("rule_id").alias("hits"))
    return hits.filter("hits > 0").withColumn("description", rule_label()).orderBy("rule_id")


def recent_queries(log: DataFrame, n: int = 10, ts: str = "event_time", tie_break: Sequence[str] = ()) -> DataFrame:
    return log.orderBy(F.col(ts).desc(), *tie_break).limit(n)


def slow_queries(log: DataFrame, at_least: float, elapsed: str = "elapsed", ts: str = "event_time", since: str | SqlColumn | None = None) -> DataFrame:
    """Queries that took ``at_least`` so long, newest first; ``since`` drops older ones."""
    slow = F.col(elapsed) >= at_least
    if since is not None:
        slow = slow & (F.col(ts) >= (F.lit(since) if isinstance(since, str) else since))
    return log.filter(slow).orderBy(F.col(ts).desc(), F.col(elapsed).desc())


def response_time(log: DataFrame, p: float = 0.95, elapsed: str = "elapsed", by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    return (exact_percentile if exact else percentile)(log, elapsed, p, by)


def speedup(log: DataFrame, slow: str, fast: str, backend: str = "backend", elapsed: str = "elapsed", by: Sequence[str] = ("query",)) -> DataFrame:
    """Mean time per query on two engines, their ratio, and whether the second one is faster."""

    def mean(name: str) -> SqlColumn:
        return F.avg(F.when(F.col(backend) == name, F.col(elapsed)))

    times = log.groupBy(*by).agg(mean(slow).alias("slow_time"), mean(fast).alias("fast_time"))
    return times.select(
        *by,
        "slow_time",
        "fast_time",
        F.try_divide("slow_time", "fast_time").alias("speedup"),
        (F.col("slow_time") > F.col("fast_time")).alias("faster"),
    )

"""Source against replica: counts, fields, samples, progress and alert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as SqlColumn, DataFrame, functions as F

from changelake.functions import join_list, percent, truncated_close
from changelake.operators.audit import union_all
from changelake.operators.ranks import sampled_keys
from changelake.specs import TableSpec

# Fixed values: (rule, metric, threshold); a rule fires above its threshold.
ALERT_RULES = (
    ("lag alert", "lag", 1_000_000.0),
    ("memory alert", "memory_percent", 80.0),
    ("cpu alert", "cpu_percent", 200.0),
    ("scale on lag", "lag", 5_000_000.0),
    ("scale on query time", "query_seconds", 1.0),
    ("scale on memory", "memory_percent", 80.0),
    ("scale on growth", "growth_gb_per_day", 10.0),
)


Predicate = str | SqlColumn | dict[str, str | SqlColumn] | None


def side_counts(sources: dict[str, DataFrame], targets: dict[str, DataFrame], predicate: Predicate = None) -> DataFrame:
    """``(table_name, source_count, target_count)``; one aggregate per side and table.

    ``predicate`` limits the rows counted: one for all tables, or one per table name.
    """

    def counted(name: str, frame: DataFrame, side: str) -> DataFrame:
        condition = predicate.get(name) if isinstance(predicate, dict) else predicate
        if condition is not None:
            frame = frame.filter(condition)
        n = frame.agg(F.count("*").alias("n"))
        return n.select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n")

    frames = [counted(t, df, "source") for t, df in sources.items()]
    frames += [counted(t, df, "target") for t, df in targets.items()]
    n, side = F.col("n"), F.col("side")
    return (
        union_all(frames)
        .groupBy("table_name")
        .agg(
            F.sum(F.when(side == "source", n)).alias("source_count"),
            F.sum(F.when(side == "target", n)).alias("target_count"),
        )
    )


def count_check(sources: dict[str, DataFrame], targets: dict[str, DataFrame], predicate: Predicate = None) -> DataFrame:
    counts = side_counts(sources, targets, predicate)
    same = F.col("source_count").eqNullSafe(F.col("target_count"))
    return counts.withColumn("result", F.when(same, "PASS").otherwise("FAIL"))


def progress(sources: dict[str, DataFrame], targets: dict[str, DataFrame]) -> DataFrame:
    """Replicated percent per table, and whether the target has caught up."""
    done = (F.col("source_count") > 0) & (F.col("target_count") >= F.col("source_count"))
    return side_counts(sources, targets).select(
        "*", percent("target_count", "source_count").alias("percent"), done.alias("done")
    )


def clean_check(sources: dict[str, DataFrame], targets: dict[str, DataFrame], total: str = "TOTAL") -> DataFrame:
    """Rows left per table after a reset, and in all; clean means none on either side."""
    summed = (
        side_counts(sources, targets)
        .rollup("table_name")
        .agg(F.sum("source_count").alias("source_count"), F.sum("target_count").alias("target_count"))
    )
    clean = (F.col("source_count") == 0) & (F.col("target_count") == 0)
    return summed.select(
        F.coalesce("table_name", F.lit(total)).alias("table_name"), "source_count", "target_count", clean.alias("clean")
    )


def _compared(source: DataFrame, target: DataFrame, spec: TableSpec, fields: Sequence[str] | None) -> tuple[DataFrame, dict]:
    """Both sides next to each other, and the match condition of each field.

    Joined on the source key, which is unique on both sides.
    """
    pk = list(spec.source_pk)
    fields = list(fields or [n for n in spec.names if n not in pk])

    def side(frame: DataFrame, mark: str) -> DataFrame:
        types = dict(frame.dtypes)

        def text_or_value(name: str) -> SqlColumn:
            return join_list(name) if types[name].startswith("array") else F.col(name)

        return frame.select(*pk, F.lit(True).alias(f"{mark}_here"), *[text_or_value(n).alias(f"{mark}_{n}") for n in fields])

    both = side(source, "s").join(side(target, "t"), pk, "full_outer")
    here = F.col("s_here").isNotNull() & F.col("t_here").isNotNull()

    def same(name: str) -> SqlColumn:
        s, t = F.col(f"s_{name}"), F.col(f"t_{name}")
        if spec.column(name).kind in ("float32", "float64"):
            return truncated_close(s, t)
        return s.eqNullSafe(t)

    return both, {n: here & same(n) for n in fields}


def field_check(
    source: DataFrame,
    target: DataFrame,
    spec: TableSpec,
    fields: Sequence[str] | None = None,
    only_failures: bool = False,
) -> DataFrame:
    """One row per key and field: both values as text, and whether they match.

    Numbers with a fraction match to about 0.01, everything else exactly; lists are
    compared as joined text. A key missing on one side fails in every field.
    """
    both, ok = _compared(source, target, spec, fields)
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                F.col(f"s_{n}").cast("string").alias("source_value"),
                F.col(f"t_{n}").cast("string").alias("target_value"),
                match.alias("ok"),
            )
            for n, match in ok.items()
        ]
    )
    if only_failures:
        cells = F.filter(cells, lambda c: ~c["ok"])
    return both.select(*spec.source_pk, F.inline(cells))


def field_summary(
    source: DataFrame, target: DataFrame, spec: TableSpec, fields: Sequence[str] | None = None
) -> DataFrame:
    """Passed and failed keys per field; counted before the result is turned into rows."""
    both, ok = _compared(source, target, spec, fields)
    totals = both.agg(
        *[F.count_if(m).alias(f"p_{n}") for n, m in ok.items()], *[F.count_if(~m).alias(f"f_{n}") for n, m in ok.items()]
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(f"p_{n}").alias("passed"), F.col(f"f_{n}").alias("failed"))
            for n in ok
        ]
    )
    return totals.select(F.inline(cells))


def random_keys(rows: DataFrame, keys: Sequence[str], n: int, seed: int | None = None) -> DataFrame:
    """``n`` keys picked at random, of any number: the same ones every time, other ones with another ``seed``."""
    return sampled_keys(rows, keys, n, seed)


def sample_check(
    source: DataFrame, target: DataFrame, spec: TableSpec, n: int = 5, fields: Sequence[str] | None = None
) -> DataFrame:
    """Field check of ``n`` random source keys; adaptive execution broadcasts the keys if they turn out to be few."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    pk = list(spec.source_pk)
    picked = random_keys(source, pk, n)
    return field_check(source.join(picked, pk, "left_semi"), target.join(picked, pk, "left_semi"), spec, fields)


def pass_fail(checks: DataFrame, ok: str | SqlColumn = "ok") -> DataFrame:
    """Totals over any check output."""
    ok = F.col(ok) if isinstance(ok, str) else ok
    return checks.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed")).withColumn(
        "all_passed", F.col("failed") == 0
    )


def alerts(
    metrics: DataFrame, rules: Sequence[tuple[str, str, float]] = ALERT_RULES, metric: str = "metric", value: str = "value"
) -> DataFrame:
    """Metric rows with every rule they break. Rules are literals, so nothing is joined."""
    table = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(m).alias("of"), F.lit(float(t)).alias("threshold")) for r, m, t in rules]
    )
    broken = F.filter(table, lambda r: (r["of"] == F.col(metric)) & (F.col(value) > r["threshold"]))
    return metrics.select("*", F.inline(broken)).drop("of")

"""Periods in which a metric breaks a rule, and growth per day, over series of samples.

Samples are ordered within days only. What leads from one day to the next goes through a table with one row per series and
day, so no task orders the whole history of a metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from changelake.operators.reconcile import ALERT_RULES


def alert_periods(
    samples: DataFrame,
    rules: Sequence[tuple[str, str, float]] = ALERT_RULES,
    by: Sequence[str] = ("topic",),
    at: str = "sampled_at",
    metric: str = "metric",
    value: str = "value",
) -> DataFrame:
    """Each stretch of consecutive samples of a series above a rule's threshold, as one row.

    A series is one metric of one group of ``by``; groups and metrics may be null, though no rule applies to a null metric. Returns
    ``by``, the metric, rule, threshold, started_at and ended_at (first and last sample above the threshold), peak and
    samples. A null value is not above anything and ends a period, as does a sample at the threshold. Samples of one
    moment are ordered by their value. An empty series has no periods. Rules are literals, nothing is joined for them.
    """
    literal = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(m).alias("_of"), F.lit(float(t)).alias("threshold")) for r, m, t in rules])
    own = F.filter(literal, lambda r: r["_of"] == F.col(metric))
    series = [*by, metric, "rule"]
    place = F.struct(at, value)
    within = Window.partitionBy(*series, "_day").orderBy(at, value)
    rows = samples.select(*by, metric, F.col(at), F.col(value), F.inline(own)).drop("_of")
    rows = rows.withColumns({"_day": F.to_date(at), "_broken": F.coalesce(F.col(value) > F.col("threshold"), F.lit(False))})
    rows = rows.withColumn("_before", F.lag("_broken").over(within))
    # the first sample of a day has nothing before it here; the day's row knows better
    rows = rows.withColumn("_opens", F.when(~F.col("_before") & F.col("_broken"), F.col(at)))
    rows = rows.withColumn("_inner", F.last("_opens", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))

    days = rows.groupBy(*series, "_day").agg(
        F.min_by("_broken", place).alias("_first"), F.min(at).alias("_first_at"), F.max_by("_broken", place).alias("_last"), F.max("_opens").alias("_opened")
    )
    across = Window.partitionBy(*series).orderBy("_day")
    start = F.when(F.col("_first") & ~F.coalesce(F.lag("_last").over(across), F.lit(False)), F.col("_first_at"))
    days = days.withColumn("_start", start)
    newest = F.coalesce("_opened", "_start")
    earlier = F.last(newest, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    keys = [*series, "_day"]
    days = days.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.coalesce("_start", earlier).alias("_from"))

    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys])
    broken = rows.filter("_broken").join(days, same)
    return broken.groupBy(*series, "threshold", F.coalesce("_inner", "_from").alias("started_at")).agg(
        F.max(at).alias("ended_at"), F.max(value).alias("peak"), F.count("*").alias("samples")
    )


def growth_per_day(samples: DataFrame, by: Sequence[str] = ("topic",), at: str = "sampled_at", value: str = "records") -> DataFrame:
    """Last value of each group and day, and how much it grew per day since the last day with samples.

    Returns ``by``, day, the value and ``per_day``, which is null for a group's first day. Days are aggregated before they are
    ordered: one row per group and day. Of samples of one moment the largest value counts; null values are left out.
    """
    days = samples.where(F.col(value).isNotNull()).groupBy(*by, F.to_date(at).alias("day")).agg(F.max_by(value, F.struct(at, value)).alias(value))
    order = Window.partitionBy(*by).orderBy("day")
    grown = (F.col(value) - F.lag(value).over(order)).cast("double")
    return days.withColumn("per_day", grown / F.date_diff("day", F.lag("day").over(order)))

"""Ranks, exact quantiles and samples of any size, without gathering a group in one task.

Mechanisms:

- ``ranked``: rows are cut into ranges of the sort key; a row's rank is its place in its range plus the totals of the
  ranges before it, of which there is one row per range and group.
- ``quantile``: a sketch brackets the wanted rank, a second sketch of the bracket's rows brackets it again, and only what
  is left is put in order.
- ``cut_off``: the value at a rank of a hash is found by descending a histogram of its leading digits.

``carried`` uses the ranges of the first for the last value before each row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from changelake.operators.skew import copied, salted
from changelake.session import written

#: Hex digits of the hash that one round of ``cut_off`` tells apart, and rounds.
DIGITS, ROUNDS = 3, 4


def ranked(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rows with their rank (from 0) within their group, in ascending order with nulls first.

    The rows are written once in range order, to the shared scratch folder, so that the ranks of a second pass belong to the rows of the
    first even if executors are lost in between. No window runs over rows: the only ordered step is over one
    row per range and group. A hot group is cut into as many ranges as its size asks for. Ties of the whole order are
    broken by a hash of the row; rows that are equal in every column have any order among themselves and share a range.
    An empty table stays empty; other columns come back unchanged unless they are called ``name``.
    """
    mine = _fresh(rows.columns, "at", "piece", "first", "before", "tie")
    at, piece, first, before, tie = mine
    keys = [f"k{i}_{at}" for i in range(len(by))]
    by_range = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *order]] + [F.col(tie).asc()]
    arranged = (
        rows.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
        .repartitionByRange(*by_range)
        .sortWithinPartitions(*by_range)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    kept = written(arranged, "ranked").withColumn(piece, F.shiftright(at, 33))
    pieces = kept.groupBy(piece, *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]).agg(
        F.min(at).alias(first), F.count("*").alias(before)
    )
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.select(F.col(piece).alias(f"{piece}_t"), *keys, first, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    match = [F.col(piece) == F.col(f"{piece}_t")] + [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    joined = kept.join(totals, reduce(lambda a, b: a & b, match))
    rank = (F.col(at) - F.col(first) + F.col(before)).alias(name)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], rank)


def _fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names that no column has: the wanted ones, with as many underscores in front as it takes."""
    low = {c.lower() for c in taken}
    mark = "_"
    while any(f"{mark}{w}" in low for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def quantile(rows: DataFrame, value: str, p: float, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Interpolated quantile per group, exact: ``by`` columns and ``quantile``. Null values do not count.

    A sketch of fixed size brackets the wanted rank to within ``n / accuracy``; a second sketch, of the rows inside that
    bracket only, brackets it to within ``16 n / accuracy ** 2`` rows. Those are counted per distinct value and ordered: of a
    group of 10 ** 12 rows at most 160,000 values. Nothing depends on how the values are spread, no job is run to decide
    anything, and a hot group is dealt over salts wherever its rows meet the brackets. The plan is the same at every size.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    groups = [f"_g{i}" for i in range(len(by))] or ["_all"]
    own = [F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)] or [F.lit(0).alias("_all")]
    rows = rows.filter(F.col(value).isNotNull()).select(*own, F.col(value).cast("double").alias("_v"))
    place = F.lit(p) * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)  # the ranks, from 0, of the two values to interpolate between

    def bracketed(frame: DataFrame, bounds: DataFrame, carried: Sequence[str]) -> DataFrame:
        """Rows with their group's bounds; a group's rows are dealt over salts and its one row of bounds copied to each."""
        named = bounds.select(*[F.col(g).alias(f"{g}b") for g in groups], *carried)
        dealt, copies = salted(frame, ["_v"]), copied(named).withColumnRenamed("_salt", "_salt_b")
        match = [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in groups] + [F.col("_salt") == F.col("_salt_b")]
        return dealt.join(copies, reduce(lambda a, b: a & b, match)).select(*frame.columns, *carried)

    def ends(first: Column, last: Column, n: Column, slack: float) -> list[Column]:
        """Bounds below and above the ranks first..last of n rows, from a sketch that may be off by slack * n either way."""
        share = lambda rank, by_: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rank + by_) / n))
        return [share(first, -slack * n), share(last + 1, slack * n)]

    # First sketch: all rows of a group; the shares asked for do not depend on its size but for rounding, which the slack covers.
    slack = 2.0 / accuracy
    asked = F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack)))
    whole = rows.groupBy(*groups).agg(
        F.percentile_approx("_v", asked, F.lit(accuracy)).alias("_ends"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_n")
    )
    tight = F.col("_n") < 10 * accuracy  # ranks of so few rows may round beyond the slack
    bounds = whole.select(
        *groups,
        F.when(tight | F.lit(p <= slack), F.col("_min")).otherwise(F.col("_ends")[0]).alias("_low"),
        F.when(tight | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_ends")[1]).alias("_high"),
        "_n",
    )
    inside = bracketed(rows, bounds, ["_low", "_high", "_n"]).filter("_v <= _high")
    # Second sketch: rows inside the bracket. Its shares depend on how many rows lie below, so many are asked for and the nearest taken.
    steps = 200
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    within = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))
    counted = inside.groupBy(*groups).agg(
        F.max("_n").alias("_n"),
        F.count_if(F.col("_v") < F.col("_low")).alias("_below"),
        F.count(within).alias("_m"),
        F.percentile_approx(within, grid, F.lit(accuracy)).alias("_grid"),
        F.min(within).alias("_min"),
        F.max(within).alias("_max"),
    )
    share = lambda rank: (rank - F.col("_below")) / F.col("_m")
    few = F.col("_m") < 10 * accuracy
    under = F.floor((share(low) - slack) * steps).cast("int") - 1
    over = F.ceil((share(high + 1) + slack) * steps).cast("int") + 1
    narrow = counted.select(
        *groups,
        F.when(few | (under < 0), F.col("_min")).otherwise(F.get("_grid", under)).alias("_low"),
        F.when(few | (over > steps), F.col("_max")).otherwise(F.get("_grid", over)).alias("_high"),
        "_n",
    )
    left = bracketed(rows, narrow, ["_low", "_high", "_n"]).filter("_v <= _high")
    kept = F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")  # null: all that lies below, as one count
    values = left.groupBy(*groups, kept, "_n").agg(F.count("*").alias("_c"))
    listed = values.groupBy(*groups).agg(
        F.max("_n").alias("_n"),
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_under"),
        F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "_c")))).alias("_list"),
    )
    none = F.lit(None).cast("double")
    at = lambda found, upto, rank, v: F.when(found.isNull() & (upto > rank), v).otherwise(found)

    def step(s: Column, x: Column) -> Column:
        upto = s["upto"] + x["_c"]
        return F.struct(upto.alias("upto"), at(s["a"], upto, low, x["_v"]).alias("a"), at(s["b"], upto, high, x["_v"]).alias("b"))

    start = F.struct(F.col("_under").alias("upto"), none.alias("a"), none.alias("b"))
    picked = listed.select(*groups, F.aggregate("_list", start, step).alias("_at"), (place - low).alias("_part")).select(
        *groups, F.col("_at.a").alias("_a"), F.col("_at.b").alias("_b"), "_part"
    )
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    # both ends equal: no arithmetic, which would turn infinite values into NaN
    result = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(exact).alias("quantile")
    return picked.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], result)


def cut_off(hashes: DataFrame, hash_col: str, n: int) -> DataFrame:
    """Where the ``n`` smallest of a column of hashes in hex end: one row ``(cut, rest)``, or none if there are fewer than ``n``.

    All hashes whose 12 leading digits are below ``cut`` belong to the ``n`` smallest, and ``rest`` of those that start with
    these digits. Each round counts, in fixed space, the hashes per value of the next 3 digits under the prefix found so far;
    counts are combined before the shuffle, so a round moves at most 4,096 of them a task. Rows are never sorted.
    """
    found = None
    for i in range(ROUNDS):
        digits = hashes.select(F.substring(hash_col, 1, DIGITS * (i + 1)).alias("_code"))
        if found is None:
            coded = digits.withColumns({"_prefix": F.lit(""), "_wanted": F.lit(n).cast("bigint")})
        else:  # one row, as it comes out of a group of one value
            named = found.select(F.col("cut").alias("_prefix"), F.col("rest").alias("_wanted"))
            coded = digits.withColumn("_prefix", F.substring("_code", 1, DIGITS * i)).join(F.broadcast(named), "_prefix")
        counts = coded.groupBy("_prefix", "_wanted", "_code").agg(F.count("*").alias("_c"))
        listed = counts.groupBy("_prefix", "_wanted").agg(F.array_sort(F.collect_list(F.struct("_code", "_c"))).alias("_list"))
        none = F.lit(None).cast("string")

        def step(s: Column, x: Column) -> Column:
            here = F.struct(x["_code"].alias("cut"), s["rest"].alias("rest"))
            beyond = F.struct(none.alias("cut"), (s["rest"] - x["_c"]).alias("rest"))
            return F.when(s["cut"].isNotNull(), s).when(x["_c"] >= s["rest"], here).otherwise(beyond)

        at = F.aggregate("_list", F.struct(none.alias("cut"), F.col("_wanted").alias("rest")), step)
        found = listed.select(at.alias("_at")).select("_at.cut", "_at.rest").where("cut IS NOT NULL")
    return found


def key_hash(keys: Sequence[str], seed: int | None = None) -> Column:
    """MD5 of the keys as text, in hex: the same in every engine that has MD5. Null keys count as \\N."""
    text = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws("\u001f", *text, *([F.lit(str(seed))] if seed is not None else [])))


def sampled_keys(rows: DataFrame, keys: Sequence[str], n: int, seed: int | None = None) -> DataFrame:
    """``n`` keys picked at random, the same ones on every run with the same ``seed``; all keys if there are no more.

    The keys of smallest hash are taken: those below a cut-off by a filter, where they lie, and from those that share its
    12 leading digits as many as are missing, in order of hash and keys. No rows are sorted but those few. A key that stands on
    several rows counts as often.
    """
    if n < 0:
        raise ValueError("sample size must not be negative")
    if n == 0:
        return rows.select(*keys).limit(0)
    hashed = rows.select(*keys, key_hash(keys, seed).alias("_hash"))
    cut = cut_off(hashed, "_hash", n)
    coded = hashed.withColumn("_code", F.substring("_hash", 1, DIGITS * ROUNDS))
    # one row at most; without one there are fewer than n keys, and all are below
    limit = cut.select("cut").scalar()
    below = coded.where(F.coalesce(F.col("_code") < limit, F.lit(True))).select(*keys)
    named = cut.select(F.col("cut").alias("_code"), "rest")
    tied = coded.join(F.broadcast(named), "_code").groupBy("_code", "rest", "_hash", *keys).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_code").orderBy("_hash", *keys).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("_c"), F.col("rest") - F.coalesce(F.sum("_c").over(before), F.lit(0)))
    copies = tied.withColumn("_take", taken).where("_take > 0")
    return below.unionAll(copies.select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), "_take")).alias("_i")).select(*keys))


def carried(rows: DataFrame, value: Column, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Rows with the last non-null ``value`` up to and including their own, in ascending order within their group.

    Rows are written once in range order, as ``ranked`` does; a window looks back within each range, and what a range leaves
    to the next ones of its group goes through one row per range and group. So a group is never in one task, however long it is.
    Ties of the order are broken by a hash of the row.
    """
    at, piece, own, last, tie = _fresh([*rows.columns, name], "at", "piece", "own", "last", "tie")
    keys = [f"k{i}_{at}" for i in range(len(by))]
    rows = rows.withColumn(own, value)
    by_range = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *order]] + [F.col(tie).asc()]
    arranged = (
        rows.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
        .repartitionByRange(*by_range)
        .sortWithinPartitions(*by_range)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    kept = written(arranged, "carried").withColumn(piece, F.shiftright(at, 33))
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    ends = kept.groupBy(piece, *named).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col(at))).alias(last))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select(F.col(piece).alias(f"{piece}_t"), *keys, F.last(last, ignorenulls=True).over(earlier).alias(last))
    match = [F.col(piece) == F.col(f"{piece}_t")] + [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    joined = kept.join(left, reduce(lambda a, b: a & b, match))
    back = Window.partitionBy(piece, *[F.col(f"`{c}`") for c in by]).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(own, ignorenulls=True).over(back), F.col(last)).alias(name)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (name, own)], found)

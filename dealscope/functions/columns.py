"""Column expressions with the semantics of the data model: nulls, day differences, periods, robust statistics."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """A comparison that is False, not null, for missing input."""
    return F.coalesce(cond, F.lit(False))


def any_flag(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def days(later, earlier) -> Column:
    """Floored difference of timestamps in days."""
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000))


def quarter(c) -> Column:
    """``2024Q2``; a missing date is the level ``NaT``."""
    return F.coalesce(F.date_format(c, "yyyy'Q'q"), F.lit("NaT"))


def period_end(c, granularity: str) -> Column:
    """Last day of the month, quarter or year."""
    c = F.col(c) if isinstance(c, str) else c
    months = {"month": 0, "quarter": 2, "year": 11}[granularity]
    return F.last_day(F.add_months(F.trunc(c, granularity), months))


def skew_corrected(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_corrected(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def quantile(c, q: float) -> Column:
    """Exact with linear interpolation, for groups of moderate size; ``quantile_row`` is for whole tables."""
    return F.percentile(c, F.lit(q))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder (a temporary one only where none is set)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


#: rank error of the sketch that brackets a quantile is at most 1 / SKETCH of the rows
SKETCH = 10_000


def quantile_row(df: DataFrame, wanted: dict, narrow: bool = False) -> DataFrame:
    """One row of exact quantiles with linear interpolation: alias -> (column name or expression, q).

    One scan sketches every column and brackets each quantile surely; a second counts what lies below a bracket and keeps the values inside it, about
    four rows in SKETCH, which are counted and ranked. Nothing else is shuffled. The columns are stored first, unless ``narrow`` says that reading them twice is cheap.
    Jobs run while the plan is built.
    """
    sources = {}
    for c, _ in wanted.values():
        sources.setdefault(str(c), F.col(c) if isinstance(c, str) else c)
    names = {k: f"v{i}" for i, k in enumerate(sources)}
    values = df.select(*(v.cast("double").alias(names[k]) for k, v in sources.items()))
    values = values if narrow else cut(values)
    asked = {n: sorted({q for c, q in wanted.values() if names[str(c)] == n}) for n in names.values()}
    off = 2 / SKETCH
    ends = lambda qs: F.array(*(F.lit(float(min(max(q + d, 0.0), 1.0))) for q in qs for d in (-off, off)))
    one = values.agg(*(x for n, qs in asked.items() for x in (F.count(n).alias(f"{n}_n"), F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), F.percentile_approx(n, ends(qs), SKETCH).alias(f"{n}_q")))).first()
    brackets, ranks = [], {}
    for n, qs in asked.items():
        for i, q in enumerate(qs):
            if one[f"{n}_n"]:
                at = q * (one[f"{n}_n"] - 1)
                lo, hi = one[f"{n}_q"][2 * i : 2 * i + 2]
                few = one[f"{n}_n"] < 4 * SKETCH  # brackets narrower than the step between ranks: take all
                brackets.append((n, q, one[f"{n}_min"] if few or q <= off else lo, one[f"{n}_max"] if few or q >= 1 - off else hi))
                ranks[n, q] = at
    spark, found = df.sparkSession, {}
    if brackets:
        below = values.agg(*(F.count(F.when(F.col(n) < F.lit(lo), 1)).alias(f"b{i}") for i, (n, _, lo, _) in enumerate(brackets))).first()
        cells = F.array(*(F.when(F.col(n).between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("i"), F.col(n).alias("v"))) for i, (n, _, lo, hi) in enumerate(brackets)))
        inside = values.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("c.i", "c.v").groupBy("i", "v").agg(F.count("*").alias("n"))
        ran = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
        targets = [(i, r, r - below[f"b{i}"]) for i, (n, q, _, _) in enumerate(brackets) for r in {math.floor(ranks[n, q]), math.ceil(ranks[n, q])}]
        hit = ran.join(F.broadcast(spark.createDataFrame(targets, "i int, rank long, place long")), "i").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        found = {(*brackets[r["i"]][:2], r["rank"]): r["v"] for r in hit.select("i", "rank", "v").collect()}  # two for each quantile
    row = []
    for c, q in wanted.values():
        n = names[str(c)]
        if (n, q) not in ranks:
            row.append(None)
            continue
        at = ranks[n, q]
        lo, hi = found[n, q, math.floor(at)], found[n, q, math.ceil(at)]
        row.append(float(lo + (hi - lo) * (at - math.floor(at))))
    return spark.createDataFrame([tuple(row)], ", ".join(f"`{a}` double" for a in wanted))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], ascending: bool = True) -> DataFrame:
    """``df`` with running totals (alias -> column) in the order of a column without repeated values.

    Rows are dealt by range and stored (a job while the plan is built, like ``quantile_row``); one row of totals per partition tells what stands
    before it, and a window adds up inside a partition only. No task holds more than its range.
    """
    by = F.col(order).asc() if ascending else F.col(order).desc()
    dealt = cut(df.repartitionByRange(by).select("*", F.spark_partition_id().alias("_part")))
    before, offsets = [0] * len(sums), []
    for r in dealt.groupBy("_part").agg(*(F.sum(c).alias(a) for a, c in sums.items())).orderBy("_part").collect():  # one row per partition
        offsets.append((r["_part"], *before))
        before = [b + (r[a] or 0) for b, a in zip(before, sums)]
    kinds = dict(dealt.agg(*(F.sum(c).alias(a) for a, c in sums.items())).dtypes)
    known = df.sparkSession.createDataFrame(offsets, ", ".join(["_part int", *(f"`_{a}` {kinds[a]}" for a in sums)]))
    w = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.join(F.broadcast(known), "_part").withColumns({a: F.col(f"_{a}") + F.sum(c).over(w) for a, c in sums.items()})
    return run.drop("_part", *(f"_{a}" for a in sums))


def wide_to_long(df: DataFrame, columns: list[str], stats: dict, key: str = "variable") -> DataFrame:
    """One aggregate over all columns in one scan, then one row per column."""
    wide = df.agg(*(f(c).alias(f"{c}__{s}") for c in columns for s, f in stats.items()))
    rows = F.array(*(F.struct(F.lit(c).alias(key), *(F.col(f"{c}__{s}").alias(s) for s in stats)) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def level_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, level) for every cell; null stays a level."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns))).alias("r")).select("r.*")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

"""Scalable exact order statistics without single-task windows.

``group_positions`` numbers rows inside groups (like ``row_number() - 1``)
but range-partitions the data first, so no task ever holds a whole group:
each range partition is sorted locally, rows get a local index from
``monotonically_increasing_id`` and a small (group, partition) offset table
turns local indices into group positions.

``exact_quantiles`` works on a value histogram (``groupBy(value).count``,
partially aggregated map-side), numbers the distinct values the same way
and interpolates linearly (numpy's default), so hot values cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.session import cut_lineage


def group_positions(df: DataFrame, by: list[str], order: list, out: str = "pos",
                    weight: str | None = None, sums: dict | None = None,
                    n_parts: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within ``by`` ordered by ``order``.

    ``order`` must make rows unique inside a group (add a key as tie-break).
    With ``weight`` the position is the exclusive running sum of that column
    instead of a row count; ``sums`` (name -> Column) adds further exclusive
    running sums in the same pass.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(b) for b in by] + order_cols
    acc = {out: F.col(weight).cast("double") if weight else F.lit(1).cast("long")}
    acc.update(sums or {})
    # without an explicit count AQE may merge adjacent ranges; merged
    # partitions stay contiguous and ordered, which is all the offsets need
    s = (df.repartitionByRange(n_parts, *keys) if n_parts else df.repartitionByRange(*keys)) \
        .sortWithinPartitions(*keys)
    s = s.select("*", *[e.alias(f"_w_{n}") for n, e in acc.items()],
                 F.monotonically_increasing_id().alias("_mid"))
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    # Both the offset table and the local sums must see the very same range
    # partitions and ids: a reliable checkpoint fixes them once (the range
    # bounds come from sampling, and a second evaluation could differ).
    s = cut_lineage(s)
    # Offsets: totals of every earlier range partition of the same group
    # (a table of groups x partitions rows).
    part = s.groupBy(*by, "_pid").agg(*[F.sum(f"_w_{n}").alias(f"_p_{n}") for n in acc])
    prev = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = part.select(*by, "_pid", *[F.coalesce(F.sum(f"_p_{n}").over(prev), F.lit(0)).alias(f"_o_{n}")
                                     for n in acc])
    # Exclusive running sums inside each (group, range partition); such a
    # slice is never larger than one range partition.
    local = Window.partitionBy(*by, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", *[F.coalesce(F.sum(f"_w_{n}").over(local), F.lit(0)).alias(f"_l_{n}") for n in acc])
    # null-safe: a group whose key is NULL keeps its rows
    off = off.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_pid").alias("_b__pid"),
                     *[f"_o_{n}" for n in acc])
    s = s.join(off, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by] + [F.col("_pid") == F.col("_b__pid")]) \
        .drop(*[f"_b_{c}" for c in by], "_b__pid")
    s = s.select("*", *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in acc if n != out],
                 (F.col(f"_o_{out}") + F.col(f"_l_{out}")).alias(out))
    tmp = [c for c in s.columns if c.startswith(("_w_", "_p_", "_o_", "_l_"))] + ["_mid", "_pid"]
    return s.drop(*tmp)


def histogram_quantiles(hist: DataFrame, value: str, count: str, probs: dict[str, float],
                        by: list[str] | None = None, extra: dict | None = None) -> DataFrame:
    """Linear-interpolated quantiles from a ``(by..., value, count)`` histogram.

    Returns one row per group with one column per entry of ``probs``
    (name -> probability), matching ``numpy.percentile(..., 'linear')``;
    ``extra`` (name -> aggregate Column over the histogram rows) is computed
    in the same final aggregate.
    """
    if not by:
        return histogram_quantiles(hist.withColumn("_g", F.lit(0)), value, count, probs,
                                   ["_g"], extra).drop("_g")
    h = group_positions(hist, by, [value], out="_start", weight=count)
    h = h.withColumn("_end", F.col("_start") + F.col(count))  # rows [start, end)
    n = h.groupBy(*by).agg(F.sum(count).alias("_n"))
    h = h.join(n, by)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(pos)
        frac = pos - lo
        hi = F.least(lo + 1, F.col("_n") - 1)
        x_lo = F.min(F.when((F.col("_start") <= lo) & (lo < F.col("_end")), F.col(value)))
        x_hi = F.min(F.when((F.col("_start") <= hi) & (hi < F.col("_end")), F.col(value)))
        f = F.max(frac)
        aggs.append((x_lo + (x_hi - x_lo) * f).alias(name))
    aggs += [e.alias(n) for n, e in (extra or {}).items()]  # further aggregates in the same pass
    return h.groupBy(*by).agg(*aggs)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    by: list[str] | None = None) -> DataFrame:
    by = by or []
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return histogram_quantiles(hist, value, "_c", probs, by)


def upper_median(df: DataFrame, value: str, by: list[str] | None = None, out: str = "median") -> DataFrame:
    """Element ``floor(n/2)`` of the ascending values (the reference's median of counts)."""
    if not by:
        return upper_median(df.withColumn("_g", F.lit(0)), value, ["_g"], out).drop("_g")
    hist = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    h = group_positions(hist, by, [value], out="_start", weight="_c")
    h = h.withColumn("_end", F.col("_start") + F.col("_c"))
    n = h.groupBy(*by).agg(F.sum("_c").alias("_n"))
    h = h.join(n, by)
    mid = F.floor(F.col("_n") / 2)
    return h.groupBy(*by).agg(F.min(F.when((F.col("_start") <= mid) & (mid < F.col("_end")),
                                           F.col(value))).alias(out))

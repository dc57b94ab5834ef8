"""Global ordering without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. The
operators here rank through a range-partitioned sort instead:

1. ``orderBy`` (range exchange + per-partition sort; ranging on the key *and*
   a unique tie-break, so a value shared by a third of the rows still spreads
   over many partitions);
2. ``monotonically_increasing_id`` right after the sort: partition index in
   the upper bits, position within the partition in the lower 33 bits;
3. reliable ``checkpoint`` so the partition layout that is counted is the
   one that is numbered (the checkpoint folder is the session's shared one);
4. per-partition counts (one row per partition, a proven bound) -> running
   offsets -> broadcast back -> rank = offset + position + 1.

From the rank: NTILE, exact quantiles with linear interpolation, qcut bins,
average ranks and cumulative curves, all exact, all distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import resolve_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (lineage cut,
    survives executor loss)."""
    resolve_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                count_col: str | None = None, materialize_input: bool = False) -> DataFrame:
    """Append ``rank_col`` = 1-based row number in the global ``order``.

    ``order`` must be a total order (end it with a unique key). With
    ``count_col`` the total row count is attached as well. The range
    exchange evaluates its input twice (sampling for the bounds, then the
    shuffle); ``materialize_input`` checkpoints an expensive input first so
    both read the stored rows.
    """
    if materialize_input:
        df = checkpoint(df)
    tagged = checkpoint(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum is over a bounded, tiny frame.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    out = (tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
           .withColumn(rank_col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1))
    if count_col:
        out = out.withColumnRenamed("_total", count_col)
    return out.drop("_mid", "_pid", "_off", "_total")


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """SQL NTILE(k) from a 1-based rank and the row count: with q = n div k and
    m = n mod k the first m buckets hold q + 1 rows, the rest q."""
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    return (F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1)
            .otherwise(m + F.floor((rank - 1 - big) / F.when(q > 0, q)) + 1)).cast("int")


def ntile(df: DataFrame, k: int, order: Sequence[Column], out_col: str) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY order)`` computed with :func:`global_rank`."""
    ranked = global_rank(df, order, "_r", count_col="_n")
    return ranked.withColumn(out_col, ntile_from_rank(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")


def quantile_edges(df: DataFrame, value: str, probs: Sequence[float], order_tiebreak: Sequence[str] = (),
                   ranked: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default,
    DuckDB ``quantile_cont``) as a 1-row frame with an ascending ``edges`` array.

    Only the at most 2 x len(probs) rows at the needed ranks leave the
    ranked frame; nothing is collected.
    """
    spark = df.sparkSession
    if ranked is None:
        order = [F.col(value).asc_nulls_last()] + [F.col(c) for c in order_tiebreak]
        ranked = global_rank(df.where(F.col(value).isNotNull()), order, "_r", count_col="_n")
    n = ranked.agg(F.max("_n").alias("_n"))
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(probs)], "i int, p double")
    pos = (p.crossJoin(F.broadcast(n))
           .select("i", (F.col("p") * (F.col("_n") - 1)).alias("_pos"))
           .select("i", (F.floor("_pos") + 1).alias("_lo"), (F.floor("_pos") + 2).alias("_hi"),
                   (F.col("_pos") - F.floor("_pos")).alias("_frac")))
    vals = ranked.select(F.col("_r"), F.col(value).cast("double").alias("_v"))
    lo = vals.withColumnRenamed("_r", "_lo").withColumnRenamed("_v", "_vlo")
    hi = vals.withColumnRenamed("_r", "_hi").withColumnRenamed("_v", "_vhi")
    # ``pos`` has len(probs) rows: a proven bound, broadcast it.
    edges = (F.broadcast(pos).join(lo, "_lo").join(hi, "_hi", "left")
             .select("i", (F.col("_vlo") + F.col("_frac") * (F.coalesce("_vhi", "_vlo") - F.col("_vlo")))
                     .alias("edge")))
    return edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge"))),
                                 lambda s: s["edge"]).alias("edges"))


def qcut_bin(x: Column, edges: Column) -> Column:
    """0-based bin of ``x`` against interior ``edges``, right-closed, lowest
    value included: the number of edges strictly below ``x``. Duplicate edges
    leave empty bins instead of failing."""
    return F.size(F.filter(edges, lambda e: e < x)).cast("int")


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                      tiebreak: Sequence[str] = ()) -> DataFrame:
    """Exact per-group quantiles (linear interpolation), long form:
    ``by..., i, p, q``.

    One global rank over (by, value, tie-break); each group's rows are a
    contiguous rank range, so the quantile rows are found by rank arithmetic.
    No group is gathered into one task, whatever its size; the positions
    frame has len(groups) x len(probs) rows and is broadcast.
    """
    spark = df.sparkSession
    order = [F.col(c) for c in by] + [F.col(value).asc()] + [F.col(c) for c in tiebreak]
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(*by, *tiebreak, value), order, "_r",
                         materialize_input=True)
    stats = ranked.groupBy(*by).agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(probs)], "i int, p double")
    pos = (stats.crossJoin(F.broadcast(p))
           .select(*by, "i", "p", (F.col("p") * (F.col("_n") - 1)).alias("_pos"), "_r0")
           .select(*by, "i", "p", (F.col("_r0") + F.floor("_pos")).alias("_lo"),
                   (F.col("_pos") - F.floor("_pos")).alias("_frac")))
    vals = ranked.select("_r", F.col(value).cast("double").alias("_v"))
    lo = vals.withColumnRenamed("_r", "_lo").withColumnRenamed("_v", "_vlo")
    hi = vals.select((F.col("_r") - 1).alias("_lo"), F.col("_v").alias("_vhi"))
    q = (F.broadcast(pos).join(lo, "_lo").join(hi, "_lo", "left")
         .select(*by, "i", "p",
                 F.when(F.col("_frac") == 0, F.col("_vlo"))
                 .otherwise(F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("q")))
    return q


def rank_sum(df: DataFrame, value: str, is_first: Column, tiebreak: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum of average ranks (ties share the mean rank) of the rows where
    ``is_first`` holds, in the ranking of all rows by ``value``: the core of
    the Mann-Whitney U statistic and of the exact ROC-AUC.

    Returns one row (per group of ``by``): ``rank_sum``, ``n1``, ``n2`` and
    ``tie_term`` (Σ t³ - t over tie groups, for the variance correction). All
    groups share one global order; a group is a run of ranks in it, so its own
    ranks are the global ones less those before its first row.
    """
    base = df.select(*by, F.col(value).alias("_x"), is_first.cast("int").alias("_g"), *tiebreak)
    ranked = global_rank(base, [*[F.col(c) for c in by], F.col("_x").asc(), *[F.col(c) for c in tiebreak]], "_r",
                         materialize_input=True)
    per_value = ranked.groupBy(*by, "_x").agg(F.min("_r").alias("_rmin"), F.count(F.lit(1)).alias("_t"),
                                              F.sum("_g").alias("_t1"))
    avg_rank = F.col("_rmin") + (F.col("_t") - 1) / 2.0
    return per_value.groupBy(*by).agg(
        (F.sum(avg_rank * F.col("_t1")) - (F.min("_rmin") - 1) * F.sum("_t1")).alias("rank_sum"),
        F.sum("_t1").alias("n1"), (F.sum("_t") - F.sum("_t1")).alias("n2"),
        F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("tie_term"))


def global_cumsum(df: DataFrame, order: Sequence[Column], cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Running sums of ``cols`` along a global order (inclusive), without a
    single-partition window: per-partition totals become broadcast offsets
    and each range partition is summed on its own."""
    tagged = checkpoint(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
                        .withColumn("_pid", F.shiftright(F.col("_mid"), 33)))
    totals = tagged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                      for c in cols])
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offsets), "_pid")
    for c in cols:
        out = out.withColumn(prefix + c, F.col(f"_o_{c}") + F.sum(c).over(within))
    return out.drop("_mid", "_pid", *[f"_o_{c}" for c in cols])

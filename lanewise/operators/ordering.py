"""Global ordering without a single-task window.

Rows are range-partitioned on the full ordering key, so ties on a hot score are
split by the tie-breaker, and written once to the shared folder: block numbers
stay the same when a task is rerun. Per-block totals (one row per block
and group) carry the running offsets.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import col
from ..session import shared_path, shuffle_partitions

BLOCK = "_block"
BLOCK_ROWS, SMALL_ROWS = 2_000_000, 200


def ordered_blocks(df: DataFrame, order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """Copy of ``df`` in the shared folder with a block number that grows with ``order``.

    The rows are held while they are counted and the ranges sampled (lost parts are computed again), and written once, with their blocks,
    which thus stay the same for all readers. A block holds about ``rows`` (BLOCK_ROWS) rows at most, whatever the volume, and small inputs are
    not cut finer than SMALL_ROWS.
    """
    spark, level = df.sparkSession, df.storageLevel
    held = level.useMemory or level.useDisk
    path = shared_path(spark, "ordered")
    if not held:
        df.persist()
    try:
        n = df.count()
        blocks = max(1, -(-n // (rows or BLOCK_ROWS)), min(shuffle_partitions(spark), -(-n // SMALL_ROWS)))
        placed = df.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id())
        placed.write.parquet(path)
    finally:
        if not held:
            df.unpersist()
    return spark.read.schema(placed.schema).parquet(path)


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column],
                totals: bool = True) -> DataFrame:
    """Running sums along a total order within each group, plus the group totals.

    Adds ``cum_<name>`` (inclusive) and, with ``totals``, ``all_<name>``. A group of any
    size is spread over the blocks it spans; the carry table has at most
    (blocks x groups present in them) rows.
    """
    by = list(by)
    blocks = ordered_blocks(df, [*[F.col(c) for c in by], *order])
    block_totals = blocks.groupBy(BLOCK, *by).agg(*[F.sum(e).alias(f"_t_{k}") for k, e in sums.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = block_totals.select(
        F.col(BLOCK).alias("_at"), *[F.col(c).alias(f"_by_{c}") for c in by],
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums],
        *([F.sum(f"_t_{k}").over(group).alias(f"all_{k}") for k in sums] if totals else []))
    inside = Window.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = blocks.select("*", *[F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(f"_in_{k}")
                                   for k, e in sums.items()])
    # Null-safe on the group, so a missing key is a group like any other.
    same = F.col(BLOCK) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = running.join(carry, same)
    keep = [c for c in df.columns]
    return joined.select(*keep, *[(F.col(f"_in_{k}") + F.col(f"_off_{k}")).alias(f"cum_{k}") for k in sums],
                         *([F.col(f"all_{k}") for k in sums] if totals else []))


def global_rank(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``rank`` (1..n along a total order) and ``n`` rows, per group."""
    one = F.lit(1).cast("bigint")
    return (prefix_sums(df, by, order, {"n": one})
            .withColumnRenamed("cum_n", "rank").withColumnRenamed("all_n", "n"))


def top_fraction_flag(df: DataFrame, fraction: float, order: Sequence[Column], by: Sequence[str] = (),
                      out: str = "in_top") -> DataFrame:
    """The first ceil(fraction * n) rows of the order."""
    return global_rank(df, order, by).withColumn(out, F.col("rank") <= F.ceil(F.lit(fraction) * F.col("n")))


def top_fraction_ties(df: DataFrame, fraction: float, score: str, out: str = "in_top") -> DataFrame:
    """Every row at or above the score of position ceil(fraction * n): ties at the cut stay in."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    curve = prefix_sums(counts, [], [F.desc(score)], {"n": F.col("n")})
    cut = curve.where(F.col("cum_n") >= F.ceil(F.lit(fraction) * F.col("all_n"))).agg(F.max(score)).first()[0]
    return df.withColumn(out, F.col(score) >= F.lit(cut))


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                    probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group and column, in long form.

    Works from counts of distinct values laid out in blocks, so a group may hold any
    share of the rows. Result: (*by, variable, n, one column per probability).
    """
    by = list(by)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(*by, f"stack({len(columns)}, {pairs}) AS (variable, value)") \
        .where("value IS NOT NULL AND NOT isnan(value)")
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = prefix_sums(counts, [*by, "variable"], [F.col("value")], {"n": F.col("n")})
    start, stop, total = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("all_n")
    picks, outs = [], []
    for name, p in probs.items():
        pos = (total - 1) * F.lit(float(p))
        for side, edge in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((edge >= start) & (edge < stop), F.col("value"))).alias(f"_{side}_{name}"))
        frac = (F.col("n") - 1) * F.lit(float(p))
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                     * (frac - F.floor(frac))).alias(name))
    return (steps.groupBy(*by, "variable").agg(F.max("all_n").alias("n"), *picks)
            .select(*by, "variable", "n", *outs))


SKETCHED_ROWS = 1_000_000  # rows from which brackets are guessed from about so many


def _coarse(x: Column, edges: Sequence[tuple[float, float]]) -> tuple[Column, Column]:
    """A value between any two edges as it is, another as the nearest edge below it; and whether it is such another."""
    inside, below = F.lit(False), F.lit(-math.inf)
    for lo, hi in sorted(edges, key=lambda e: e[1]):
        inside, below = inside | x.between(F.lit(lo), F.lit(hi)), F.when(x > F.lit(hi), F.lit(hi)).otherwise(below)
    return F.when(x.isNotNull(), F.when(inside, x).otherwise(below)), ~inside


def narrowed_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], span: Sequence[Column] = ()) -> dict[int, dict[str, dict[str, float]]]:
    """group -> column -> name -> the value that ``exact_quantiles`` gives, for a table that is cheap to read twice and few groups.

    ``span`` names the first and last group of each row (whole numbers); without it all rows are group 0. Approximate quantiles bracket
    each exact one, then only values inside a bracket are counted one by one, all others as one. A quantile outside its bracket shows
    there and is found by ``exact_quantiles``, so the guess (from a hash sample of a large table) does not touch results.
    """
    names = [f"q{i}" for i in range(len(columns))]
    ends = dict(zip(("_lo", "_hi"), span or (F.lit(0), F.lit(0))))
    numbers = {n: F.col(f"`{c}`").cast("double") for n, c in zip(names, columns)}
    flat = df.select(*[e.cast("int").alias(k) for k, e in ends.items()], *[F.when(~F.isnan(x), x).alias(n) for n, x in numbers.items()])

    def grouped(rows):
        return rows.withColumn("_g", F.explode(F.sequence("_lo", "_hi"))).drop(*ends)
    every = flat.count() // SKETCHED_ROWS
    some = flat.where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0) if every > 1 else flat
    reach = 0.01 if every > 1 else 0.001
    asked = [(max(p - reach, 0.0), min(p + reach, 1.0)) for p in probs.values()]
    sketch = grouped(some).groupBy("_g").agg(*[F.percentile_approx(n, F.array(*[F.lit(a) for pair in asked for a in pair])).alias(n) for n in names]).collect()
    cells = []
    for n in names:
        found = [r[n] for r in sketch if r[n]]
        edges = [(min(f[2 * i] for f in found), max(f[2 * i + 1] for f in found)) for i in range(len(asked))] if found else []
        cells += [F.lit(n), *_coarse(F.col(n), edges)]
    long = flat.select(*ends, F.stack(F.lit(len(names)), *cells).alias("variable", "value", "outside")).where("value IS NOT NULL")
    counts = grouped(long.groupBy(*ends, "variable", "value", "outside").agg(F.count(F.lit(1)).alias("n")))
    # A group's values are those of its brackets and few others: some thousandths of its rows.
    group = Window.partitionBy("_g", "variable")
    steps = counts.groupBy("_g", "variable", "value", "outside").agg(F.sum("n").alias("n")).select(
        "*", F.sum("n").over(group.orderBy("value", "outside").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("n").over(group).alias("total"))
    at = {(k, side): edge((F.col("total") - 1) * F.lit(float(p))) for k, p in probs.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))}
    hit = {k: (e >= F.col("upto") - F.col("n")) & (e < F.col("upto")) for k, e in at.items()}
    rows = steps.groupBy("_g", "variable").agg(F.max("total").alias("total"), *[F.max(F.when(h, F.col("value"))).alias(f"_{side}_{k}") for (k, side), h in hit.items()],
                                               *[F.bool_or(h & F.col("outside")).alias(f"_miss_{side}_{k}") for (k, side), h in hit.items()]).collect()
    out: dict[int, dict[str, dict[str, float]]] = {}
    column = dict(zip(names, columns))
    missed = sorted({r["variable"] for r in rows if any(r[f"_miss_{side}_{k}"] for k, side in hit)})
    for r in rows:
        if r["variable"] not in missed:
            values = {}
            for k, p in probs.items():
                place, lo, hi = (r["total"] - 1) * float(p), r[f"_lo_{k}"], r[f"_hi_{k}"]
                values[k] = lo + (hi - lo) * (place - math.floor(place))
            out.setdefault(r["_g"], {})[column[r["variable"]]] = values
    if missed:
        for r in exact_quantiles(grouped(flat), ["_g"], missed, probs).collect():
            out.setdefault(r["_g"], {})[column[r["variable"]]] = {k: r[k] for k in probs}
    return out


def quantile_values(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column as driver values (one per probability)."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_quantiles(df, [], [column], names).first()
    return [row[k] for k in names] if row else [None] * len(names)


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Equal-count edges with equal neighbours dropped."""
    edges = [e for e in quantile_values(df, column, [i / bins for i in range(bins + 1)]) if e is not None]
    return sorted(set(edges))


def qcut_code(c, edges: Sequence[float]) -> Column:
    """0-based right-closed band over quantile edges, lowest edge included; 0 when all tied."""
    c = col(c)
    if len(edges) < 3:
        return F.when(c.isNotNull(), F.lit(0))
    code = None
    for i, hi in enumerate(edges[1:-1]):
        code = F.when(c <= hi, F.lit(i)) if code is None else code.when(c <= hi, F.lit(i))
    return F.when(c.isNotNull(), code.otherwise(F.lit(len(edges) - 2)))


def hash_order(id_col: str, seed: int = 42) -> Column:
    """Reproducible pseudo-random key per row (never rand(), which changes on a rerun)."""
    return F.xxhash64(F.col(id_col), F.lit(seed))

"""Model choice under sampling noise: unit-level bootstraps and fold intervals."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import ratio
from ..functions.tails import t_ppf
from ..session import share_code, shared_folder
from .metrics import ranking_scores, score_curve
from .ordering import global_rank, ordered_blocks

# Fixed value: order of preference among tied model families.
FAMILY_RANK = {"linear": 0, "tree": 1, "forest": 2}


# Units of one task's share of the draws, and cells of the largest table of draws a worker holds whole.
UNIT_BLOCK, TABLE_CELLS = 4096, 16_000_000


def block_totals(n: int, draws: int, seed: int, block: int) -> np.ndarray:
    """How many of the ``n`` picks of each draw fall into one block of units.

    The picks are halved down a tree over the blocks. A node's generator is seeded by its range, so all
    blocks agree on the splits without meeting, and the totals of a draw add up to ``n``.
    """
    edge = lambda at: min(n, at * UNIT_BLOCK)
    lo, hi, left = 0, -(-n // UNIT_BLOCK), np.full(draws, n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = np.random.default_rng([seed, lo, hi]).binomial(left, (edge(mid) - edge(lo)) / (edge(hi) - edge(lo)))
        if block < mid:
            left, hi = first, mid
        else:
            left, lo = left - first, mid
    return left


def multiplicities(n: int, draws: int, seed: int, block: int) -> np.ndarray:
    """(units of the block, draws): how often each unit appears when ``n`` units are drawn ``n`` times with replacement.

    A pure function of its arguments, so a task that runs again gives the same draws. A count above 255 does not
    occur: even for 256 units its chance is below 10^-500.
    """
    size = min(n, (block + 1) * UNIT_BLOCK) - block * UNIT_BLOCK
    totals = block_totals(n, draws, seed, block)
    picks = np.random.default_rng([seed, block, 0, 1]).integers(0, size, totals.sum())
    cells = picks * draws + np.repeat(np.arange(draws), totals)
    return np.bincount(cells, minlength=size * draws).reshape(size, draws).astype(np.uint8)


def draw_table(strata: Sequence[int], draws: int, seed: int = 42) -> np.ndarray:
    """Multiplicities of units numbered stratum after stratum; each draw takes as many units from a stratum as it has."""
    return np.concatenate([multiplicities(size, draws, seed + i, block) for i, size in enumerate(strata) for block in range(-(-size // UNIT_BLOCK))])


def resampling_units(df: DataFrame, unit: str, most: int) -> list | None:
    """Distinct resampling units in order, or None if there are more than ``most``."""
    units = sorted(r[0] for r in df.select(unit).where(F.col(unit).isNotNull()).distinct().limit(most + 1).collect())
    return units if len(units) <= most else None


def _indexed(df: DataFrame, unit: str, draws: int) -> tuple[DataFrame, int, bool]:
    """``df`` with ``u``, the position of its unit from 0, the number of units, and whether one table of draws covers them."""
    units = resampling_units(df, unit, TABLE_CELLS // draws)
    key = F.col(unit) == F.col("_unit_key")
    if units is not None:
        look = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(units)], df.select(F.col(unit).alias("_unit_key")).schema.add("u", T.LongType()))
        return df.join(F.broadcast(look), key).drop("_unit_key"), len(units), True
    ranked = global_rank(df.select(F.col(unit).alias("_unit_key")).where("_unit_key IS NOT NULL").distinct(), [F.col("_unit_key")]) \
        .select("_unit_key", (F.col("rank") - 1).alias("u"), "n")
    return df.join(ranked.drop("n"), key).drop("_unit_key"), ranked.first()["n"], False


def _by_unit(df: DataFrame) -> DataFrame:
    """Rows in order of their unit; the rows of one unit may lie in several tasks."""
    return df.repartitionByRange("u", *[c for c in df.columns if c != "u"]).sortWithinPartitions("u")


def _weights(n: int, draws: int, seed: int):
    """Rows of multiplicities for an array of unit positions in ascending order, one block of units at a time."""
    held: dict[int, np.ndarray] = {}

    def rows(u: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        start = 0
        while start < len(u):
            block = int(u[start]) // UNIT_BLOCK
            stop = int(np.searchsorted(u, (block + 1) * UNIT_BLOCK))
            if block not in held:
                held.clear()
                held[block] = multiplicities(n, draws, seed, block)
            yield slice(start, stop), held[block][u[start:stop] - block * UNIT_BLOCK]
            start = stop
    return rows


def bootstrap_rmse(df: DataFrame, unit: str, draws: int = 2000, seed: int = 42, actual: str = "target",
                   predicted: str = "days") -> DataFrame:
    """(b, model, value): RMSE of each draw, exact from per-unit sums of squares. Any number of units, single rows included."""
    share_code(df.sparkSession)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    per_unit, n, _ = _indexed(known.groupBy("model", unit).agg(F.sum(e * e).alias("sse"), F.count(F.lit(1)).cast("double").alias("n")), unit, draws)

    def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, sums = _weights(n, draws, seed), {}
        for rows in frames:
            values = rows[["sse", "n"]].to_numpy()
            for at, m in weights(rows["u"].to_numpy()):
                models = rows["model"].to_numpy()[at]
                for model in pd.unique(models):
                    mine = models == model
                    sums[model] = sums.get(model, 0) + values[at][mine].T @ m[mine]
        for model, (sse, k) in sums.items():
            yield pd.DataFrame({"b": np.arange(draws), "model": model, "sse": sse, "n": k})

    parts = _by_unit(per_unit.select("model", "u", "sse", "n")).mapInPandas(totals, "b int, model string, sse double, n double")
    return parts.groupBy("b", "model").agg(F.sqrt(ratio(F.sum("sse"), F.sum("n"))).alias("value"))


def bootstrap_ap(df: DataFrame, unit: str, draws: int = 2000, seed: int = 42, score: str = "p", label: str = "label",
                 strata: Sequence[int] | None = None) -> DataFrame:
    """(b, model, value): average precision of each draw, every model on the same draws.

    Counts per (model, score, unit) are laid out in score order; each block turns unit
    multiplicities into weighted running counts for all draws at once, with the
    totals of earlier blocks carried in. Exact, and no task holds more than a block.
    Few units (days): a worker makes the table of draws itself. Many units (orders): each
    row takes its draws along, a byte each, from a pass in unit order. A score may span blocks: the first and last
    score of a block are added up over all of its blocks.
    """
    share_code(df.sparkSession)
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    counts = known.groupBy("model", F.col(score).alias("score"), unit).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    counts, n, small = _indexed(counts, unit, draws)
    counts = counts.select("model", "score", "u", "k", "pos")
    if not small and strata:
        raise ValueError("strata are lists of calendar units")

    def take_along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = _weights(n, draws, seed)
        for rows in frames:
            for at, m in weights(rows["u"].to_numpy()):
                for lo in range(0, len(m), 2048):
                    yield rows.iloc[at].iloc[lo:lo + 2048].assign(w=[r.tobytes() for r in m[lo:lo + 2048]])

    if not small:
        counts = _by_unit(counts).mapInPandas(take_along, "model string, score double, u long, k long, pos long, w binary")
    blocks = ordered_blocks(counts, [F.col("model"), F.desc("score"), F.col("u")], rows=None if small else max(1, TABLE_CELLS // draws))
    sizes = list(strata or [n])

    def weighted(rows: pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Products with the multiplicities, some draws at a time."""
        width = max(1, 4_000_000 // max(1, len(rows)))
        held = None if small else np.frombuffer(b"".join(rows["w"]), dtype=np.uint8).reshape(len(rows), draws)
        for lo in range(0, draws, width):
            at = slice(lo, min(draws, lo + width))
            m = (_cached_table(tuple(sizes), draws, seed)[:, at][rows["u"].to_numpy()] if small else held[:, at]).astype(np.int64)
            yield at, [m * rows[c].to_numpy()[:, None] for c in columns]

    def totals(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if small:
            pdf = pdf.groupby("u", as_index=False)[["k", "pos"]].sum()
        out = {c: np.zeros(draws, dtype=np.int64) for c in ("k", "pos")}
        for at, products in weighted(pdf, ("k", "pos")):
            for c, x in zip(("k", "pos"), products):
                out[c][at] = x.sum(0)
        return pd.DataFrame({"_block": key[0], "model": key[1], "b": np.arange(draws), **out})

    per_block = blocks.groupBy("_block", "model").applyInPandas(totals, "_block int, model string, b int, k long, pos long")
    w = Window.partitionBy("model", "b")
    before = w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select("_block", "model", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"),
                             F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("p0"))

    def precision_steps(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        """Per draw: the finished steps inside the block, and the open first and last score with the running counts at their end."""
        start, rows = start.sort_values("b"), rows.sort_values("score", ascending=False)
        scores = rows["score"].to_numpy()
        first = np.flatnonzero(np.r_[True, np.diff(scores) != 0])
        ends = sorted({0, len(first) - 1})
        part = np.zeros(draws)
        edges = {i: np.zeros((3, draws), dtype=np.int64) for i in ends}
        for at, (k, pos) in weighted(rows, ("k", "pos")):
            ks, ps = np.add.reduceat(k, first), np.add.reduceat(pos, first)
            ck, cp = ks.cumsum(0) + start["k0"].to_numpy()[at], ps.cumsum(0) + start["p0"].to_numpy()[at]
            steps = ps * np.divide(cp, ck, out=np.zeros(ck.shape), where=ck > 0)
            part[at] = steps[1:-1].sum(0)
            for i in ends:
                edges[i][:, at] = ps[i], ck[i], cp[i]
        base = {"model": key[1], "b": np.arange(draws)}
        frames = [pd.DataFrame({**base, "score": scores[first[i]], "part": 0.0, "pos": e[0], "ck": e[1], "cp": e[2]}) for i, e in edges.items()]
        return pd.concat([pd.DataFrame({**base, "score": np.nan, "part": part, "pos": 0, "ck": 0, "cp": 0}), *frames])

    parts = blocks.groupBy("_block", "model").cogroup(carry.groupBy("_block", "model")).applyInPandas(
        precision_steps, "model string, b int, score double, part double, pos long, ck long, cp long")
    per_score = parts.groupBy("b", "model", "score").agg(
        (F.sum("part") + F.sum("pos") * F.coalesce(ratio(F.max("cp"), F.max("ck")), F.lit(0.0))).alias("part"))
    positives = per_block.groupBy("b", "model").agg(F.sum("pos").alias("p_all"))
    return per_score.groupBy("b", "model").agg(F.sum("part").alias("part")).join(positives, ["b", "model"]) \
        .select("b", "model", ratio("part", "p_all").alias("value"))


@lru_cache(maxsize=1)
def _cached_table(strata: tuple[int, ...], draws: int, seed: int) -> np.ndarray:
    return draw_table(strata, draws, seed)


def bootstrap_vs_leader(df: DataFrame, unit: str, task: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Point score, difference to the leader, percentile interval and tied flag per model.

    The scored rows are read several times, so their lineage is cut once.
    """
    shared_folder(df.sparkSession)
    df = df.select("model", unit, "p", "days", "label", "target").checkpoint()
    if task == "classification":
        point = ranking_scores(score_curve(df, ["model"]), ["model"]).select("model", F.col("avg_precision").alias("score"))
        draws_df, best = bootstrap_ap(df, unit, draws, seed), F.max_by("model", F.struct("score", "model"))
    else:
        known = df.where("target IS NOT NULL AND days IS NOT NULL")
        point = known.groupBy("model").agg(F.sqrt(F.avg(F.pow(F.col("days") - F.col("target"), 2))).alias("score"))
        draws_df, best = bootstrap_rmse(df, unit, draws, seed), F.min_by("model", F.struct("score", "model"))
    scores = {r["model"]: r["score"] for r in point.collect()}
    leader = point.agg(best).first()[0]
    lead = draws_df.where(F.col("model") == leader).select("b", F.col("value").alias("_lead"))
    tail = (1 - level) / 2
    # One value per draw and model: the percentile's input is the number of draws.
    gaps = draws_df.join(lead, "b").groupBy("model").agg(
        F.percentile(F.col("value") - F.col("_lead"), F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci"))
    look = df.sparkSession.createDataFrame([(m, float(s), float(s - scores[leader])) for m, s in scores.items()],
                                           "model string, score double, diff_vs_leader double")
    low, high = F.col("_ci")[0], F.col("_ci")[1]
    return look.join(gaps, "model").select(
        "model", "score", "diff_vs_leader", low.alias("ci_low"), high.alias("ci_high"), (F.col("model") == leader).alias("leader"),
        ((F.col("model") == leader) | ((low <= 0) & (high >= 0))).alias("tied"))


def choose_model(table: DataFrame, families: Mapping[str, str], sizes: Mapping[str, int]) -> DataFrame:
    """Simplest tied model: family order, then parameter count, with the reason per row."""
    spark = table.sparkSession
    facts = spark.createDataFrame([(m, f, FAMILY_RANK[f], int(sizes[m])) for m, f in families.items()],
                                  "model string, family string, _rank int, parameters int")
    rows = table.join(F.broadcast(facts), "model", "left")
    key = F.struct("_rank", "parameters", "model")
    # The window covers one row per candidate model.
    winner = F.min_by("model", F.when(F.col("tied") & F.col("family").isNotNull(), key)).over(Window.partitionBy())
    chosen = F.col("model") == F.col("_w")
    return rows.withColumn("_w", winner).withColumn("selected", F.coalesce(chosen, F.lit(False))).withColumn(
        "decision", F.when(F.col("family").isNull(), "baseline: not selectable").when(F.col("selected"), "selected: simplest model tied with the leader")
        .when(~F.col("tied"), "not tied: interval excludes 0").otherwise("tied, but a simpler tied model exists")).drop("_w", "_rank")


def paired_fold_interval(folds: DataFrame, a: str, b: str, metric: str, level: float = 0.95) -> DataFrame:
    """Fold-wise a - b with the variance corrected for shared training rows.

    ``folds`` has (model, fold, metric, n_train, n_valid).
    """
    pick = lambda m, name: folds.where(F.col("model") == m).select("fold", F.col(metric).alias(name), "n_train", "n_valid")
    both = pick(a, "_a").join(pick(b, "_b").select("fold", "_b"), "fold").withColumn("_d", F.col("_a") - F.col("_b"))
    j, mean, var, share, better = both.agg(F.count("_d"), F.avg("_d"), F.var_samp("_d"), F.avg(ratio("n_valid", "n_train")), F.count_if(F.col("_d") > 0)).first()
    half = t_ppf(1 - (1 - level) / 2, j - 1) * ((1 / j + share) * var) ** 0.5
    return folds.sparkSession.createDataFrame([(f"{a} - {b}", metric, mean, var ** 0.5, mean - half, mean + half, better, j)],
                                              "comparison string, metric string, mean_diff double, sd_diff double, ci_low double, ci_high double, folds_better long, folds long")


def monthly_block_bootstrap(df: DataFrame, month: str, day: str, a: str, b: str, draws: int = 499, seed: int = 42) -> DataFrame:
    """Average monthly AP difference with 7-day blocks resampled inside each month."""
    unit = F.concat_ws("-", F.col(month), F.floor((F.dayofmonth(day) - 1) / 7).cast("string"))
    rows = df.where(F.col("model").isin(a, b) & F.col("label").isNotNull() & F.col("p").isNotNull()).withColumn("_unit", unit) \
        .withColumn("model", F.concat_ws("|", F.col(month), F.col("model")))
    sizes: dict[str, int] = {}
    for u in resampling_units(rows, "_unit", TABLE_CELLS // draws) or []:
        sizes[u[:7]] = sizes.get(u[:7], 0) + 1
    values = bootstrap_ap(rows, "_unit", draws, seed, strata=list(sizes.values())) \
        .withColumn("month", F.split_part("model", F.lit("|"), F.lit(1))).withColumn("_m", F.split_part("model", F.lit("|"), F.lit(2)))
    pick = lambda m: F.max(F.when(F.col("_m") == m, F.col("value")))
    mean = values.groupBy("b", "month").agg((pick(a) - pick(b)).alias("d")).groupBy("b").agg(F.avg("d").alias("d"))
    q = mean.agg(F.avg("d").alias("mean_diff"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("d").alias("draws"))
    return q.select("mean_diff", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "draws")

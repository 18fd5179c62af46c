"""Logistic regression on many column subsets, folds and penalties at once.

One pass over the encoded rows gives the log-likelihood, gradient and Hessian of every model that is still moving: each task adds up small
matrices and Spark adds up the tasks'. The driver only solves p x p systems. A step of a selection is one batch of models, warm-started
from the model they extend, so its number of passes does not grow with the number of candidates.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import narrowed_quantiles

INTERCEPT = "(intercept only)"
MOST_CELLS = 2_000_000     # numbers of one pass's gradients and Hessians; more models take more passes
BINS = 64                  # bins per unit of the linear score in which validation rows are ordered
# Inverse penalties of the L1 search, strongest first.
INVERSE_PENALTIES = [float(c) for c in np.logspace(-4, 4, 10)]


@dataclass
class Model:
    """Columns (places among the design's), fold whose training rows are read, and L1 penalty on all but the intercept."""
    cols: tuple[int, ...]
    fold: int = 0
    penalty: float = 0.0
    beta: np.ndarray | None = None
    loss: float = np.inf       # minus log-likelihood plus penalty
    loglik: float = -np.inf
    method: str = ""           # newton, pseudo-inverse (singular information matrix), or the reason of a failure
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.cols)

    def aic(self, n: float) -> float:
        return 2 * (self.k + 1) - 2 * self.loglik

    def bic(self, n: float) -> float:
        return float(np.log(n)) * (self.k + 1) - 2 * self.loglik


@dataclass
class Prep:
    """What a fold's training rows say of each column: value for missing ones, shift and scale."""
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """(1, prepared columns) of raw rows, in which NaN is missing."""
        z = (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale
        return np.column_stack([np.ones(len(x)), z])

    @staticmethod
    def none(p: int) -> Prep:
        return Prep(np.zeros(p), np.zeros(p), np.ones(p))


@dataclass
class Rows:
    """Raw rows, each stored once: train_lo, train_hi (first and last fold that trains on the row; none where lo > hi), valid (the fold that it
    validates, or null), y, x0 .. x{p-1}; and the preparation of each fold."""
    df: DataFrame
    p: int
    preps: Mapping[int, Prep]

    def prep(self, fold: int) -> Prep:
        return self.preps.get(fold) or Prep.none(self.p)


def raw_rows(df: DataFrame, columns: Sequence[str], train_lo: Column, train_hi: Column, valid: Column, y: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Rows as this module reads them; `columns` hold numbers, null for missing."""
    return df.select(train_lo.cast("int").alias("train_lo"), train_hi.cast("int").alias("train_hi"), valid.cast("int").alias("valid"),
                     y.cast("double").alias("y"), *keep, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def prepare(df: DataFrame, p: int, folds: Sequence[int], scaled: bool = True) -> Rows:
    """Exact median of each column among a fold's training rows (0 if it has none) and, with `scaled`, mean and deviation after filling in;
    one job for the medians of all folds and one for their moments."""
    names = [f"x{i}" for i in range(p)]
    fills = {f: np.zeros(p) for f in folds}
    if p:
        found = narrowed_quantiles(df.where("train_lo <= train_hi"), names, {"mid": 0.5}, (F.col("train_lo"), F.col("train_hi")))
        for f in fills:
            for c, v in found.get(f, {}).items():
                fills[f][int(c[1:])] = v["mid"]
    rows = Rows(df, p, {f: Prep(fills[f], np.zeros(p), np.ones(p)) for f in folds})
    if scaled:
        sums = dict(zip(folds, _moments(rows, folds)))
        for f, (n, total, squares) in sums.items():
            mean = total / max(n, 1)
            sd = np.sqrt(np.clip(squares / max(n, 1) - mean * mean, 0, None))
            rows.preps[f].mean, rows.preps[f].scale = mean, np.where(sd > 1e-9 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
    return rows


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """Raw columns with NaN for null."""
    return np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(p)]) if p else np.zeros((batch.num_rows, 0))


def _summed(rows: Rows, folds: Sequence[int], size: int, add) -> np.ndarray:
    """Sum over tasks of a vector of `size` numbers; `add(acc, fold, z, y)` is called for each batch and each fold with its training rows."""
    p, preps, wanted = rows.p, {f: rows.prep(f) for f in folds}, sorted(set(folds))

    def partial(batches):
        acc = np.zeros(size)
        for batch in batches:
            lo, hi, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("train_lo", "train_hi", "y"))
            x = _matrix(batch, p)
            for f in wanted:
                mine = (lo <= f) & (f <= hi)
                if mine.any():
                    add(acc, f, preps[f].apply(x[mine]), y[mine].astype(float))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(size, dtype=np.int32)), "v": pa.array(acc)})

    cells = rows.df.where("train_lo <= train_hi").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return out


def _moments(rows: Rows, folds: Sequence[int]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, sums, sums of squares) of the filled columns per fold."""
    width = 2 * rows.p + 1
    at = {f: i * width for i, f in enumerate(folds)}

    def add(acc, f, z, y):
        acc[at[f]:at[f] + width] += np.concatenate([[len(z)], z[:, 1:].sum(axis=0), (z[:, 1:] ** 2).sum(axis=0)])
    flat = _summed(rows, folds, width * len(folds), add)
    return [(flat[a], flat[a + 1:a + 1 + rows.p], flat[a + 1 + rows.p:a + width]) for a in at.values()]


def derivatives(rows: Rows, models: Sequence[Model], betas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log-likelihood, gradient, Hessian of minus the log-likelihood) of each model at its beta over the training rows of its fold."""
    sizes = [1 + len(b) + len(b) * (len(b) + 1) // 2 for b in betas]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    of: dict[int, list] = {}
    for m, beta, a in zip(models, betas, starts):
        of.setdefault(m.fold, []).append((np.array([0, *(c + 1 for c in m.cols)]), beta, a))

    def add(acc, f, z_all, y):
        for cols, beta, a in of[f]:
            z = z_all[:, cols]
            eta = z @ beta
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            hessian = (z * (mu * (1 - mu))[:, None]).T @ z
            part = np.concatenate([[float(y @ eta - np.logaddexp(0, eta).sum())], z.T @ (y - mu), hessian[np.triu_indices(len(beta))]])
            acc[a:a + len(part)] += part

    flat = _summed(rows, list(of), int(starts[-1]), add)
    out = []
    for beta, a, b in zip(betas, starts, starts[1:]):
        k = len(beta)
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = flat[a + 1 + k:b]
        out.append((flat[a], flat[a + 1:a + 1 + k], hessian + np.triu(hessian, 1).T))
    return out


def _newton(beta, gradient, hessian) -> tuple[np.ndarray, float, bool]:
    """Next point, expected gain, and whether the information matrix has full rank."""
    scale = np.sqrt(np.clip(np.diag(hessian), 1e-300, None))
    values, vectors = np.linalg.eigh(hessian / np.outer(scale, scale))
    kept = values > max(values.max(initial=0.0), 1e-300) * 1e-11
    step = (vectors[:, kept] @ ((vectors[:, kept].T @ (gradient / scale)) / values[kept])) / scale
    return beta + step, float(gradient @ step) / 2, bool(kept.all())


def _proximal(beta, gradient, hessian, penalty, sweeps: int = 40) -> tuple[np.ndarray, float]:
    """Minimum of the quadratic model plus the L1 penalty, and its expected gain: coordinate descent finds the terms and their signs, and a
    solved system that meets the optimality conditions ends it. Unfinished, it is a step downhill that the next pass goes on from."""
    new, pull, slack = beta.copy(), gradient + hessian @ beta, 1e-9 * max(penalty, 1e-300)
    moving = np.flatnonzero(np.diag(hessian) > 1e-12)
    for sweep in range(sweeps):
        for j in moving:
            rho = pull[j] - hessian[j] @ new + hessian[j, j] * new[j]
            new[j] = (rho if j == 0 else np.sign(rho) * max(abs(rho) - penalty, 0.0)) / hessian[j, j]
        if sweep % 10 == 9:
            on = moving[(new[moving] != 0) | (moving == 0)]
            signs = np.where(on == 0, 0.0, np.sign(new[on]))
            exact = np.zeros(len(new))
            exact[on] = np.linalg.lstsq(hessian[np.ix_(on, on)], pull[on] - penalty * signs, rcond=None)[0]
            left = pull - hessian @ exact
            if np.all(exact[on] * signs >= 0) and np.all(np.abs(left[1:]) <= penalty + slack) and np.all(np.abs(left[on] - penalty * signs) <= max(slack, 1e-9)):
                new = exact
                break
    d = new - beta
    gain = float(gradient @ d - d @ hessian @ d / 2 + penalty * (np.abs(beta[1:]).sum() - np.abs(new[1:]).sum()))
    return new, gain


def fit_many(rows: Rows, models: Sequence[Model], max_iter: int = 40, tol: float = 1e-10) -> list[Model]:
    """Fits all models together, each from its own beta; steps that raise the loss are halved.

    A model has converged when the next step promises less than `tol` of its loss. One that has not after `max_iter` passes, or whose steps
    shrink to nothing, keeps the best point found, with the reason as its method.
    """
    active, trial, halved = list(models), {}, {}
    for m in active:
        trial[id(m)] = np.zeros(m.k + 1) if m.beta is None else m.beta
    for _ in range(max_iter):
        if not active:
            break
        values = []
        for some in _portions(active):
            values += derivatives(rows, some, [trial[id(m)] for m in some])
        moving = []
        for m, (loglik, gradient, hessian) in zip(active, values):
            beta = trial[id(m)]
            loss = -loglik + m.penalty * float(np.abs(beta[1:]).sum())
            if not loss <= m.loss + 1e-12 * abs(m.loss):
                halved[id(m)] = halved.get(id(m), 0) + 1
                if halved[id(m)] > 30:
                    m.method = "steps shrink to nothing"
                else:
                    trial[id(m)] = (beta + m.beta) / 2
                    moving.append(m)
                continue
            halved[id(m)] = 0
            m.beta, m.loss, m.loglik = beta, loss, loglik
            if m.penalty:
                new, gain = _proximal(beta, gradient, hessian, m.penalty)
                full = True
            else:
                new, gain, full = _newton(beta, gradient, hessian)
            m.method = "newton" if full else "pseudo-inverse"
            if gain <= tol * max(1.0, abs(loss)):
                m.converged = True
                m.beta, m.loss = new, loss - gain  # the last step is too small to need another look
                m.loglik = float(m.penalty * np.abs(new[1:]).sum() - m.loss)
            else:
                trial[id(m)] = new
                moving.append(m)
        active = moving
    for m in active:
        m.method = "did not converge"
    return list(models)


def _portions(models: Sequence[Model]) -> list[list[Model]]:
    out, room = [], 0
    for m in models:
        cells = 1 + (m.k + 1) * (m.k + 4) // 2
        if cells > room:
            out.append([])
            room = MOST_CELLS
        out[-1].append(m)
        room -= cells
    return out


def scores(rows: Rows, models: Sequence[Model], keep: Sequence[str] = ("y",)) -> DataFrame:
    """model, eta and the `keep` columns of every validation row, for every model of its fold; models are numbered in order."""
    p, of = rows.p, {}
    for i, m in enumerate(models):
        of.setdefault(m.fold, []).append((i, np.array([0, *(c + 1 for c in m.cols)]), m.beta))
    preps = {f: rows.prep(f) for f in of}
    kinds = ", ".join(f"{c} {rows.df.schema[c].dataType.simpleString()}" for c in keep)

    def apply(batches):
        for batch in batches:
            valid, x = batch.column("valid").to_numpy(zero_copy_only=False), _matrix(batch, p)
            for f in of:
                mine = np.flatnonzero(valid == f)
                if len(mine):
                    z, kept = preps[f].apply(x[mine]), [batch.column(c).take(pa.array(mine)) for c in keep]
                    for i, cols, beta in of[f]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), i, np.int32)), pa.array(z[:, cols] @ beta), *kept], ["model", "eta", *keep])

    return rows.df.where("valid IS NOT NULL").mapInArrow(apply, f"model int, eta double, {kinds}")


def average_precision(scored: DataFrame, bins: int = BINS) -> dict[int, float]:
    """Average precision per model over distinct scores, highest first; models without a positive row are missing.

    Rows shrink to counts per score. Scores are ordered inside `bins` bins per unit of the score, and only one total per bin is summed up over a
    model, so no task orders all rows of a model.
    """
    # Sums of the same products may differ in their last digits between equal rows: scores equal to 12 digits tie.
    counts = scored.groupBy("model", F.round("eta", 12).alias("eta")).agg(F.count("*").alias("n"), F.sum("y").alias("pos")) \
        .withColumn("bin", F.floor(F.least(F.greatest(F.col("eta"), F.lit(-700.0)), F.lit(700.0)) * bins))
    inside = Window.partitionBy("model", "bin").orderBy(F.desc("eta"))
    above = Window.partitionBy("model").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy("model", "bin").agg(F.sum("n").alias("bin_n"), F.sum("pos").alias("bin_pos"))
    carry = bins.select("model", "bin", *[F.coalesce(F.sum(f"bin_{c}").over(above), F.lit(0)).alias(f"before_{c}") for c in ("n", "pos")],
                        F.sum("bin_pos").over(Window.partitionBy("model")).alias("all_pos"))
    placed = counts.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in ("n", "pos")}).join(carry, ["model", "bin"])
    precision = (F.col("upto_pos") + F.col("before_pos")) / (F.col("upto_n") + F.col("before_n"))
    found = placed.where("all_pos > 0").groupBy("model").agg(F.sum(F.col("pos") / F.col("all_pos") * precision).alias("ap")).collect()
    return {r["model"]: float(r["ap"]) for r in found}


# ---- selection ----

def _places(columns: Sequence[str], units: Mapping[str, Sequence[str]]) -> dict[str, tuple[int, ...]]:
    at = {c: i for i, c in enumerate(columns)}
    return {u: tuple(at[c] for c in cols) for u, cols in units.items()}


def _extend(base: Model, extra: tuple[int, ...]) -> Model:
    start = None if base.beta is None else np.concatenate([base.beta, np.zeros(len(extra))])
    return Model(base.cols + extra, base.fold, 0.0, start)


def forward_ic(rows: Rows, whole: int, columns: Sequence[str], units: Mapping[str, Sequence[str]],
               criteria: Sequence[str] = ("aic", "bic")) -> tuple[dict[str, list[dict]], list[dict]]:
    """Greedy paths by AIC and BIC on the fold `whole`, and the log of candidates that were solved another way or skipped.

    A unit brings all its encoded columns. Paths stop when no addition lowers their criterion; first of equals wins. Both paths walk
    together and share the models that both want.
    """
    if set(criteria) - {"aic", "bic"}:
        raise ValueError("criterion must be 'aic' or 'bic'")
    place = _places(columns, units)
    n = float(rows.df.where((F.col("train_lo") <= whole) & (F.col("train_hi") >= whole)).count())
    base = fit_many(rows, [Model((), whole)])[0]

    def entry(step, unit, m):
        return {"step": step, "added_unit": unit, "k": m.k, "aic": float(m.aic(n)), "bic": float(m.bic(n)), "method": m.method}

    paths = {c: [entry(0, INTERCEPT, base)] for c in criteria}
    chosen = {c: ((), base) for c in criteria}
    log: list[dict] = []
    going = list(criteria)
    while going:
        tries: dict[tuple[str, ...], Model] = {}
        for c in going:
            have, model = chosen[c]
            for u in units:
                if u not in have:
                    tries.setdefault((*have, u), _extend(model, place[u]))
        if not tries:
            break
        fit_many(rows, list(tries.values()))
        for key, m in tries.items():
            if m.method != "newton":
                log.append({"step": len(key), "unit": key[-1], "method": m.method if m.converged else "skipped", "reason": m.method})
        still = []
        for c in going:
            have, _ = chosen[c]
            usable = [(getattr(m, c)(n), u, m) for u in units if u not in have for m in [tries[(*have, u)]] if m.converged]
            if usable:
                value, unit, model = min(usable, key=lambda x: x[0])
                if value < paths[c][-1][c]:
                    chosen[c] = ((*have, unit), model)
                    paths[c].append(entry(len(have) + 1, unit, model))
                    still.append(c)
        going = still
    return paths, log


def fold_average_precision(rows: Rows, models: Sequence[Model], folds: Sequence[int]) -> np.ndarray:
    """(models / folds) x folds average precisions, 0 in a fold without positive rows; models come fold by fold within each candidate."""
    found = average_precision(scores(rows, models))
    return np.array([found.get(i, 0.0) for i in range(len(models))]).reshape(-1, len(folds))


def forward_cv(rows: Rows, columns: Sequence[str], units: Mapping[str, Sequence[str]], folds: Sequence[int],
               early_stop: int | None = None) -> list[dict]:
    """Greedy path by mean fold average precision: all candidates and folds of a step are fitted together and ranked together."""
    place = _places(columns, units)

    def row(step, unit, n_units, model, scored):
        return {"step": step, "added_unit": unit, "n_units": n_units, "n_encoded_columns": model.k, "cv_mean": float(scored.mean()),
                "cv_se": float(scored.std(ddof=1) / np.sqrt(len(scored)))}

    base = fit_many(rows, [Model((), f) for f in folds])
    path = [row(0, INTERCEPT, 0, base[0], fold_average_precision(rows, base, folds)[0])]
    left, stale, best = list(units), 0, path[0]["cv_mean"]
    while left:
        tries = fit_many(rows, [_extend(b, place[u]) for u in left for b in base])
        table = fold_average_precision(rows, tries, folds)
        at = int(np.argmax(table.mean(axis=1)))
        base = tries[at * len(folds):(at + 1) * len(folds)]
        path.append(row(len(path), left.pop(at), len(path), base[0], table[at]))
        stale = 0 if path[-1]["cv_mean"] > best else stale + 1
        best = max(best, path[-1]["cv_mean"])
        if early_stop and stale >= early_stop:
            break
    return path


def l1_path(rows: Rows, whole: int, columns: Sequence[str], folds: Sequence[int], grid: Sequence[float] = INVERSE_PENALTIES) -> tuple[list[dict], Model]:
    """(inverse penalty, mean fold average precision) rows, strongest penalty first, and the model of the best one on the fold `whole`. All penalties and folds are fitted in the same passes."""
    every = tuple(range(len(columns)))
    models = fit_many(rows, [Model(every, f, 1.0 / c) for c in grid for f in folds])
    means = fold_average_precision(rows, models, folds).mean(axis=1)
    best = int(np.argmax(means))
    table = [{"inverse_penalty": float(c), "mean_ap": float(v), "best": i == best} for i, (c, v) in enumerate(zip(grid, means))]
    return table, fit_many(rows, [Model(every, whole, 1.0 / grid[best])])[0]

"""pyspark.ml models on the order features: folds, searches, importance, resampling.

Fits run on the executors. The driver loops over folds and candidates and submits
independent fits from a small thread pool.
"""
from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..functions.scalars import clip_to_waiting_period
from ..functions.times import day, month_label
from ..session import shared_folder, shared_path
from . import labels, logit, metrics, rescoring
from .design import Design, category_counts, fit_design
from .neighbours import nearest
from .ordering import exact_quantiles, global_rank, hash_order, ordered_blocks

SEED = 42
THREADS = 4
TASK_ROWS, MANY_ROWS = 2_000, 50_000  # rows of a task: the fewest worth one, and those from which the files' own splits are enough


def in_parallel(fn: Callable, items: Sequence) -> list:
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(fn, items))


def dealt(df: DataFrame, copies: int = 1) -> DataFrame:
    """The same rows, dealt evenly over the cores if a few files hold them and each stands for ``copies`` rows of work; a table of few rows
    (one task) or many (the splits of its files) stays as it is."""
    rows, cores = df.count() * copies, df.sparkSession.sparkContext.defaultParallelism
    tasks = min(cores, rows // TASK_ROWS)
    return df.repartition(tasks) if tasks > 1 and rows < cores * MANY_ROWS * copies else df


@dataclass
class Spec:
    """One model: estimator factory, input features, and how the design is built."""
    name: str
    task: str                       # 'classification' or 'regression'
    estimator: Callable[[], Any]
    num_cols: Sequence[str]
    cat_cols: Sequence[str] = ()
    scale: bool = False
    options: Mapping[str, Any] | None = None
    weight: str | None = None       # 'balanced': negative/positive ratio, recomputed per fit


@dataclass
class Fitted:
    spec: Spec
    design: Design
    model: Any

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns plus ``p`` (late probability) or ``days`` (clipped to the waiting period)."""
        return self.score_vectors(vectorise(self.design, df, keep), keep)

    def score_vectors(self, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = self.model.transform(vectors)
        if self.spec.task == "classification":
            p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
            return out.select(*keep, p.alias("p"))
        if "promised_lead_days" in keep:
            return out.select(*keep, clip_to_waiting_period("prediction", "promised_lead_days", 45).alias("days"))
        return out.select(*keep, F.col("prediction").alias("days"))


def vectorise(design: Design, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns (as a struct while encoding, so names cannot clash) plus ``features``."""
    held = df.withColumn("_keep", F.struct(*keep))
    wide = design.encode(held, keep=["_keep"])
    names = [f"x{i}" for i in range(len(design.columns))]
    flat = wide.toDF("_keep", *names)
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("_keep.*", "features")


def fit(spec: Spec, train: DataFrame) -> Fitted:
    """Design and model from the training rows only."""
    design = build_design(spec, train)
    return fit_vectors(spec, design, vectorise(design, train, ["y"]))


def build_design(spec: Spec, train: DataFrame) -> Design:
    return fit_design(train, spec.num_cols, spec.cat_cols, scale=spec.scale, **(spec.options or {}))


def fit_vectors(spec: Spec, design: Design, rows: DataFrame) -> Fitted:
    est = spec.estimator().setFeaturesCol("features").setLabelCol("y")
    trees, level = est.hasParam("maxBins"), rows.storageLevel
    # Trees read their rows level by level: encoded once and on every core. Held rows are dealt by who holds them.
    mine = trees and not (level.useMemory or level.useDisk)
    rows = dealt(rows).persist() if mine else rows
    try:
        fitted = rows
        if spec.weight == "balanced":
            neg, pos = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
            fitted = rows.withColumn("w", F.when(F.col("y") == 1, F.lit(neg / max(pos, 1))).otherwise(F.lit(1.0)))
            est = est.setWeightCol("w")
        return Fitted(spec, design, est.fit(fitted))
    finally:
        if mine:
            rows.unpersist()


# ---- estimators ----

def logistic() -> LogisticRegression:
    return LogisticRegression(regParam=0.0, maxIter=200, tol=1e-8, standardization=False)


def logistic_checked(spec: Spec, train: DataFrame, max_iter: int = 200) -> tuple[Fitted, dict]:
    """Plain fit; one that spends all its iterations is refitted with a negligible ridge."""
    plain = fit(spec, train)
    used = plain.model.summary.totalIterations
    if used < max_iter:
        return plain, {"converged": True, "fallback": None, "iterations": used}
    ridge = Spec(spec.name, spec.task, lambda: logistic().setRegParam(1e-6), spec.num_cols, spec.cat_cols, spec.scale, spec.options, spec.weight)
    return fit(ridge, train), {"converged": False, "fallback": "ridge 1e-6", "iterations": used}


def linear() -> LinearRegression:
    return LinearRegression(regParam=0.0, standardization=False)


def _twin(task: str, classifier, regressor, params: Mapping[str, Any]):
    """A regressor on the 0/1 label for gini: the same splits (the variance is half of gini), and leaves keep their own rates, where the
    classifier merges neighbours that vote alike. Entropy has no such twin and keeps the classifier with its merged leaves."""
    entropy = task == "classification" and params.get("impurity") == "entropy"
    return classifier(seed=SEED, **params) if entropy else regressor(seed=SEED, **{k: v for k, v in params.items() if k != "impurity"})


# How a forest is computed, not what it is: rows keep their node of every tree, and a pass takes the nodes that fit into more memory.
FOREST_PASSES = {"cacheNodeIds": True, "checkpointInterval": -1, "maxMemoryInMB": 512}


def tree(task: str, **params):
    return _twin(task, DecisionTreeClassifier, DecisionTreeRegressor, params)


def forest(task: str, **params):
    return _twin(task, RandomForestClassifier, RandomForestRegressor, {**FOREST_PASSES, **params})


def gbt(task: str, **params):
    return (GBTClassifier if task == "classification" else GBTRegressor)(seed=SEED, **params)


# What the solver says of a singular information matrix.
SINGULAR = ("SingularMatrix", "singular", "No Std. Error", "No t-statistic", "No p-value")


def logit_inference(design_rows: DataFrame, cols: Sequence[str], y: str, se_limit: float = 10.0) -> tuple[list[dict], dict]:
    """Unpenalised logit with standard errors; terms with a huge SE are reported as quasi-separated."""
    names = [f"x{i}" for i in range(len(cols))]
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(
        design_rows.select(F.col(y).alias("_y"), *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names)])).select("_y", "features").persist()
    try:
        return _inference(vec, cols, se_limit)
    finally:
        vec.unpersist()


def _inference(vec: DataFrame, cols: Sequence[str], se_limit: float) -> tuple[list[dict], dict]:
    """Each step of the fit and each statistic reads all rows, which the caller holds."""
    def run(ridge):
        return GeneralizedLinearRegression(family="binomial", link="logit", labelCol="_y", regParam=ridge, maxIter=100, tol=1e-10).fit(vec)
    fallback = None
    try:
        model = run(0.0)
        se, p = model.summary.coefficientStandardErrors, model.summary.pValues
    except Exception as error:
        if not any(sign in str(error) for sign in SINGULAR):
            raise
        # Singular information matrix: negligible ridge, no standard errors available.
        model, fallback = run(1e-6), "ridge 1e-6"
        se = p = [float("nan")] * (len(cols) + 1)
    coef = [*model.coefficients, model.intercept]
    rows = [{"term": n, "coef": float(b), "se": float(s), "statistic": float(b) / s if s else float("nan"), "p_value": float(q),
             "ci_low": float(b) - 1.959963984540054 * s, "ci_high": float(b) + 1.959963984540054 * s}
            for n, b, s, q in zip([*cols, "const"], coef, se, p)]
    k = len(cols) + 1
    loglik = k - model.summary.aic / 2
    return rows, {"converged": fallback is None and model.summary.numIterations < 100, "fallback": fallback, "aic": model.summary.aic, "loglik": loglik,
                  "unstable": [r["term"] for r in rows if r["se"] > se_limit]}


# ---- folds ----

def fold_parts(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    part = folds.where(F.col("fold") == fold)
    return part.where("role = 'train'"), part.where("role = 'valid'")


FOLD_KEEP = ["order_id", "fold", "y", "label", "promised_lead_days"]


def fold_scores(specs: Sequence[Spec], folds: DataFrame, n_folds: int) -> DataFrame:
    """Validation scores of every model and fold with the outcome, as one table.

    Models with the same inputs share the encoded rows of a fold, which stay cached
    (and recomputable) while the candidates are fitted.
    """
    from .audits import union_all
    groups: dict[tuple, list[Spec]] = {}
    for s in specs:
        groups.setdefault((tuple(s.num_cols), tuple(s.cat_cols), s.scale, repr(s.options)), []).append(s)

    def prepare(job):
        key, i = job
        train, valid = fold_parts(folds, i)
        d = build_design(groups[key][0], train)
        return key, d, vectorise(d, train, ["y"]).persist(), vectorise(d, valid, FOLD_KEEP).persist()

    ready = in_parallel(prepare, [(k, i) for k in groups for i in range(1, n_folds + 1)])

    def one(job):
        spec, (_, d, train, valid) = job
        return fit_vectors(spec, d, train).score_vectors(valid, FOLD_KEEP).withColumn("model", F.lit(spec.name))

    shared_folder(folds.sparkSession)
    # Metrics read the scores more than once: keep them, not the model applications.
    out = union_all(in_parallel(one, [(s, r) for r in ready for s in groups[r[0]]])).checkpoint()
    for _, _, train, valid in ready:
        train.unpersist()
        valid.unpersist()
    return out


def cv_metrics(specs: Sequence[Spec], folds: DataFrame, n_folds: int) -> DataFrame:
    """(model, fold, metric...): one ranking job for all models and folds together."""
    scored = fold_scores(specs, folds, n_folds)
    if specs[0].task == "classification":
        return metrics.classification_metrics(scored.withColumn("label", F.col("y").cast("int")), ["model", "fold"])
    return metrics.regression_metrics(scored.withColumn("target", F.col("y")), ["model", "fold"])


def out_of_fold(spec: Spec, folds: DataFrame, rows: DataFrame, n_folds: int) -> DataFrame:
    """Validation-fold score per row; rows outside every validation block stay missing."""
    score = "p" if spec.task == "classification" else "days"
    return rows.select("order_id").join(fold_scores([spec], folds, n_folds).select("order_id", "fold", score), "order_id", "left")


# ---- searches ----

# Searched values, simplest first (tree depth is limited to 30 here).
TREE_SPACE = {"maxDepth": [2, 3, 4, 5, 6, 8, 10, 12, 16, 30], "minInstancesPerNode": [1, 5, 10, 20, 50, 100, 200, 500], "impurity": ["gini", "entropy"]}
FOREST_SPACE = {"maxDepth": [6, 8, 10, 12, 16, 20, 30], "minInstancesPerNode": [1, 2, 5, 10, 20, 50, 100, 200],
                "featureSubsetStrategy": ["log2", "sqrt", "0.2", "0.3", "0.5", "0.7", "1.0"], "subsamplingRate": [1.0, 0.5, 0.7, 0.9],
                "impurity": ["gini", "entropy"], "weight": [None, "balanced"]}


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, v)) for v in itertools.product(*space.values())]


def random_grid(space: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """``n`` distinct reproducible candidates."""
    import random
    every = grid(space)
    return random.Random(seed).sample(every, min(n, len(every)))


def neighbour_grid(space: Mapping[str, Sequence], best: Mapping[str, Any], keys: Sequence[str], width: int = 1, **fixed) -> list[dict]:
    """All points of the space at most ``width`` steps from the best along ``keys`` and equal to it elsewhere."""
    def steps(point: dict) -> bool:
        return all(abs(space[k].index(point[k]) - space[k].index(best[k])) <= width if k in keys else point[k] == best[k] for k in best)
    around = {k: space[k] if k in keys else [best[k]] for k in best}
    return [{**point, **extra} for point in grid(around) if steps(point) for extra in grid(fixed)]


CANDIDATE = "candidate string, fold int, score double"


def fold_scores_of(specs: Sequence[Spec], train: DataFrame, valid: DataFrame) -> list[float]:
    """Score of each fitted spec on the validation rows (average precision, or minus the root mean squared error); all models are applied in one
    pass, and their scores ranked or summed in one job."""
    def one(spec):
        return spec.estimator().setFeaturesCol("features").setLabelCol("y")

    def fit_one(spec):
        return fit_vectors(spec, None, train).model if spec.weight else one(spec).fit(train)
    models, scored = in_parallel(fit_one, specs), valid
    for i, (spec, model) in enumerate(zip(specs, models)):
        p = vector_to_array("probability")[1] if hasattr(model, "numClasses") else F.col("prediction")
        if spec.task == "regression":
            p = clip_to_waiting_period("prediction", "promised_lead_days", 45)
        scored = model.transform(scored).withColumn(f"s{i}", p).drop("prediction", "probability", "rawPrediction")
    long = scored.select("y", F.posexplode(F.array(*[f"s{i}" for i in range(len(specs))])).alias("model", "s"))
    if specs[0].task == "classification":
        found = logit.average_precision(long.withColumn("eta", F.col("s")), bins=4096)
        return [found.get(i, 0.0) for i in range(len(specs))]
    errors = dict(long.groupBy("model").agg(F.sqrt(F.avg(F.pow(F.col("s") - F.col("y"), 2)))).collect())
    return [-errors[i] for i in range(len(specs))]


def search(spec_of: Callable[[dict], Spec], candidates: Sequence[dict], folds: DataFrame, n_folds: int, path: str | None = None, at_once: int = 12) -> DataFrame:
    """candidate, fold, score: every candidate on every fold, from a table at `path` that grows by `at_once` candidates at a time.

    A search that was broken off goes on with the candidates that the table lacks. Each fold is encoded once for all of them.
    """
    import json
    spark = folds.sparkSession
    path = path or shared_path(spark, "search")
    names = [json.dumps(c, sort_keys=True) for c in candidates]
    done: set[tuple[str, int]] = set()
    if _exists(spark, path):
        done = {(r["candidate"], r["fold"]) for r in spark.read.schema(CANDIDATE).parquet(path).select("candidate", "fold").collect()}
    specs = {n: spec_of(c) for n, c in zip(names, candidates)}
    for fold in range(1, n_folds + 1):
        todo = [n for n in names if (n, fold) not in done]
        if not todo:
            continue
        train, valid = fold_parts(folds, fold)
        d = build_design(specs[todo[0]], train)
        rows, held = dealt(vectorise(d, train, ["y"])).persist(), dealt(vectorise(d, valid, ["y", "promised_lead_days"])).persist()
        for start in range(0, len(todo), at_once):
            some = todo[start:start + at_once]
            found = fold_scores_of([specs[n] for n in some], rows, held)
            spark.createDataFrame([(n, fold, float(v)) for n, v in zip(some, found)], CANDIDATE).coalesce(1).write.mode("append").parquet(path)
        rows.unpersist()
        held.unpersist()
    wanted = spark.createDataFrame([(n,) for n in names], "candidate string")
    return spark.read.schema(CANDIDATE).parquet(path).join(wanted, "candidate")


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def candidate_table(found: DataFrame, schema: str) -> DataFrame:
    """One row per candidate with its parameters (`schema`), mean_score and sd_score."""
    by = found.groupBy("candidate").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd_score"))
    return by.select(F.from_json("candidate", schema).alias("c"), "mean_score", "sd_score").select("c.*", "mean_score", "sd_score")


def mark_best(table: DataFrame, simplest: Sequence[Column], tol: float = 1e-4) -> DataFrame:
    """Adds ``best``: of the candidates within ``tol`` of the best mean, the first by `simplest`. One row per candidate."""
    everyone = Window.partitionBy()
    near = table.withColumn("_near", F.col("mean_score") >= F.max("mean_score").over(everyone) - tol)
    first = F.row_number().over(everyone.orderBy(F.desc("_near"), *simplest, F.desc("mean_score")))
    return near.withColumn("best", first == 1).drop("_near")


# ---- interpretation ----

def model_size(model) -> int:
    if hasattr(model, "coefficients"):
        return len(model.coefficients) + 1
    if hasattr(model, "trees"):
        return sum((t.numNodes + 1) // 2 for t in model.trees)
    return (model.numNodes + 1) // 2


def impurity_importance(f: Fitted) -> list[tuple[str, float]]:
    """Importance per raw feature (encoded columns of a categorical are added up)."""
    values = dict(zip(f.design.columns, f.model.featureImportances.toArray()))
    return sorted(((u, float(sum(values[c] for c in cols))) for u, cols in f.design.units.items()), key=lambda x: (-x[1], x[0]))


def shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """Copy with one column permuted: two hash orders of the same rows joined on position."""
    base = global_rank(df.withColumn("_h", hash_order("order_id", seed)), [F.col("_h"), F.col("order_id")]).drop("n", "_h", column)
    values = global_rank(df.select("order_id", column).withColumn("_h", hash_order("order_id", seed + 7919)), [F.col("_h"), F.col("order_id")])
    return base.join(values.select("rank", column), "rank").drop("rank")


def _names(design: Design, letter: str) -> list[str]:
    return [f"{letter}{i}" for i in range(len(design.columns))]


def _places(design: Design, features: Sequence[str]) -> dict[str, list[int]]:
    """feature -> places of its columns in the design."""
    at = {c: i for i, c in enumerate(design.columns)}
    return {u: [at[c] for c in design.units.get(u, [])] for u in features}


def _swapped(f: Fitted, both: DataFrame, keep: Sequence[str], features: Sequence[str], suffix: str, base: bool) -> DataFrame:
    """`keep`, run and score of the rows with each feature in turn taken from the struct `_v`."""
    d = f.design
    rest = [c for c in [*d.num_cols, *d.cat_cols] if c not in features]
    own = d.encode(dealt(both, len(features)).withColumn("_keep", F.struct(*keep, "_v", *rest)), keep=["_keep"]).toDF("_keep", *_names(d, "x"))
    held = own.select(F.struct(F.struct(*[F.col("_keep")[c].alias(c) for c in keep]).alias("k"), F.struct(*_names(d, "x")).alias("x")).alias("_held"),
                      *[F.col("_keep._v")[c].alias(c) for c in features], *[F.col("_keep")[c].alias(c) for c in rest])
    other = d.encode(held, keep=["_held"]).toDF("_held", *_names(d, "z"))
    rows = other.select("_held.k.*", "_held.x.*", *_names(d, "z"))
    score = "p" if f.spec.task == "classification" else "days"
    return rescoring.changed_scores(rows, f.model, len(d.columns), _places(d, features), keep, suffix, base).withColumnRenamed("score", score)


def permutation_importance(f: Fitted, df: DataFrame, features: Sequence[str], repeats: int = 5) -> DataFrame:
    """Drop in AP (or rise in RMSE) after permuting one raw feature, mean and sd over repeats."""
    cls = f.spec.task == "classification"
    keep = ["order_id", "y"]
    from .audits import union_all
    shared_folder(df.sparkSession)
    known = rescoring.averages_trees(f.model)
    runs = [] if known else [f.score(df, keep).withColumn("run", F.lit("base"))]
    for i, r in enumerate(range(repeats)):
        # One permutation of the rows serves every feature of the repeat.
        both = shuffled(df.withColumn("_v", F.struct(*features)), "_v", 1000 * r + i).checkpoint()
        if known:
            runs.append(_swapped(f, both, keep, features, f"|{r}", not runs))
            continue
        each = dealt(both, len(features)).withColumn("_f", F.explode(F.array(*[F.lit(c) for c in features])))
        made = each.withColumns({c: F.when(F.col("_f") == c, F.col("_v")[c]).otherwise(F.col(c)) for c in features})
        runs.append(f.score(made.withColumn("run", F.concat("_f", F.lit(f"|{r}"))), [*keep, "run"]))
    scored = union_all(runs).checkpoint()  # ranking and the base score read them again
    if cls:
        curve = metrics.score_curve(scored.withColumn("label", F.col("y").cast("int")), ["run"])
        value = metrics.ranking_scores(curve, ["run"]).select("run", F.col("avg_precision").alias("v"))
    else:
        value = scored.groupBy("run").agg((-F.sqrt(F.avg(F.pow(F.col("days") - F.col("y"), 2)))).alias("v"))
    base = value.where("run = 'base'").first()["v"]
    drop = value.where("run <> 'base'").select(F.split_part("run", F.lit("|"), F.lit(1)).alias("feature"), (F.lit(base) - F.col("v")).alias("d"))
    table = drop.groupBy("feature").agg(F.avg("d").alias("importance_mean"), F.stddev_pop("d").alias("importance_sd"))
    # One row per feature.
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature")))


def dependence_grids(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), points: int = 20) -> dict[str, list]:
    """Values of each feature: its levels, its distinct values if there are at most `points`, else even steps from the 5 % to the 95 % quantile."""
    few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in numeric]).first() if numeric else {}
    out: dict[str, list] = {}
    wide = []
    for c in numeric:
        values = [r[0] for r in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).distinct().limit(points + 1).collect()] if few[c] <= 2 * points else []
        if values and len(values) <= points:
            out[c] = sorted(values)
        else:
            wide.append(c)
    if wide:
        edges = {r["variable"]: (r["lo"], r["hi"]) for r in exact_quantiles(df, [], wide, {"lo": 0.05, "hi": 0.95}).collect()}
        for c in wide:
            if c in edges:
                lo, hi = edges[c]
                out[c] = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    return out | {c: [v for v, _ in levels] for c, levels in category_counts(df, categorical).items()} if categorical else out


def partial_dependence(f: Fitted, df: DataFrame, grids: Mapping[str, Sequence]) -> DataFrame:
    """feature, value, average: mean prediction over the given rows with one feature set to each of its values; one scoring pass for all."""
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(None if isinstance(v, str) else float(v)).cast("double").alias("number"),
                      F.lit(v if isinstance(v, str) else None).cast("string").alias("level")) for c, values in grids.items() for v in values]
    kinds = dict(df.dtypes)
    if rescoring.averages_trees(f.model) and cells:
        return _dependence_of_trees(f, df, grids, cells, kinds)
    each = dealt(df, len(cells)).withColumn("_g", F.explode(F.array(*cells)))
    made = each.withColumns({c: F.when(F.col("_g.feature") == c, F.col("_g.level") if kinds[c] == "string" else F.col("_g.number")).otherwise(F.col(c)) for c in grids})
    target = "p" if f.spec.task == "classification" else "days"
    value = F.coalesce("_g.level", F.col("_g.number").cast("string"))
    scored = f.score(made.withColumns({"_feature": F.col("_g.feature"), "_value": value}), ["_feature", "_value"])
    return scored.groupBy(F.col("_feature").alias("feature"), F.col("_value").alias("value")).agg(F.avg(target).alias("average"))


def _dependence_of_trees(f: Fitted, df: DataFrame, grids: Mapping[str, Sequence], cells: Sequence[Column], kinds: Mapping[str, str]) -> DataFrame:
    """The same averages from one walk of each row through each tree and feature, for all values of the feature together."""
    d, spark = f.design, df.sparkSession
    shared_folder(spark)
    one = spark.range(1).select(F.posexplode(F.array(*cells)).alias("_at", "_g"))
    asked = one.select(F.struct("_at", F.col("_g.feature").alias("feature"), F.coalesce("_g.level", F.col("_g.number").cast("string")).alias("value")).alias("_cell"), *[
        F.when(F.col("_g.feature") == c, F.col("_g.level") if kinds[c] == "string" else F.col("_g.number")).alias(c) if c in grids else F.lit(None).cast(kinds[c]).alias(c)
        for c in [*d.num_cols, *d.cat_cols]])
    found = d.encode(asked, keep=["_cell"]).toDF("_cell", *_names(d, "x")).orderBy("_cell._at").collect()
    places, wanted, labels_of = _places(d, list(grids)), {}, {}
    for c in grids:
        mine = {r["_cell"]["value"]: [r[f"x{i}"] for i in places[c]] for r in found if r["_cell"]["feature"] == c}
        if mine:
            labels_of[c], wanted[c] = list(mine), (places[c], np.array(list(mine.values()), float).reshape(len(mine), -1))
    rows = d.encode(dealt(df, len(cells))).toDF(*_names(d, "x"))
    totals, n = rescoring.grid_totals(rows, f.model, len(d.columns), wanted)
    table = [(c, v, float(t) / n) for c, values in labels_of.items() for v, t in zip(values, totals[c])] if n else []
    return spark.createDataFrame(table, "feature string, value string, average double")


# ---- class balance ----

def undersample(df: DataFrame, y: str = "y", seed: int = SEED) -> DataFrame:
    """Majority rows cut to the minority count by hash rank."""
    ranked = global_rank(df.withColumn("_h", hash_order("order_id", seed)), [F.col("_h"), F.col("order_id")], [y])
    smallest = df.groupBy(y).count().agg(F.min("count")).first()[0]
    return ranked.where(F.col("rank") <= smallest).drop("_h", "rank", "n")


def _copies(df: DataFrame, y: str, seed: int) -> tuple[DataFrame, dict]:
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    return global_rank(df.withColumn("_h", hash_order("order_id", seed)), [F.col("_h"), F.col("order_id")], [y]), counts


def oversample(df: DataFrame, y: str = "y", seed: int = SEED) -> DataFrame:
    """Minority rows repeated to the majority count: whole rounds, then the first rows by hash."""
    ranked, counts = _copies(df, y, seed)
    top = max(counts.values())
    whole = F.floor(F.lit(top) / F.col("n"))
    times = (whole + (F.col("rank") <= F.lit(top) - whole * F.col("n")).cast("bigint")).cast("int")
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_h", "rank", "n")


def flag_columns(df: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Numeric columns that hold 0 and 1 only (nulls aside)."""
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False)).alias(f"b{i}") for i, c in enumerate(numeric)]).first()
    return [c for i, c in enumerate(numeric) if row[f"b{i}"]]


def synthetic_minority(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y", k: int = 5, seed: int = SEED) -> DataFrame:
    """Balanced rows with interpolated minority rows added.

    Neighbours are the ``k`` nearest minority rows by squared distance, where a differing level or 0/1 flag
    counts half the squared median deviation of the numbers. Numbers (median-filled) are interpolated towards one neighbour,
    levels and flags take the neighbours' most frequent value (ties: the smallest; no neighbour: the row's own). New rows have
    negative ids. A table of one class comes back as it is.
    """
    columns = ["order_id", y, *[F.col(c).cast("double").alias(c) for c in numeric], *categorical]
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    if len(counts) < 2:
        return df.select(*columns)
    low = min(counts, key=lambda v: (counts[v], -v))
    need = max(counts.values()) - counts[low]
    flags = flag_columns(df, numeric)
    moving, levels = [c for c in numeric if c not in flags], [*flags, *categorical]
    medians = {r["variable"]: r["m"] for r in exact_quantiles(df, [], numeric, {"m": 0.5}).collect()} if numeric else {}
    filled = df.select("order_id", y, *[F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(c) for c in numeric], *categorical)
    minority = filled.where(F.col(y) == low)
    spread = sorted(minority.agg(*[F.stddev_pop(c) for c in moving]).first()) if moving else [1.0]
    mismatch = ((spread[(len(spread) - 1) // 2] + spread[len(spread) // 2]) / 2) ** 2 / 2
    path = shared_path(df.sparkSession, "neighbours")
    nearest(minority, "order_id", moving, levels, mismatch, k, seed=seed).write.parquet(path)
    near = df.sparkSession.read.parquet(path)
    common = near.select("id", F.explode("near").alias("order_id")).join(minority.select("order_id", *levels), "order_id") \
        .groupBy("id").agg(*[F.mode(c, True).alias(f"_{c}") for c in levels], F.count(F.lit(1)).alias("_seen"))
    times = F.ceil(F.lit(need) / F.lit(counts[low])).cast("int")
    made = global_rank(near.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).withColumn("_h", F.xxhash64("id", "_copy", F.lit(seed))),
                       [F.col("_h"), F.col("id"), F.col("_copy")]).where(F.col("rank") <= need)
    pick = F.element_at(F.when(F.size("near") > 0, F.col("near")).otherwise(F.array("id")), (F.pmod(F.xxhash64("_h", F.lit(1)), F.greatest(F.size("near"), F.lit(1))) + 1).cast("int"))
    step = F.pmod(F.xxhash64("_h", F.lit(2)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    made = made.select("id", F.col("rank"), pick.alias("_pick"), step.alias("_step"))
    own = minority.withColumnRenamed("order_id", "id")
    other = minority.select(F.col("order_id").alias("_pick"), *[F.col(c).alias(f"_to_{c}") for c in moving])
    joined = made.join(own, "id").join(other, "_pick").join(common, "id", "left")
    new = joined.select((-F.col("rank")).alias("order_id"), y, *[(F.col(c) + F.col("_step") * (F.col(f"_to_{c}") - F.col(c))).alias(c) if c in moving
                        else F.when(F.col("_seen").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [*numeric, *categorical]])
    return df.select(*columns).unionByName(new)


STRATEGIES = {"none": lambda rows, num, cat: rows, "undersample": lambda rows, num, cat: undersample(rows),
              "oversample": lambda rows, num, cat: oversample(rows), "smotenc": synthetic_minority}
FOLD_METRICS = ["avg_precision", "roc_auc", "brier", "precision_top10", "recall_top10", "top10_lift"]


def resampled_scores(specs: Sequence[Spec], train: DataFrame, valid: DataFrame, num: Sequence[str], cat: Sequence[str], strategy: str, fold: int) -> DataFrame:
    """(model, strategy, fold, order_id, y, p): all models fitted on the same resampled training rows, scored on untouched ones."""
    path = shared_path(train.sparkSession, f"resampled-{strategy}")
    STRATEGIES[strategy](train, num, cat).write.parquet(path)
    rows = train.sparkSession.read.parquet(path)
    parts = [fit(s, rows).score(valid, ["order_id", "y"]).select(F.lit(s.name).alias("model"), F.lit(strategy).alias("strategy"), F.lit(fold).alias("fold"), "order_id", "y", "p") for s in specs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resampling_summary(scored: DataFrame) -> DataFrame:
    """One row per model and strategy from ``resampled_scores``; fold 0 is the fit on all training rows, scored on Validation.

    Fold means and deviations (``cv_``), Validation scores with the mean probability and late rate (``val_``), the mean paired
    gain in average precision over no resampling with its standard error, and whether the gain exceeds twice that error.
    """
    by = ["model", "strategy"]
    table = metrics.classification_metrics(scored.withColumn("label", F.col("y").cast("int")), [*by, "fold"])
    base = table.where("strategy = 'none'").select("model", "fold", F.col("avg_precision").alias("_base"))
    gain = F.col("avg_precision") - F.col("_base")
    cv = table.where("fold > 0").join(base, ["model", "fold"], "left").groupBy(by).agg(
        *[f(c).alias(f"cv_{c}_{name}") for c in FOLD_METRICS for f, name in ((F.avg, "mean"), (F.stddev_samp, "sd"))],
        F.avg(gain).alias("ap_gain_vs_none"), ratio(F.stddev_samp(gain), F.sqrt(F.count(gain))).alias("ap_gain_se"))
    chance = scored.where("fold = 0").groupBy(by).agg(F.avg("p").alias("val_mean_probability"))
    val = table.where("fold = 0").select(*by, *[F.col(c).alias(f"val_{c}") for c in [*FOLD_METRICS, "late_rate"]])
    return cv.join(val, by, "left").join(chance, by, "left").withColumn(
        "clear_ap_gain", F.coalesce((F.col("strategy") != "none") & (F.col("ap_gain_vs_none") > 2 * F.col("ap_gain_se")), F.lit(False)))


def bulk_score(f: Fitted, df: DataFrame, numeric: Sequence[str], categories: Mapping[str, Sequence[str]], others: Sequence[str] | None = None) -> DataFrame:
    """Scores of valid rows plus rejected rows with their reasons and no score. With ``others``, unknown columns are refused."""
    from .contract import split_valid, validate
    good, bad = split_valid(validate(df, numeric, categories, others))
    target = "p" if f.spec.task == "classification" else "days"
    ok = f.score(good, ["order_id"]).withColumn("violations", F.array().cast("array<string>"))
    return ok.unionByName(bad.select("order_id", F.lit(None).cast("double").alias(target), "violations"))


def monthly_refits(encode: Callable[[DataFrame], tuple[DataFrame, Mapping[str, Sequence[str]]]], rows: DataFrame, months: Sequence[str],
                   lookback: int = 45, window_days: int = 365) -> DataFrame:
    """model (place of the month), order_id, label and p of every month's eligible orders, scored by the logit fitted on the second day of the month.

    A refit trains on the window's orders whose label was known by then. Labels never change once known, and windows move forward, so the refits
    that use an order are consecutive: rows are stored once with the first and the last of them, and all refits run in the same passes.
    `encode` gives the rows with numeric columns (null for missing) and the columns of each unit.
    """
    runs = F.array(*[F.lit(dt.date.fromisoformat(f"{m}-02")) for m in months])
    approved = day("approved_at")
    known = F.greatest(F.least(day("delivered_at"), day("estimated_at")), F.date_add(approved, lookback))  # the last day before the first refit
    own = ["label_status", "delivered_by_run"]
    later = labels.labels_as_of(rows, F.date_add(approved, lookback + 1)).withColumnRenamed("label", "later").drop(*own)
    ended = labels.labels_as_of(later, F.date_add(known, 1)).drop(*own)
    trains = ~F.col("order_status").isin(labels.EXCLUDED_STATUSES) & F.col("label").isNotNull()
    open_then = F.col("delivered_at").isNull() | (day("delivered_at") > approved)
    scored = open_then & ~F.col("order_status").isin(labels.EXCLUDED_STATUSES)
    wide, units = encode(ended.withColumns({
        "_lo": F.when(trains, F.size(F.filter(runs, lambda r: r <= known))).otherwise(1),
        "_hi": F.when(trains, F.size(F.filter(runs, lambda r: r <= F.date_add(approved, lookback + window_days))) - 1).otherwise(0),
        "_valid": F.when(scored, F.array_position(F.transform(runs, lambda r: F.date_format(r, "yyyy-MM")), month_label("approved_at")) - 1)}))
    columns = [c for cols in units.values() for c in cols]
    held = logit.raw_rows(wide, columns, F.col("_lo"), F.col("_hi"), F.when(F.col("_valid") >= 0, F.col("_valid")), F.col("label"), [F.col("order_id"), F.col("later")])
    shared_folder(rows.sparkSession)
    ready = logit.prepare(held.checkpoint(), len(columns), range(len(months)))
    models = logit.fit_many(ready, [logit.Model(tuple(range(len(columns))), f) for f in range(len(months))])
    out = logit.scores(ready, models, keep=["order_id", "later"])
    return out.select("model", "order_id", F.col("later").alias("label"), (1 / (1 + F.exp(-F.col("eta")))).alias("p"))

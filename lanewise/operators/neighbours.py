"""Nearest rows of mixed type without all pairs: random-projection trees grown in Spark, then neighbours of neighbours."""
from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import share_code, shared_path

# A cell at most this large is compared whole; a larger one is cut into at most WAYS parts a round.
LEAF, WAYS, ROUNDS = 512, 16, 12


def distance(numbers: tuple, levels: tuple, mismatch: float) -> Column:
    """Squared Euclidean distance of two number arrays plus ``mismatch`` for each pair of levels that differ."""
    far = F.aggregate(F.zip_with(*numbers, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return far + F.lit(float(mismatch)) * F.size(F.filter(F.zip_with(*levels, lambda a, b: a != b), lambda x: x))


def _projection(n_numbers: int, n_levels: int, trees: int, mismatch: float, rng: random.Random, turn: int) -> Column:
    """One random direction per tree; a level counts as a coordinate of its own with a hashed coefficient."""
    total = F.lit(0.0)
    for i in range(n_numbers):
        total = total + F.col("v")[i] * F.element_at(F.array(*[F.lit(rng.gauss(0, 1)) for _ in range(trees)]), F.col("tree") + 1)
    for i in range(n_levels):
        unit = F.pmod(F.xxhash64(F.col("c")[i], F.lit(i), "tree", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        total = total + (unit - 0.5) * F.lit(12 ** 0.5 * (mismatch / 2) ** 0.5)
    return total


def _cells(rows: DataFrame, n_numbers: int, n_levels: int, trees: int, mismatch: float, leaf: int, seed: int) -> DataFrame:
    """Every row once per tree with its cell of at most about ``leaf`` rows.

    Each round cuts all large cells at quantiles of a fresh projection; rows that no projection separates (copies)
    are at distance 0 of each other and are cut by a hash. Rounds are written to the shared folder.
    """
    spark, rng = rows.sparkSession, random.Random(seed)
    placed = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("cell", F.xxhash64("tree"))
    cuts = [(i + 1) / WAYS for i in range(WAYS - 1)]
    for turn in range(ROUNDS):
        x = placed.withColumn("_x", _projection(n_numbers, n_levels, trees, mismatch, rng, turn))
        large = x.groupBy("tree", "cell").agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", cuts, 2000).alias("_cuts"), (F.min("_x") == F.max("_x")).alias("_same")) \
            .where(F.col("_n") > leaf)
        path = shared_path(spark, "cells")
        part = F.when(F.col("_same"), F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(WAYS)).cast("int")) \
            .otherwise(F.size(F.filter("_cuts", lambda q: q < F.col("_x"))))
        ways = F.least(F.lit(WAYS), F.pow(F.lit(2), F.ceil(F.log2(F.col("_n") / F.lit(leaf)))).cast("int"))
        cell = F.when(F.col("_n").isNotNull(), F.xxhash64("cell", F.floor(part * ways / F.lit(WAYS)))).otherwise(F.col("cell"))
        x.join(large, ["tree", "cell"], "left").select("id", "v", "c", "tree", cell.alias("cell"), F.col("_n").isNotNull().alias("_open")).write.parquet(path)
        placed = spark.read.parquet(path)
        if placed.where("_open").isEmpty():
            break
        placed = placed.drop("_open")
    return placed.select("id", "v", "c", "tree", "cell")


def _inside(mismatch: float, k: int):
    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id")
        ids, v = cell["id"].to_numpy(), np.array(cell["v"].tolist(), dtype=float).reshape(len(cell), -1)
        c = np.array(cell["c"].tolist(), dtype=object).reshape(len(cell), -1)
        found = []
        for i in range(len(cell)):
            d = ((v - v[i]) ** 2).sum(1) + mismatch * (c != c[i]).sum(1)
            d[i] = np.inf
            # Rows lie in order of their id, so the stable sort settles ties by id.
            best = np.argsort(d, kind="stable")[:min(k, len(cell) - 1)]
            found.append(pd.DataFrame({"id": ids[i], "other": ids[best], "d": d[best]}))
        return pd.concat(found)
    return compare


def _closest(pairs: DataFrame, k: int) -> DataFrame:
    """(id, near): the ``k`` closest others of each row, ties by id; a row sees a bounded number of candidates."""
    ranked = F.array_sort(F.collect_set(F.struct("d", "other")))
    return pairs.groupBy("id").agg(F.slice(F.array_distinct(F.transform(ranked, lambda s: s["other"])), 1, k).alias("near"))


def nearest(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], mismatch: float, k: int = 5, trees: int = 8,
            passes: int = 1, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """(id, near): about the ``k`` nearest other rows by ``distance``, closest first.

    Numbers must not be null; a null level is a level of its own. Every row lies in one cell of each tree and is compared with
    that cell; each pass then compares it with the neighbours of its neighbours. A table of one row has an empty list. ``key`` is unique.
    """
    share_code(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("v"),
                     F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in categorical]).cast("array<string>").alias("c"))
    kind = rows.schema["id"].dataType.simpleString()
    cells = _cells(rows, len(numeric), len(categorical), trees, mismatch, leaf, seed)
    near = _closest(cells.groupBy("tree", "cell").applyInPandas(_inside(mismatch, k), f"id {kind}, other {kind}, d double"), k)
    for _ in range(passes):
        path = shared_path(df.sparkSession, "near")
        near.write.parquet(path)
        near = df.sparkSession.read.parquet(path)
        known = near.select("id", F.explode("near").alias("other"))
        second = known.join(near.select(F.col("id").alias("other"), F.col("near").alias("_next")), "other").select("id", F.explode("_next").alias("other"))
        pairs = known.unionByName(second).where("id != other").distinct()
        far = pairs.join(rows.select("id", F.col("v").alias("_v"), F.col("c").alias("_c")), "id") \
            .join(rows.select(F.col("id").alias("other"), "v", "c"), "other")
        near = _closest(far.select("id", "other", distance(("v", "_v"), ("c", "_c"), mismatch).alias("d")), k)
    return rows.select("id").join(near, "id", "left").select("id", F.coalesce("near", F.array().cast(f"array<{kind}>")).alias("near"))

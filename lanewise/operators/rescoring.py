"""Scores of trees and forests when the columns of one feature change: only trees whose path meets the feature are walked again, from there."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import share_code, shared_path

BATCH, CELLS = 8_192, 60  # rows walked at once; grid values that fit into the bits of a number


@dataclass
class Walk:
    """One tree: column (-1 at leaves), threshold, children (left, right; leaves are their own), value and leaf number of each node; `first` has,
    for each unit and leaf number, the topmost node on its path that asks a column of the unit, or -1."""
    column: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        flat, start = x.ravel(), row * x.shape[1]
        for _ in range(self.depth):
            node = self.child[node, (flat[start + self.column[node]] > self.threshold[node]).view(np.int8)]
        return node


def averages_trees(model) -> bool:
    """Whether the model's score is the mean of the values of its trees' leaves."""
    return type(model).__name__ in ("DecisionTreeRegressionModel", "RandomForestRegressionModel")


def walks(spark, model, units: Sequence[Sequence[int]]) -> list[Walk]:
    """The trees of a fitted model from its stored nodes; `units` are the places of each unit's columns."""
    path = shared_path(spark, "forest")
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in stored.columns else ""
    tree = F.col("treeID") if node else F.lit(0)
    split = f"{node}split"
    rows = stored.select(tree.cast("int").alias("tree"), F.col(f"{node}id").alias("id"), F.col(f"{node}leftChild").alias("left"), F.col(f"{node}rightChild").alias("right"),
                         F.col(f"{node}prediction").alias("value"), F.col(f"{split}.featureIndex").alias("column"),
                         F.get(F.col(f"{split}.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold")).toArrow()
    rows = rows.sort_by([("tree", "ascending"), ("id", "ascending")])
    each = {c: rows[c].to_numpy() for c in rows.column_names}
    of = np.full(max(int(each["column"].max()), *(max(u, default=0) for u in units), 0) + 1, -1)
    for i, places in enumerate(units):
        of[list(places)] = i
    bounds = np.searchsorted(each["tree"], np.arange(int(each["tree"].max()) + 2))
    return [_walk({c: v[a:b] for c, v in each.items()}, of, len(units)) for a, b in zip(bounds[:-1], bounds[1:])]


def _walk(nodes: Mapping[str, np.ndarray], unit_of: np.ndarray, units: int) -> Walk:
    n, inner = len(nodes["id"]), nodes["left"] >= 0
    own = np.arange(n)
    child = np.column_stack([np.where(inner, nodes["left"], own), np.where(inner, nodes["right"], own)])
    small = np.int16 if n < 2 ** 15 else np.int32  # every worker holds the forest
    column = np.where(inner, nodes["column"], 0).astype(np.int32)
    threshold = np.where(inner, np.nan_to_num(nodes["threshold"].astype(float), nan=0.0), np.inf)
    first, depth = np.full((units, n), -1, small), 0
    level = np.array([0])
    while len(level := level[inner[level]]):  # a node's first places are its parent's, and itself for its own unit
        depth += 1
        held = first[:, level]
        mine = unit_of[column[level]]
        new = np.flatnonzero((mine >= 0) & (held[np.maximum(mine, 0), np.arange(len(level))] < 0))
        held[mine[new], new] = level[new]
        for side in (0, 1):
            first[:, child[level, side]] = held
        level = child[level].ravel()
    leaf = np.where(inner, -1, np.cumsum(~inner) - 1).astype(small)
    return Walk(column, threshold, child.astype(small), nodes["value"].astype(float), leaf, np.ascontiguousarray(first[:, ~inner]), depth)


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in names])


def _some(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, BATCH):
            yield b.slice(start, BATCH)


def changed_scores(rows: DataFrame, model, width: int, units: Mapping[str, Sequence[int]], keep: Sequence[str], suffix: str, base: bool) -> DataFrame:
    """`keep`, run and score: each row's mean leaf value with the columns of one unit taken from z instead of x, a row for each unit (run: unit
    and `suffix`), and with none (run 'base') if asked. Values are added tree by tree, as the model adds them."""
    spark = rows.sparkSession
    share_code(spark)
    names, places = list(units), list(units.values())
    shared = spark.sparkContext.broadcast(walks(spark, model, places))
    xs, zs = [f"x{i}" for i in range(width)], [f"z{i}" for i in range(width)]

    def one(batches):
        trees = shared.value
        for b in _some(batches):
            x, z, n = _matrix(b, xs), _matrix(b, zs), b.num_rows
            swapped = []
            for columns in places:
                other = x.copy()
                other[:, list(columns)] = z[:, list(columns)]
                swapped.append(other)
            total = np.zeros((len(places) + 1, n))
            every = np.arange(n)
            for t in trees:
                leaf = t.leaves(x, every, np.zeros(n, np.int64))
                value, number = t.value[leaf], t.leaf[leaf]
                total[-1] += value
                for i, other in enumerate(swapped):
                    start = t.first[i, number]
                    again = np.flatnonzero(start >= 0)
                    got = value
                    if len(again):
                        got = value.copy()
                        got[again] = t.value[t.leaves(other, again, start[again])]
                    total[i] += got
            total /= len(trees)
            for i, name in enumerate([f"{u}{suffix}" for u in names] + ["base"] * base):
                yield pa.record_batch([*[b[c] for c in keep], pa.array([name] * n), pa.array(total[i] if name != "base" else total[-1])], names=[*keep, "run", "score"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "run string", "score double"]))


def grid_totals(rows: DataFrame, model, width: int, grids: Mapping[str, tuple[Sequence[int], np.ndarray]]) -> tuple[dict[str, np.ndarray], int]:
    """unit -> sum of the scores of all rows (columns x0, x1, ...) with the unit's columns set to each row of its grid; and the number of rows.

    A row goes through a tree once with the set of grid values that get there, and parts only where the unit is asked.
    """
    spark = rows.sparkSession
    share_code(spark)
    jobs = [(u, list(places), values[a:a + CELLS], a) for u, (places, values) in grids.items() for a in range(0, len(values), CELLS)]
    units = [places for _, places, _, _ in jobs]
    each = [list(u) for u in dict.fromkeys(map(tuple, units))]
    shared = spark.sparkContext.broadcast(walks(spark, model, each))
    which = [each.index(places) for places in units]
    xs = [f"x{i}" for i in range(width)]

    def one(batches):
        held, n = shared.value, 0
        total = [np.zeros(len(values)) for _, _, values, _ in jobs]
        for b in _some(batches):
            x, n = _matrix(b, xs), n + b.num_rows
            for t in held:
                leaf = t.leaves(x, np.arange(len(x)), np.zeros(len(x), np.int64))
                for i, (_, places, values, _) in enumerate(jobs):
                    total[i] += _spread(t, which[i], x, leaf, places, values)
        yield pa.record_batch([pa.array([n]), pa.array([np.concatenate(total) / len(held)], pa.list_(pa.float64()))], names=["n", "totals"])
    found = rows.mapInArrow(one, "n long, totals array<double>").collect()
    sums = np.sum([r["totals"] for r in found], axis=0) if found else np.zeros(sum(len(j[2]) for j in jobs))
    out, at = {}, 0
    for unit, _, values, _ in jobs:
        out[unit] = np.concatenate([out.get(unit, np.zeros(0)), sums[at:at + len(values)]])
        at += len(values)
    return out, sum(r["n"] for r in found)


def _spread(t: Walk, unit: int, x: np.ndarray, leaf: np.ndarray, places: Sequence[int], values: np.ndarray) -> np.ndarray:
    """Sum over the rows of the tree's value for each grid value."""
    start = t.first[unit, t.leaf[leaf]]
    same = start < 0
    out = np.full(len(values), t.value[leaf[same]].sum())
    row = np.flatnonzero(~same)
    node, full = start[row].astype(np.int64), (1 << len(values)) - 1
    mask = np.full(len(row), full, np.int64)
    asked = np.zeros(x.shape[1], bool)
    asked[list(places)] = True
    own = asked[t.column] & np.isfinite(t.threshold)
    goes = np.zeros(len(own), np.int64)  # the grid values that go left at the unit's own nodes
    where = {c: i for i, c in enumerate(places)}
    some = np.flatnonzero(own)
    if len(some):
        left = values[:, [where[c] for c in t.column[some]]] <= t.threshold[some]
        goes[some] = (left * (np.int64(1) << np.arange(len(values)))[:, None]).sum(0)
    flat, width = x.ravel(), x.shape[1]
    ended_value, ended_mask = [], []
    while len(row):
        mine = own[node]
        right = flat[row * width + t.column[node]] > t.threshold[node]
        lefts, rights = np.where(mine, mask & goes[node], np.where(right, 0, mask)), np.where(mine, mask & ~goes[node], np.where(right, mask, 0))
        a, b = np.flatnonzero(lefts), np.flatnonzero(rights)
        row, mask, node = np.concatenate([row[a], row[b]]), np.concatenate([lefts[a], rights[b]]), np.concatenate([t.child[node[a], 0], t.child[node[b], 1]])
        end = t.child[node, 0] == node
        ended_value.append(t.value[node[end]])
        ended_mask.append(mask[end])
        row, mask, node = row[~end], mask[~end], node[~end]
    if ended_value:
        value, mask = np.concatenate(ended_value), np.concatenate(ended_mask)
        out += [value[(mask >> k & 1).astype(bool)].sum() for k in range(len(values))]
    return out

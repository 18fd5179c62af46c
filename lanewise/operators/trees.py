"""Nested trees: one deep tree per leaf size, impurity and fold gives every shallower tree by cutting.

A split does not depend on the depth limit, so the tree of depth d is the deep tree cut at d, with the mean of the training rows below
each cut as its score. Rows are counted per leaf of the deep trees, in one pass for all trees of a fold; everything after that works on
those leaf counts, whose number is bounded by the trees that the driver holds anyway.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from . import growth
from .design import Design
from .ml import build_design, dealt, fold_parts, in_parallel

DEEPEST = 30


@dataclass
class Leaves:
    """Parent and depth of a tree's nodes (the root is its own parent), and the leaves in the order of their numbers."""
    parent: np.ndarray
    level: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> np.ndarray:
        return self.level[self.leaf]

    def cut(self, depth: int) -> np.ndarray:
        """The node that stands for each leaf once the tree is cut at `depth`."""
        at = self.leaf
        for _ in range(int(max(self.level.max() - depth, 0))):
            at = np.where(self.level[at] > depth, self.parent[at], at)
        return at

    def count(self, depth: int) -> int:
        return len(np.unique(self.cut(depth)))


def _numbers(values: Sequence[int]) -> np.ndarray:
    return np.array(values, dtype=np.int32)


def leaves_of(debug: str) -> Leaves:
    """Leaves from a tree's printed rules, which show each node indented by its depth; for small trees."""
    parent, level, leaves, open_nodes = [0], [0], [], [0]
    for line in debug.splitlines()[1:]:
        text = line.lstrip()
        depth = len(line) - len(text) - 2
        if text.startswith(("If", "Else")):
            open_nodes[depth + 1:] = [len(parent)]
            parent.append(open_nodes[depth])
            level.append(depth + 1)
        elif text.startswith("Predict"):
            leaves.append(open_nodes[depth])
    return Leaves(_numbers(parent), _numbers(level), _numbers(leaves))


def model_leaves(spark, model) -> Leaves:
    """Leaves of a fitted tree from its stored nodes: a few numbers a node, where the printed rules of a deep tree take about a kilobyte a leaf.

    A node is numbered before its left part and that before its right one, so leaves in order of their nodes are in order of their numbers.
    """
    path = shared_path(spark, "tree")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("id", "leftChild", "rightChild").toArrow()
    of, left, right = (nodes[c].to_numpy() for c in nodes.column_names)
    parent, level = np.zeros(len(of), np.int32), np.zeros(len(of), np.int32)
    inner = left >= 0
    parent[left[inner]], parent[right[inner]] = of[inner], of[inner]
    above = parent.copy()
    while above.any():  # one round for each level of the tree
        level += above > 0
        above = parent[above]
    level[1:] += 1  # nodes below the root have it above them too
    return Leaves(parent, level, np.sort(of[~inner]).astype(np.int32))


@dataclass
class DeepTree:
    name: str
    fold: int
    leaves: Leaves
    model: object


def _flat(design: Design, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """y and the encoded columns under names that cannot clash."""
    names = [f"x{i}" for i in range(len(design.columns))]
    held = df.withColumn("_keep", F.struct("y"))
    return design.encode(held, keep=["_keep"]).toDF("_keep", *names).select(F.col("_keep.y").cast("double").alias("y"), *names), names


def _tree_of(nodes: Mapping[str, np.ndarray], i: int, kind: growth.Kind) -> tuple[Leaves, np.ndarray]:
    """Leaves of the tree of one kind and their rows (rows, sum, squares of training, then of asked rows): its joint nodes, less sibling leaves
    of one prediction, which are merged."""
    mine = np.flatnonzero(nodes["mask"] >> i & 1)
    parent, level = np.searchsorted(nodes["id"][mine], nodes["parent"][mine]), nodes["level"][mine]
    stats = np.column_stack([nodes[c][mine] for c in ("n", "total", "squares", "asked", "asked_total", "asked_squares")])
    n, total = stats[:, 0], stats[:, 1]
    says = total / np.maximum(n, 1) if kind.impurity == "variance" else (total > n - total).astype(float)
    leaf, kept = np.ones(len(mine), bool), np.ones(len(mine), bool)
    leaf[parent[1:]] = False
    left = np.arange(1, len(mine), 2)  # after the root, nodes come as pairs of siblings
    for depth in range(int(level.max()), 0, -1):
        pair = left[level[left] == depth]
        pair = pair[leaf[pair] & leaf[pair + 1] & (says[pair] == says[pair + 1])]
        leaf[parent[pair]] = True
        leaf[pair] = leaf[pair + 1] = kept[pair] = kept[pair + 1] = False
    number = np.cumsum(kept) - 1
    ends = np.flatnonzero(leaf)
    return Leaves(_numbers(number[parent[kept]]), _numbers(level[kept]), _numbers(number[ends])), stats[ends]


def _counts(tree: int, stats: np.ndarray) -> list[pa.Table]:
    """tree (its place), valid, leaf, n, total, squares: rows per leaf of one tree."""
    out = []
    for valid, some in ((False, stats[:, :3]), (True, stats[:, 3:])):
        leaf = np.flatnonzero(some[:, 0])
        out.append(pa.table({"tree": np.full(len(leaf), tree), "leaf": leaf, "n": some[leaf, 0].astype(np.int64), "total": some[leaf, 1],
                             "squares": some[leaf, 2], "valid": np.full(len(leaf), valid)}))
    return out


def deep_trees(spec_of: Callable[..., object], grid: Sequence[Mapping], train: DataFrame, valid: DataFrame | None, fold: int) -> tuple[list[DeepTree], pa.Table]:
    """The deep tree of every grid point on one fold, and the leaf counts of its training and validation rows; all trees grow together."""
    specs = [(f"{g['minInstancesPerNode']}|{g['impurity']}", spec_of(maxDepth=DEEPEST, **g)) for g in grid]
    made = [spec.estimator() for _, spec in specs]
    kinds = [growth.Kind(e.getMinInstancesPerNode(), e.getImpurity()) for e in made]
    d = build_design(specs[0][1], train)
    flat, names = _flat(d, train)
    rows = dealt(flat).persist()
    n = rows.count()
    if not n:
        raise ValueError(f"fold {fold} has no training rows")
    splits = growth.candidate_splits(rows, names, n, made[0].getMaxBins(), made[0].getSeed())
    held = growth.binned(rows, names, splits).persist()
    asked = growth.binned(_flat(d, valid)[0], names, splits) if valid is not None else None
    try:
        found = growth.grow(held, asked, [len(x) + 1 for x in splits], kinds, DEEPEST)
    finally:
        held.unpersist()
        rows.unpersist()
    nodes = {c: found[c].to_numpy() for c in found.column_names}
    trees, counts = [], []
    for i, ((name, _), kind) in enumerate(zip(specs, kinds)):
        leaves, stats = _tree_of(nodes, i, kind)
        trees.append(DeepTree(name, fold, leaves, None))
        counts += _counts(i, stats)
    return trees, pa.concat_tables(counts)


def _column(counts: pa.Table, tree: int, valid: bool, size: int) -> np.ndarray:
    """(n, total, squares) per leaf of one tree."""
    some = counts.filter(pc.and_(pc.equal(counts["tree"], tree), pc.equal(counts["valid"], valid)))
    out = np.zeros((size, 3))
    out[some["leaf"].to_numpy()] = np.column_stack([some[c].to_numpy() for c in ("n", "total", "squares")])
    return out


def score_cut(t: DeepTree, depth: int, train: np.ndarray, valid: np.ndarray, task: str) -> float:
    """Average precision (or minus the root mean squared error) of the tree cut at `depth`, from its leaf counts."""
    nodes, at = np.unique(t.leaves.cut(depth), return_inverse=True)
    known, asked = np.zeros((len(nodes), 3)), np.zeros((len(nodes), 3))
    np.add.at(known, at, train)
    np.add.at(asked, at, valid)
    value = known[:, 1] / np.maximum(known[:, 0], 1)
    if task == "regression":
        error = (asked[:, 2] - 2 * value * asked[:, 1] + value * value * asked[:, 0]).sum()
        return -float(np.sqrt(max(error, 0.0) / max(asked[:, 0].sum(), 1)))
    scores, at = np.unique(np.round(-value, 12), return_inverse=True)
    n, hits = np.zeros(len(scores)), np.zeros(len(scores))
    np.add.at(n, at, asked[:, 0])
    np.add.at(hits, at, asked[:, 1])
    upto = np.maximum(np.cumsum(n), 1)
    return float((hits * np.cumsum(hits) / upto).sum() / hits.sum()) if hits.sum() else float("nan")


def grid_search(spec_of: Callable[..., object], space: Mapping[str, Sequence], train: DataFrame, folds: DataFrame, n_folds: int, task: str,
                tol: float = 1e-4) -> list[dict]:
    """Every point of the space: mean and sd of the fold scores, leaves of the tree on all training rows, and the best point.

    The best is, among points within `tol` of the best mean, the one with the fewest leaves, then the best mean.
    """
    grid = [{"minInstancesPerNode": m, "impurity": i} for m in space["minInstancesPerNode"] for i in space["impurity"]]
    def one(fold):
        """Leaves of every point's tree (fold 0, all training rows) or its score on the fold."""
        trees, counts = deep_trees(spec_of, grid, *(fold_parts(folds, fold) if fold else (train, None)), fold)
        out = {}
        for i, (t, g) in enumerate(zip(trees, grid)):
            known, asked = (_column(counts, i, v, len(t.leaves.leaf)) if fold else None for v in (False, True))
            for depth in space["maxDepth"]:
                out[depth, g["minInstancesPerNode"], g["impurity"]] = score_cut(t, depth, known, asked, task) if fold else t.leaves.count(depth)
        return out
    sizes, *each = in_parallel(one, range(n_folds + 1))
    scored = {k: [found[k] for found in each] for g in grid for depth in space["maxDepth"] for k in [(depth, g["minInstancesPerNode"], g["impurity"])]}
    out = [{"maxDepth": k[0], "minInstancesPerNode": k[1], "impurity": k[2], "mean_score": float(np.mean(v)), "sd_score": float(np.std(v, ddof=1)),
            "n_leaves": sizes[k]} for k, v in scored.items()]
    enough = max(r["mean_score"] for r in out) - tol
    best = min((r for r in out if r["mean_score"] >= enough), key=lambda r: (r["n_leaves"], -r["mean_score"]))
    return [{**r, "best": r is best} for r in out]

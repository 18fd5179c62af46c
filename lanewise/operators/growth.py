"""Growth of many regression and classification trees over the same binned rows.

Trees that differ in leaf size or impurity alone mostly choose the same splits near the root, so they grow together: a joint node is a set
of rows with the trees that have it, and its histogram is made once for them. It parts only where they choose differently. Candidate
splits, gains, ties, ends and the merging of equal sibling leaves are those of ``pyspark.ml``, whose trees these are node by node.

Nodes of more than `PART_ROWS` rows get their histograms from a pass over all rows, whose sums the driver adds; smaller nodes are dealt to
one task each, which grows everything below. No task holds more rows than that.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import share_code

PART_ROWS = 100_000  # rows of a task that grows a whole branch
SAMPLED, NODES_AT_ONCE, EPSILON = 10_000, 512, float(np.finfo(float).eps)


@dataclass(frozen=True)
class Kind:
    """What tells trees over the same rows apart; impurity is variance, gini or entropy (the latter two over 0/1 labels)."""
    least: int
    impurity: str


# ---- candidate splits and bins ----

def thresholds(values: np.ndarray, rows: float, bins: int) -> np.ndarray:
    """Candidate splits of one column from its sampled values, which stand for `rows` rows: midpoints of neighbouring values, all of them or
    those nearest to even steps of the rows."""
    values = values[values != 0]
    seen, counts = np.unique(values, return_counts=True)
    counts = counts.astype(float)
    if rows - len(values) > EPSILON * len(values) * 100 and len(seen):
        at = int(np.searchsorted(seen, 0.0))
        seen, counts = np.insert(seen, at, 0.0), np.insert(counts, at, rows - len(values))
    if len(seen) < 2:
        return np.zeros(0)
    middle = (seen[:-1] + seen[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    out, step, current, wanted = [], rows / bins, counts[0], rows / bins
    for i in range(1, len(seen)):
        before, current = current, current + counts[i]
        if abs(before - wanted) < abs(current - wanted):
            out.append(middle[i - 1])
            wanted += step
    return np.array(out)


def candidate_splits(rows: DataFrame, names: Sequence[str], n: int, bins: int, seed: int) -> list[np.ndarray]:
    share = min(max(bins * bins, SAMPLED) / n, 1.0)
    seen = (rows if share == 1 else rows.sample(False, share, seed)).select(*names).toArrow()
    return [thresholds(seen[c].to_numpy(), share * n, min(bins, n)) for c in names]


def binned(rows: DataFrame, names: Sequence[str], splits: Sequence[np.ndarray]) -> DataFrame:
    """y and the bins of all columns as one binary, a byte a column."""
    share_code(rows.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = np.column_stack([np.searchsorted(at, b[c].to_numpy(zero_copy_only=False)).astype(np.uint8) for c, at in zip(names, splits)])
                yield pa.record_batch([b["y"], pa.array(_packed(held), pa.binary())], names=["y", "bins"])
    return rows.select("y", *names).mapInArrow(one, "y double, bins binary")


def _packed(held: np.ndarray) -> list[bytes]:
    wide = np.ascontiguousarray(held)
    return wide.view(f"V{wide.shape[1]}").ravel().tolist()


def _columns(bins, width: int) -> np.ndarray:
    """(columns, rows) from an Arrow array of equally long binaries."""
    bins = bins.combine_chunks() if isinstance(bins, pa.ChunkedArray) else bins
    start = bins.offset * width
    held = np.frombuffer(bins.buffers()[2], np.uint8)[start:start + len(bins) * width] if len(bins) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(held.reshape(-1, width).T)


# ---- one level of joint nodes ----

@dataclass
class Rows:
    """Rows of some joint nodes, one node after the other: `at` are places in `columns`, node i has those from starts[i] to starts[i + 1]."""
    columns: np.ndarray
    y: np.ndarray
    at: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, columns: np.ndarray, y: np.ndarray) -> Rows:
        return cls(columns, y, np.arange(len(y)), np.array([0, len(y)]))

    def histograms(self, first: int, last: int, bins: int) -> np.ndarray:
        """(3, nodes, columns, bins): rows, sum and sum of squares of y."""
        nodes = last - first
        at = self.at[self.starts[first]:self.starts[last]]
        node = np.repeat(np.arange(nodes) * bins, np.diff(self.starts[first:last + 1]))
        y = self.y[at]
        whole = bool(np.array_equal(y, y * y))
        out = np.zeros((3, nodes, len(self.columns), bins))
        for f, column in enumerate(self.columns):
            place = node + column[at]
            out[0, :, f] = np.bincount(place, minlength=nodes * bins).reshape(nodes, bins)
            out[1, :, f] = np.bincount(place, y, nodes * bins).reshape(nodes, bins)
            out[2, :, f] = out[1, :, f] if whole else np.bincount(place, y * y, nodes * bins).reshape(nodes, bins)
        return out

    def moved(self, node: np.ndarray, column: np.ndarray, cut: np.ndarray) -> tuple[Rows, np.ndarray]:
        """Rows of the children, left and right of each split of `node` (ascending, repeated where trees part) in turn; and their rows, sums
        and squares (3, children)."""
        sizes = np.diff(self.starts)[node]
        ends = np.cumsum(sizes)
        split = np.repeat(np.arange(len(node)), sizes)
        at = self.at[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[node] - (ends - sizes), sizes)]
        right = self.columns[column[split], at] > cut[split]
        child = 2 * split + right
        counts = np.bincount(child, minlength=2 * len(node))
        starts = np.concatenate([[0], np.cumsum(counts)])
        place = np.empty(len(at), np.int64)
        for side in (False, True):  # places keep their order in each child
            mine = np.flatnonzero(right == side)
            place[starts[2 * np.arange(len(node)) + side].repeat(counts[side::2]) + _upto(counts[side::2])] = mine
        at = at[place]
        y = self.y[at]
        child = np.repeat(np.arange(len(counts)), counts)
        stats = np.array([counts.astype(float), np.bincount(child, y, len(counts)), np.bincount(child, y * y, len(counts))])
        return Rows(self.columns, self.y, at, starts), stats

    def only(self, nodes: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[nodes]
        at = self.at[np.repeat(self.starts[nodes], sizes) + _upto(sizes)]
        return Rows(self.columns, self.y, at, np.concatenate([[0], np.cumsum(sizes)]))


def _upto(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def impurity(kind: str, n, total, squares):
    """Impurity of rows by their number, sum and sum of squares; 0 for none."""
    n = np.asarray(n, float)
    some = np.maximum(n, 1)
    if kind == "variance":
        return (squares - total * total / some) / some
    out = np.zeros(np.broadcast(n, total).shape) if kind == "entropy" else np.ones(np.broadcast(n, total).shape)
    for part in (n - total, total):
        share = part / some
        out = out - (share * np.log(np.where(share > 0, share, 1)) / np.log(2) if kind == "entropy" else share * share)
    return np.where(n > 0, out, 0.0)


def chosen(hist: np.ndarray, kinds: Sequence[Kind], mask: np.ndarray) -> np.ndarray:
    """(kinds, nodes): place (column * (bins - 1) + bin) of the best split of each node for each kind in its mask, -1 for none."""
    left = np.cumsum(hist, axis=3)
    whole = left[:, :, :1, -1:]
    left = left[..., :-1].reshape(3, hist.shape[1], -1)
    whole = whole.reshape(3, -1, 1)
    right = whole - left
    out = np.full((len(kinds), hist.shape[1]), -1)
    fewest = np.minimum(left[0], right[0])
    for name in {k.impurity for k in kinds}:
        mine = sorted((k.least, i) for i, k in enumerate(kinds) if k.impurity == name)
        bits = sum(1 << i for _, i in mine)
        asked = np.flatnonzero(mask & bits)
        if not len(asked):
            continue
        l, r, w = left[:, asked], right[:, asked], whole[:, asked]
        gain = impurity(name, *w) - l[0] / w[0] * impurity(name, *l) - r[0] / w[0] * impurity(name, *r)
        few = fewest[asked]
        best, ok = np.full(len(asked), -1), np.ones(len(asked), bool)  # no split yet; those without one have none with more rows
        enough = np.full(len(asked), -1.0)
        for least, i in mine:
            again = np.flatnonzero(ok & (enough < max(least, 1)))
            if len(again):
                some = np.where(few[again] >= max(least, 1), gain[again], -np.inf)
                best[again] = some.argmax(1)
                ok[again] = some[np.arange(len(again)), best[again]] > 0
                enough[again] = few[again, best[again]]
            out[i, asked] = np.where(ok & (mask[asked] >> i & 1 > 0), best, -1)
    return out


def splits_of(codes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, column, last bin to the left and mask of kinds of each different split, by node."""
    kind, node = np.nonzero(codes >= 0)
    key, inverse = np.unique(node.astype(np.int64) << 32 | codes[kind, node], return_inverse=True)
    mask = np.zeros(len(key), np.int64)
    np.bitwise_or.at(mask, inverse, np.int64(1) << kind)
    code = key & 0xFFFFFFFF
    return key >> 32, code // (bins - 1), code % (bins - 1), mask


def alive(stats: np.ndarray, mask: np.ndarray, kinds: Sequence[Kind]) -> np.ndarray:
    """The kinds for which a node may be split further: it is not pure and holds two leaves."""
    pure = {name: np.abs(impurity(name, *stats)) < EPSILON for name in {k.impurity for k in kinds}}
    out = np.zeros(len(mask), np.int64)
    for i, k in enumerate(kinds):
        out |= np.where(~pure[k.impurity] & (stats[0] >= 2 * max(k.least, 1)), mask & (1 << i), 0)
    return out


def level_splits(rows: Rows, mask: np.ndarray, kinds: Sequence[Kind], bins: int) -> tuple[np.ndarray, ...]:
    codes = [np.zeros((len(kinds), 0), np.int64)]
    for first in range(0, len(mask), NODES_AT_ONCE):
        last = min(first + NODES_AT_ONCE, len(mask))
        codes.append(chosen(rows.histograms(first, last, bins), kinds, mask[first:last]))
    return splits_of(np.concatenate(codes, axis=1), bins)


NODE = pa.schema([("id", pa.int64()), ("parent", pa.int64()), ("level", pa.int32()), ("mask", pa.int64()),
                  *[(c, pa.float64()) for c in ("n", "total", "squares", "asked", "asked_total", "asked_squares")]])


def grown(train: Rows, asked: Rows, mask: int, level: int, deepest: int, kinds: Sequence[Kind], bins: int) -> pa.Table:
    """The joint nodes below the node that holds all given rows, which is 0; `asked` rows are counted only."""
    out, ids, known = [], np.array([0]), np.array([mask])
    after = 1
    while len(ids) and level < deepest:
        node, column, cut, masks = level_splits(train, known, kinds, bins)
        if not len(node):
            break
        level += 1
        train, stats = train.moved(node, column, cut)
        asked, seen = asked.moved(node, column, cut)
        made, masks = after + np.arange(2 * len(node)), np.repeat(masks, 2)
        after += len(made)
        out.append(pa.table([made, np.repeat(ids[node], 2), np.full(len(made), level, np.int32), masks, *stats, *seen], schema=NODE))
        known = alive(stats, masks, kinds)
        left = np.flatnonzero(known)
        train, asked, ids, known = train.only(left), asked.only(left), made[left], known[left]
    return pa.concat_tables(out) if out else NODE.empty_table()


# ---- all rows ----

def _down(rows: Rows, steps: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
    """Rows of the nodes kept after the given levels: each step names the splits of the nodes before it and the children that are kept."""
    for node, column, cut, kept in steps:
        rows = rows.moved(node, column, cut)[0].only(kept)
    return rows


def grow(rows: DataFrame, asked: DataFrame | None, sizes: Sequence[int], kinds: Sequence[Kind], deepest: int) -> pa.Table:
    """All joint nodes of the trees of all kinds over binned `rows` (`sizes` bins a column), with the counts of the `asked` rows in each. The
    first is the root."""
    width, bins = len(sizes), max(2, *sizes)
    held = rows.withColumn("asked", F.lit(False))
    every = held if asked is None else held.unionByName(asked.withColumn("asked", F.lit(True)))
    full = (1 << len(kinds)) - 1
    sums = {r["asked"]: np.array([r["n"], r["s"], r["q"]], float) for r in every.groupBy("asked").agg(
        F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).collect()}
    stats, seen = sums[False].reshape(3, 1), sums.get(True, np.zeros(3)).reshape(3, 1)
    ids, known, level, after = np.array([0]), alive(stats, np.array([full]), kinds), 0, 1
    nodes = [pa.table([ids, ids, np.zeros(1, np.int32), np.array([full]), *stats, *seen], schema=NODE)]
    left = np.flatnonzero(known)
    ids, known, filled = ids[left], known[left], stats[0][left]
    steps: list[tuple] = []
    # Large nodes first, level by level; small ones wait for their task as a step without splits.
    parts = []
    while len(ids) and level < deepest:
        small = filled <= PART_ROWS
        parts += [(int(i), int(m), level, len(steps), int(p)) for i, m, p in zip(ids[small], known[small], np.flatnonzero(small))]
        large = np.flatnonzero(~small)
        if not len(large):
            break
        codes = np.concatenate([chosen(_all_histograms(held, steps, some, width, bins), kinds, known[some])
                                for some in np.array_split(large, -(-len(large) // NODES_AT_ONCE))], axis=1)
        node, column, cut, masks = splits_of(codes, bins)
        level += 1
        node = large[node]
        step = (node, column, cut, np.arange(2 * len(node)))
        stats, seen = _all_counts(every, [*steps, step], width)
        made, masks = after + np.arange(2 * len(node)), np.repeat(masks, 2)
        after += len(made)
        nodes.append(pa.table([made, np.repeat(ids[node], 2), np.full(len(made), level, np.int32), masks, *stats, *seen], schema=NODE))
        known = alive(stats, masks, kinds)
        kept = np.flatnonzero(known)
        steps.append((*step[:3], kept))
        ids, known, filled = made[kept], known[kept], stats[0][kept]
    if parts:
        nodes += _branches(every, parts, steps, width, bins, kinds, deepest, after)
    return pa.concat_tables(nodes)


def _partition_rows(batches, width: int) -> Iterator[tuple[Rows, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield Rows.of(_columns(b["bins"], width), b["y"].to_numpy(zero_copy_only=False)), b["asked"].to_numpy(zero_copy_only=False)


def _all_histograms(held: DataFrame, steps: Sequence, nodes: np.ndarray, width: int, bins: int) -> np.ndarray:
    """Histograms of the given nodes, added up over the partitions."""
    def one(batches):
        total = np.zeros((3, len(nodes), width, bins))
        for rows, _ in _partition_rows(batches, width):
            total += _down(rows, steps).only(nodes).histograms(0, len(nodes), bins)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["h"])
    out = np.zeros((3, len(nodes), width, bins))
    for r in held.mapInArrow(one, "h binary").toLocalIterator():
        out += np.frombuffer(bytes(r["h"])).reshape(out.shape)
    return out


def _all_counts(every: DataFrame, steps: Sequence, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, nodes) of the training and of the asked rows after the last step."""
    size = len(steps[-1][3])

    def one(batches):
        total = np.zeros((2, 3, size))
        for rows, asked in _partition_rows(batches, width):
            for i in (0, 1):
                some = np.flatnonzero(asked == bool(i))
                got = _down(Rows(rows.columns, rows.y, some, np.array([0, len(some)])), steps)
                node, y = np.repeat(np.arange(size), np.diff(got.starts)), rows.y[got.at]
                total[i] += [np.bincount(node, w, size) for w in (np.ones(len(y)), y, y * y)]
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["h"])
    out = np.zeros((2, 3, size))
    for r in every.mapInArrow(one, "h binary").collect():
        out += np.frombuffer(bytes(r["h"])).reshape(out.shape)
    return out[0], out[1]


def _branches(every: DataFrame, parts: Sequence[tuple], steps: Sequence, width: int, bins: int, kinds: Sequence[Kind], deepest: int, after: int) -> list[pa.Table]:
    """Everything below the nodes of `parts` (id, mask, level, steps before it, place after them), each grown by one task."""
    by_level: dict[int, list[tuple[int, int]]] = {}
    for part, (_, _, _, before, place) in enumerate(parts):
        by_level.setdefault(before, []).append((part, place))

    def deal(batches):
        for rows, asked in _partition_rows(batches, width):
            for before in range(len(steps) + 1):
                if before:
                    rows = _down(rows, steps[before - 1:before])
                if before in by_level:
                    part, place = (np.array(x) for x in zip(*by_level[before]))
                    mine = rows.only(place)
                    yield pa.record_batch([pa.array(np.repeat(part, np.diff(mine.starts)).astype(np.int32)), pa.array(rows.y[mine.at]),
                                           pa.array(asked[mine.at]), pa.array(_packed(rows.columns[:, mine.at].T), pa.binary())], names=["part", "y", "asked", "bins"])

    def one(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        _, mask, level, _, _ = parts[part]
        columns, y, asked = _columns(table["bins"], width), table["y"].to_numpy(), table["asked"].to_numpy()
        some, other = np.flatnonzero(~asked), np.flatnonzero(asked)
        made = grown(Rows(columns, y, some, np.array([0, len(some)])), Rows(columns, y, other, np.array([0, len(other)])), mask, level, deepest, kinds, bins)
        return made.append_column("part", pa.array(np.full(made.num_rows, part, np.int32)))
    schema = "id long, parent long, level int, mask long, n double, total double, squares double, asked double, asked_total double, asked_squares double, part int"
    dealt = every.mapInArrow(deal, "part int, y double, asked boolean, bins binary")
    found = dealt.repartition(min(len(parts), 200), "part").groupBy("part").applyInArrow(one, schema).toArrow()
    out = []
    order = np.argsort(found["part"].to_numpy(), kind="stable")
    found = found.take(order)
    where = found["part"].to_numpy()
    for part in range(len(parts)):
        some = found.slice(*(lambda a, b: (a, b - a))(*np.searchsorted(where, [part, part + 1])))
        if some.num_rows:
            ids, parent = some["id"].to_numpy(), some["parent"].to_numpy()
            made = np.where(parent == 0, parts[part][0], parent + after - 1)
            out.append(pa.table([ids + after - 1, made, *[some[c] for c in NODE.names[2:]]], schema=NODE))
            after += int(ids.max())
    return out

"""Near duplicates of word shingles by fast similarity sketching, banding and exact verification.

Fast similarity sketching fills `BINS` coordinates from one set: round i throws every element into one bin with value i + hash, so a
large set is done after one round; rounds BINS .. 2 BINS - 1 throw all elements into bin i - BINS and so fill what is left. Equal
coordinates estimate the Jaccard similarity with concentration bounds. Bands of six coordinates (five below 0.85) make candidates: a
pair at the threshold of 0.85 or 0.8 misses all bands with a chance of 6e-9.

Equal sets are one class. Every bucket compares its members with its smallest first (a star, not all pairs). A bucket whose members
are one component by then can add nothing. In the others, members of different components are compared in blocks of bounded size:
sketches find those near the threshold, products of their full sets find the links, and a forest of links leaves the task, never
the pairs. So no link between components is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ODD, WordHashes, as_bytes, hold, mix64, small_batches, windows, written

BINS = 240
SHINGLE = 3
SLACK = 0.15  # six standard deviations of an estimate from BINS coordinates at 0.85
BLOCK = 2000
BROADCAST_IDS = 1_000_000
HASHES = WordHashes()


def shingles(text, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    words = HASHES.of(as_bytes(text).lower().split())
    return np.unique(windows(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Coordinates (round << 32 | hash) of a non-empty set; independent of the order of its elements."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    step, low = max(1, 2048 // len(items)), np.uint64(0xFFFFFFFF)
    for first in range(0, bins, step):
        rounds = np.arange(first, min(bins, first + step), dtype=np.uint64)[:, None]
        h = mix64(items[None, :] + ODD * (rounds + np.uint64(1)))
        np.minimum.at(out, ((h >> np.uint64(32)) % np.uint64(bins)).ravel(), ((rounds << np.uint64(32)) | (h & low)).ravel())
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        i = np.full(1, bins + j, np.uint64)
        out[j] = (i[0] << np.uint64(32)) | (mix64(items + ODD * (i + np.uint64(1))) & low).min()
    return out


def _digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, text_hash, n, digest and signs of every row, in its order."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(HASHES)
        for batch in batches:
            n, digest, signs = [], [], []
            for value in batch.column(1):
                items = shingles(value.as_py(), size)
                n.append(len(items))
                digest.append(_digest(items) if len(items) else None)
                signs.append(mix64(sketch(items)).astype("<u2").tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(signs, pa.binary())], ["doc_id", "text_hash", "n", "digest", "signs"])
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long, n long, digest binary, signs binary")


def _band_keys(classes: DataFrame, rows_in_band: int) -> DataFrame:
    """(key, rep) for every class and band."""
    bands = BINS // rows_in_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(rows, bands, rows_in_band).astype(np.uint64)
            keys = np.tile(np.arange(bands, dtype=np.uint64), (rows, 1))
            for r in range(rows_in_band):
                keys = keys * ODD + signs[:, :, r]
            keys = (mix64(keys) & ~np.uint64(63)) | np.arange(bands, dtype=np.uint64)  # the band is the key's low bits
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(rows), bands)))],
                                             ["key", "rep"])
    return classes.select("rep", "signs").mapInArrow(run, f"key long, rep {classes.schema['rep'].dataType.simpleString()}")


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean()) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _of_ids(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """Rows of `docs` with the given ids (column `id`): broadcast up to a counted bound, shuffled beyond it."""
    ids = ids if ids.count() > BROADCAST_IDS else F.broadcast(ids)
    return docs.join(ids, docs[doc_id] == ids["id"], "left_semi")


def _close(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, items): the full set of every class in `reps` (column id). Texts are read by the id of the class's first row and told apart,
    where an id repeats, by the digest of their sets."""
    wanted = written(reps.join(classes.select(F.col("rep").alias("id"), "rep_id", "digest"), "id"), "wanted")
    some = _of_ids(docs.select(doc_id, text), wanted.select(F.col("rep_id").alias("id")).distinct(), doc_id).select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(HASHES)
        for batch in batches:
            sets = [shingles(v.as_py(), size) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                                             ["digest", "items"])
    found = some.mapInArrow(run, "digest binary, items binary").join(wanted.select("id", "digest"), "digest")
    return written(found.groupBy("id").agg(F.first("items").alias("items")), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the similarity."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "items": "y"}), "b")
    union = F.length("x") / 8 + F.length("y") / 8 - F.col("common")
    return both.withColumn("common", _common("x", "y")).where(100 * F.col("common") >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for the vertices of the edges (a, b).

    Every vertex points to its smallest neighbour, pointers are followed to their roots, and edges are drawn between roots until
    none is left: the vertices at least halve each time.
    """
    labels, edges = None, edges.where("a <> b")
    while edges.head(1):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        up = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "roots")
        while True:
            over = up.select(F.col("v").alias("root"), F.col("root").alias("next"))
            up = written(up.join(over, "root").select("v", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "roots")
            if not up.where("moved").head(1):
                break
            up = up.drop("moved")
        up = up.select("v", "root")
        labels = up if labels is None else written(
            labels.withColumnRenamed("root", "via").join(up.withColumnRenamed("v", "via"), "via", "left").select("v", F.coalesce("root", "via").alias("root")), "labels")
        ends = [up.select(F.col("v").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
                        .where("a <> b").distinct(), "edges")
    return (labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))).withColumnsRenamed({"v": "vertex", "root": "component"})


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, rep, ...) of buckets as groups (key, i, j): large buckets are dealt out as pairs of blocks of about BLOCK."""
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _in_doubt(members: DataFrame, percent: int, bands: int) -> DataFrame:
    """(key, i, j, block, rep): members that come near the threshold with one of another component, by their sketches.

    A pair counts in the first band it shares, and across blocks only. Sizes that rule the similarity out are exact; the sketches
    leave out what lies SLACK below the threshold. At most one row per member and group comes out, however many pairs there are.
    """
    rep = members.schema["rep"].dataType.simpleString()

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(frame["signs"]), "<u2").reshape(len(frame), BINS)
        n, comp, block = frame["n"].to_numpy(), frame["component"].to_numpy(), frame["block"].to_numpy()
        band, doubt = int(key[0]) & 63, np.zeros(len(frame), bool)
        for k in range(len(frame) - 1):
            rest = comp[k + 1:] != comp[k]
            rest &= 100 * np.minimum(n[k + 1:], n[k]) >= percent * np.maximum(n[k + 1:], n[k])
            if key[1] != key[2]:
                rest &= block[k + 1:] != block[k]
            rest = np.flatnonzero(rest) + k + 1
            if len(rest):
                equal = signs[rest] == signs[k]
                near = equal.mean(axis=1) >= percent / 100 - SLACK
                near &= ~equal.reshape(len(rest), bands, -1)[:, :band].all(axis=2).any(axis=1)
                doubt[rest[near]] = True
                doubt[k] |= near.any()
        return frame.loc[doubt, ["key", "i", "j", "block", "rep"]]
    return _dealt(members).groupBy("key", "i", "j").applyInPandas(run, f"key long, i int, j int, block int, rep {rep}")


def _links_in_groups(doubt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the members of each group as all its links do (a forest), from products of the full sets."""
    rep = doubt.schema["rep"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in frame["items"]]
        n, reps = np.array([len(x) for x in sets]), frame["rep"].to_numpy()
        who, (_, what, often) = np.repeat(np.arange(len(sets)), n), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(often > 1) - 1  # only items of two members can be common
        keep = often[what] > 1
        who, what = who[keep], shared[what[keep]]
        common, width = np.zeros((len(sets), len(sets)), np.float32), 4096
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        for low in range(0, int(what[-1]) + 1 if len(what) else 0, width):
            a, b = np.searchsorted(what, (low, low + width))
            part = np.zeros((len(sets), width), np.float32)
            part[who[a:b], what[a:b] - low] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        new, out = np.ones(len(sets), bool), []
        for start in range(len(sets)):
            todo = [start] if new[start] else []
            new[start] = False
            while todo:
                at = todo.pop()
                found = np.flatnonzero(linked[at] & new)
                new[found] = False
                out += [(reps[at], reps[x]) for x in found]
                todo += found.tolist()
        return pd.DataFrame(out, columns=["a", "b"]).astype(frame["rep"].dtype)
    return doubt.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("key", "i", "j").applyInPandas(run, f"a {rep}, b {rep}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Rows link when 100 * intersection >= percent * union of their sets. Null and empty texts link with nothing and are kept; so are rows
    without an id, whose component is null. Rows that repeat an id are compared row by row; of near copies under one id all have
    that id, so all are kept. No rows give no rows.
    """
    return _near_rows(docs, doc_id, text, size, percent).drop("text_hash")


def _near_rows(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """`near_duplicates` with the hash of each row's text. A class is known by the number of its first row in the written sketches."""
    small_batches(docs)
    rows = written(_sketches(docs, doc_id, text, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = written(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
                      .agg(F.min(F.struct("doc_id", "row")).alias("best"), F.first("n").alias("n"), F.first("signs").alias("signs"))
                      .select("digest", F.col("best.row").alias("rep"), F.col("best.doc_id").alias("rep_id"), "n", "signs"), "classes")
    band_rows = 6 if percent >= 85 else 5
    keys = written(_band_keys(classes, band_rows), "bands")
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").drop("last")
    members = written(keys.join(shared, "key"), "buckets")
    facts = classes.select("rep", "n", "signs")
    star = members.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    star = star.join(facts.withColumnsRenamed({"rep": "a", "n": "na", "signs": "sa"}), "a") \
        .join(facts.withColumnsRenamed({"rep": "b", "n": "nb", "signs": "sb"}), "b").where(_close(F.col("na"), F.col("nb"), percent))
    star = written(star.withColumn("like", _agreement("sa", "sb")).where(F.col("like") >= percent / 100 - SLACK).select("a", "b"), "star")
    sets = _sets(star.select(F.col("a").alias("id")).union(star.select("b")).distinct(), classes, docs, doc_id, text, size)
    edges = written(_linked(star, sets, percent), "links")
    parts = components(edges)

    labelled = members.select("key", "rep").join(parts.withColumnRenamed("vertex", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    doubt = written(_in_doubt(labelled.join(mixed, "key").join(facts, "rep"), percent, BINS // band_rows), "doubt")
    if doubt.head(1):
        more = doubt.select(F.col("rep").alias("id")).distinct().join(sets.select("id"), "id", "left_anti")
        sets = sets.unionByName(_sets(more, classes, docs, doc_id, text, size))
        parts = components(written(edges.unionByName(_links_in_groups(doubt, sets, percent)), "links"))

    placed = classes.select("digest", "rep", "rep_id").join(parts.withColumnRenamed("vertex", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    ids = placed.join(smallest, "component").select("digest", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(ids, "digest", "left").withColumn("component_id", own).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 85) -> DataFrame:
    """The rows that `near_duplicates` keeps, with all their columns; rows are known by id and text, so a repeated id loses no other text."""
    gone = written(_near_rows(docs, doc_id, text, size, percent).where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct(), "gone")
    gone = gone if gone.count() > BROADCAST_IDS else F.broadcast(gone)
    return docs.join(gone, (docs[doc_id] == gone["id"]) & (F.xxhash64(docs[text].cast("string")) == gone["hash"]), "left_anti")

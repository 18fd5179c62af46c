"""Repeated passages by fixed-block anchors.

A window of 13 words at any place of a document holds a whole block of 7 words that starts at a multiple of 7. So the index has the
non-overlapping 7-word blocks of every document, and every rolling 7-word run probes it. Hits of a document are extended to the runs
of 13-word windows they can lie in; those windows alone are compared, by their own hashes and the smallest id that has them.

Documents are dealt to chunks by id, those without one by text. A chunk sends each distinct hash once, as sorted packed numbers per bucket, however often a
passage repeats inside it; answers come back per chunk and are matched with its documents again. Chunk and bucket counts follow
the number of words, so each stays at a size that one task can hold.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .text import WordHashes, as_bytes, hold, small_batches, windows

WINDOW, BLOCK = 13, 7
CHUNK_BYTES, BUCKET_WORDS = 8 << 20, 2_000_000
HASHES = WordHashes()
LAST = np.iinfo(np.int64).max
KEEP48 = np.uint64((1 << 48) - 1)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane: the high planes are zeros and compress away."""
    values = values.astype("<u8")
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket per sorted 48-bit hash: equal ranges."""
    return (hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    at = np.searchsorted(_buckets(hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))
    return ((b, slice(at[b], at[b + 1])) for b in range(buckets) if at[b] < at[b + 1])


def _probes(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct probes of a chunk (48-bit hash * 2 + whether several documents have it) and its distinct block hashes."""
    runs = [windows(w, BLOCK) & KEEP48 for w in words]
    if not any(map(len, runs)):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.sort(np.concatenate([np.unique(r) for r in runs]))
    first = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
    many = np.diff(np.append(first, len(own))) > 1
    return own[first] * np.uint64(2) + many.astype(np.uint64), np.unique(np.concatenate([r[::BLOCK] for r in runs]))


def _chunk_words(frame: pd.DataFrame) -> list[np.ndarray]:
    hold(HASHES)
    return [HASHES.of(as_bytes(t).split()) for t in frame["text"]]


def _candidates(words: list[np.ndarray], hits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, window starts, window hashes) of the 13-word windows that hold a hit."""
    for d, w in enumerate(words):
        if len(w) < WINDOW or not len(hits):
            continue
        runs = windows(w, BLOCK) & KEEP48
        found = hits[np.minimum(np.searchsorted(hits, runs), len(hits) - 1)] == runs
        if found.any():
            upto = np.concatenate([[0], np.cumsum(found)])
            n = len(w) - WINDOW + 1
            starts = np.flatnonzero(upto[WINDOW - BLOCK + 1:WINDOW - BLOCK + 1 + n] > upto[:n])
            yield d, starts, windows(w, WINDOW)[starts]


def _hits_of(right: pd.DataFrame) -> np.ndarray:
    return np.unique(np.concatenate([unpacked(x) for x in right["found"]])) if len(right) else np.zeros(0, np.uint64)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text).

    Every word is removed that lies in a 13-word window whose words also start in a document with a smaller id, judged on the input.
    Null is the empty text. Texts under 13 words lose nothing. Rows that repeat an id are one document to the rule: neither removes
    from the other. A null id counts as the largest long, so it comes after all others. No rows give no rows.
    """
    # A long column with nulls reaches pandas as floats, so ids are made complete before that.
    key = F.col(doc_id).cast("long")
    source = docs.select(F.coalesce(key, F.lit(int(LAST))).alias("doc_id"), key.isNull().alias("no_id"), F.col(text).cast("string").alias("text"))
    small_batches(docs)
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(8, -(-total // 6 // BUCKET_WORDS))
    # One exchange of the texts by chunk serves the three passes below, which therefore stay in one plan.
    dealt = source.withColumn("chunk", F.pmod(F.when(F.col("no_id"), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks)).cast("int")) \
        .repartition(shuffle_partitions(docs.sparkSession), "chunk").groupBy("chunk")

    def probe(frame: pd.DataFrame) -> pd.DataFrame:
        probes, blocks = _probes(_chunk_words(frame))
        rows = {b: [b, int(frame["chunk"].iloc[0]), packed(probes[s]), b""] for b, s in _by_bucket(probes >> np.uint64(1), buckets)}
        for b, s in _by_bucket(blocks, buckets):
            rows[b][3] = packed(blocks[s])
        return pd.DataFrame(list(rows.values()), columns=["bucket", "chunk", "probes", "blocks"])

    def lookup(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = np.unique(np.concatenate([unpacked(x) for x in frame["blocks"]]))
        each = [unpacked(x) for x in frame["probes"]]
        probes = [p >> np.uint64(1) for p in each]
        every = np.sort(np.concatenate(probes))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flagged = np.concatenate([p[(e & np.uint64(1)) == 1] for p, e in zip(probes, each)])
        hits = np.intersect1d(blocks, np.union1d(twice, flagged))
        out = [(c, packed(np.intersect1d(p, hits, assume_unique=True))) for c, p in zip(frame["chunk"], probes)]
        return pd.DataFrame([x for x in out if x[1]], columns=["chunk", "found"])

    hits = dealt.applyInPandas(probe, "bucket int, chunk int, probes binary, blocks binary") \
        .groupBy("bucket").applyInPandas(lookup, "chunk int, found binary")

    def compare(frame: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["bucket", "chunk", "hashes", "least", "last"])
        frame = _in_order(frame)
        ids = frame["doc_id"].to_numpy()
        h, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, _, found in _candidates(_chunk_words(frame), _hits_of(right)):
            h.append(found)
            d.append(np.full(len(found), ids[i]))
        h, d = np.concatenate(h), np.concatenate(d)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
        most = d[np.append(first[1:], len(h)) - 1] if len(h) else d
        return pd.DataFrame([(b, int(frame["chunk"].iloc[0]), packed(h[first][s]), d[first][s].tobytes(), most[s].tobytes())
                             for b, s in _by_bucket64(h[first], buckets)], columns=["bucket", "chunk", "hashes", "least", "last"])

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        each = [unpacked(x) for x in frame["hashes"]]
        least = [np.frombuffer(x, np.int64) for x in frame["least"]]
        h, d = np.concatenate(each), np.concatenate(least)
        order = np.lexsort((d, h))
        keys, at = np.unique(h[order], return_index=True)
        smallest = d[order][at]
        out = []
        for c, hs, last in zip(frame["chunk"], each, frame["last"]):
            owner = smallest[np.searchsorted(keys, hs)]
            take = owner < np.frombuffer(last, np.int64)
            out.append((c, packed(hs[take]), owner[take].tobytes()))
        return pd.DataFrame([x for x in out if x[1]], columns=["chunk", "found", "owner"])

    answers = dealt.cogroup(hits.groupBy("chunk")).applyInPandas(compare, "bucket int, chunk int, hashes binary, least binary, last binary") \
        .groupBy("bucket").applyInPandas(decide, "chunk int, found binary, owner binary")

    def remove(frame: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x) for x in right["found"])])
        owner = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in right["owner"])])
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        rows = []
        for key, no_id, value in zip(frame["doc_id"], frame["no_id"], frame["text"]):
            words = as_bytes(value).split()
            gone = np.zeros(len(words) + 1, np.int64)
            if len(words) >= WINDOW and len(keys):
                h = windows(HASHES.of(words), WINDOW)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                starts = np.flatnonzero((keys[at] == h) & (owner[at] < key))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + WINDOW, -1)
            covered = np.cumsum(gone)[:len(words)] > 0
            kept = b" ".join(w for w, c in zip(words, covered) if not c) if covered.any() else b" ".join(words)
            rows.append((None if no_id else key, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
        return pd.DataFrame(rows, columns=columns).assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    out = dealt.cogroup(answers.groupBy("chunk")).applyInPandas(
        remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("doc_id", kind="stable", ignore_index=True)


def _by_bucket64(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    return _by_bucket(hashes >> np.uint64(16), buckets)

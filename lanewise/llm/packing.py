"""Packing token pieces into sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into full sequences and a rest. Only the histogram of piece lengths (at most 4,096 numbers)
reaches the driver. There lengths are placed longest first, each into the pack filled least
so far, on counts of packing patterns rather than on single packs. A piece finds its pack by its rank among pieces of its length.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import as_bytes, hold, small_batches, small_groups, written

SIZE = 4096
END_ID = 2


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) per word of bytes, remembered up to a bound.

    The tokenizer drops white space and splits letters from signs before its merges, so a text's ids are those of its words in
    order, and a full stop or comma after a letter stands alone. Letters A-Z are folded first, unless the mark of a special token
    is in the text. New words of letters are encoded together: each then ends at exactly one word-end token.
    """

    LIMIT = 500_000

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = b"".join(i.to_bytes(4, "little") for i in self._encode(word.decode()))
        return ids

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > self.LIMIT:
            self.clear()
        stops = {w for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        plain = [w for w in (words - stops) | {w[:-1] for w in stops} if w not in self and w.decode().isalpha()]
        ids = np.array(self._encode(b" ".join(plain).decode()), "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(plain):  # else a letter falls apart when folded; such words are encoded one by one
            self.update(zip(plain, (x.tobytes() for x in np.split(ids, last[:-1]))))
        for w in stops:
            self[w] = self[w[:-1]] + self[w[-1:]]

    def of(self, texts) -> list[bytes]:
        raws = [as_bytes(t) for t in texts]
        words = [(r if b"<|" in r else r.lower()).split() for r in raws]
        found = [list(map(self.get, ws)) for ws in words]
        self.learn({w for ws, ids in zip(words, found) if None in ids for w, v in zip(ws, ids) if v is None})
        return [b"".join([self[w] if v is None else v for w, v in zip(ws, ids)] if None in ids else ids) for ws, ids in zip(words, found)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(tokens: int, size: int = SIZE) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the rest."""
    whole, rest = divmod(tokens, size)
    return [size] * whole + [rest] * bool(rest)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and the ids). A null text is the empty one: its end id alone."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = hold(word_ids(tokenizer))
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            values = batch.column(1).to_pylist()
            rows = []
            for group in small_groups(values, lambda v: len(v or ""), 1 << 20):
                for i, ids in zip(group, ids_of.of([values[i] for i in group])):
                    ids, start = ids + end, 0
                    for length in cut(len(ids) // 4):
                        part = ids[4 * start:4 * (start + length)]
                        rows.append((i, start, length, zlib.crc32(part), len(ids) // 4, part if keep_ids else None))
                        start += length
            at, *columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    out = source.mapInArrow(tokenise, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return out if keep_ids else out.drop("ids")


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, piece lengths) per pattern, from the number of pieces of each length.

    Lengths go longest first; a length joins the pattern with the most room, one piece per pack, and opens new packs when no
    pattern has room. Patterns with equal room are taken in the order they were made.
    """
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, serial, packs, lengths)
    done: list[tuple[int, tuple[int, ...]]] = []
    serial = 0

    def put(room: int, packs: int, lengths: tuple[int, ...]) -> None:
        nonlocal serial
        serial += 1
        if room:
            heappush(open_packs, (-room, serial, packs, lengths))
        else:
            done.append((packs, lengths))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not open_packs or -open_packs[0][0] < length:
                fit = size // length
                if left >= fit:
                    put(size - fit * length, left // fit, (length,) * fit)
                if left % fit:
                    put(size - left % fit * length, 1, (length,) * (left % fit))
                break
            room, _, packs, lengths = heappop(open_packs)
            used = min(packs, left)
            if used < packs:
                put(-room, packs - used, lengths)
            put(-room - length, used, (*lengths, length))
            left -= used
    return done + [(packs, lengths) for _, _, packs, lengths in sorted(open_packs)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, low, high, each, first, offset, ...) saying which ranks of a length go where.

    Ranks low..high-1 of a length fill a pattern's packs from sequence `first` on, `each` pieces per pack from `offset` on.
    """
    rows, next_rank, sequence = [], {}, 0
    for packs, lengths in patterns:
        offset, i = 0, 0
        while i < len(lengths):
            each = next((j for j in range(i, len(lengths)) if lengths[j] != lengths[i]), len(lengths)) - i
            low = next_rank.get(lengths[i], 0)
            next_rank[lengths[i]] = low + packs * each
            rows.append((lengths[i], low, low + packs * each, each, sequence, offset))
            offset += each * lengths[i]
            i += each
        sequence += packs
    return rows


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False,
         rows_per_salt: int = 100_000) -> DataFrame:
    """Every piece with its place: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    Null and empty texts are one end id. Repeated rows and repeated ids are packed as documents of their own. Texts longer than a
    sequence are cut. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(docs)
    cut_up = written(pieces(docs, tokenizer, doc_id, text, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    fills = spark.createDataFrame(slots(pack_histogram(histogram)) or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, each long, first long, place long")
    # Ranks within a length from counts per (length, salt): no task ever holds all pieces of one length.
    salts = max(1, -(-max(histogram.values(), default=0) // rows_per_salt))
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")) \
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The slot table has a bounded number of rows: patterns come from at most 4,096 lengths.
    placed = ranked.join(F.broadcast(fills), "length").where("low <= rank AND rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(*cut_up.columns, (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("place") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """Token ids per sequence from placed pieces that kept their ids; a sequence has at most 4,096 of them."""
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start"))).alias("p")).select(
        "sequence_id", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))

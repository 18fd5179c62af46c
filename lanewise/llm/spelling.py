"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

The vocabulary is counted in Spark. Each word's edits are generated as hashes (a rolling sum, so that an edit costs one addition, not a
new string) and probed against blocked Bloom filters, one per word length and part. Only hits become strings; they shuffle to an
exact join with the vocabulary, which removes the false ones. A pass broadcasts filters of at most `filter_bytes`; a larger vocabulary takes more
passes, and a length too large for one pass is cut into parts by hash.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix64, small_batches, text_or_empty, written

LEAST_LENGTH, LEAST_COUNT, RATIO, DIVISOR = 7, 2, 10, 31
COUNTED_WORDS = 200_000  # distinct words that a task holds before it hands partial counts on
BITS_PER_WORD, LEAST_SLOTS, FILTER_BYTES = 32, 64, 1 << 24
PROBED_CHARS = 1 << 19  # characters of the words that are probed at once
# One byte per code point up to U+00FF: letters stay, A-Z become small, all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
CHAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as small letters, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def misspelt(run: bytes, seed: int, divisor: int = DIVISOR) -> bytes:
    """The run, or the run without one code point if `divisor` divides the crc32 of id, colon and run (`seed` is that of id and colon)."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, min_count: int = LEAST_COUNT,
               divisor: int = DIVISOR) -> DataFrame:
    """word, n: the distinct words of `least` code points or more with `min_count` occurrences or more over all texts.

    Null texts have no words; a null id counts as the empty text. Rows count one by one, also when they repeat an id.
    """
    small_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in total], pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for name, body in zip(batch["name"].to_pylist(), batch["body"].to_pylist()):
                seed = zlib.crc32(f"{name}:".encode())
                for run, n in Counter([r for r in runs_of(body) if len(r) >= least]).items():
                    word = misspelt(run, seed, divisor)
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield flush()
        yield flush()

    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), text_or_empty(text).alias("body"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- hashes and filters ----

def word_grid(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def powers(length: int) -> np.ndarray:
    out = np.ones(length, np.uint64)
    np.multiply.accumulate(np.full(max(length - 1, 0), BASE, np.uint64), out=out[1:])
    return out


def grid_hash(grid: np.ndarray) -> np.ndarray:
    total, step = np.zeros(len(grid), np.uint64), powers(grid.shape[1])
    for i in range(grid.shape[1]):
        total += CHAR[grid[:, i]] * step[i]
    return total


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def mask_of(h: np.ndarray) -> np.ndarray:
    """Five of the 64 bits of a slot, from the hash's low 30 bits."""
    out = np.zeros(len(h), np.uint64)
    for k in range(0, 30, 6):
        out |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
    return out


@dataclass(frozen=True)
class Shard:
    """One filter: the words of a length whose hash falls into one of `parts` equal parts."""
    length: int
    part: int
    parts: int
    slots: int

    def holds(self, h: np.ndarray) -> np.ndarray | None:
        """Which hashes belong here; None for all."""
        return None if self.parts == 1 else (h * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)) % np.uint64(self.parts) == self.part


def shards_of(counts: dict[int, int], filter_bytes: int = FILTER_BYTES) -> list[list[Shard]]:
    """Passes of filters, each of at most `filter_bytes` in all."""
    passes, room = [], 0
    for length, n in sorted(counts.items()):
        need = max(LEAST_SLOTS, -(-n * BITS_PER_WORD // 64))
        parts = -(-need * 8 // filter_bytes)
        for part in range(parts):
            shard = Shard(length, part, parts, -(-need // parts))
            if shard.slots * 8 > room:
                passes.append([])
                room = filter_bytes
            passes[-1].append(shard)
            room -= shard.slots * 8
    return passes


def _by_length(words: list[str]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        b = w.encode("latin-1")
        out.setdefault(len(b), []).append(b)
    return out


def build_filters(vocab: DataFrame, shards: list[Shard]) -> dict[Shard, np.ndarray]:
    """The filters of one pass: Spark sets and joins the bits, the driver gets at most the pass's `filter_bytes` of slots."""
    of = {}
    for at, shard in enumerate(shards):
        of.setdefault(shard.length, []).append((at, shard))

    def bits(batches):
        for batch in batches:
            for length, words in _by_length(batch["word"].to_pylist()).items():
                h = scrambled(grid_hash(word_grid(words)))
                for at, shard in of[length]:
                    mine = h if shard.parts == 1 else h[shard.holds(h)]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(mine), at, np.int32)),
                        "slot": pa.array(slot_of(mine, shard.slots).astype(np.int32)), "bits": pa.array(mask_of(mine).view(np.int64))})

    inside = vocab.where(F.length("word").isin(sorted(of)))
    rows = inside.mapInArrow(bits, "shard int, slot int, bits long").groupBy("shard", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    shard, slot, mask = (rows[c].to_numpy() for c in ("shard", "slot", "bits"))
    out = {}
    for at, s in enumerate(shards):
        out[s] = np.zeros(s.slots, np.uint64)
        out[s][slot[shard == at]] = mask[shard == at].view(np.uint64)
    return out


def probe(h: np.ndarray, shard: Shard, table: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold: one bit for all, the other four for those that pass."""
    h = scrambled(h)
    at = np.flatnonzero((table[slot_of(h, shard.slots)] >> (h & np.uint64(63))) & np.uint64(1))
    if shard.parts > 1 and len(at):
        at = at[shard.holds(h[at])]
    if len(at):
        mask = mask_of(h[at])
        at = at[(table[slot_of(h[at], shard.slots)] & mask) == mask]
    return at


def deleted(grid: np.ndarray, shard: Shard, table: np.ndarray) -> Iterator[tuple[int, str]]:
    """(row, candidate) for each single deletion that the filter may hold; equal results of one word come once."""
    terms = CHAR[grid] * powers(grid.shape[1])
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    shorter = (upto - terms) + (upto[:, -1:] - upto) * np.uint64(BACK)
    for r, i in zip(*np.divmod(probe(shorter.ravel(), shard, table), grid.shape[1])):
        if not i or grid[r, i] != grid[r, i - 1]:
            word = grid[r].tobytes()
            yield int(r), (word[:i] + word[i + 1:]).decode("latin-1")


def replaced(grid: np.ndarray, alphabet: list[int], shard: Shard, table: np.ndarray) -> Iterator[tuple[int, str]]:
    """(row, candidate) for each replacement by a larger letter that the filter may hold; the other half are the same pairs."""
    step = np.tile(powers(grid.shape[1]), len(grid))
    order = np.argsort(grid, axis=None, kind="stable")
    letters, step = grid.ravel()[order], step[order]
    rest = grid_hash(grid)[order // grid.shape[1]] - CHAR[letters] * step
    for c in alphabet:
        below = int(np.searchsorted(letters, c))
        for at in order[probe(rest[:below] + CHAR[c:c + 1] * step[:below], shard, table)]:
            r, i = divmod(int(at), grid.shape[1])
            word = grid[r].tobytes()
            yield r, (word[:i] + bytes([c]) + word[i + 1:]).decode("latin-1")


def candidates(vocab: DataFrame, shards: list[Shard], alphabet: list[int]) -> DataFrame:
    """word, n, near: possible pairs of one pass, each pair from one of its sides."""
    filters = vocab.sparkSession.sparkContext.broadcast(build_filters(vocab, shards))
    lengths = sorted({x for s in shards for x in (s.length, s.length + 1)})

    def find(batches):
        for batch in batches:
            counted = dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist()))
            for length, words in _by_length(list(counted)).items():
                most = max(1, PROBED_CHARS // length)
                for start in range(0, len(words), most):
                    some = words[start:start + most]
                    grid = word_grid(some)
                    found = []
                    for shard, table in filters.value.items():
                        if shard.length == length:
                            found += replaced(grid, alphabet, shard, table)
                        elif shard.length == length - 1:
                            found += deleted(grid, shard, table)
                    names = [some[r].decode("latin-1") for r, _ in found]
                    yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "n": pa.array([counted[w] for w in names], pa.int64()),
                                                      "near": pa.array([c for _, c in found], pa.string())})

    return vocab.where(F.length("word").isin(lengths)).mapInArrow(find, "word string, n long, near string")


def near_words(vocab: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, near, near_n: both directions of every pair of words one insertion, deletion or replacement apart."""
    spark = vocab.sparkSession
    counts = {r["length"]: r["n"] for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return vocab.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))

    def letters(batches):
        seen = set()
        for batch in batches:
            seen.update(b"".join(w.encode("latin-1") for w in batch["word"].to_pylist()))
        yield pa.RecordBatch.from_pydict({"letter": pa.array(sorted(seen), pa.int32())})

    alphabet = sorted(r[0] for r in vocab.mapInArrow(letters, "letter int").distinct().collect())
    # Among words of one length alone and with none that is one shorter there is nothing to find.
    useful = {length: n for length, n in counts.items() if n > 1 or length + 1 in counts}
    out = None
    for shards in shards_of(useful or counts, filter_bytes):
        hits = candidates(vocab, shards, alphabet)
        out = hits if out is None else out.unionByName(hits)
    exact = out.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    pairs = written(exact.select("word", "n", "near", "near_n"), "near_words")
    return pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): forms followed to their end by pointer doubling. A form is more frequent than its word, so
    there are no circles, and chains are short as counts grow by a factor at each step."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(ahead, "root", "left"), "roots")
        now = moved.select("word", F.coalesce("further", "root").alias("root"))
        if not moved.where("further IS NOT NULL").head(1):
            return now


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, min_count: int = LEAST_COUNT,
                      ratio: int = RATIO, divisor: int = DIVISOR, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word of `vocabulary`: word, form, root, n, n_near, form_n.

    The form is the near word with the largest n (ties: the smallest), if that is `ratio` times the word's own or more, else null; the root
    ends the chain of forms and is the word itself without one. No rows or no words give no rows.
    """
    vocab = written(vocabulary(docs, doc_id, text, least, min_count, divisor), "vocabulary")
    near = near_words(vocab, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    far = -F.col("best.less") >= ratio * F.col("n")
    known = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"),
        F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    rooted = roots(known.where("form IS NOT NULL"))
    return known.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Phrase collocations from weighted acyclic automata over words.

Every word starts a window of up to four words that ends at its piece's end, so a phrase occurs as often as it starts windows. A task sorts
the windows of some texts and builds count transducers from them: acyclic automata whose states are prefixes, in arrays by level,
with the windows that end in a state as its weight. They are shuffled by prefix range, cut at sampled windows so that a frequent first word
spreads over many ranges. Each range's automata are united with their weights added; a state's count is the sum below it. The
frequent states form the phrase automaton, again by ranges, with which the parts of candidates are composed for their counts.
States are not merged by equal tails: their weights differ.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import small_batches, text_or_empty, written

LONGEST, MIN_COUNT, TOP = 4, 30, 2_000
SCALE, ABSORB = 2_000_000, 80
FLUSH_CHARS, UNION_ROWS = 1 << 23, 1 << 21
# Layout of the ranges; results do not depend on it. Bounds on the driver: MOST_RANGES windows per job.
RANGE_CHARS, LEAST_RANGES, MOST_RANGES, SAMPLED, SAMPLE_STEP = 6_000_000, 8, 65_536, 6_000, 16
STOP = b"."
# A-Z as small letters, tab as space, every piece mark as the one that `tokens` sets apart.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def tokens(texts: Sequence[str]) -> list[bytes]:
    """Words of the texts in order, with STOP wherever a piece ends."""
    body = STOP.join(t.encode("utf-8") for t in texts)
    return body.translate(BYTES).replace(STOP, b" . ").split()


def windows_of(texts: Sequence[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words in byte order, distinct windows as ids from 1 in ascending order with 0 for no word, occurrences of each)."""
    coded = pa.array(tokens(texts), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    order = [i for i in order if words[i] != STOP]
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ids = np.append(rank[coded.indices.to_numpy()], np.zeros(LONGEST, np.int64))
    at = np.flatnonzero(ids)
    rows = np.zeros((len(at), LONGEST), np.int64)
    rows[:, 0] = ids[at]
    for d in range(1, LONGEST):
        rows[:, d] = np.where(rows[:, d - 1] > 0, ids[at + d], 0)
    return [words[i] for i in order], *summed(rows, np.ones(len(rows), np.int64), len(order) + 1)


def packed(rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    return rows[:, 0] * base + rows[:, 1], rows[:, 2] * base + rows[:, 3]


def summed(rows: np.ndarray, weights: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order and the sums of their weights."""
    if not len(rows):
        return rows, weights
    high, low = packed(rows, base)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    start = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    return rows[order[start]], np.add.reduceat(weights[order], start)


class Transducer:
    """Count transducer of sorted distinct windows. Per level: label, weight of the windows that end there, first child, and `count`,
    the weight of all windows through the state; `words` are the label's words in byte order from 1."""

    def __init__(self, words: list[bytes], rows: np.ndarray, weights: np.ndarray):
        self.words, self.labels, self.own, self.first, self.count = words, [], [], [], []
        below, total = np.zeros(len(rows), bool), np.append(0, np.cumsum(weights))
        places = []
        for d in range(LONGEST):
            below[:1] = True
            below[1:] |= rows[1:, d] != rows[:-1, d]
            start = np.flatnonzero(below)
            end = np.append(start[1:], len(rows))
            some = rows[start, d] > 0
            start, end = start[some], end[some]
            ends = np.ones(len(start), bool) if d == LONGEST - 1 else rows[start, d + 1] == 0
            places.append(start)
            self.labels.append(rows[start, d])
            self.own.append(np.where(ends, weights[start], 0))
            self.count.append(total[end] - total[start])
        for d in range(LONGEST - 1):
            self.first.append(np.append(np.searchsorted(places[d + 1], places[d]), len(places[d + 1])))

    def parents(self, d: int) -> np.ndarray:
        """State of level d - 1 above each state of level d."""
        return np.repeat(np.arange(len(self.labels[d - 1])), np.diff(self.first[d - 1]))

    def packed(self) -> dict:
        """Words and arrays as bytes, each array in the narrowest type."""
        def narrow(a):
            kind = np.min_scalar_type(int(a.max(initial=0)))
            return bytes([kind.itemsize]) + a.astype(kind).tobytes()
        arrays = [narrow(a) for d in range(LONGEST) for a in (self.labels[d], self.own[d], *([np.diff(self.first[d])] if d < LONGEST - 1 else []))]
        return {"words": b"\n".join(self.words), "arrays": arrays}

    def compose(self, parts: np.ndarray) -> np.ndarray:
        """The own weight at the end of each part (rows of ids, 0 beyond its end, negative for unknown words); 0 where no path leads."""
        base, state = len(self.words) + 1, np.zeros(len(parts), np.int64)
        alive, out = np.ones(len(parts), bool), np.zeros(len(parts), np.int64)
        for d in range(LONGEST):
            above = self.parents(d) if d else np.zeros(len(self.labels[0]), np.int64)
            key, want = above * base + self.labels[d], state * base + parts[:, d]
            alive &= (parts[:, d] > 0) & (len(key) > 0)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            alive[alive] = key[at[alive]] == want[alive]
            state = np.where(alive, at, 0)
            done = alive if d == LONGEST - 1 else alive & (parts[:, d + 1] == 0)
            out[done] = self.own[d][state[done]]
        return out


def unpacked(words: bytes, arrays: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, windows and weights of `Transducer.packed`."""
    wide = [np.frombuffer(a, f"<u{a[0]}", offset=1).astype(np.int64) for a in arrays]
    paths, rows, weights = np.zeros((1, 0), np.int64), [], []
    fan = np.array([len(wide[0])])
    for d in range(LONGEST):
        labels, own = wide[3 * d], wide[3 * d + 1]
        paths = np.column_stack([np.repeat(paths, fan, axis=0), labels])
        fan = wide[3 * d + 2] if d < LONGEST - 1 else None
        ends = own > 0
        rows.append(np.pad(paths[ends], ((0, 0), (0, LONGEST - d - 1))))
        weights.append(own[ends])
    return words.split(b"\n") if words else [], np.concatenate(rows), np.concatenate(weights)


def cut(words: list[bytes], rows: np.ndarray, bounds: Sequence[tuple]) -> list[int]:
    """Place of each bound (a tuple of words) among sorted windows."""
    base = len(words) + 1
    high, low = packed(rows, base)
    out = []
    for bound in bounds:
        ids = []
        for word in bound:
            at = bisect_left(words, word)
            ids.append(at + 1)
            if at == len(words) or words[at] != word:
                break
        ids += [0] * (LONGEST - len(ids))
        a, b = ids[0] * base + ids[1], ids[2] * base + ids[3]
        start, end = np.searchsorted(high, a, "left"), np.searchsorted(high, a, "right")
        out.append(int(start + np.searchsorted(low[start:end], b, "left")))
    return out


def buffered(batches: Iterator[pa.RecordBatch], most: int = FLUSH_CHARS) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) in portions of about `most` characters over all languages."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for lang, body in zip(batch["lang"].to_pylist(), batch["body"].to_pylist()):
            held.setdefault(lang, []).append(body)
            size += len(body)
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def sampled_bounds(rows: DataFrame, chars: dict[str, int], range_chars: int = RANGE_CHARS) -> dict[str, list[tuple]]:
    """Per language the windows at which its ranges begin, all but the first; from a sample of texts chosen by hash."""
    total = max(sum(chars.values()), 1)
    wanted = {lang: max(LEAST_RANGES, -(-n // max(range_chars, total // MOST_RANGES))) for lang, n in chars.items()}
    share = min(1.0, max(range_chars, SAMPLED * sum(wanted.values())) / total)

    def sample(batches):
        for lang, texts in buffered(batches):
            words, found, _ = windows_of(texts)
            picked = [b" ".join(words[i - 1] for i in row if i).decode() for row in found[SAMPLE_STEP // 2::SAMPLE_STEP].tolist()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(picked), pa.string()), "window": pa.array(picked, pa.string())})

    some = rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = some.mapInArrow(sample, "lang string, window string").toArrow()
    by_lang: dict[str, list[tuple]] = {}
    for lang, window in zip(drawn["lang"].to_pylist(), drawn["window"].to_pylist()):
        by_lang.setdefault(lang, []).append(words_of(window))
    out = {}
    for lang, n in wanted.items():
        have = sorted(by_lang.get(lang, []))
        out[lang] = sorted({have[len(have) * k // n] for k in range(1, n)}) if have else []
    return out


def words_of(phrase: str) -> tuple:
    return tuple(phrase.encode().split(b" "))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT,
                  range_chars: int = RANGE_CHARS) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """(lang, phrase, f) of all phrases of one to four words with f >= min_count and, with phrase null, the words of each language;
    and the bounds of the ranges. Null texts have no words, a null lang is `und`."""
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("body"))
    chars = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("body")).alias("n")).collect()}
    held = docs.sparkSession.sparkContext.broadcast(bounds := sampled_bounds(rows, chars, range_chars))

    def build(batches):
        for lang, texts in buffered(batches):
            words, found, weights = windows_of(texts)
            places = [0, *cut(words, found, held.value[lang]), len(found)]
            made = []
            for part, (a, b) in enumerate(zip(places, places[1:])):
                if a < b:
                    used = np.unique(found[a:b])
                    mine = np.searchsorted(used[used > 0], found[a:b]) + (found[a:b] > 0)
                    made.append({"lang": lang, "part": part, **Transducer([words[i - 1] for i in used if i], mine, weights[a:b]).packed()})
                    if len(made) == 64:
                        yield pa.RecordBatch.from_pylist(made, BUILT)
                        made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, BUILT)

    def unite(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = united(zip(frame["words"], frame["arrays"]))
        bounds = held.value[key[0]]
        edges = [bounds[p] for p in (int(key[1]) - 1, int(key[1])) if 0 <= p < len(bounds)]
        found = dict(frequent_states(whole, min_count))
        # A prefix of a bound may go on in another range: its count is handed on whatever its size.
        part_ids = {w: i + 1 for i, w in enumerate(whole.words)}
        for prefix in {e[:d] for e in edges for d in range(1, LONGEST + 1)}:
            n = through(whole, [part_ids.get(w, -1) for w in prefix])
            if n:
                found[b" ".join(prefix)] = n
        return pd.DataFrame({"lang": key[0], "phrase": [None, *[p.decode() for p in found]], "f": [int(whole.count[0].sum()), *found.values()]})

    parts = rows.mapInArrow(build, BUILT_SQL).groupBy("lang", "part").applyInPandas(unite, "lang string, phrase string, f long")
    every = parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= min_count))
    return written(every, "phrase_counts"), bounds


BUILT = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("words", pa.binary()), ("arrays", pa.list_(pa.binary()))])
BUILT_SQL = "lang string, part int, words binary, arrays array<binary>"


def united(parts: Iterator[tuple[bytes, Sequence[bytes]]]) -> Transducer:
    """The union of transducers, weights added; sorted and summed whenever UNION_ROWS windows have come together."""
    ids: dict[bytes, int] = {}
    rows, weights, held = [], [], 0

    def fold():
        r, w = summed(np.concatenate(rows), np.concatenate(weights), len(ids) + 1)
        rows[:], weights[:] = [r], [w]
        return len(r)

    limit = UNION_ROWS
    for packed_words, arrays in parts:
        words, found, n = unpacked(packed_words, arrays)
        to = np.array([0, *[ids.setdefault(w, len(ids) + 1) for w in words]], np.int64)
        rows.append(to[found])
        weights.append(n)
        held += len(n)
        if held >= limit:
            held = fold()
            limit = max(UNION_ROWS, 2 * held)
    order = sorted(ids, key=ids.__getitem__)
    ranked = sorted(range(len(order)), key=order.__getitem__)
    to = np.zeros(len(order) + 1, np.int64)
    to[np.array(ranked, np.int64) + 1] = np.arange(1, len(order) + 1)
    if not rows:
        return Transducer([], np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64))
    return Transducer([order[i] for i in ranked], *summed(to[np.concatenate(rows)], np.concatenate(weights), len(order) + 1))


def frequent_states(t: Transducer, least: int) -> Iterator[tuple[bytes, int]]:
    """(phrase, count) of the states with count >= least; each lies below one of the level above."""
    above: dict[int, bytes] = {0: b""}
    for d in range(LONGEST):
        parent = t.parents(d) if d else np.zeros(len(t.labels[0]), np.int64)
        now = {}
        for s in np.flatnonzero(t.count[d] >= least).tolist():
            word = t.words[t.labels[d][s] - 1]
            now[s] = above[int(parent[s])] + b" " + word if d else word
            yield now[s], int(t.count[d][s])
        above = now


def through(t: Transducer, ids: Sequence[int]) -> int:
    """Count of the state at the end of a path; 0 without one."""
    start, end, state = 0, len(t.labels[0]), 0
    for d, word in enumerate(ids):
        state = start + int(np.searchsorted(t.labels[d][start:end], word))
        if state >= end or t.labels[d][state] != word:
            return 0
        if d < LONGEST - 1:
            start, end = int(t.first[d][state]), int(t.first[d][state + 1])
    return int(t.count[len(ids) - 1][state])


def part_counts(counts: DataFrame, parts: DataFrame, bounds: dict[str, list[tuple]]) -> DataFrame:
    """lang, part, f: the distinct parts composed with the automaton of the frequent phrases, range by range."""
    held = counts.sparkSession.sparkContext.broadcast(bounds)

    def routed(rows: DataFrame, column: str) -> DataFrame:
        @F.pandas_udf("int")
        def place(langs: pd.Series, phrases: pd.Series) -> pd.Series:
            return pd.Series([bisect_right(held.value[a], words_of(b)) for a, b in zip(langs, phrases)], dtype="int32")
        return rows.withColumn("part", place("lang", column)).groupBy("lang", "part")

    def look(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tuples = [words_of(p) for p in known["phrase"]]
        words = sorted({w for t in tuples for w in t})
        ids = {w: i + 1 for i, w in enumerate(words)}
        def grid(phrases):
            return np.array([[ids.get(w, -1) for w in p] + [0] * (LONGEST - len(p)) for p in phrases], np.int64).reshape(-1, LONGEST)
        automaton = Transducer(words, *summed(grid(tuples), known["f"].to_numpy(np.int64), len(words) + 1))
        found = automaton.compose(grid([words_of(p) for p in asked["wanted"]]))
        return pd.DataFrame({"lang": asked["lang"], "wanted": asked["wanted"], "f": found})

    asked = parts.distinct()
    return routed(counts, "phrase").cogroup(routed(asked, "wanted")).applyInPandas(look, "lang string, wanted string, f long")


def _score(a: Column, both: Column) -> Column:
    """floor(SCALE * a / both) in whole numbers of up to 38 digits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * a.cast("decimal(19,0)"), both.cast("decimal(20,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, top: int = TOP,
                 absorb: int = ABSORB, range_chars: int = RANGE_CHARS) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have two to four words and `min_count` occurrences or more. The score is that of the cut with the lowest floor(2000000 a /
    (l + r)), ties to the shortest first part. A phrase inside a longer one with `absorb` percent of its occurrences or more is left out.
    Ties in rank go by occurrences, then by the phrase's bytes. No rows or no words give no rows.
    """
    every, bounds = phrase_counts(docs, lang, text, min_count, range_chars)
    counts = every.where("phrase IS NOT NULL")
    words = F.split("phrase", " ", -1)
    candidates = counts.withColumn("words", words).where(F.size("words") > 1)

    def part(start, size):
        return F.array_join(F.slice("words", start, size), " ")
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: part(at, size))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(pieces).alias("phrase"), F.col("f").alias("longest")) \
        .groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = candidates.join(longer, ["lang", "phrase"], "left") \
        .where(F.col("longest").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longest") < F.lit(absorb).cast("decimal(3,0)") * F.col("f")))
    cuts = written(kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
            k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.size("words") - k).alias("tail")))).alias("cut"))
        .select("lang", "phrase", "a", "cut.*"), "cuts")
    asked = cuts.select("lang", F.explode(F.array("head", "tail")).alias("wanted"))
    known = written(part_counts(counts, asked, bounds), "part_counts")
    head, tail = (known.select("lang", F.col("wanted").alias(c), F.col("f").alias(v)) for c, v in (("head", "l"), ("tail", "r")))
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]) \
        .withColumn("score", _score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each language are among the first of its 64 shares.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    first = scored.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = every.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

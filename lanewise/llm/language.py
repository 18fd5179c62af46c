"""Language of texts and of spans in mixed-language texts.

The scripts of a word's letters leave the languages that were seen in that script. Each candidate gets a log-likelihood from its
character n-grams; Viterbi over the words with a penalty per switch labels the spans. A whole text keeps one language without
the search when no stretch of words gains more in any other language than a switch costs, which gives the same path.
"""
from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import hashed_share, held_out, small_batches, small_groups

# Fixed script ranges (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "armenian": [(0x531, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x9FFF)],
}
SIDE = 64  # classes of letters: 0 space, 1-26 a-z, then the others by code point
CELLS = SIDE ** 3
UNKNOWN = "und"
PENALTY = 8.0
GROUP_CHARS = 1 << 18


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: letter class (0: no letter) and script bit."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    kind = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (SIDE - 27)).astype(np.int32)
    bit = np.full(len(points), 1 << len(SCRIPTS), np.int32)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            bit[a:b + 1] = 1 << k
    return np.where(letter, kind, 0), np.where(letter, bit, 0)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of several texts: cell of (class before, own, after), script bit, word number; and words per text.

    Words are runs between white space, numbered on through the texts; letters are folded and composed first. A word's first and
    last letter have a space before and after them; signs inside a word are skipped.
    """
    kind, bit = letter_tables()
    folded = "\0".join(unicodedata.normalize("NFC", t.replace("\0", "\x01").lower()) for t in texts) + "\0"
    points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0)
    first = ~space & np.concatenate([[True], space[:-1]])
    word = np.cumsum(first) - 1
    ends = np.cumsum(first)[points == 0]
    kinds = kind[points]
    kept = np.flatnonzero((kinds > 0) | space)
    seq = np.concatenate([[0], kinds[kept], [0]])
    cell = (seq[:-2] * SIDE + seq[1:-1]) * SIDE + seq[2:]
    letter = seq[1:-1] > 0
    at = kept[letter]
    return cell[letter], bit[points[at]], word[at], np.diff(ends, prepend=0)


class Model:
    """Score per cell and language, scripts per language, and the commonest language; travels with the tasks."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray, prior: str):
        self.languages, self.table, self.scripts, self.prior = languages, table, scripts, prior

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores at most 0, all 0 for a word without letters or known script; words per text."""
        cell, bit, word, sizes = letters_of(texts)
        out = np.zeros((int(sizes.sum()), len(self.languages)), np.float32)
        if len(cell):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            score = np.add.reduceat(self.table[cell], starts, axis=0)
            seen = np.bitwise_or.reduceat(bit, starts)
            allowed = np.zeros(score.shape, bool)
            for k in range(len(SCRIPTS) + 1):
                allowed |= ((seen >> k) & 1).astype(bool)[:, None] & self.scripts[k]
            score = np.where(allowed, score, -np.inf)
            score = np.clip(score - score.max(axis=1, keepdims=True), -12, 0, where=allowed.any(axis=1)[:, None], out=np.zeros_like(score))
            out[word[starts]] = score
        return out, sizes


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label per row when every change of label costs `penalty`; ties go to the smaller label and to staying."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    gain = np.cumsum((np.delete(scores, best, axis=1).max(axis=1) if k > 1 else scores[:, 0] * 0 - 1).astype(np.float64) - scores[:, best])
    lowest = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if k == 1 or (gain - lowest).max() < penalty:
        return np.full(n, best, np.int64)
    value, back = scores[0].astype(float).tolist(), np.zeros((n, k), np.int8 if k < 128 else np.int32)
    rows = scores.astype(float).tolist()
    for i in range(1, n):
        top = max(range(k), key=value.__getitem__)
        switch = value[top] - penalty
        row, came = rows[i], back[i]
        for j in range(k):
            if value[j] >= switch:
                came[j], value[j] = j, value[j] + row[j]
            else:
                came[j], value[j] = top, switch + row[j]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(value))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label_text(text: str, scores: np.ndarray, model: Model) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, score, spans): the language of most words, its share of them times its certainty, spans (first, end, language)."""
    known = scores.any(axis=1)
    if not known.any():
        return (model.prior if any(c.isalpha() for c in text) else UNKNOWN), 0.0, []
    path = viterbi(scores)
    share = np.bincount(path[known], minlength=len(model.languages))
    label = int(share.argmax())
    mean = scores[known & (path == label)].mean(axis=0, dtype=np.float64)
    sure = 1 / np.exp(np.clip(mean - mean[label], -30, 0)).sum()
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return model.languages[label], float(share[label] / share.sum() * sure), [(a, b, model.languages[path[a]]) for a, b in zip(edges, edges[1:])]


def train(docs: DataFrame, bound: int = 8_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Letter-triple model from texts with a language outside the held-out third; at most about `bound` of them, chosen by hash.

    Counts per language and cell (at most SIDE^3) are made per partition and added in Spark. A script is a language's own when one
    of fifty of its letters is in it. None without a training text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")) \
        .where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out("doc_id"))
    rows = hashed_share(rows, bound)
    small_batches(docs)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for language, texts in frame.groupby("lang")["text"]:
                cells, scripts = np.zeros(CELLS, np.int64), Counter()
                values = texts.tolist()
                for group in small_groups(values, len, GROUP_CHARS):
                    cell, bit, _, _ = letters_of([values[i] for i in group])
                    cells += np.bincount(cell, minlength=CELLS)
                    scripts.update(dict(zip(*np.unique(bit, return_counts=True))))
                used = np.flatnonzero(cells)
                yield pd.DataFrame({"lang": language, "key": [*used, *(-b for b in scripts)], "n": [*cells[used], *scripts.values()]}).astype({"key": "int64", "n": "int64"})
    got = rows.select("lang", "text").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    counts, scripts = np.zeros((CELLS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    for i, language in enumerate(languages):
        own = got[got["lang"] == language]
        cells, bits = own[own["key"] >= 0], own[own["key"] < 0]
        counts[cells["key"], i] = cells["n"]
        scripts[np.log2(-bits["key"].to_numpy()).astype(int), i] = bits["n"]
    cube = counts.reshape(SIDE, SIDE, SIDE, -1)
    # Triples, pairs and single letters each as a share of the language's letters; the longer weigh more.
    table = sum(w * np.log((c + 0.5) / (c.sum(axis=(0, 1, 2)) + 0.5 * c[..., 0].size)) for w, c in
                ((0.6, cube), (0.3, cube.sum(axis=2, keepdims=True)), (0.1, cube.sum(axis=(0, 2), keepdims=True))))
    common = int(np.argmax(counts.sum(axis=0)))
    return Model(languages, table.reshape(CELLS, -1).astype(np.float32), scripts >= 0.02 * scripts.sum(axis=0), languages[common])


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (and spans of words: first, end, language).

    `und` for a null text and one without letters; a text whose letters are in no known script gets the commonest language with score
    0. Without a model every row is `und`. Repeated rows are labelled alike; no rows give no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    small_batches(docs)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, got = [t or "" for t in batch.column(2).to_pylist()], []
            for group in small_groups(texts, len, GROUP_CHARS):
                some = [texts[i] for i in group]
                if model is None:
                    got += [(UNKNOWN, 0.0, [])] * len(some)
                    continue
                scores, sizes = model.word_scores(some)
                got += [label_text(t, s, model) for t, s in zip(some, np.split(scores, np.cumsum(sizes)[:-1]))]
            parts = [[{"first": a, "end": b, "lang": x} for a, b, x in s] if spans else None for _, _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                              pa.array(parts, span_type)], ["doc_id", "held_out", "lang_pred", "score", "spans"])
    out = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, "
                                 "spans array<struct<first: bigint, end: bigint, lang: string>>")
    return out if spans else out.drop("spans")

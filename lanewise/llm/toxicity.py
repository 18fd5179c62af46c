"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words, by their longest known stem, to the symbols insult, threat, target, negation and report. Small
transducers for negation, reported speech and target each follow the symbols of a clause; their composition says in which context
an insult or threat stands. Weighted sums per context, over the clauses of a document, are calibrated by a logistic model.
Stems of insults and their weights are learned from labelled rows; the words of the other symbols are fixed lists.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_bytes, fresh, hashed_share, held_out, hold, small_batches, text_or_empty, words_column, written

# Fixed word lists per symbol.
FIXED = {
    "threat": "kill hurt destroy beat shoot stab burn hang die matar morir tuer mourir töten sterben",
    "target": "you your yours yourself he she him her they them tu vous toi usted ustedes du ihr euch dich",
    "negation": "not never no nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca",
    "report": "said says wrote writes called quoted claims claimed told reported dit sagte dijo schrieb",
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = dict(zip(FIXED, (THREAT, TARGET, NEGATION, REPORT)))
STEM = (4, 12)  # shortest and longest stem
NEGATED_FOR = 3  # words
CONTEXTS = 8  # negated + 2 * reported + 4 * targeted


class Transducer:
    """Deterministic, over symbols: (state, symbol) -> (state, output bit); other symbols use the state's default."""

    def __init__(self, moves: dict[tuple[int, int], tuple[int, int]], default: dict[int, tuple[int, int]]):
        self.moves, self.default = moves, default

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.moves.get((state, symbol)) or self.default[state]


def negation() -> Transducer:
    """Outputs 1 for the words up to NEGATED_FOR after a negation."""
    return Transducer({(s, NEGATION): (NEGATED_FOR, 0) for s in range(NEGATED_FOR + 1)},
                      {s: (max(0, s - 1), int(s > 0)) for s in range(NEGATED_FOR + 1)})


def after(symbol: int) -> Transducer:
    """Outputs 1 from the symbol to the end of the clause."""
    return Transducer({(0, symbol): (1, 1)}, {0: (0, 0), 1: (1, 1)})


def compose(parts: list[Transducer]) -> Transducer:
    """The product: states are numbered as reached; output bit i is that of part i."""
    number, todo, moves, default = {(0,) * len(parts): 0}, [(0,) * len(parts)], {}, {}
    while todo:
        state = todo.pop()
        for symbol in range(6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            moves[number[state], symbol] = (number[to], sum(bit << i for i, (_, bit) in enumerate(steps)))
    return Transducer(moves, default)


@lru_cache(maxsize=1)
def grammar() -> tuple[Transducer, Transducer]:
    """Left to right: negation, report and target before the word. Right to left: target after the word."""
    return compose([negation(), after(REPORT), after(TARGET)]), compose([after(TARGET)])


class Lexicon(dict):
    """word -> (symbol, weight, ends a clause), remembered up to a bound; `stems` has the learned insults."""

    LIMIT = 100_000

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: SYMBOLS[k] for k, words in FIXED.items() for w in words.split()}

    def __missing__(self, word: bytes) -> int | tuple[int, float, bool]:
        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode()
        core = text.strip(".,;:!?\"'()[]#*$%&|<>").lower()
        end = text[-1] in ".,;:!?"
        symbol, weight = self.fixed.get(core, OTHER), 1.0
        for n in range(min(len(core), STEM[1]), STEM[0] - 1, -1):
            if core[:n] in self.stems:
                symbol, weight = INSULT, self.stems[core[:n]]
                break
        out = (symbol, weight, end) if symbol in (INSULT, THREAT) else 0
        self[word] = out
        return out

    def symbol(self, word: bytes) -> int:
        core = word.decode().strip(".,;:!?\"'()[]#*$%&|<>").lower()
        hit = self[word]
        return hit[0] if hit else self.fixed.get(core, OTHER)


def features(text, lexicon: Lexicon) -> np.ndarray:
    """Weight of insults per context, of threats at a target, hits, and hits per word."""
    words = as_bytes(text).split()
    out = np.zeros(CONTEXTS + 3)
    hits = [i for i, x in enumerate(map(lexicon.__getitem__, words)) if x]
    forward, backward = grammar()
    done = -1
    for i in hits:
        if i <= done:
            continue
        low, high = i, i
        while low and words[low - 1][-1:] not in (b".", b",", b";", b":", b"!", b"?"):
            low -= 1
        while high + 1 < len(words) and words[high][-1:] not in (b".", b",", b";", b":", b"!", b"?"):
            high += 1
        symbols = [lexicon.symbol(w) for w in words[low:high + 1]]
        state, before, behind = 0, [], [0] * len(symbols)
        for s in symbols:
            state, bits = forward.step(state, s)
            before.append(bits)
        state = 0
        for k in range(len(symbols) - 1, -1, -1):
            state, behind[k] = backward.step(state, symbols[k])
        for k, s in enumerate(symbols):
            context = before[k] | (behind[k] << 2)
            if s == INSULT:
                out[context] += lexicon[words[low + k]][1]
                out[CONTEXTS + 1] += 1
            elif s == THREAT and context & 4 and not context & 3:
                out[CONTEXTS] += 1
        done = high
    out[CONTEXTS + 2] = 1000 * out[CONTEXTS + 1] / max(1, len(words))
    return np.log1p(out)


def learn_stems(rows: DataFrame, least: int = 4, odds: float = 16.0, most: int = 5000) -> dict[str, float]:
    """Stems with the log-odds of their toxic against clean use, from rows (text, toxic).

    A use counts once per preceding word, so copies of a document add nothing. The shortest stem that is as telling stands for the
    longer ones. At most `most` stems, those used most; the tables behind them are aggregated in Spark.
    """
    words = F.transform(words_column(F.lower(text_or_empty("text"))), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    uses = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.transform(
        "w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1)).alias("before")))).alias("u")) \
        .select("toxic", "u.word", "u.before").where(F.length("word").between(STEM[0], 40)).distinct()
    counts = uses.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    counts = written(counts, "uses")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    bad, good = max(1, total["bad"] or 0), max(1, total["good"] or 0)
    stems = counts.select(F.explode(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word")))).alias("n"), "word", "bad", "good") \
        .groupBy(F.substring("word", F.lit(1), F.col("n")).alias("stem")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    found = stems.withColumn("weight", ratio).where((F.col("bad") >= least) & (F.col("weight") >= float(np.log(odds)))) \
        .orderBy(F.desc("bad"), F.length("stem"), "stem").limit(most).collect()
    known = {r["stem"]: r["weight"] for r in found}
    kept: dict[str, float] = {}
    for stem in sorted(known, key=len):  # a longer stem only where it is clearly more telling than a kept one inside it
        inside = [kept[stem[:n]] for n in range(STEM[0], len(stem)) if stem[:n] in kept]
        if not inside or known[stem] > max(inside) + 2:
            kept[stem] = known[stem]
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights and intercept by damped Newton steps; a class without rows gives the smoothed base rate."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = ridge * np.append(np.ones(x.shape[1]), 0)

    def loss(v: np.ndarray) -> float:
        z = x1 @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (v * v))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-6), x1.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, bound: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], list[float]]:
    """(stems, logistic weights) from labelled rows outside the held-out third; at most about `bound` of them, chosen by hash."""
    small_batches(docs)
    marked = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["_id"])
    rows = written(hashed_share(marked.where(~held_out("_id")), bound, "_id"), "marked")
    rows = written(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "_id"), "labelled")
    stems = learn_stems(rows)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = hold(Lexicon(stems))
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "x": pd.Series([features(t, lexicon).tolist() for t in frame["text"]], dtype=object)})
    got = rows.select("toxic", "text").mapInPandas(measure, "toxic int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), CONTEXTS + 3)
    return stems, fit_logistic(x, got["toxic"].to_numpy(float)).tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], text: str = "text", column: str = "score") -> DataFrame:
    """All columns of `docs` and the probability of a toxic text, in the place of a column of that name.

    A null text is the empty one, which has no clause. Repeated rows are scored alike; no rows give no rows.
    """
    stems, weights = model
    small_batches(docs)
    w = np.array(weights)
    clash = [c for c in docs.columns if c.lower() == column.lower()]
    source = docs.drop(*clash)
    at = [f.name for f in source.schema].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = hold(Lexicon(stems))
        for batch in batches:
            x = np.array([features(v.as_py(), lexicon) for v in batch.column(at)]).reshape(batch.num_rows, CONTEXTS + 3)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, column])
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(column, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 12_000) -> DataFrame:
    """The rows whose score stays under the threshold, with all their columns."""
    mark = fresh(docs, "_toxicity")
    return score(docs, train(docs, labels, bound), column=mark).where(F.col(mark) < threshold).drop(mark)

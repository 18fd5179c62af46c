"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature.

Every term has a fixed sparse random index vector. A term's word vector is its own index vector and the sum of those of the terms
next to it, over a bounded sample of documents. Terms are words in a hashed vocabulary and the forms that tell prose from debris:
capitals, digits, signs, and a word said again. A document is the mean of its word vectors; the network is trained in numpy.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, hashed_share, held_out, hold, small_batches, written

VOCABULARY, FORMS, WIDTH, NONZERO = 4096, 64, 96, 6
SAID_AGAIN, TERMS = VOCABULARY + FORMS, VOCABULARY + FORMS + 1


def index_vectors(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((TERMS, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out / np.sqrt(NONZERO).astype(np.float32)


def form(word: str) -> int:
    """A number under FORMS: case, signs at the end or alone, digits, length."""
    letters = [c for c in word if c.isalpha()]
    signs = sum(not c.isalnum() for c in word)
    case = 0 if not letters else 2 if len(letters) > 1 and all(c.isupper() for c in letters) else 1
    kind = 0 if not signs else 1 if signs == 1 and word[-1] in ".,;:" else 2 if letters else 3
    return case * 16 + kind * 4 + (2 if any(c.isdigit() for c in word) else 0) + (1 if len(word) > 12 else 0)


class Terms(dict):
    """word -> (vocabulary term, form term), remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode()
        core = text.strip(".,;:!?\"'()[]#*$%&|<>").lower()
        self[word] = out = (xxhash.xxh64_intdigest(core.encode()) % VOCABULARY, VOCABULARY + form(text))
        return out


def terms(text, known: Terms) -> np.ndarray:
    """Rows (word, form) per word; a word said again has the form SAID_AGAIN."""
    words = as_bytes(text).split()
    if not words:
        return np.zeros((0, 2), np.int64)
    out = np.array(list(map(known.__getitem__, words)), np.int64)
    out[1:][out[1:, 0] == out[:-1, 0], 1] = SAID_AGAIN
    return out


def context_counts(texts: DataFrame) -> np.ndarray:
    """Per term the sum of the index vectors beside it, from (text); partial sums are one row per term and partition."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, known = index_vectors(), Terms()
        total = np.zeros((TERMS, WIDTH), np.float32)
        for frame in frames:
            for text in frame["text"]:
                t = terms(text, known)
                both = index[t[:, 0]] + index[t[:, 1]] if len(t) else np.zeros((0, WIDTH), np.float32)
                if len(t) > 1:
                    beside = np.zeros_like(both)
                    beside[1:] += both[:-1]
                    beside[:-1] += both[1:]
                    np.add.at(total, t[:, 0], beside)
                    np.add.at(total, t[:, 1], beside)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"term": used.astype("int64"), "v": pd.Series([total[i].astype(float).tolist() for i in used], dtype=object)})
    parts = texts.mapInPandas(run, "term long, v array<double>")
    sums = parts.select("term", F.posexplode("v").alias("at", "v")).groupBy("term", "at").agg(F.sum("v").alias("v"))
    got = sums.toPandas()  # at most TERMS * WIDTH numbers
    out = np.zeros((TERMS, WIDTH), np.float32)
    out[got["term"].to_numpy(int), got["at"].to_numpy(int)] = got["v"]
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Unit context vectors added at half weight to the index vectors."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index_vectors() + 0.5 * context / np.maximum(norm, 1e-9)


def pooled(text, vectors: np.ndarray, known: Terms) -> np.ndarray:
    """Mean vector of words, mean vector of forms, log length; zeros for an empty text."""
    t = terms(text, known)
    out = np.zeros(2 * WIDTH + 1, np.float32)
    if len(t):
        count = np.bincount(t.ravel(), minlength=TERMS).astype(np.float32) / len(t)
        out[:WIDTH], out[WIDTH:2 * WIDTH] = count[:VOCABULARY] @ vectors[:VOCABULARY], count[VOCABULARY:] @ vectors[VOCABULARY:] * 4
        out[-1] = np.log1p(len(t)) / 10
    return out


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 1) -> dict[str, np.ndarray]:
    """Two layers (tanh, logistic) by Adam; every fifth row is left out and sets the temperature."""
    rng = np.random.default_rng(seed)
    net = {"a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, hidden ** -0.5, hidden),
           "d": np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))]), "t": np.ones(1)}
    if len(y) < 10 or y.min() == y.max():
        net["c"][:] = 0
        return net
    keep = np.arange(len(y)) % 5 > 0
    tx, ty = x[keep], y[keep]
    balance = np.where(ty > 0, 1.0, ty.mean() / max(1e-9, 1 - ty.mean())) ** 0.5
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    step, size = 0, min(256, len(ty))
    for _ in range(max(epochs, 2000 * size // len(ty))):
        order = rng.permutation(len(ty))
        for i in range(0, len(ty), size):
            at = order[i:i + size]
            h = np.tanh(tx[at] @ net["a"] + net["b"])
            p = 1 / (1 + np.exp(-np.clip(h @ net["c"] + net["d"], -30, 30)))
            g = (p - ty[at]) * balance[at] / len(at)
            gh = np.outer(g, net["c"]) * (1 - h * h)
            grads = {"a": tx[at].T @ gh + 1e-5 * net["a"], "b": gh.sum(0), "c": h.T @ g + 1e-5 * net["c"], "d": np.array([g.sum()])}
            step += 1
            for k, d in grads.items():
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * d
                v *= 0.999
                v += 0.001 * d * d
                net[k] = net[k] - 0.005 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    z = np.tanh(x[~keep] @ net["a"] + net["b"]) @ net["c"] + net["d"]
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, z / t) - y[~keep] * z / t) for t in grid]
    net["t"] = grid[[int(np.argmin(loss))]]
    return net


def probability(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    z = (np.tanh(x @ net["a"] + net["b"]) @ net["c"] + net["d"]) / net["t"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, bound: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(word vectors, network) from labelled rows outside the held-out third; at most about `bound` of them, chosen by hash."""
    small_batches(docs)
    marked = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).dropDuplicates(["_id"])
    rows = written(hashed_share(marked.where(~held_out("_id")), bound, "_id"), "marked")
    rows = written(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "_id"), "labelled")
    vectors = word_vectors(context_counts(rows.select("text")))

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = hold(Terms())
        for frame in frames:
            yield pd.DataFrame({"id": frame["_id"], "y": frame["quality"], "x": pd.Series([pooled(t, vectors, known).astype(float).tolist() for t in frame["text"]], dtype=object)})
    got = rows.mapInPandas(pool, f"id {rows.schema['_id'].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), 2 * WIDTH + 1)
    return vectors, fit_network(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: tuple[np.ndarray, dict[str, np.ndarray]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. A null text is the empty one; repeated rows are scored alike; no rows give no rows."""
    vectors, net = model
    small_batches(docs)
    source = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hold(Terms())
        for batch in batches:
            x = np.array([pooled(v.as_py(), vectors, known) for v in batch.column(2)], np.float64).reshape(batch.num_rows, 2 * WIDTH + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(probability(x, net), pa.float64())], ["doc_id", "held_out", "score"])
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

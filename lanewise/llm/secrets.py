"""Secret scan with SQL functions only.

Three fixed patterns give the base spans. Character Markov models, one of random strings and one of ordinary identifiers, are
counted from labelled samples and compared by log-likelihood ratio; they add spans that no pattern names. The model is one
array over pairs of a small alphabet, so a token's score is a sum of array reads inside the row.
"""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hashed_share, in_chunks, let, text_or_empty, words_column

# Fixed patterns: kind -> (pattern, shortest value, group that holds the value).
PATTERNS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]+", 16, 0),
}
KINDS = [*PATTERNS, "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # position 0: start of the token or a character outside the alphabet
TOKEN = r"[A-Za-z0-9+/_-]{16,}=*"
NO_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _running_spans(steps: Column, kind: int, size, keep) -> Column:
    """Spans of the kept steps, each placed after the gaps and sizes of all steps before it."""
    after = lambda at, s: at + s["gap"] + size(s)

    def chunk_spans(chunk: Column, at: Column) -> Column:
        empty = F.struct(at.alias("at"), F.from_json(F.lit("[]"), NO_SPANS).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            span = F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(kind).alias("kind"), after(acc["at"], s).alias("end")))
            return F.struct(after(acc["at"], s).alias("at"), F.when(keep(s), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(chunk, empty, step, lambda acc: acc["out"])
    return F.flatten(in_chunks(steps, after, chunk_spans))


def _places(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all non-overlapping matches whose value is long enough, from the texts between the matches."""
    hits, values = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        sizes = F.zip_with(F.transform(found, lambda h: F.length(h)), F.transform(values, lambda v: F.length(v)),
                           lambda a, b: F.struct(a.alias("all"), b.alias("value")))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), sizes,
                           lambda g, s: F.struct(g.alias("gap"), s["all"].alias("all"), s["value"].alias("value")))
        return let(steps, lambda all_steps: _running_spans(all_steps, kind, lambda s: s["all"], lambda s: s["value"] >= least))

    return F.when(text.rlike(pattern), let(hits, spans)).otherwise(F.from_json(F.lit("[]"), NO_SPANS))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the fixed patterns by start, then kind; code points, end exclusive."""
    # A run too short for the last two kinds holds no longer match inside itself, so they can match long runs only.
    long_runs = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
    return F.array_sort(F.concat(*(_places(text, long_runs.get(kind, pattern), i, group, least)
                                   for i, (kind, (pattern, least, group)) in enumerate(PATTERNS.items()))))


def labelled_samples(docs: DataFrame, bound: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, random) from a bounded hash sample of documents: values of the fixed patterns; letter-only words of 8+, alone and
    with the next one as identifiers are joined (by an underscore, or by a capital)."""
    some = hashed_share(docs.select(doc_id, text), bound, doc_id).select(text_or_empty(text).alias("t"))

    def values(pattern: str, group: int, least: int) -> Column:
        return F.filter(F.regexp_extract_all("t", F.lit(pattern), group), lambda v: F.length(v) >= least)
    secret = F.concat(*(values(p, g, n) for p, n, g in PATTERNS.values()))
    plain = F.filter(words_column(F.col("t")), lambda w: w.rlike(r"^[A-Za-z]{8,}[.,;:!?]*$"))

    def joined(words: Column) -> Column:
        bare = F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
        return let(bare, lambda b: F.flatten(F.transform(b, lambda w, i: F.array(
            w, F.concat(F.lower(w), F.lit("_"), F.lower(F.coalesce(F.get(b, i + 1), w))), F.concat(F.lower(w), F.initcap(F.coalesce(F.get(b, i + 1), w)))))))
    return some.select(F.explode(secret).alias("token"), F.lit(True).alias("random")).unionByName(
        some.select(F.explode(let(plain, joined)).alias("token"), F.lit(False).alias("random")))


def _cell(before: Column, after: Column) -> Column:
    return before * SIDE + after


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) per pair of characters, SIDE * SIDE values.

    Counts are aggregated in Spark to at most 2 * SIDE^2 rows. A random string is mixed with the uniform model (half a weight
    of 20 per cell) so unseen alphabets stay possible; ordinary identifiers get one tenth per cell. No samples give zeros.
    """
    at = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.transform(at, lambda x, i: _cell(F.coalesce(F.get(at, i - 1), F.lit(0)), x))
    counts = samples.where("token <> ''").select("random", F.explode(pairs).alias("cell")).groupBy("random", "cell").count().collect()
    tables = {True: [20.0] * SIDE * SIDE, False: [0.1] * SIDE * SIDE}
    if not counts:
        return [0.0] * SIDE * SIDE
    for r in counts:
        tables[r["random"]][r["cell"]] += r["count"]
    share = {k: [v / sum(t[i // SIDE * SIDE:i // SIDE * SIDE + SIDE]) for i, v in enumerate(t)] for k, t in tables.items()}
    return [log(a) - log(b) for a, b in zip(share[True], share[False])]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a token."""
    table = F.split(F.lit(",".join(f"{v:.5f}" for v in model)), ",").cast("array<double>")

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.get(table, _cell(F.coalesce(F.get(at, i - 1), F.lit(0)), x))),
                           F.lit(0.0), lambda a, b: a + b) / F.size(at)
    return let(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), total)


def markov_spans(text: Column, model: list[float], threshold: float) -> Column:
    """Spans of tokens of 16+ characters whose mean ratio exceeds the threshold."""
    def with_tokens(tokens: Column) -> Column:
        gaps = F.transform(F.split(text, TOKEN, -1), lambda p: F.length(p))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.struct(
            g.alias("gap"), F.length(t).alias("n"), (log_ratio(t, model) > threshold).alias("hit")))
        return let(steps, lambda all_steps: _running_spans(all_steps, 3, lambda s: s["n"], lambda s: s["hit"]))
    return F.when(text.rlike(TOKEN), let(F.regexp_extract_all(text, F.lit(TOKEN), 0), with_tokens)).otherwise(F.from_json(F.lit("[]"), NO_SPANS))


def _furthest(at: Column, span: Column) -> Column:
    return F.greatest(at, span["end"])


def _blanked(text: Column, base: Column) -> Column:
    """The text with every character of a base span as a space, so places stay and no token reaches into a span."""
    def chunk_text(chunk: Column, at: Column) -> Column:
        # Cut out the chunk's part of the text first: a place in it is found by counting from its start.
        end = F.aggregate(chunk, at, _furthest)

        def blanked(part: Column) -> Column:
            empty = F.struct(at.alias("at"), F.from_json(F.lit("[]"), "array<string>").alias("out"))

            def step(acc: Column, s: Column) -> Column:
                plain = F.greatest(s["start"] - acc["at"], F.lit(0))
                blank = F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))
                parts = F.array(F.substring(part, acc["at"] - at + 1, plain), F.repeat(F.lit(" "), blank))
                return F.struct(_furthest(acc["at"], s).alias("at"), F.concat(acc["out"], parts).alias("out"))
            return F.aggregate(chunk, empty, step, lambda acc: F.array_join(acc["out"], ""))
        return let(F.substring(text, at + 1, end - at), blanked)
    tail = F.substring(text, F.aggregate(base, F.lit(0), _furthest) + 1, F.length(text))
    return F.when(F.size(base) > 0, F.concat(F.array_join(in_chunks(base, _furthest, chunk_text), ""), tail)).otherwise(text)


def scan(docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", threshold: float = 1.0) -> DataFrame:
    """One row per input row: id, base spans, spans added by the models (tokens of 16+ characters, and such parts of tokens as lie
    outside the base spans; each is scored by itself).

    Null is the empty text and has no spans. Repeated rows are scanned like any other; no rows give no rows.
    """
    def found(t: Column) -> Column:
        return let(base_spans(t), lambda base: F.struct(base.alias("base"), let(
            _blanked(t, base), lambda rest: markov_spans(rest, model, threshold)).alias("added")))
    return docs.select(F.col(doc_id).alias("doc_id"), let(text_or_empty(text), found).alias("f")).select("doc_id", "f.base", "f.added")


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, threshold: float = 1.0) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    rows = scan(docs, train(labelled_samples(docs, sample, doc_id, text)), doc_id, text, threshold)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)),
                       F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                       spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))

"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one bit per failed rule. A policy is a named, versioned set
of rules and is applied by a bitwise AND, so a policy change or an ablation never reads the texts again. SQL functions only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, let, text_or_empty, words_column

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Rule name -> SQL predicate over the measurements that is true when the rule fails. Bit i belongs to the i-th rule.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "mean_word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 30 * word_chars",
}
BASE = ("few_words", "repeated_windows")
POLICIES = {1: BASE, 2: tuple(RULES)}
LATEST = 2


def bits(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def _covered_words(win: Column) -> Column:
    """Words in windows that occur twice or more, from the array of window hashes."""
    placed = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        flags = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.struct(
            F.get(s, k)["i"].alias("i"),
            (F.get(s, k)["h"].eqNullSafe(F.get(s, k - 1)["h"]) | F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("twice")))
        return F.sort_array(F.transform(F.filter(flags, lambda x: x["twice"]), lambda x: x["i"]))

    def union_length(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return let(placed, lambda s: let(repeated(s), union_length))


def repeated_words(words: Column) -> Column:
    """Number of words covered by 8-word windows that occur at least twice in the same array of words."""
    def inside(h: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return F.when(F.size(h) <= WINDOW, 0).otherwise(
            let(wins, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered_words(w))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), inside)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, measurements, `failures` (one bit per failed rule).

    Null is the empty text, which fails `few_words` only. Other columns, whatever their names, are not read.
    """
    def measure(t: Column) -> Column:
        def from_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"))
        return let(words_column(t), from_words)

    m = docs.select(F.col(doc_id).alias("doc_id"), let(text_or_empty(text), measure).alias("m"))
    m = m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words",
                 F.col("m.lines.n").alias("n_lines"), "m.n_upper")
    fails = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    return m.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), fails).cast("long"))


def verdict(version: int = LATEST) -> Column:
    """Kept under a policy: no rule of it failed."""
    return F.col("failures").bitwiseAND(F.lit(bits(POLICIES[version]))) == 0


def ablations(book: DataFrame, version: int = LATEST) -> DataFrame:
    """Per rule of the policy: rows it fails, rows it alone fails, and rows kept without it.

    The ledger shrinks to one row per bit pattern (at most 2^rules) before the rules are tried. An empty ledger gives zeros.
    """
    whole = bits(POLICIES[version])
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("f")).agg(F.count("*").alias("n"))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    sums = [F.struct(F.lit(name).alias("rule"), rows(F.col("f").bitwiseAND(F.lit(bits([name]))) != 0).alias("failed"),
                     rows(F.col("f") == bits([name])).alias("failed_alone"),
                     rows(F.col("f").bitwiseAND(F.lit(whole & ~bits([name]))) == 0).alias("kept_without"))
            for name in POLICIES[version]]
    return patterns.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", version: int = LATEST) -> DataFrame:
    """The ledger with `base_failed` (policy 1) and `kept` (not base_failed, and passed by the chosen policy)."""
    return ledger(docs, doc_id, text).withColumn("base_failed", ~verdict(1)).withColumn("kept", ~F.col("base_failed") & verdict(version))

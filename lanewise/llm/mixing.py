"""Mixing sources to target weights by a splitting tree.

Documents of a source fall into blocks by a hash; whole blocks are drawn in a permuted order until the source's words are
reached, and only the last block is cut. Block quotas per source are split among output shards by a tree: each node divides its
quotas between its halves by a multivariate hypergeometric draw seeded by the node, so any task can walk to its own shard without
the others. A shard then owns a range of permuted blocks of each source and orders its documents by a hash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SPACES, fresh, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of words: pieces between white space, less an empty one at either end."""
    pieces = F.size(F.split(text, SPACES, -1))
    return (pieces - F.when(F.length(text) == 0, 1).otherwise(
        text.rlike(rf"^{SPACES}").cast("int") + text.rlike(rf"{SPACES}$").cast("int"))).cast("long")


def targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Weights repeat over the sources by code point, null last. Targets share `budget` of all words by weight and stop at `most`
    times a source's words; what is above goes to the others by weight. With sources by most * size / weight the capped ones come
    first, so running sums give the common level; the table has one row per source. Sources without words get 0.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    total = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.get(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(everything) - 1) % len(weights)))) \
        .withColumn("cap", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (budget * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    # The level of the first source that is not capped holds for all after it.
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(total)
    return leveled.withColumn("free", free["level"]).select("source", "source_size", "weight", F.least(
        F.col("cap"), F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"))


def shard_quotas(quotas: dict[int, int], shard: int, shards: int, seed: int) -> list[tuple[int, int, int]]:
    """(source, first, blocks) of one shard: walk from the root, drawing the left half's share at every node."""
    keys = sorted(quotas)
    left = np.array([quotas[k] for k in keys], np.int64)
    first, low, high = np.zeros_like(left), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        here = int(left.sum())
        take = here * (middle - low) // (high - low)
        # Hypergeometric draws colour by colour are the multivariate draw; "marginals" also holds for totals over 10^9.
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        share = np.zeros_like(left)
        rest, want = here, take
        for i, n in enumerate(left):
            n = int(n)
            share[i] = rng.hypergeometric(n, rest - n, want) if want and n and rest < 10 ** 9 else (n * want // rest if rest else 0)
            rest, want = rest - n, want - int(share[i])
        if want:  # only after proportional shares of very large totals
            room = left - share
            for i in np.argsort(-room):
                extra = min(want, int(room[i]))
                share[i] += extra
                want -= extra
        if shard < middle:
            left, high = share, middle
        else:
            first, left, low = first + share, left - share, middle
    return [(k, int(f), int(n)) for k, f, n in zip(keys, first, left)]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = 1.5, most: float = 2.0,
        weights: tuple[float, ...] = WEIGHTS, block_words: int = 1 << 18, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, shards, place.

    A source with target t and s words gives floor(t / s) whole copies of everything, then drawn blocks for the rest; `taken` counts
    the words over all copies. Only the last block of a source is cut, and in it one document; a cut copy is a document's first words.
    `shards` has the output shard of each copy, `place` the order inside a shard. Documents without words, or not drawn, have taken 0
    and no shard. A null source is a source; repeated rows are documents of their own; no rows give no rows. The result does not
    depend on the partitioning.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                               n_words(text_or_empty(text)).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), budget, most, weights).withColumns({
        "key": F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")),
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        "n_blocks": F.ceil(F.col("source_size") / block_words) + 1})
    plan = written(plan.withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
                   .withColumnRenamed("source", "_source"), "plan")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).withColumns({
        "block": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")), "place": F.xxhash64("doc_id", F.lit(seed + 1))})

    permuted = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(seed + 2)), "block")
    blocks = placed.groupBy("key", "block", "extra", "whole").agg(F.sum("size").alias("words")).withColumns({
        "rank": (F.row_number().over(permuted) - 1).cast("long"),
        "before": F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    blocks = blocks.withColumn("quota", F.least("words", F.greatest(F.lit(0), F.col("extra") - F.col("before"))))
    # Units of the tree: each block once per whole copy, and once more when it is drawn.
    blocks = written(blocks.withColumn("units", F.col("whole") + (F.col("quota") > 0).cast("long"))
                     .withColumn("first", F.sum("units").over(permuted) - F.col("units")).drop("before", "extra"), "blocks")
    quotas = {r["key"]: r["n"] for r in blocks.groupBy("key").agg(F.sum("units").alias("n")).collect()}  # one row per source

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                yield pd.DataFrame([(shard, *x) for x in shard_quotas(quotas, int(shard), shards, seed) if x[2]],
                                   columns=["shard", "key", "low", "n"]).astype("int64")
    owned = docs.sparkSession.range(shards).mapInPandas(walk, "shard long, key int, low long, n long") \
        .groupBy("key").agg(F.collect_list(F.struct("low", "n", "shard")).alias("owned"))

    def owner(unit: Column) -> Column:
        return F.filter("owned", lambda o: (o["low"] <= unit) & (unit < o["low"] + o["n"]))[0]["shard"]
    blocks = written(blocks.join(owned, "key", "left").select("key", "block", "words", "quota", F.when(F.col("units") > 0, F.transform(
        F.sequence(F.col("first"), F.col("first") + F.col("units") - 1), owner)).otherwise(F.array().cast("array<long>")).alias("shards")), "drawn")

    drawn = placed.join(blocks, ["key", "block"])
    is_cut = (F.col("quota") > 0) & (F.col("quota") < F.col("words"))
    inside = Window.partitionBy("key").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    full = drawn.where(~is_cut).withColumn("more", F.when(F.col("quota") > 0, F.col("size")).otherwise(0))
    # One block per source at most, of about `block_words` words.
    cut = drawn.where(is_cut).withColumn("more", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("quota") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    taken = full.unionByName(cut).withColumn("taken", (F.col("whole") * F.col("size") + F.col("more")).cast("long"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.select("doc_id", "row", "source", "size", "source_size", "target", "taken", F.slice("shards", F.lit(1), copies).alias("shards"), "place")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them: a row per copy with all columns, a cut copy's text ending after its last taken word.

    A document is known by its id here; of rows that repeat one, each is matched with each row of the mix at most once.
    """
    mark = fresh(docs, "_mix")
    taken = mix(docs, doc_id, text, source, **options).where("taken > 0")
    taken = written(taken.groupBy("doc_id", "size", "source").agg(F.max("taken").alias("taken")), "taken") \
        .select(F.struct("doc_id", "size", "source", "taken").alias(mark))
    m = F.col(mark)
    same = F.col(doc_id).eqNullSafe(m["doc_id"]) & F.col(source).cast("string").eqNullSafe(m["source"]) & (n_words(text_or_empty(text)) == m["size"])
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((m["taken"] - 1) / m["size"])), lambda c: F.struct(
        m["size"].alias("size"), F.least(m["size"], m["taken"] - c * m["size"]).alias("words")))
    rows = docs.join(taken, same).withColumn(mark, F.explode(copies))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1),
                                       m["words"].cast("int")), "")
    changed = {text: F.when(m["words"] == m["size"], F.col(text)).otherwise(first_words)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(m["words"] == m["size"], F.col("n_chars")).otherwise(F.length(first_words)).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(changed).select(*docs.columns)

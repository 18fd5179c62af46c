"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A run is a Parquet table of line keys, bucketed and sorted by the key's hash, with the number of documents and the keeper of each
key. Batches of documents come in order of precedence. The keys of a batch are merge-anti-joined with the settled keys of every
run and the rest is added as a run of its own; two runs of one level are merged into one of the next, so that a ledger of n
batches has about log2(n) runs. As runs share their buckets, neither the joins nor the merges move a run over the network.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, shuffle_partitions
from .text import let, text_or_empty, written

BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
BATCH_ROWS, LEAST_BATCHES = 50_000_000, 4


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as small letters."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, SMALL)


def line_hash(key: Column) -> list[Column]:
    """128 bits as two seeded 64-bit hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LineRuns:
    """Ledger of line keys in levels of sorted runs; columns h1, h2, docs and keeper.

    Add batches with the keepers first: a key's keeper is the largest id that the ledger has seen. Once one run holds a key with
    `settled` documents, later batches leave the key out, so `docs` is exact below that number and a lower bound from there on.
    """

    def __init__(self, spark: SparkSession, settled: int = 3):
        self.spark, self.settled, self.buckets = spark, settled, shuffle_partitions(spark)
        self.levels: dict[int, list[str]] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels.values() for name in level]

    def _write(self, rows: DataFrame) -> str:
        path = shared_path(self.spark, "line_run")
        name = "lanewise_" + os.path.basename(path).replace("-", "_")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        return name

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` that no run has settled."""
        for run in self.runs():
            keys = keys.join(run.where(F.col("docs") >= self.settled).select(*KEY), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """One row per key of a batch: h1, h2, docs, keeper."""
        self._place(self._write(self.unsettled(keys)), 0)

    def _merged(self, names: list[str]) -> str:
        one, two = (self.spark.table(n) for n in names)
        both = one.alias("a").join(two.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full")
        return self._write(both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY],
                                       (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs"),
                                       F.greatest("a.keeper", "b.keeper").alias("keeper")))

    def _place(self, name: str, level: int) -> None:
        kept = self.levels.setdefault(level, [])
        kept.append(name)
        if len(kept) == 2:
            self.levels[level] = []
            self._place(self._merged(kept), level + 1)

    def compact(self) -> None:
        """All runs into one, smallest level first."""
        names = [n for _, level in sorted(self.levels.items()) for n in level]
        while len(names) > 1:
            names[:2] = [self._merged(names[:2])]
        self.levels = {max(self.levels, default=0): names}

    def frequent(self) -> DataFrame:
        """The keys with at least `settled` documents: h1, h2, keeper. Compacts the runs."""
        self.compact()
        return self.runs()[0].where(F.col("docs") >= self.settled).drop("docs")


def _marked(lines: Column, least: int) -> Column:
    """(h1, h2, pos, first) of every line whose key has `least` code points; `first` marks a key's first line in the text."""
    keyed = F.transform(lines, lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    hashed = F.transform(F.filter(keyed, lambda x: F.length(x["key"]) >= least), lambda x: F.struct(*line_hash(x["key"]), x["pos"].alias("pos")))
    return let(F.sort_array(hashed), lambda s: F.transform(s, lambda x, i: F.struct(
        x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
        ((i == 0) | (F.get(s, i - 1)["h1"] != x["h1"]) | (F.get(s, i - 1)["h2"] != x["h2"])).alias("first"))))


def _batches(docs: DataFrame) -> Column:
    """Batch number per row: equal shares of the ids, largest ids first, missing ids last."""
    n, ids = docs.count(), F.col("doc_id").cast("double")
    parts = max(LEAST_BATCHES, -(-n // BATCH_ROWS))
    cuts = docs.agg(F.percentile_approx(ids, [1 - k / parts for k in range(1, parts)], 10_000).alias("cuts")).first()["cuts"] or []
    batch = F.lit(0)
    for cut in sorted(set(cuts), reverse=True):
        batch = batch + F.when(ids >= cut, 0).otherwise(1)
    return F.when(ids.isNull(), len(cuts) + 1).otherwise(batch)


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash and `dropped`: the places (from 0) of the lines that go, for the texts that lose any.

    A line goes if its key has `least` code points or more, lies in `min_docs` rows or more, and its row's id is not the largest
    of them. Rows count one by one, also when they repeat an id. A missing id comes below all others; a key in rows without id
    alone stays in all of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    marked = rows.select("doc_id", _batches(rows).alias("batch"), F.xxhash64("text").alias("text_hash"),
                         F.explode(_marked(lines_of(F.col("text")), least)).alias("line")).select("batch", "doc_id", "text_hash", "line.*")
    path = shared_path(spark, "lines")
    marked.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(marked.schema).parquet(path)
    ledger = LineRuns(spark, min_docs)
    for (batch,) in sorted(lines.select("batch").distinct().collect()):
        mine = lines.where(F.col("batch") == batch)
        ledger.add(mine.groupBy(*KEY).agg(F.count_if("first").alias("docs"), F.max("doc_id").alias("keeper")))
    if not ledger.runs():
        return lines.select("doc_id", "text_hash", F.array("pos").alias("dropped"))
    frequent = written(ledger.frequent(), "frequent_lines")
    gone = lines.join(frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and the text without the lines of `dropped_lines`.

    Texts are split at newlines; null equals the empty text and is one empty line. Other columns of `docs` are not read. No rows give
    no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gone = dropped_lines(docs, doc_id, text, least, min_docs).toDF("gone_id", "gone_hash", "dropped")
    met = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["text_hash"] == gone["gone_hash"]), "left")
    n_lines = F.size(lines_of(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    kept = let(lines_of(F.col("text")), lambda lines: F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return met.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"))

"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries, one per partition, find digests that many rows share. Their exact counts and winners are recomputed
over all rows and broadcast (at most `counters` rows), so those rows never shuffle. All other digests meet in an ordinary
shuffle, where a group then holds at most rows / counters of the input.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SPACES, fresh, text_or_empty, written


def normalised(text: str = "text") -> Column:
    """The text with every run of white space as one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def misra_gries(values: DataFrame, column: str, counters: int) -> DataFrame:
    """At most `counters` (value, estimate) rows holding every value with more than 1/counters of the rows.

    An estimate is at most the true count. Partition summaries are added by value before the largest are taken.
    """
    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for frame in frames:
            kept = kept.add(frame[column].value_counts(), fill_value=0).astype("int64").sort_values(ascending=False)
            if len(kept) > counters:
                kept = kept.iloc[:counters] - kept.iloc[counters]
                kept = kept[kept > 0]
        yield pd.DataFrame({column: kept.index.astype(str), "estimate": kept.to_numpy()})

    parts = values.select(column).mapInPandas(summarise, f"{column} string, estimate long")
    return parts.groupBy(column).agg(F.sum("estimate").alias("estimate")) \
        .orderBy(F.desc("estimate"), column).limit(counters)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is normalised; null equals the empty text. The row with the smallest
    id of its group stays, a null id coming last. Of rows that repeat that id, exactly one stays. No rows give no rows.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"),
                               F.monotonically_increasing_id().alias("row")), "digests")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    frequent = misra_gries(rows, "text_sha256", counters).where("estimate > 1").select("text_sha256")
    winners = written(rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256")
                      .agg(F.min(place).alias("best"), F.count("*").alias("group_size")), "winners")
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti") \
        .withColumns({"best": F.min(place).over(group), "group_size": F.count("*").over(group)})
    return heavy.unionByName(light).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256")


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; rows with a null id are compared like all others."""
    kept = written(exact_duplicates(docs, doc_id, text).where("kept").select("doc_id", "text_sha256"), "kept")
    sha = F.sha2(normalised(text), 256)
    out = docs.join(kept, docs[doc_id].eqNullSafe(kept["doc_id"]) & (sha == kept["text_sha256"]), "left_semi")
    # Rows that repeat both id and text all match the one kept row; only then a second shuffle is needed.
    repeated = docs.groupBy(F.col(doc_id).alias("id")).count().where("count > 1").select("id")
    if not repeated.head(1):
        return out
    same, mark = docs[doc_id].eqNullSafe(repeated["id"]), fresh(docs, "_sha")
    return out.join(repeated, same, "left_anti").unionByName(
        out.join(repeated, same, "left_semi").withColumn(mark, sha).dropDuplicates([doc_id, mark]).drop(mark))

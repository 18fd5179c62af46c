"""Words, hashes, row splits and written tables that the operators share.

Words are runs of bytes other than space and \\t..\\r, so `bytes.split()` and the regular expression below agree exactly.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

SPACES = r"[\x20\x09-\x0D]+"
MIX_STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))  # fixed constants of the splitmix64 finaliser
ODD = np.uint64(0x9E3779B97F4A7C15)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_column(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


# Session setting -> (Spark's default, what long texts need).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def small_batches(df: DataFrame) -> None:
    """Texts are long: Arrow batches of at most 1,000 rows and 4 MB keep Python workers small. Only Spark's defaults are changed."""
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCHES.items():
        if conf.get(key, None) == default:
            conf.set(key, ours)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """`body(x)` with x bound to `value`, evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32(id as text) mod 3 is 1; a missing id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in MIX_STEPS:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word (bytes), remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HELD: list[dict] = []


def hold(table: dict) -> dict:
    """`table` as the one word table of this Python process: that of an operator that ran here before is emptied."""
    if _HELD and _HELD[0] is not table:
        _HELD[0].clear()
    _HELD[:] = [table]
    return table


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of `size` consecutive words; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * ODD + hashes[j:j + n]
    return mix64(out)


def as_bytes(text) -> bytes:
    return text.encode("utf-8") if isinstance(text, str) else b""


def small_groups(values: list, weight, most: int) -> Iterator[list[int]]:
    """Consecutive positions whose weights add up to about `most`."""
    group, total = [], 0
    for i, v in enumerate(values):
        group.append(i)
        total += weight(v)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_share(docs: DataFrame, bound: int, doc_id: str = "doc_id", seed: int = 11) -> DataFrame:
    """About `bound` rows chosen by a hash of the id (all when there are fewer), for fitting a model."""
    rows = docs.count()
    if rows <= bound:
        return docs
    return docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 20)) < int(bound / rows * (1 << 20)))


CHUNK = 256


def in_chunks(items: Column, carry, each) -> Column:
    """each(chunk, at) per chunk of 256 array elements; ``at`` is carry(at, element) over all elements before, from 0.

    A fold that appends to an array copies it at every step; per chunk the copies stay short, whatever the length of the array.
    """
    def walk(chunks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<int>").alias("starts"))
        starts = F.aggregate(chunks, first, lambda acc, chunk: F.struct(
            F.aggregate(chunk, acc["at"], carry).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.zip_with(chunks, starts, each)
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK))), walk)

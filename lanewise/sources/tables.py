"""Table readers and writers."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: Mapping[str, str],
                schemas: Mapping[str, T.StructType] | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Named tables of a star schema; CSV needs an explicit schema per table (no inference pass)."""
    out = {}
    for role, file in names.items():
        path = f"{folder.rstrip('/')}/{file}"
        if fmt == "csv":
            out[role] = spark.read.schema(schemas[role]).option("header", True).csv(path)
        else:
            reader = spark.read.schema(schemas[role]) if schemas and role in schemas else spark.read
            out[role] = reader.format(fmt).load(path)
    return out


def translate_dimension(df: DataFrame, translation: DataFrame, key: str = "category",
                        target: str = "category_english", out: str = "category_label") -> DataFrame:
    """Translated name, else the original one, else 'Unknown'."""
    return (df.join(translation.select(key, target), key, "left")
            .withColumn(out, F.coalesce(F.col(target), F.col(key), F.lit("Unknown"))).drop(target))


def batch_input_csv(spark: SparkSession, path: str, columns: Sequence[str], id_col: str = "order_id",
                    tolerated: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Feature rows from CSV: exact column contract, blanks missing, id optional."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    missing = [c for c in columns if c not in raw.columns]
    unknown = [c for c in raw.columns if c not in columns and c != id_col and c not in tolerated]
    if missing or unknown:
        raise ValueError(f"missing columns: {missing}; unrecognised columns: {unknown}")
    keep = [id_col] if id_col in raw.columns else []
    return raw.select(*keep, *[F.col(c) if c in categorical else F.col(c).cast("double").alias(c) for c in columns])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables: Spark's double text form reads back to the same bits."""
    df.write.mode("overwrite").option("header", True).csv(path)


def table_fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free content hash: row count, xor and modular sum of row hashes."""
    cols = list(keys) or df.columns
    row_hash = F.xxhash64(*[F.col(c) for c in cols])
    return df.select(row_hash.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("xor_hash"),
        F.sum(F.pmod(F.col("h"), F.lit(2_147_483_647))).alias("sum_hash"))

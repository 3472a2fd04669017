"""Shared plumbing: the shared folder, written cuts of lineage, Arrow helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import shared_folder

DOC_ID, TEXT = "doc_id", "text"
#: Bytes of text handled by one vectorised pass; bounds the arrays a task holds.
CHUNK_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: a cut of lineage that survives lost executors.

    The table has a unique name and stays, since lazy results may read it; see README on removal.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with 64-bit offsets and nulls made empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")

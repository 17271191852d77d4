"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that cross to Python at a time; long documents stay few per batch.
BATCH_ROWS = 1000


def session_of(df: DataFrame) -> SparkSession:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every machine of the cluster reaches.

    Only where that setting is missing (tests, notebooks) a folder below the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.folder = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote. Only for those of which all that follows is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over df; fn takes and yields record batches."""
    session_of(df)
    return df.mapInArrow(fn, schema)


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def held_out(doc_id: str, modulus: int, remainder: int):
    """The fold of a document: crc32 of its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def each(it: Iterator[pa.RecordBatch], fn) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            yield fn(batch)

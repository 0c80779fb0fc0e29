"""Helpers shared by the operators: lineage cuts, distributed running totals, Arrow column access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run in one process (tests)."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and reread: later readers, and retries after a lost executor, don't compute it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, most: int) -> DataFrame:
    """(no, row): row holds the columns of docs (doc_id, text, others), no >= 0 tells rows apart and is under most.

    Numbers rise with doc_id (null first), then with a hash of the text. Whole doc_ids without null or repeat are taken as
    they are, less the least; else rows are sorted by ranges into a staged table and numbered there, range by range.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        s = docs.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.sum(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
        fits = s["least"] is not None and not s["nulls"] and s["greatest"] - s["least"] < most
        if fits and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return docs.select((F.col("doc_id").cast("long") - F.lit(s["least"])).alias("no"), row)
    keys = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"), row)
    order = ["_d", "_h", "_salt"]  # the salt deals out many rows of one doc_id and text
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"), "row"), "numbered")
    s = placed.agg(F.max("part").alias("part"), F.max("nth").alias("nth")).first()
    width = (s["nth"] or 0) + 1
    if ((s["part"] or 0) + 1) * width > most:
        raise ValueError("rows and lines are too many to number in 63 bits")
    return placed.select((F.col("part").cast("long") * width + F.col("nth")).alias("no"), "row")


def running_total(df: DataFrame, keys: list[str], salt: Column, order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds out: the sum of weight over the rows of the same keys that come before, in the order of (salt, *order).

    No task holds all rows of a key: rows are summed within (keys, salt), and only the sums of the salts, a bounded
    number for a key, are added up in one place.
    """
    d = df.withColumns({"_salt": salt, "_w": weight.cast("long")})
    sums = d.groupBy(*keys, "_salt").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_salt", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_within", F.sum("_w").over(within) - F.col("_w"))
    return d.join(sums, [*keys, "_salt"]).withColumn(out, F.col("_base") + F.col("_within")).drop("_salt", "_w", "_base", "_within")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as Python strings; null counts as empty, and what isn't valid UTF-8 becomes U+FFFD."""
    try:
        return ["" if x is None else x for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def by_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema, rows: int = 1024) -> Callable:
    """For mapInArrow: f makes columns from each slice of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = f(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)

    return run


def hex16(column: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")

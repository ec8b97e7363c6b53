"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured table may be broadcast; its hash table is two or three times as large. Beyond it, joins shuffle.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(context, "_rankforge_folder", None)
        if folder is None:
            folder = context._rankforge_folder = tempfile.mkdtemp(prefix="rankforge-")
    return folder.rstrip("/")


#: Rows and bytes of an Arrow batch. The default of Spark, 10,000 rows, is a gigabyte of long texts.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers of this session take at most BATCH_ROWS rows and BATCH_BYTES bytes at a time; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name, str((1 << 31) - 2)), re.I)
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """Hands memory that a worker has freed back to the system; at the end of a task, as workers outlive tasks and their allocators keep what they had."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps the memory


def releasing(work: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """A function of batches that calls ``release`` when it is through."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


class Workspace:
    """Named Parquet tables of one run of an operator. Written tables survive lost executors and are read instead of recomputed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any longer."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = hadoop(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is measured to be small. df should be a written table, or cheap to compute."""
    sized = [F.octet_length(f.name if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string")) for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    width = sum((F.coalesce(c, F.lit(0)) for c in sized), F.lit(16 + 8 * len(df.columns)).cast("long"))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def identified(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, variant, text and all other columns of docs. Texts that share an id are told apart by ``variant``, a hash; it is 0 where an id occurs once."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    often = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__again"))
    often = small(work.table(often, "often"))
    variant = F.when(F.col("__again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    others = [c for c in rows.columns if c not in ("doc_id", "text", "variant")]
    return rows.join(often, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", variant.alias("variant"), "text", *others)


def once(rows: DataFrame) -> DataFrame:
    """doc_id, variant, text of each document, however many rows it has."""
    again = rows.where("variant != 0").groupBy("doc_id", "variant").agg(F.min("text").alias("text"))
    return rows.where("variant = 0").select("doc_id", "variant", "text").unionByName(again)

"""Sources and sinks: every input format of the engine as a DataFrame, scores and pools as Parquet."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.schema import INTERACTIONS, ITEMS, SCORED


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has something, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob, in order, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(f.getPath().toString()) for f in found or [])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(context, "_rankforge_artefacts", None)
        if root is None:
            root = context._rankforge_artefacts = tempfile.mkdtemp(prefix="rankforge-artefacts-")
    return root.rstrip("/")


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of the files below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a given schema; separators may have several characters."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("encoding", encoding).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or gzipped; gzipped files cannot be split, so their rows are dealt out after the read."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def arrow_shards(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Arrow stream or file shards of a folder, read as binary files by Spark and decoded in tasks."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = to_arrow_schema(schema)  # shards may hold narrower types

    def run(batches):
        for b in batches:
            for data in b.column(0):
                buffer = data.as_buffer()
                try:
                    reader = pa.ipc.open_file(buffer)
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    parts = pa.ipc.open_stream(buffer)
                for part in parts:
                    yield from pa.Table.from_batches([part]).select(wanted.names).cast(wanted).to_batches()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("content").mapInArrow(run, schema)


def optional_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores, or an empty table where there is no file (missing pairs count as 0)."""
    return scores(spark, path) if exists(spark, path) else spark.createDataFrame([], SCORED)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """One or many ``{model}_scores.csv``, files or folders of parts, with the model's name taken from theirs."""
    df = csv(spark, path, SCORED)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)_scores\.csv(?:/[^/]*)?$", 1)
    return df.select("*", name.alias("model"))


def merged(spark: SparkSession, pattern: str, level: int = 2) -> DataFrame:
    """CSV files of several datasets; ``dataset`` is the folder ``level`` - 1 steps above the file."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.element_at(parts, -level).alias("dataset"))


def write_scores(scored: DataFrame, path: str) -> None:
    """Scores by model; models that are written again replace their former rows, others stay."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Rows of old whose key is not in new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def relabel(scored: DataFrame, old: str, new: str) -> DataFrame:
    return scored.withColumn("model", F.when(F.col("model") == old, new).otherwise(F.col("model")))


def write_status(path: str, **status: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(status, indent=2, default=str))


def extract(archive: str, folder: str) -> list[str]:
    """Unpacks a ZIP on the driver; files of a single top folder are lifted out of it; paths that leave the folder are errors."""
    root = Path(folder).resolve()
    out = []
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        tops = {n.split("/")[0] for n in names}
        strip = len(tops) == 1 and all("/" in n for n in names)
        for n in names:
            to = (root / (n.split("/", 1)[1] if strip else n)).resolve()
            if not to.is_relative_to(root):
                raise ValueError(f"{n} leaves {folder}")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(z.read(n))
            out.append(str(to))
    return out


__all__ = ["INTERACTIONS", "ITEMS", "arrow_shards", "csv", "exists", "extract", "fingerprint", "json_lines", "listed", "merged", "optional_scores", "parquet", "relabel", "scores", "shared_folder", "upsert", "write_scores", "write_status"]

"""Tables kept in the folder that driver and executors share, under a name that their input decides."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so what follows reads it and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(source: DataFrame) -> str:
    """A digest of the files a table consists of: their paths, sizes and times of change.  No column is read."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()[:32]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def kept(spark: SparkSession, name: str, state: str, tables: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables stored for ``name`` in this state of its input, written first if there are none.

    They are written under a passing name, and a one-row table names it once all are
    whole; of two writers at a time either one's tables may be the ones read.
    """
    root = f"{shared_dir(spark)}/{name}-{state}"
    pointer = f"{root}/current"
    found = _read(spark, pointer)
    if found is None:
        version = uuid.uuid4().hex
        names = []
        for table, df in tables().items():
            df.write.option("compression", "zstd").parquet(f"{root}/{version}/{table}")
            names.append(table)
        spark.createDataFrame([(version, names)], "version string, tables array<string>").coalesce(1).write.mode("overwrite").parquet(pointer)
        found = spark.read.parquet(pointer)
    row = found.first()
    return {t: spark.read.parquet(f"{root}/{row['version']}/{t}") for t in row["tables"]}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(b & 255 for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False if it is, so of two writers one is told."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        stream = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)

"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary folder; on a cluster it is an error, since executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN_DIR.get(app) or _OWN_DIR.setdefault(app, tempfile.mkdtemp(prefix="tracewell-"))
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, sizes are known, lost executors cost nothing.
    The table stays until release() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made(spark: SparkSession) -> int:
    """How many tables materialise() holds for this application: a mark for release()."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, begin: int = 0, end: int | None = None) -> int:
    """Delete the tables that materialise() has written, from mark begin up to mark end, and tell how many: once the
    results that read them have been written elsewhere. Works on every file system that Spark writes to."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = made[begin:end]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del made[begin:end]
    return len(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves no remainder by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_pattern() -> str:
    """White space between words, as a regular expression for split()."""
    return "[ \t-\r]+"


def word_count(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs; null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, words_pattern()))).cast("long")

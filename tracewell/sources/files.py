"""Recordings as files: inventory without reading bytes, tolerant table and sidecar readers, sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import null_tokens
from ..operators.inventory import CONTENT_BYTES

KINDS = {"vhdr": r"_ieeg\.vhdr$", "vmrk": r"_ieeg\.vmrk$", "eeg": r"_ieeg\.eeg$", "events": r"_events\.tsv$", "channels": r"_channels\.tsv$", "json": r"_ieeg\.json$"}


def run_base(path) -> F.Column:
    """The path of a run without extension: every kind of sidecar leads to the same .._ieeg."""
    return F.regexp_replace(F.regexp_replace(path, r"_(events|channels)\.tsv$", "_ieeg"), r"\.(vhdr|vmrk|eeg|json)$", "")


def sibling(base, kind: str) -> F.Column:
    """The path of one kind of file of a run."""
    tail = {"events": "_events.tsv", "channels": "_channels.tsv"}.get(kind)
    return F.concat(F.regexp_replace(base, r"_ieeg$", ""), F.lit(tail)) if tail else F.concat(base, F.lit("." + kind))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, kind, base) of the files below root; contents are not read. Spark lists no files of 0 bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    kind = F.coalesce(*(F.when(F.col("path").rlike(rx), F.lit(k)) for k, rx in KINDS.items()))
    return files.withColumn("kind", kind).where("kind is not null").withColumn("base", run_base(F.col("path")))


def content_present(files: DataFrame) -> DataFrame:
    """(base, eeg_present): the run's signal file holds more than a pointer."""
    return files.groupBy("base").agg(F.coalesce(F.bool_or(F.when(F.col("kind") == "eeg", F.col("length") > CONTENT_BYTES)), F.lit(False)).alias("eeg_present"))


def read_tsv(spark: SparkSession, root: str, pattern: str = "*_events.tsv") -> DataFrame:
    """(path, row_idx, cells map<string,string>): every table by its own header, whatever the order of its columns;
    tokens for missing values are null. Of columns of one name the first counts. A file without rows gives none."""
    text = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x != "")
    t = text.withColumn("lines", lines).where(F.size("lines") > 1).withColumn("header", F.split(F.regexp_replace(F.get("lines", F.lit(0)), "^﻿", ""), "\t"))
    rows = t.select("path", "header", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("row_idx", "line"))
    cells = F.transform(F.split("line", "\t"), lambda x: null_tokens(F.trim(x)))
    firsts = F.array_distinct("header")
    padded = F.transform(firsts, lambda name: F.get("cells", (F.array_position("header", name) - 1).cast("int")))
    return rows.withColumn("cells", cells).select("path", "row_idx", F.map_from_arrays(firsts, padded).alias("cells"))


def events_from_tsv(cells: DataFrame) -> DataFrame:
    """(base, row_idx, onset, trial_type) of read_tsv() rows; rows of files without either column go."""
    has = F.map_contains_key("cells", "onset") & F.map_contains_key("cells", "trial_type")
    return cells.where(has).select(run_base(F.col("path")).alias("base"), F.col("row_idx").cast("long").alias("row_idx"), F.try_element_at("cells", F.lit("onset")).alias("onset"), F.try_element_at("cells", F.lit("trial_type")).alias("trial_type"))


def channels_from_tsv(cells: DataFrame) -> DataFrame:
    names = ("name", "type", "status", "sampling_frequency")
    return cells.select(F.regexp_replace("path", r"_channels\.tsv$", "_ieeg").alias("base"), F.col("row_idx").alias("ch_idx"), *(F.try_element_at("cells", F.lit(n)).alias(n) for n in names))


def scans_from_tsv(cells: DataFrame) -> DataFrame:
    """(subject, session, filename, acq_time); subject and session from the directories."""
    of = lambda k: F.nullif(F.regexp_extract("path", rf"/{k}-([^/]+)/", 1), F.lit(""))
    named = cells.where(F.map_contains_key("cells", "filename"))
    return named.select(of("sub").alias("subject"), of("ses").alias("session"), F.try_element_at("cells", F.lit("filename")).alias("filename"), F.try_to_timestamp(F.try_element_at("cells", F.lit("acq_time"))).cast("timestamp_ntz").alias("acq_time"))


def read_json(spark: SparkSession, root: str, pattern: str = "*_ieeg.json") -> DataFrame:
    """(base, raw): the text of sidecars, unreadable ones as {}."""
    t = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select(run_base(F.col("path")).alias("base"), F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.lit("{}")).alias("raw"))


def valid_headers(spark: SparkSession, root: str) -> DataFrame:
    """(base, is_valid): header files that hold their common section."""
    t = spark.read.text(root, wholetext=True, pathGlobFilter="*.vhdr", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select(run_base(F.col("path")).alias("base"), (F.contains("value", F.lit("[Common Infos]")) | F.contains("value", F.lit("[Common infos]"))).alias("is_valid"))


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, nullValue="n/a")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_texts(texts: DataFrame, root: str) -> int:
    """Write each row (path, value) to a file of that name below root, and tell how many there were. Files are written
    in tasks, on every file system that Arrow knows; a repeated task writes the same again. Paths must differ, a row
    without path goes, a null value is an empty file."""
    where = re.sub("^file:/+", "file:///", root.rstrip("/"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(where)
        for pdf in batches:
            for path, value in zip(pdf["path"], pdf["value"], strict=True):
                name = f"{base}/{path}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write((value or "").encode())
            yield pdf[["path"]]

    return texts.select("path", "value").where("path is not null").mapInPandas(put, "path string").count()

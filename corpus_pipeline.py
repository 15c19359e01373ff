"""A corpus pipeline: language ID, near-duplicates, benchmark passages, secrets, source mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents (the last
adds copy). run() writes each stage's result as Parquet in the shared folder and hands what it reads back on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import materialise, release, table, tables_made
from tracewell.llm.decontaminate import contaminated
from tracewell.llm.langid import fit_languages, identify
from tracewell.llm.minhash import minhash_components
from tracewell.llm.mixing import entropy_balance
from tracewell.llm.secrets import scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns of docs in one struct, so that none can clash with what an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or none of its characters a letter) go; lang becomes the predicted one.
    Null and repeated ids and repeated rows stay as they are, and so do other columns, whatever their names."""
    found = identify(packed(docs), fit_languages(docs), keep=("row",))
    return found.where("lang_pred != 'und'").select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, source, key): all columns of docs in row, and a key that no two rows share: the file that a row
    is read from and its number there. What is not read from Parquet files is written to some first."""
    columns = docs.columns
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
    out = [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "doc_id", "text", "source", key.alias("key")]
    try:
        return docs.select(*out)
    except AnalysisException:
        return materialise(docs).select(*out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null ids after all others, the
    first row read among equal ids. Where ids repeat or are null, rows are numbered in that order, and the numbers serve
    as ids; where they do not, ids are in that order already."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").isEmpty():
        dropped = minhash_components(docs).where("not kept").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    rows = keyed(docs)
    order = [F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    ordered = rows.select("doc_id", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    # Written before it is used, so that a lost executor cannot deal numbers anew.
    numbers = materialise(ordered.select("key", F.monotonically_increasing_id().alias("number")))
    numbered = materialise(rows.join(numbers, "key").select("row", "number"))
    dropped = minhash_components(numbered.select("number", "row.text"), id_col="number").where("not kept").select(F.col("doc_id").alias("number"))
    return numbered.join(dropped, "number", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, whatever their ids; all others stay."""
    rows = keyed(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text is replaced by a mark, and n_chars follows the text."""
    found = scan_secrets(packed(docs), keep=("row",))
    n_chars = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    clean = F.col("row").withField("text", F.col("redacted")).withField("n_chars", n_chars)
    return found.select(F.when(F.col("redacted").isNotNull(), clean).otherwise(F.col("row")).alias("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, numbered from 1 in copy (which takes the place of a column
    of that name); documents with no copy go. Rows of one id, or of none, have copies of their own."""
    rows = keyed(docs)
    taken = entropy_balance(rows, row_col="key").where("copies > 0").select(F.col("row").alias("key"), F.col("copies").cast("int").alias("times"))
    mixed = rows.select("row", "key").join(taken, "key")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "copy"]
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*kept, "copy")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the classifier, the signatures or the dual of the mix; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begin = tables_made(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs)
            # The stage's own tables, and the one it read, have served.
            release(spark, begin, tables_made(spark) - 1)
    return docs

"""Driver queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digest
from .common import table
from .decontaminate import contaminated
from .embedding import near_vectors
from .kneser import quality_by_perplexity
from .langid import language_digest
from .minhash import minhash_components
from .mixing import entropy_balance
from .packing import packing_digest
from .repeats import periodic_runs, runs_digest, with_repeats
from .secrets import secrets_digest
from .toxicity import toxicity_digest
from .whitening import whiten_vectors
from .wrapper import main_text


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per contaminated document with the benchmark items found in it."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("overlap"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents that labels marks as of good quality."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_by_perplexity(table(spark, sf_dir, "documents"), trusted)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(table(spark, sf_dir, "conversations"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_balance(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a tokenizer that is installed, not part of this repository."""
    import public_tokenizers

    return packing_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"), 4, 256)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


def queries() -> dict:
    found = (
        op1_toxicity, op2_secrets, op3_language, op4_near_dedup, op5_decontamination, op6_quality, op7_chat, op8_embedding_dedup, op9_html, op10_mixing, op11_packing,
        op12_whitening, op13_runs,
    )
    return {f.__name__: f for f in found}


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_REACH = """both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, low) AS (SELECT x, x FROM both_ways UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.node WHERE r.low < b.y),
comp AS (SELECT node, min(low) AS low FROM reach GROUP BY 1)"""

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)), {_REACH}
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM n LEFT JOIN comp ON node = doc_id"""

OP7 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, 14 + length(url_encode(role)) + length(x) + length(x) - length(replace(x, '\', '')) + (length(x) - length(replace(x, '</turn>', ''))) // 7 + (length(x) - length(replace(x, '<|', ''))) // 2
  + coalesce(list_sum(list_transform(regexp_extract_all(x, '###+'), lambda h: length(h) - 2)), 0) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256, coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM s GROUP BY 1"""

OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93), {_REACH},
k AS (SELECT x, count(*) AS k FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON node = vec_id LEFT JOIN k ON x = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": OP4, "op7_chat": OP7, "op8_embedding_dedup": OP8}

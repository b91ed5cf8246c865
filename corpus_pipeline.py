"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, token files.

Each stage works on all rows its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from balanza.llm.language import UNDETERMINED, detect_languages, fit_languages
from balanza.llm.mixing import mixed_documents
from balanza.llm.ngram_join import ngram_jaccard_join
from balanza.llm.queries import held_out, table
from balanza.llm.token_files import read_token_files, write_token_files
from balanza.llm.winnowing import decontaminate
from balanza.session import cut

#: A document stays if its language holds at least this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5
#: A text with a word, which has a shingle.
WORD = r"[^\x20\x09-\x0D]"


def as_one(docs: DataFrame) -> DataFrame:
    """(id, body, text_hash, doc): all columns of a document in one, so that none clashes with the stage's own."""
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and holds at least half of their letters."""
    model = fit_languages(docs.filter(~held_out("doc_id", 4, 2)))
    found = detect_languages(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 0.8 or more on 5-word shingles: the row of the least id, then text.

    Rows are told apart by their text, whatever their ids; a null id comes last. Texts without words are linked to
    none: each stays once for its id.
    """
    rows = as_one(docs)
    worded = F.coalesce(F.col("body").rlike(WORD), F.lit(False))
    groups = ngram_jaccard_join(rows.filter(worded).select("text_hash", "body"), n=5, num=80, den=100, id_col="text_hash", text_col="body")
    groups = groups.select("text_hash", "component_id").distinct()
    least = rows.filter(worded).groupBy("text_hash").agg(F.min("id").alias("id"))
    picked = least.join(groups, "text_hash").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("low"))
    keep = picked.select(F.col("low.id").alias("keep_id"), F.col("low.text_hash").alias("keep_hash"))
    named = rows.filter(worded).join(keep, (F.col("text_hash") == F.col("keep_hash")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return named.unionByName(rows.filter(~worded)).dropDuplicates(["id", "text_hash"]).select("doc.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the share of their words in them."""
    rows = as_one(docs)
    verdict = decontaminate(rows.select("text_hash", "body"), table(spark, sf_dir, "benchmark"), id_col="text_hash", text_col="body")
    return rows.join(verdict.filter("contaminated").select("text_hash").distinct(), "text_hash", "left_anti").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: a row for each time a document is taken."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each row."""
    import public_tokenizers

    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(files).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus preparation: language ID, near-duplicate join, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next stage's documents; all but the last keep the columns of documents.
A stage whose last step runs in Python sets small Arrow batches for that write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.ids import with_gapless_ids
from premia.llm import decontaminate, jaccard_join, langid, packing, suffix_dedup
from premia.llm.common import bounded, is_empty, materialise, scratch, small_batches, table

MIN_LANGUAGE_SCORE = 0.2      # texts in a learned language score 0.36 and more


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no learned language go: null, without letters, or far from every profile."""
    small_batches(spark)
    profiles = langid.learn(docs.where(~langid.held_out()))
    keep = langid.identify(docs.select(*docs.columns), profiles)
    return keep.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` with ids that name one row each; rows with a null id stay as they are.

    Of rows equal in id and text, the first by all columns (as JSON) stays. Of an id's texts
    the first in byte order (a null text comes first) keeps the id; the others become documents
    of their own, with new ids after the largest one, in order of old id and text.
    """
    again = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
                        .where("c > 1").select("doc_id"), "pipeline-repeated")
    if is_empty(again):
        return docs
    names, kind = docs.columns, docs.schema["doc_id"].dataType
    again = bounded(again)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    texts = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    texts = with_gapless_ids(texts.select("row"), [F.col("row.doc_id"), F.col("row.text")], "number")
    first = materialise(texts.groupBy(F.col("row.doc_id").alias("id")).agg(F.min("number").alias("first")), "pipeline-first")
    last = int(docs.agg(F.max("doc_id")).first()[0])
    new = F.when(F.col("number") == F.col("first"), F.col("row.doc_id")).otherwise(F.col("number") + last).cast(kind)
    texts = texts.join(bounded(first), F.col("row.doc_id") == F.col("id")).select(
        *[new.alias(c) if c == "doc_id" else F.col(f"row.`{c}`") for c in names])
    once = docs.join(again, "doc_id", "left_anti").select(*[f"`{c}`" for c in names])
    return materialise(once.unionByName(texts), "pipeline-once")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at Jaccard 0.8, the smallest id stays.

    Ids that name several rows are made to name one first (``one_text_per_id``).
    """
    docs = one_text_per_id(docs)
    groups = jaccard_join.jaccard_components(docs, words=5, percent=80)
    gone = bounded(materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-near"))
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occurred earlier are cut; a document with nothing left goes."""
    small_batches(spark)
    return suffix_dedup.cut_repeats(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    small_batches(spark)
    return packing.piece_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables, its input among them, go once its result is written."""
    docs, used = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            written.remove(docs.written_to)
            written.extend(used)
            used = [docs.written_to]
    return docs


# Tokenisation and bin numbers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None

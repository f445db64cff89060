"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept. All but the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm import line_dedup, minhash_dedup, nnls_packing, passage_dedup, queries, suffix_decon
from spanlab.llm.common import passing, scratch_path, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or more is at least a half."""
    names = [f"c{i}__" for i in range(len(docs.columns))]  # so that no column's name meets one of the scores
    labels = queries.table(spark, sf_dir, "labels")
    model = queries.quality_model(docs, labels)
    text = names[[c.lower() for c in docs.columns].index("text")]
    graded = queries.quality(docs.toDF(*names), model, names, text)
    return graded.where("accepted").select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id. Rows equal in doc_id and text count as one
    document, of which one row stays; different texts under one doc_id are documents of their own. Rows without
    doc_id stay."""
    some = docs.where("doc_id is not null")
    repeated = written(some.groupBy(F.col("doc_id").alias("id__")).agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1").select("id__"), "ids")
    one = some.join(repeated, some["doc_id"] == F.col("id__"), "left_anti")
    ids, none = one.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.where("doc_id is null")
    if not repeated.limit(1).count():
        kept = _kept(ids)
        return one.join(kept, one["doc_id"] == F.col("kept__"), "left_semi").unionByName(none)
    # the distinct texts of repeated ids get ids beyond all others
    rows = some.join(repeated, some["doc_id"] == F.col("id__"), "left_semi").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc__"))
    text = F.coalesce(F.sha2(F.col("doc__.text").cast("binary"), 256), F.lit("-"))
    rows = rows.groupBy(F.col("doc__.doc_id").alias("id__"), text.alias("text__")).agg(F.min_by("doc__", F.to_json("doc__")).alias("doc__"))
    low, top = some.agg(F.min("doc_id"), F.max("doc_id")).first()
    nth = F.monotonically_increasing_id()
    own = nth + (top + 1) if top < 1 << 62 else (low - 1) - nth
    rows = written(rows.select("doc__", own.alias("u__")), "distinct")
    kept = _kept(ids.unionByName(rows.select(F.col("u__").alias("doc_id"), F.col("doc__.text").alias("text"))))
    more = rows.join(kept, F.col("u__") == F.col("kept__"), "left_semi").select("doc__.*")
    return one.join(kept, one["doc_id"] == F.col("kept__"), "left_semi").unionByName(more).unionByName(none)


def _kept(ids: DataFrame) -> DataFrame:
    return written(minhash_dedup.near_duplicates(ids).where("kept").select(F.col("doc_id").alias("kept__")), "kept")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later occurrences of repeated units cut out, then those of 50 repeated words that are left."""
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns]
    path = scratch_path(spark, "lines")
    with passing(spark):  # the units' tables go once the lines are written
        lines = line_dedup.dedup(docs).select(*columns)
        lines.write.parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    return passage_dedup.dedup(lines).select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return suffix_decon.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return nnls_packing.pack(docs, queries.tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: Trained weights, MinHash and tokenizer ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

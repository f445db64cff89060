"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (html_consensus, line_dedup, merkle_manifest, minhash_dedup, mixture_lid, nnls_packing, nra_search, oracle,
               ordinal_quality, pivot_topk, sharding, suffix_decon, toxicity, url_markov)

SHARDS = 40
URL_RULES = [url_markov.Rule("net", "/", "block"), url_markov.Rule("example.net", "/en/", "allow"),
             url_markov.Rule("example.com", "/de/", "block"), url_markov.Rule("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_html_extraction(spark, sf_dir):
    return html_consensus.main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = toxicity.Params()
    model = toxicity.train(*toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic", p.ratio_rows), p)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_topk(spark, sf_dir):
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = mixture_lid.train(docs.where(~toxicity.held_out()).select("text", "lang"))
    return mixture_lid.predict(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "n_langs")


def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_decon.report(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_near_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return nnls_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark, sf_dir):
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), F.col("kept_text").alias("text"),
                      F.coalesce(F.size("spans"), F.lit(0)).alias("n_removed"),
                      F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]), F.lit(0)).alias("chars_removed"),
                      F.col("spans").alias("removed"))


def quality_model(docs: DataFrame, labels: DataFrame) -> ordinal_quality.Model:
    """Learnt from labels.quality."""
    p = ordinal_quality.Params()
    return ordinal_quality.train(*toxicity.labelled_rows(docs, labels, "quality", p.sample_rows, even=False), p)


def quality(docs: DataFrame, model: ordinal_quality.Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with expected_grade, tail and accepted (a tail of just 0.5 is)."""
    graded = ordinal_quality.grade_rows(docs, model, 1, columns, text)
    return graded.withColumn("accepted", F.col("tail") >= 0.5)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, quality_model(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op11_nra_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return nra_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    number = F.col("n_chars").cast("decimal(20,0)")

    def leaf(n_chars):
        return merkle_manifest.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = merkle_manifest.prove(docs.select(
        F.col("lang").alias("part"), F.col("doc_id").alias("id"), leaf(number).alias("leaf"), F.when(tampered, leaf(number + 1)).alias("other")))
    folded = merkle_manifest.fold(F.coalesce("other", "leaf"), F.col("proof"))
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias(
        "proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_url_filter(spark, sf_dir):
    return url_markov.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_html_extraction, op3_toxicity, op4_topk, op5_language_id, op6_decontamination, op7_near_dedup,
    op8_packing, op9_substring_dedup, op10_quality, op11_nra_search, op12_merkle_manifest, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": oracle.op1(SHARDS), "op4_topk": oracle.OP4, "op6_decontamination": oracle.OP6, "op7_near_dedup": oracle.OP7, "op11_nra_search": oracle.OP11,
    "op12_merkle_manifest": oracle.OP12, "op13_url_filter": oracle.op13(URL_RULES)}

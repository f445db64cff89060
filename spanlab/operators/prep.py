"""Corpus preparation on the nested annotation column.

These work on the reference's data model: one row per document with
``privacy_mask array<struct<value, start, end, label[, label_index]>>``.
Nested rewrites are higher-order column expressions (``filter``,
``transform``, ``withField``, ``dropFields``) evaluated per row, so they
never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions.text import is_blank
from ..sources.corpus import DOC_KEY, MASK_TYPE


def filter_language(docs: DataFrame, code: str = "en") -> DataFrame:
    """Keep one language; each corpus spells it its own way."""
    a = tx.LANGUAGE_NAMES["A"][code]
    b = tx.LANGUAGE_NAMES["B"][code]
    return docs.where(((F.col("origin") == "A") & (F.col("language") == a))
                      | ((F.col("origin") == "B") & (F.col("language") == b)))


def filter_blank_text(docs: DataFrame) -> DataFrame:
    """Drop null and whitespace-only text (Python ``strip()`` semantics)."""
    return docs.where(~is_blank(F.col("source_text")))


def select_columns(docs: DataFrame) -> DataFrame:
    """Project the two columns the evaluation needs (plus the key)."""
    return docs.select(*DOC_KEY, "source_text", "privacy_mask")


def keep_labels(mask: Column, labels: list[str]) -> Column:
    """Keep annotations whose label is allowed; rows survive with ``[]``."""
    return F.filter(mask, lambda a: a["label"].isin(*labels))


def keep_own_labels(docs: DataFrame) -> DataFrame:
    """O12 for both corpora at once: each keeps its own allow-list."""
    m = F.when(F.col("origin") == "A", keep_labels(F.col("privacy_mask"), tx.KEEP_LABELS["A"])) \
        .otherwise(keep_labels(F.col("privacy_mask"), tx.KEEP_LABELS["B"]))
    return docs.withColumn("privacy_mask", m)


def drop_nested_field(mask: Column, field: str = "label_index") -> Column:
    """Remove a field from every struct of the array."""
    return F.transform(mask, lambda a: a.dropFields(field))


def conform_schema(mask: Column) -> Column:
    """Give any annotation array the four-field schema of corpus A."""
    return F.transform(mask, lambda a: F.struct(
        a["value"].cast("string").alias("value"), a["start"].cast("int").alias("start"),
        a["end"].cast("int").alias("end"), a["label"].cast("string").alias("label"))).cast(MASK_TYPE)


def relabel(mask: Column, src: str, dst: str) -> Column:
    """Replace each label through the mapping; unmapped labels pass through."""
    return F.transform(mask, lambda a: a.withField("label", tx.map_label(a["label"], src, dst)))


def uniform_corpus(docs: DataFrame, taxonomy: str) -> DataFrame:
    """O34 building block: every document's mask in ``taxonomy`` labels.

    Each corpus first keeps its own allow-list; the other corpus is then
    relabelled into ``taxonomy``; both get the same schema.
    """
    other = tx.OTHER[taxonomy]
    kept = keep_own_labels(docs)
    mask = F.when(F.col("origin") == taxonomy, conform_schema(F.col("privacy_mask"))) \
        .otherwise(relabel(conform_schema(F.col("privacy_mask")), other, taxonomy))
    return kept.select(*DOC_KEY, "language", "lang", "split", "source_text", mask.alias("privacy_mask"))


def concat_corpora(docs: DataFrame, taxonomy: str) -> DataFrame:
    """Own corpus plus the other one relabelled; duplicates kept.

    ``eval_set`` tags each row: ``concat`` for every row, plus a second
    copy tagged ``own`` for rows of the own corpus (the own-only dataset).
    """
    u = select_columns(uniform_corpus(docs, taxonomy))
    sets = F.when(F.col("origin") == taxonomy, F.array(F.lit("own"), F.lit("concat"))) \
        .otherwise(F.array(F.lit("concat")))
    return u.select(F.lit(taxonomy).alias("taxonomy"), F.explode(sets).alias("eval_set"), "*")


def mask_labels(mask: Column) -> Column:
    """Labels of a mask in list order, as one comma-separated string."""
    return F.array_join(F.transform(mask, lambda a: a["label"]), ",")


def distinct_labels(spans: DataFrame) -> DataFrame:
    """Unique labels per corpus in first-seen order (document, then list order)."""
    first = spans.groupBy("origin", "label").agg(
        F.min(F.struct("doc_id", "ann_pos")).alias("first"))
    w = Window.partitionBy("origin").orderBy("first")
    return first.select("origin", "label", F.col("first.doc_id").alias("first_doc_id"),
                        F.col("first.ann_pos").alias("first_ann_pos"),
                        F.row_number().over(w).alias("seen_rank"))


def label_sides(labels: DataFrame) -> DataFrame:
    """``label, in_a, in_b`` of an ``origin, label`` table: one pass for every set operation."""
    return labels.groupBy("label").agg(F.bool_or(F.col("origin") == "A").alias("in_a"),
                                       F.bool_or(F.col("origin") == "B").alias("in_b"))


def label_intersect(spans: DataFrame) -> DataFrame:
    """Labels present in both corpora."""
    return label_sides(spans).where("in_a and in_b").select("label")


def label_except(spans: DataFrame) -> DataFrame:
    """Labels only in A and only in B."""
    return label_sides(spans).where("in_a <> in_b").select(
        F.when(F.col("in_a"), F.lit("A_only")).otherwise(F.lit("B_only")).alias("side"), "label")


def _allowed(origin: Column, label: Column) -> Column:
    """Is the label on its corpus's allow-list?"""
    return ((origin == "A") & label.isin(*tx.KEEP_LABELS["A"])) | ((origin == "B") & label.isin(*tx.KEEP_LABELS["B"]))


def label_scope(spans: DataFrame, taxonomy: str = "B") -> DataFrame:
    """Labels that survive allow-lists and mapping in both corpora."""
    other = tx.OTHER[taxonomy]
    label = F.when(F.col("origin") == other, tx.map_label(F.col("label"), other, taxonomy)).otherwise(F.col("label"))
    kept = spans.where(_allowed(F.col("origin"), F.col("label")))
    return label_sides(kept.select("origin", label.alias("label"))).where("in_a and in_b").select("label")


def assert_label_set(spans: DataFrame) -> DataFrame:
    """Labels of the corpora vs the allow-lists after ``keep_labels``.

    An allowed label that no span has is ``expected_not_observed``; a kept one off
    the list is ``observed_not_expected``.  An empty result means the assertion holds.
    """
    rows = [(t, lab, True) for t in tx.TAXONOMIES for lab in tx.KEEP_LABELS[t]]
    expected = spans.sparkSession.createDataFrame(rows, "origin string, label string, expected boolean")
    observed = spans.select("origin", "label").distinct().withColumn("observed", F.lit(True))
    j = expected.join(observed, ["origin", "label"], "full")
    return j.where(F.col("expected").isNull() | F.col("observed").isNull()).select(
        "origin", "label", F.when(F.col("observed").isNull(), F.lit("expected_not_observed"))
        .otherwise(F.lit("observed_not_expected")).alias("issue"))


def assert_no_foreign(uniform_spans: DataFrame) -> DataFrame:
    """Labels of the other taxonomy's mapping that survived the union (expected empty)."""
    foreign = F.when(F.col("taxonomy") == "A", F.col("label").isin(*tx.MAPPINGS[("B", "A")].keys())) \
        .otherwise(F.col("label").isin(*tx.MAPPINGS[("A", "B")].keys()))
    return uniform_spans.where(foreign).groupBy("taxonomy", "label").agg(F.count(F.lit(1)).alias("n"))

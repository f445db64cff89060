"""Evaluate an annotated dataset in the reference data shape.

Input rows: ``doc_id, source_text, privacy_mask array<struct<value,start,end,
label>>`` (labels in one taxonomy) and, per document and model,
``predicted_mask array<struct<entity, word, score>>`` with one entity per
token.  This is the end-to-end flow of the original scripts -- drop blank
text, tokenise, align spans to B-/I-/O ids, pair with the predictions the
way ``zip`` does, mask ignored positions, report -- expressed with the same
operators the registered queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import align, evaluate as E, lexer, predict
from ..sources.corpus import DOC_KEY, explode_mask


def _with_origin(docs: DataFrame, taxonomy: str) -> DataFrame:
    if "origin" in docs.columns:
        return docs
    return docs.withColumn("origin", F.lit(taxonomy))


def align_dataset(docs: DataFrame, taxonomy: str, *, ignore_subwords: bool = True,
                  iob: bool = True, unknown: str = "error") -> DataFrame:
    """Token table with ``tag`` (text, null = ignored) and ``true_id`` (-100 = ignored).

    Annotations of a corpus whose ``origin`` is the other taxonomy are relabelled.  A
    label that ``taxonomy`` lacks fails the job; with ``unknown="null"`` its tokens keep
    their tag text and a null ``true_id`` (``unknown_labels`` counts them).  With ``iob=False`` tags
    are bare labels, with ids of their own (``taxonomy.plain2id``).

    Documents are placed on ``(origin, doc_id)`` once; lexing, span lookup,
    overlap resolution and the token join reuse that placement.
    """
    from ..sources.corpus import place_documents
    from ..operators.prep import filter_blank_text

    if unknown not in ("error", "null"):
        raise ValueError(f"unknown: 'error' or 'null', not {unknown!r}")
    d = place_documents(filter_blank_text(_with_origin(docs, taxonomy)))
    pieces = lexer.pieces(d)
    spans = explode_mask(d)
    al = align.align(lexer.tokens_from_pieces(pieces), align.locate(spans, pieces))
    tag = align.tag(None, taxonomy, align.label_in(taxonomy), iob=iob, ignore_subwords=ignore_subwords)
    out = al.select(*DOC_KEY, "idx", "tok", "start", "end", "is_subword", tag.alias("tag"))
    known = (tx.tag_id if iob else tx.plain_tag_id)(F.col("tag"), taxonomy)
    if unknown == "error":
        known = F.coalesce(known, F.raise_error(F.concat(
            F.lit(f"no id in taxonomy {taxonomy} for tag "), F.col("tag"))).cast("int"))
    return out.withColumn("true_id", F.when(F.col("tag").isNull(), F.lit(tx.IGNORE_ID)).otherwise(known))


def unknown_labels(docs: DataFrame, taxonomy: str) -> DataFrame:
    """Annotation labels that ``taxonomy`` lacks after relabelling: ``origin, label, n``."""
    spans = explode_mask(_with_origin(docs, taxonomy))
    known = F.coalesce(align.label_in(taxonomy, span_label=F.col("label")).isin(*tx.RAW_LABELS[taxonomy]), F.lit(False))
    return spans.where(~known).groupBy("origin", "label").agg(F.count(F.lit(1)).alias("n"))


def nested_dataset(docs: DataFrame, preds: DataFrame, taxonomy: str, model_id: str) -> DataFrame:
    """The aligned dataset in nested shape, ready for ``io.sink_parquet``: the documents'
    columns, ``predicted_mask``, ``offset_mapping``, ``true_labels`` and ``pred_labels`` (null without a
    list of ``model_id``)."""
    d = _with_origin(docs, taxonomy)
    labels = align.nest_labels(align_dataset(d, taxonomy).select(*DOC_KEY, "idx", "start", "end", "true_id"), DOC_KEY)
    p = preds.where(F.col("model_id") == model_id).select(
        *([c for c in DOC_KEY if c in preds.columns]), "predicted_mask",
        predict.encode_predictions(F.col("predicted_mask"), taxonomy).alias("pred_labels"))
    return d.join(labels, DOC_KEY).join(p, [c for c in DOC_KEY if c in preds.columns], "left")


def evaluate_dataset(docs: DataFrame, preds: DataFrame, taxonomy: str, models: list[str] | None = None,
                     eval_set: str = "concat") -> DataFrame:
    """Per-tag classification report (in-scope tags of ``taxonomy``) of every
    model in ``preds`` (``doc_id, model_id, predicted_mask``) on ``docs``.

    ``docs`` may hold both corpora (``origin`` A and B): ``eval_set="concat"`` scores them all,
    ``"own"`` those of ``taxonomy``.  A document without a list of a model counts as
    predicted ``O`` throughout.  ``models`` names the models to report; without it their
    distinct names are read from ``preds`` first.
    """
    aligned = align_dataset(docs, taxonomy)
    p = _with_origin(preds, taxonomy) if "origin" not in docs.columns else preds
    if "origin" not in p.columns:
        p = p.join(docs.select(*DOC_KEY).distinct(), "doc_id")
    if models is None:
        models = sorted(r.model_id for r in preds.select("model_id").distinct().collect())
    pairs = predict.zip_pairs(aligned.select(*DOC_KEY, "idx", "true_id"), p, taxonomy, models)
    conf = E.confusion(pairs.withColumn("taxonomy", F.lit(taxonomy)))
    return E.classification_report(conf).where(F.col("eval_set") == eval_set).drop("eval_set")

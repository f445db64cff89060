"""User-facing flow on a dataset in the reference shape."""

from pyspark.sql import Row
from pyspark.sql import functions as F

import pytest

from spanlab.functions import taxonomy as tx
from spanlab.plans.dataset import align_dataset, evaluate_dataset, nested_dataset, unknown_labels

MASK = "array<struct<value:string,start:int,end:int,label:string>>"


def test_perfect_model_scores_one(spark):
    text = "Contact John Smith at john@x.com today"
    mask = [Row(value="John", start=8, end=12, label="GIVENNAME1"),
            Row(value="Smith", start=13, end=18, label="LASTNAME1"),
            Row(value="john@x.com", start=22, end=32, label="EMAIL")]
    docs = spark.createDataFrame([(1, text, mask), (2, "   ", [])],
                                 f"doc_id bigint, source_text string, privacy_mask {MASK}")
    al = align_dataset(docs, "A").orderBy("idx").collect()
    assert {r.doc_id for r in al} == {1}                    # blank text dropped
    # a perfect model predicts the raw gold tag of every token
    raw = align_dataset(docs, "A", ignore_subwords=False).orderBy("idx").collect()
    ents = [Row(entity=r.tag, word=r.tok, score=1.0) for r in raw]
    preds = spark.createDataFrame(
        [(1, "perfect", ents)],
        "doc_id bigint, model_id string, predicted_mask array<struct<entity:string,word:string,score:double>>")
    rep = {r.tag: r for r in evaluate_dataset(docs, preds, "A").collect()}
    for tag in ("B-GIVENNAME1", "B-LASTNAME1", "B-EMAIL", "O"):
        assert rep[tag].f1 == 1.0, (tag, rep[tag])
    assert rep["B-TIME"].support == 0 and rep["B-TIME"].f1 == 0.0


DOCS = f"doc_id bigint, source_text string, privacy_mask {MASK}"
PREDS = "doc_id bigint, model_id string, predicted_mask array<struct<entity:string,word:string,score:double>>"


def test_unknown_label_fails_or_is_counted(spark):
    docs = spark.createDataFrame([(1, "Oak St 5", [Row(value="Oak", start=0, end=3, label="SECADRESS")])], DOCS)
    with pytest.raises(Exception, match="SECADRESS"):
        align_dataset(docs, "A").collect()
    rows = align_dataset(docs, "A", unknown="null").orderBy("idx").collect()
    assert rows[0].tag == "B-SECADRESS" and rows[0].true_id is None
    assert rows[1].true_id == tx.tag2id("A")["O"]
    assert [tuple(r) for r in unknown_labels(docs, "A").collect()] == [("A", "SECADRESS", 1)]


def test_bare_labels_have_ids(spark):
    docs = spark.createDataFrame([(1, "John ok", [Row(value="John", start=0, end=4, label="GIVENNAME1")])], DOCS)
    rows = align_dataset(docs, "A", iob=False).orderBy("idx").collect()
    ids = tx.plain2id("A")
    assert [(r.tag, r.true_id) for r in rows] == [("GIVENNAME1", ids["GIVENNAME1"]), ("O", ids["O"])]


def test_missing_predictions_are_misses(spark):
    mask = [Row(value="John", start=0, end=4, label="GIVENNAME1")]
    docs = spark.createDataFrame([(i, "John ok", mask) for i in (1, 2, 3)], DOCS)
    preds = spark.createDataFrame([(1, "m", [Row(entity="B-GIVENNAME1", word="John", score=1.0),
                                             Row(entity="O", word="ok", score=1.0)]), (2, "m", None)], PREDS)
    rep = {r.tag: r for r in evaluate_dataset(docs, preds, "A").collect()}
    assert rep["B-GIVENNAME1"].support == 3 and rep["B-GIVENNAME1"].tp == 1
    assert rep["O"].support == 3


def test_both_corpora_are_scored_in_one_taxonomy(spark):
    mask = lambda lab: [Row(value="John", start=0, end=4, label=lab)]
    docs = spark.createDataFrame([("A", 1, "John ok", mask("GIVENNAME1")), ("B", 2, "John ok", mask("GIVENNAME"))],
                                 "origin string, " + DOCS)
    ents = [Row(entity="B-GIVENNAME", word="John", score=1.0), Row(entity="O", word="ok", score=1.0)]
    preds = spark.createDataFrame([(1, "m", ents), (2, "m", ents)], PREDS)
    tag = lambda s: {r.tag: r for r in evaluate_dataset(docs, preds, "B", eval_set=s).collect()}["B-GIVENNAME"]
    assert (tag("concat").support, tag("concat").f1) == (2, 1.0)
    assert (tag("own").support, tag("own").f1) == (1, 1.0)


def test_nested_dataset_has_every_column(spark):
    docs = spark.createDataFrame([(1, "John ok", [Row(value="John", start=0, end=4, label="GIVENNAME1")]),
                                  (2, "ok", [])], DOCS)
    preds = spark.createDataFrame([(1, "m", [Row(entity="B-GIVENNAME1", word="John", score=1.0),
                                             Row(entity="O", word="ok", score=1.0)])], PREDS)
    rows = {r.doc_id: r for r in nested_dataset(docs, preds, "A", "m").collect()}
    ids = tx.tag2id("A")
    assert rows[1].true_labels == [-100, ids["B-GIVENNAME1"], ids["O"], -100] == rows[1].pred_labels
    assert [tuple(o) for o in rows[1].offset_mapping] == [(0, 4), (5, 7)]
    assert rows[1].source_text == "John ok" and rows[1].privacy_mask[0].label == "GIVENNAME1"
    assert rows[2].pred_labels is None and rows[2].true_labels == [-100, ids["O"], -100]

"""Nested lists and word match: what moves between tasks, and texts without a match."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.operators import align, lexer, predict
from spanlab.plans import registry
from spanlab.plans.lineage import Lineage
from spanlab.plans.registry import REGISTRY
from spanlab.sources import corpus as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _moved(df):
    """What the rows that a shuffle by document takes hold, for every shuffle."""
    lines = _plan(df).split("\n")
    return [ln for ln in lines if "Exchange hashpartitioning" in ln]


def test_lists_move_once_for_all_models_and_taxonomies(spark):
    L = Lineage(spark, SF_SMALL)
    assert len(_moved(registry._predictions(L))) == 1
    rows = registry._predictions(L).count()
    assert rows == 4 * L.geometry.select("origin", "doc_id").distinct().count()


def test_attached_lists_and_lengths_build_the_lists_once(spark):
    for q in ("attach_predictions", "length_mismatch", "encode_predictions"):
        plan = _plan(REGISTRY[q][0](spark, SF_SMALL))
        assert plan.count("collect_list(struct(lidx") + plan.count("collect_list(named_struct(lidx") <= 4, q
        assert "Union" not in plan, q


def test_gathered_lists_are_in_token_order_over_chunks(spark):
    docs = spark.createDataFrame([("A", 1, "ab cd " * 40), ("B", 2, "x"), ("A", 3, "12345 " * 30)], "origin string, doc_id bigint, source_text string")
    t = lexer.token_chunks(docs, chunk=64)
    got = {r.doc_id: (r.w, r.s) for r in align.gather(t, {"w": F.col("tok"), "s": F.col("start")}).collect()}
    assert {d: len(x[0]) for d, x in got.items()} == {1: 80, 2: 1, 3: 60}
    assert got[1][0] == ["ab", "cd"] * 40 and got[3][0] == ["123", "45"] * 30
    assert all(s == sorted(s) for _, s in got.values())
    nested = {r.doc_id: r for r in align.nest_labels(t.withColumn("true_id", F.col("lidx")), ["origin", "doc_id"]).collect()}
    assert [o.start for o in nested[1].offset_mapping] == got[1][1] and len(nested[1].true_labels) == 82
    assert nested[1].true_labels[0] == nested[1].true_labels[-1] == -100


def test_word_match_gives_out_substrings_after_the_move_and_once_a_text(spark):
    toks = spark.createDataFrame([("A", 1, i, "hello") for i in range(1, 51)] + [("A", 1, 51, "xyz")], "origin string, doc_id bigint, idx int, tok string")
    preds = spark.createDataFrame([("A", 1, "m", [("B-X", "ell", 1.0)])],
                                  "origin string, doc_id bigint, model_id string, predicted_mask array<struct<entity:string,word:string,score:double>>")
    out = predict.word_match_align(toks, preds)
    assert sorted((r.idx, r.entity) for r in out.collect()) == [(i, "B-X") for i in range(1, 51)] + [(51, "O")]
    assert not [ln for ln in _moved(out) if "gram#" in ln.split("ENSURE")[0] and "tok" in ln]
    words = spark.createDataFrame([("A", 1, "m", 0, "ell")], "origin string, doc_id bigint, model_id string, ppos int, word string")
    assert predict.word_matches(toks, words).count() == 1


def test_tokenizer_gets_few_texts_at_once(spark):
    def factory():
        def run(texts):
            if len(texts) > lexer_batch:
                raise ValueError(len(texts))
            return [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
        return run
    lexer_batch = 32
    docs = spark.createDataFrame([("A", i, f"a{i} b") for i in range(100)] + [("A", 100, None)], "origin string, doc_id bigint, source_text string").coalesce(1)
    got = lexer.tokenize(docs, factory)
    assert got.count() == 200 and {r.tok for r in got.where("idx = 2").collect()} == {"b"}


def test_texts_without_a_match_are_settled_by_one_search(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, "a @ b"), (3, "me a@b.cd x@y.zz end"), (4, None)], "i int, t string")
    got = {r.i: r.z for r in docs.select("i", C._zip(F.col("t"), C.EMAIL_RX).alias("z")).collect()}
    assert got[1] is None and got[2] is None and got[4] is None
    assert [(x.m, x.gap) for x in got[3]] == [("a@b.cd", "me "), ("x@y.zz", " "), (None, " end")]

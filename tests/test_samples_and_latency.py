"""Key-first samples, early stop by rounds, one-pass latency, schema as data, word match of several models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.functions import taxonomy as tx
from spanlab.operators import audit, predict
from spanlab.plans.lineage import Lineage, lineage
from spanlab.plans.registry import REGISTRY
from spanlab.sources import corpus as C
from spanlab.sources import io
from test_plan_shape import _plan


def test_head_sample_annotates_only_its_rows(spark):
    """The keys are a bounded top-n, and the semi join with them lies below the rules."""
    df = REGISTRY["sample_rows"][0](spark, SF_SMALL)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan
    lines = plan.split("\n")
    rules = [i for i, ln in enumerate(lines) if "regexp_extract_all" in ln]
    semi = [i for i, ln in enumerate(lines) if "LeftSemi" in ln]
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
    assert rules and all(any(j > i and depth(j) > depth(i) for j in semi) for i in rules)
    for n in (0, 3):
        assert io.sample_rows(C.corpus(spark, SF_SMALL), n).count() == n
    for n in (-1, io.MAX_HEAD + 1):
        with pytest.raises(ValueError):
            io.head_keys(C.corpus(spark, SF_SMALL), n)


def test_random_sample(spark):
    docs = spark.range(20000).select(F.lit("A").alias("origin"), F.col("id").alias("doc_id"))
    a = {r.doc_id for r in io.sample_random(docs, 0.1, 1).collect()}
    b = {r.doc_id for r in io.sample_random(docs.repartition(7), 0.1, 1).collect()}
    c = {r.doc_id for r in io.sample_random(docs, 0.1, 2).collect()}
    assert a == b and 1800 < len(a) < 2200 and 100 < len(a & c) < 320
    assert io.sample_random(docs, 0.0).count() == 0 and io.sample_random(docs, 1.0).count() == 20000


def test_rounds_cover_all_ids():
    rnd = random.Random(2)
    for _ in range(200):
        lo = rnd.randint(-50, 50)
        hi = lo + rnd.randint(-1, 500)
        got = [i for a, b in audit.rounds(lo, hi, rnd.choice([1, 4, 64])) for i in range(a, b + 1)]
        assert got == list(range(lo, hi + 1))


def test_early_stop_reads_fewer_files(spark, tmp_path):
    """Common labels are full after the first files; a label that never occurs has all files read."""
    docs = C.documents(spark, SF_SMALL).orderBy("doc_id")
    docs.repartitionByRange(20, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    every = {r[0] for r in C.documents(spark, str(tmp_path)).select(F.input_file_name()).distinct().collect()}

    def run(labels):
        L, read = Lineage(spark, str(tmp_path)), set()

        def spans_of(a, b):
            texts = C.documents(spark, str(tmp_path)).where(F.col("doc_id").between(a, b))
            read.update(r[0] for r in texts.select(F.input_file_name()).distinct().collect())
            return L.uspans_between(a, b)
        got = audit.first_in_rounds(spans_of, *L.id_range, labels, 2)
        return {tuple(r) for r in got.select(*sorted(got.columns)).collect()}, read

    want = audit.first_per_label(Lineage(spark, str(tmp_path)).uspans, 2)
    want = {tuple(r): r for r in want.select(*sorted(want.columns)).collect()}
    common = {"A": ["GIVENNAME1"], "B": ["GIVENNAME", "SURNAME"]}
    got, read = run(common)
    assert len(every) == 20 and len(read) < 10
    assert {t for t, r in want.items() if r["label"] in common[r["taxonomy"]]} <= got
    got, read = run({"A": ["GIVENNAME1", "BUILDING"], "B": []})
    assert read == every and got == set(want)
    plan = _plan(Lineage(spark, str(tmp_path)).uspans_between(3, 9))
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "LessThanOrEqual(doc_id,9)" in plan


def test_latency_is_observed_in_the_scoring_pass(spark, tmp_path):
    docs = spark.createDataFrame([("A", i, f"Ann {i}" if i % 9 else None) for i in range(100)],
                                 "origin string, doc_id bigint, source_text string").coalesce(1)

    def clock(ticks=itertools.count(0, 7_000_003)):
        return next(ticks)

    calls = spark.sparkContext.accumulator(0)

    def make_scorer():
        def score(texts):
            calls.add(len(texts))
            return [[{"entity": "O", "word": t or "", "score": 1.0}] for t in texts]
        return score

    scored, latency = predict.score_corpus(docs, make_scorer, "m", f"{tmp_path}/scored", clock)
    batches = -(-100 // predict.SCORER_BATCH)
    (r,) = latency.collect()
    assert (r.model_id, r.n_samples, r.total_sec) == ("m", 100, batches * 7_000_003 / 1e9)
    assert r.mean_ms_per_sample == batches * 7_000_003 / 1e6 / 100
    assert scored.agg(F.sum("elapsed_ns")).first()[0] == batches * 7_000_003
    assert scored.count() == 100 and calls.value == 100  # reading the rows again scores nothing

    none, latency = predict.score_corpus(docs.where("false"), make_scorer, "m", f"{tmp_path}/none", clock)
    (r,) = latency.collect()
    assert (r.n_samples, r.total_sec, r.mean_ms_per_sample, none.count()) == (0, 0.0, None, 0)


def test_latency_and_rows_share_one_run(spark):
    L = lineage(spark, SF_SMALL)
    (r,) = REGISTRY["latency_report"][0](spark, SF_SMALL).collect()
    ns = L.scored[0].agg(F.sum("elapsed_ns")).first()[0]
    assert r.n_samples == L.docs_en.count() and r.total_sec == ns / 1e9


def test_schema_is_data(spark):
    rows = REGISTRY["describe_dataset"][0](spark, SF_SMALL).where("section = 'schema'").collect()
    assert ("privacy_mask.label_index", "int") in {(r.name, r.type) for r in rows}
    docs = spark.createDataFrame([], "origin string, split string, privacy_mask array<struct<label:string,in:struct<x:int>>>")
    assert [r.name for r in io.describe_dataset(docs).collect()] == [
        "origin", "split", "privacy_mask", "privacy_mask.label", "privacy_mask.in", "privacy_mask.in.x"]


def test_word_match_of_several_models(spark):
    """One index for all models equals the rule applied token by token."""
    rnd = random.Random(8)
    words = ["", " a ", "ab", "b", "abc", "c a", "bca", None, "zzz", "abcabc"]
    tokens, lists, want = [], [], set()
    for d in range(20):
        toks = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 9))]
        tokens += [("A", d, i, t, -100 if i % 3 else 7) for i, t in enumerate(toks, 1)]
        for m in ("m1", "m2"):
            said = [(rnd.choice(words), f"B-{m}-{k}") for k in range(rnd.randint(0, 6))] if rnd.random() < .9 else None
            lists.append(("A", d, m, None if said is None else [(e, w, 1.0) for w, e in said]))
            for i, t in enumerate(toks, 1):
                want.add((d, m, i, next((e for w, e in said or [] if (w or "").strip() in t), "O"), -100 if i % 3 else 7))
    tdf = spark.createDataFrame(tokens, "origin string, doc_id bigint, idx int, tok string, true_id int")
    pdf = spark.createDataFrame(lists, "origin string, doc_id bigint, model_id string, "
                                       "predicted_mask array<struct<entity:string,word:string,score:double>>")
    got = predict.word_match_align(tdf, pdf)
    assert {(r.doc_id, r.model_id, r.idx, r.entity, r.true_id) for r in got.collect()} == want
    assert got.count() == len(want)


def test_no_query_is_vacuous(spark):
    issues = {r.issue for r in REGISTRY["assert_label_set"][0](spark, SF_SMALL).collect()}
    assert issues == {"expected_not_observed", "observed_not_expected"}
    dropped = REGISTRY["drop_pred_entities"][0](spark, SF_SMALL).where("entity <> kept").collect()
    assert {r.taxonomy for r in dropped} == set(tx.TAXONOMIES) and all(r.kept == "O" and r.n > 0 for r in dropped)

"""Tokens as marks: same places as the lists of tokens; spans and counts without a token a row."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.operators import align, lexer
from spanlab.plans.lineage import Lineage
from spanlab.plans.registry import REGISTRY
from test_token_lists import plan, random_docs

ODD = ["½x²", "naïve café", "٣٤٥٦", "\U0001f600\U0001f600", "ꙁ" * 9, "…", "  ", "  "]


def odd_docs(spark):
    docs, texts = random_docs(spark)
    rnd = random.Random(11)
    more = ["".join(rnd.choice([*ODD, "a", " ", "12"]) for _ in range(40)) for _ in range(6)]
    x = spark.createDataFrame([("AB"[i % 2], 100 + i, t) for i, t in enumerate(more)], docs.schema)
    return docs.unionByName(x), {**dict(enumerate(texts)), **{100 + i: t for i, t in enumerate(more)}}


def test_marks_are_where_the_lists_tokens_are(spark):
    """Runs cut on a byte a character, of any script, give the lexer's pieces; copies of a row are lexed with it."""
    docs, _ = odd_docs(spark)
    same = [*lexer.CHUNK_KEY, "n", "last_start", "last_end", "upto", "starts", "covered"]
    for d in (docs, docs.unionByName(docs.where("doc_id < 4"))):
        lists, marks = lexer.token_lists(d, 64).collect(), lexer.token_marks(d, 64).collect()
        assert sorted(str([r[c] for c in same]) for r in lists) == sorted(str([r[c] for c in same]) for r in marks) and len(marks) > 20
        subs = {tuple(r[c] for c in lexer.CHUNK_KEY): r.is_subword for r in lists}
        for r in marks:
            bits = [bool(r.glued[i // 64] >> i % 64 & 1) for i in range(r.n)]
            assert bits == subs[r.doc_id, r.chunk, r.origin]


def test_spans_meet_marks_where_they_lie(spark):
    docs, texts = odd_docs(spark)
    rnd = random.Random(3)
    spans = []
    for i, t in texts.items():
        for k in range(60):
            s = rnd.randint(0, len(t or "") + 5)
            spans.append(("AB"[i % 2], i, k, s, s + rnd.choice([0, 1, 2, 9, 80, 200]), "EMAIL"))
    spans = spark.createDataFrame([*spans, ("B", None, 0, 3, 5, "EMAIL")], "origin string, doc_id long, ann_pos int, start int, end int, label string")
    rows = align.locate(spans, lexer.token_chunks(docs, 64), chunk=64, places=True).collect()
    marks = lexer.token_marks(docs, 64)
    found = align.locate(spans, marks, chunk=64, places=True, near=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows))
    assert {r.status for r in rows} == {"ok", "no_token", "empty"}


def test_counts_need_no_token_rows(spark):
    """the counts on marks are those of the aligned table, which isn't built."""
    a, b = Lineage(spark, SF_SMALL), Lineage(spark, SF_SMALL)
    few = [a.label_counts, a.tag_counts(True), a.tag_counts(False)]
    assert not any("spanlab_aligned" in plan(x) or "spanlab_tokens" in plan(x) for x in few)
    assert "geometry" not in a._memo and "token_lists" not in a._memo
    b.geometry
    for x, y in zip(few, [b.label_counts, b.tag_counts(True), b.tag_counts(False)]):
        assert "spanlab_aligned" in plan(y)
        cols = sorted(y.columns)
        assert sorted(map(str, x.select(cols).collect())) == sorted(map(str, y.select(cols).collect()))


def test_spans_of_a_query_move_with_their_texts_only(spark):
    """neither spans nor the boundaries looked up move after the texts were placed; no rule model's spans are found."""
    L = Lineage(spark, SF_SMALL)
    spans = L.docs_en.select("origin", "doc_id", F.lit(0).alias("ann_pos"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("x").alias("label"))
    p = plan(align.locate(spans, L.token_marks, totals=lexer.chunk_totals(L.token_marks), places=True, near=True))
    assert p.count("Exchange") == 1 and "spanlab_marks" in p, p
    REGISTRY["entity_lengths"][0](spark, SF_SMALL)
    assert L.located.count() > 0 and "both_located" not in L._memo

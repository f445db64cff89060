"""Tokens as one row a chunk: same tokens and same places of spans as row by row, without a sort of tokens."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.operators import align, lexer, predict

DOCS = "origin string, doc_id long, source_text string"
ALPHABET = ["a", "bc", "é", "defgh", "12", "3456", " ", "     ", " " * 70, "\n", ".", "-", "\U0001f600", " ", "日本語"]


def random_docs(spark, n=12):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 90))) for _ in range(n)] + ["", " ", "x" * 200, None]
    return spark.createDataFrame([("AB"[i % 2], i, t) for i, t in enumerate(texts)], DOCS), texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_hold_the_lexers_tokens(spark):
    """Chunks of 64 characters cut runs; a row that is there twice is lexed with its copy, as by the windows."""
    docs, _ = random_docs(spark)
    for d in (docs, docs.unionByName(docs.where("doc_id < 4"))):
        x = lexer.lexed(lexer.chunks(d, 64), 64).where("is_tok")
        want = sorted(map(str, x.select(*lexer.CHUNK_KEY, "upto", "piece", "pstart", "pend", "is_subword").collect()))
        got = lexer.token_chunks(d, 64).select(*lexer.CHUNK_KEY, F.col("lidx").alias("upto"), F.col("tok").alias("piece"),
                                               F.col("start").alias("pstart"), F.col("end").alias("pend"), "is_subword").collect()
        assert sorted(map(str, got)) == want and len(want) > 200


def test_spans_meet_lists_as_they_meet_rows(spark):
    docs, texts = random_docs(spark)
    rnd = random.Random(3)
    spans = []
    for i, t in enumerate(texts):
        for k in range(60):
            s = rnd.randint(0, len(t or "") + 5)
            spans.append(("AB"[i % 2], i, k, s, s + rnd.choice([0, 1, 2, 9, 80]), "EMAIL"))
    spans = spark.createDataFrame(spans, "origin string, doc_id long, ann_pos int, start int, end int, label string")
    lists = lexer.token_lists(docs, 64)
    rows = align.locate(spans, lexer.listed_tokens(lists), chunk=64, places=True).collect()
    found = align.locate(spans, lists, chunk=64, places=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows))
    assert {r.status for r in rows} == {"ok", "no_token", "empty"}


def test_tokens_are_neither_sorted_nor_windowed(spark):
    """No window over pieces, no explode of tokens into bins, no join of tokens with covers."""
    from spanlab.plans.lineage import Lineage
    L = Lineage(spark, SF_SMALL)
    assert "Window" not in plan(lexer.token_chunks(L.docs_en))
    lookup = align.locate(L.span_stream, L.token_lists, extra_key=["src"], totals=L.totals, places=True)
    assert "bit_count" in plan(lookup)
    top = plan(L.aligned_plan).split("MapInArrow")[0]
    assert "SortMergeJoin" not in top and "Window" not in top


def test_scorer_fills_columns_at_once(spark):
    """lists of entities pass to Spark as an Arrow column; a null list and a null text stay."""
    docs = spark.createDataFrame([("A", 1, "one two"), ("B", None, None), ("A", 3, "")], DOCS).coalesce(1)

    def make_scorer():
        return lambda texts: [None if t is None else [{"entity": "O", "word": w, "score": 1} for w in t.split()] for t in texts]
    scored = predict.score_batches(docs, make_scorer, "mine")
    assert "MapInPandas" not in plan(scored) and "MapInArrow" in plan(scored)
    got = {r.doc_id: r.predicted_mask for r in scored.collect()}
    assert got[None] is None and got[3] == [] and [(e.entity, e.word, e.score) for e in got[1]] == [("O", "one", 1.0), ("O", "two", 1.0)]

"""A user's tokenizer as one row a chunk: same rows as the way of token rows, and no token moves."""

import random
import re

import pytest

from conftest import SF_SMALL
from spanlab.functions import taxonomy as tx
from spanlab.operators import align, lexer
from spanlab.plans.registry import REGISTRY
from test_token_lists import plan

DOCS = "origin string, doc_id bigint, source_text string"
SPANS = "origin string, doc_id bigint, ann_pos int, start int, end int, label string"


def words(most):
    def factory():
        word = re.compile(r"[^ \t\n\r]{1,%d}" % most)
        # special tokens without characters, and out of order
        return lambda texts: [[(0, 0), *reversed([m.span() for m in word.finditer(t)])] for t in texts]
    return factory


def texts():
    rnd = random.Random(17)
    odd = ["", " ", "x", "a" * 700, " " * 333 + "b", "é" * 63 + "😀" * 5 + "é" * 129, None]
    return odd + [" ".join(rnd.choice(["Ann", "é", "7٣", "😀", "lives-in", "q" * 90, "", " " * 70]) for _ in range(rnd.randint(1, 60))) for _ in range(40)]


def spans_of(docs):
    rnd, out = random.Random(4), []
    for origin, i, t in docs:
        for k in range(12):
            s = rnd.randint(0, len(t or "") + 5)
            out.append((origin, i, k, s, s + rnd.choice([0, 1, 2, 9, 80, 400, 10 ** 6]), rnd.choice(["EMAIL", "SURNAME"])))
    return out


def rows(df, cols=None):
    return sorted(map(str, (r[:] for r in df.select(*(cols or sorted(df.columns))).collect())))


@pytest.mark.parametrize("chunk", [64, lexer.CHUNK])
def test_lists_are_the_rows(spark, chunk):
    """rows that come twice, two texts under one id, and texts without an id give what token rows give."""
    own = [("AB"[i % 2], i, t) for i, t in enumerate(texts())]
    own += own[:8] + own[20:30] + own[:5]
    # starts that both texts share have one end
    own += [(o, i, "Ann lives " + "w" * 90) for o, i, t in own[8:14] if t and not re.match(r"\S", t)]
    own += [("B", None, "Ann lives in Rome"), ("B", None, "Ann lives in Rome")]
    docs = spark.createDataFrame(own, DOCS).repartition(3)
    spans = spark.createDataFrame(spans_of(own), SPANS)
    tokens, lists = lexer.tokenize(docs, words(100)), lexer.tokenize_lists(docs, words(100), chunk)
    assert rows(align.locate(spans, lists, chunk=chunk, places=True, near=True)) == rows(align.locate(spans, tokens, chunk=chunk, places=True))
    cols = ["origin", "doc_id", "idx", "tok", "start", "end", "is_subword", "span_label", "is_first", "ann_pos"]
    want = align.align_tokens(spans, tokens, chunk).persist()
    assert rows(align.align_tokens(spans, lists, chunk), cols) == rows(want, cols)
    tags = {f"tag_{t}": align.span_tags(t, align.label_in(t, span_label=align.F.col("label"))) for t in tx.TAXONOMIES}
    cols = ["origin", "doc_id", "idx", "tok", *tags]
    tagged = want.select("*", *[align.tag(None, t, align.label_in(t)).alias(f"tag_{t}") for t in tx.TAXONOMIES])
    assert rows(align.align_tokens(spans, lists, chunk, tags), cols) == rows(tagged, cols)


def test_long_tokens_and_texts_without_tokens(spark):
    docs = spark.createDataFrame([("A", 1, "a" * 5000 + " b"), ("A", 2, "  "), ("A", 3, None)], DOCS)
    got = lexer.tokenize_lists(docs, words(10 ** 6), 64).collect()
    assert [(r.doc_id, r.chunk, r.n, list(r.tok), r.last_end) for r in sorted(got, key=lambda r: r.chunk)] == [
        (1, 0, 1, ["a" * 5000], 5000), (1, 78, 1, ["b"], 5002)]
    spans = spark.createDataFrame([("A", 1, 0, 4000, 5002, "EMAIL"), ("A", 2, 0, 0, 1, "EMAIL")], SPANS)
    found = align.locate(spans, lexer.tokenize_lists(docs, words(10 ** 6), 64), chunk=64, near=True).collect()
    assert {r.doc_id: (r.start_idx, r.end_idx, r.status) for r in found} == {1: (1, 2, "ok"), 2: (None, None, "no_token")}


def test_tags_of_words_move_no_token(spark):
    """tokens are read in the buckets they were written in, the tokenizer's own rows aren't made again."""
    p = plan(REGISTRY["bio_tags_words"][0](spark, SF_SMALL))
    assert "spanlab_words" in p and "ArrowEvalPython" not in p and p.count("MapInArrow") == 1, p
    for ln in p.split("\n"):
        assert not ("Exchange" in ln and "tok" in ln), ln

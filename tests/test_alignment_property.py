"""The relational alignment equals the rule of the survey, applied span by span, on
random texts and random spans."""

import random

import regex
from pyspark.sql import functions as F

from spanlab.operators import align, lexer

SPAN_SCHEMA = "origin string, doc_id bigint, ann_pos int, start int, end int, label string"


def expected_cover(text, spans):
    """The rule: a span lies on the tokens from the one holding its start to the last one that
    begins before its end; of spans with one first token the last listed counts; from left to
    right, a span stands unless its first token is already covered."""
    toks = [(m.start(), m.end()) for m in regex.finditer(lexer.LEX_RX, text)
            if m.group()[0] not in " \t\n\r"]
    intervals = {}
    for s, e, lab in spans:
        first = [i for i, (a, b) in enumerate(toks, 1) if a <= s < b]
        if e > s and first:
            intervals[first[0]] = (max(i for i, (a, _) in enumerate(toks, 1) if a < e), lab)
    out = {}
    for first, (last, lab) in sorted(intervals.items()):
        if first not in out:
            out |= {i: (lab, i == first) for i in range(first, last + 1)}
    return out


def test_alignment_matches_the_rule(spark):
    rnd = random.Random(7)
    alphabet = "ab cd,ef. 12 345\nXy-z"
    docs, spans = [], []
    expected = {}
    for d in range(60):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 120)))
        sp = []
        for _ in range(rnd.randint(0, 8)):
            s = rnd.randint(0, len(text))
            e = s + rnd.randint(0, 15)
            sp.append((s, e, rnd.choice(["DATE", "TIME", "CITY"])))
        docs.append(("A", d, text))
        spans += [("A", d, i, s, e, lab) for i, (s, e, lab) in enumerate(sp)]
        for idx, v in expected_cover(text, sp).items():
            expected[(d, idx)] = v
    ddf = spark.createDataFrame(docs, "origin string, doc_id bigint, source_text string")
    sdf = spark.createDataFrame(spans, SPAN_SCHEMA)
    p = lexer.pieces(ddf)
    cov = align.cover(align.resolve_overlaps(align.locate(sdf, p)))
    got = {(r.doc_id, r.idx): (r.span_label, r.is_first) for r in cov.collect()}
    assert got == expected

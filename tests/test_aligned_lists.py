"""Aligned tokens as lists made in one pass: the rows of the operators step by step, and reports that need no table of token rows."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.functions.text import hash_bucket
from spanlab.operators import align, aligned, evaluate as E, lexer, predict
from spanlab.plans.lineage import Lineage, _span_ids, _span_rows, keep_labels_long
from spanlab.plans.registry import REGISTRY
from spanlab.sources import corpus as C
from test_token_lists import plan

DOCS = "origin string, doc_id bigint, source_text string"
BITS = ["Ann Lee", "Éva Ünal", "Zoë de", "Ann  Lee", "a@b.cd", "x.y@z.org@k.net", "@", "+1 (555) 123-4567", "10.0.0.255", "1.2.3.4.5", "4" * 16, "5" * 16, "7" * 17,
        "0af" * 14, "f" * 85, "12 34 56 78 90", "(1) 23-45.67890", "é", "٣٤٥٦", "½", "日本語", "\U0001f600", "\x01\x02B", "\x07", " ", "\n", " " * 70, ".", "Xy", "ꙁ" * 9, "word"]


def texts(n=40):
    rnd = random.Random(23)
    return [" ".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 40))) if i % 3 else "".join(rnd.choice(BITS) for _ in range(30)) for i in range(n)]


def odd_docs(spark):
    """Texts of any script; some come twice or three times, some have no id or no text."""
    own = [("AB"[i % 2], i, t) for i, t in enumerate(texts())] + [("A", -2, "Ann Lee 4 " * 9), ("B", 57, "Éva Ünal"), ("A", 58, None)]
    more = own[:6] + own[:3] + [("B", None, "Ann Lee"), ("B", None, "Ann Lee")]
    return spark.createDataFrame([*own, *more], DOCS).repartition(3)


def by_steps(docs, chunk):
    """Token rows by the operators of ``Lineage.aligned_plan``: what decides a token's state."""
    found = C.all_spans(C.place_documents(docs), predict.LOOSE_RULES)
    found = found.where("src = 'loose'").unionByName(keep_labels_long(found.where("src = 'gold'")))
    lists = lexer.token_lists(docs, chunk)
    totals = lexer.chunk_totals(lists)
    acc = align.resolve_overlaps(C.place_documents(align.locate(found, lists, extra_key=["src"], totals=totals, chunk=chunk, places=True)), extra_key=["src"])
    is_gold = F.col("src") == "gold"
    acc = acc.withColumns({"gold": is_gold, "code": F.element_at(_span_ids()[0], F.concat(
        F.when(is_gold, F.col("origin")).otherwise(F.col("src")), F.lit("|"), F.col("label")))})
    numbered = lists.join(totals.select(*lexer.CHUNK_KEY, "base", "n_tok"), lexer.CHUNK_KEY)
    x = align.spread(numbered.join(align.cover_lists(acc, totals, ["gold", "code"]), lexer.CHUNK_KEY, "left"))
    first = len(_span_rows()) - len(predict.LOOSE_RULES)
    h = hash_bucket(F.col("origin"), F.col("doc_id"), F.col("idx"))
    return x.select("origin", "doc_id", "chunk", "lidx", "idx", "n_tok", "tok", "start", "end", F.coalesce(F.expr("2 * g_code + int(g_first)"), F.lit(0)).alias("g"), "is_subword",
                    F.coalesce(F.expr(f"2 * (l_code - {first}) + int(l_first)"), F.lit(0)).alias("l"),
                    F.when(h < 3, 0).when(h < 5, 1).when(h < 6, 2).otherwise(3).alias("noise"), "scored")


def lists_of(docs, chunk):
    return aligned.aligned_lists(docs, {k: i for i, k in enumerate(_span_rows(), 1)}, predict.LOOSE_RULES, chunk)


def rows(df, cols):
    return sorted(map(str, (r[:] for r in df.select(cols).collect())))


def test_lists_hold_the_rows_of_the_steps(spark):
    """rules, places, overlaps, covers and draws of the steps; chunks of 64 characters cut runs and spans."""
    docs = odd_docs(spark)
    for chunk in (64, lexer.CHUNK):
        want = by_steps(docs, chunk).drop("scored")
        got = aligned.rows(lists_of(docs, chunk))
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got, want.columns), rows(want, want.columns)
        assert a == b and len(a) > 1000
        seen = got.agg(F.countDistinct("g"), F.countDistinct("l"), F.countDistinct("noise")).first()
        assert seen[0] > 20 and seen[1] == 9 and seen[2] == 4


def test_geometry_is_the_aligned_plan(spark):
    L = Lineage(spark, SF_SMALL)
    cols = L.geometry.columns
    assert L.geometry.exceptAll(L.aligned_plan.select(cols)).count() == 0 == L.aligned_plan.select(cols).exceptAll(L.geometry).count()
    assert [f.dataType for f in L.geometry.schema] == [L.aligned_plan.schema[c].dataType for c in cols]


def test_reports_build_no_token_rows(spark):
    """neither the token table nor spans are written, cached or joined; texts move once."""
    L = Lineage(spark, SF_SMALL)
    for made in (L.confusion, L.kinds(True), L.entities, L.matched):
        p = plan(made)
        assert "spanlab_aligned" in p and "spanlab_tokens" not in p and "SortMergeJoin" not in p
    assert "Window" not in plan(L.matched)
    assert not {"token_lists", "both_located", "totals"} & set(L._memo)
    docs = spark.createDataFrame([("A", 1, "Ann Lee")], DOCS)
    assert plan(lists_of(docs, lexer.CHUNK)).count("Exchange") == 1


def test_entities_of_lists_are_those_of_rows(spark):
    """runs over any number of chunks, some without a scored token, are joined; no position becomes a row."""
    long = "Ann " + "b" * 50 + "@" + "c" * 300 + ".org " + "Xy Zw " * 30
    docs = odd_docs(spark).unionByName(spark.createDataFrame([("A", 100, long), ("B", 101, long * 2)], DOCS))
    L = Lineage(spark, SF_SMALL)
    L._memo["aligned_lists"] = lists_of(docs, 64)
    assert "Window" not in plan(E._decoded(L.aligned_lists, [("A", "*", [0, 1], [0, 1])]))
    want = E.entity_report(L.pairs)
    got = E.entity_scores(L.entities, L.matched)
    assert rows(got, got.columns) == rows(want, got.columns) and got.count() > 20
    L.aligned_lists.where("n < n_tok").first()["before"], L.aligned_lists.where("n = n_tok").first()["n"]  # of either kind some


PREDS = "origin string, doc_id bigint, model_id string, predicted_mask array<struct<entity:string,word:string,score:double>>"


def test_lists_are_zipped_as_rows_are(spark):
    """shorter, equal, longer, empty, null and missing lists, with and without names of models; no token row is joined."""
    def mask(n):
        return None if n is None else [(["O", "B-EMAIL", "I-EMAIL"][i % 3], "w", 1.0) for i in range(n)]
    lists = [("A", i, m, mask(n)) for i, (a, b) in enumerate([(3, 4), (5, 9), (0, 4), (None, 2), (4, 6)]) for m, n in (("m", a), ("n", b))]
    preds = spark.createDataFrame([*lists, ("B", 9, "m", mask(4)), ("A", 4, "m", mask(2))], PREDS)
    true = [("A", i, [(k * 7 + i) % 5 - 100 * (k % 3 == 0) for k in range(4)]) for i in range(6)]
    lists = spark.createDataFrame(true, "origin string, doc_id bigint, true_ids array<tinyint>")
    tokens = spark.createDataFrame([(o, i, k, v) for o, i, ids in true for k, v in enumerate(ids, 1)], "origin string, doc_id bigint, idx int, true_id int")
    for models in (None, ["m", "n", "other"]):
        want = predict.zip_pairs(tokens, preds.where("doc_id <> 4 OR model_id = 'n'"), "A", models)
        got = predict.zip_pairs(lists, preds.where("doc_id <> 4 OR model_id = 'n'"), "A", models)
        assert rows(got, want.columns) == rows(want, want.columns) and sorted(got.columns) == sorted(want.columns)
    assert rows(predict.zip_pairs(lists, preds, "A"), ["doc_id", "idx", "pred_id"]) == rows(predict.zip_pairs(tokens, preds, "A"), ["doc_id", "idx", "pred_id"])
    p = plan(REGISTRY["zip_pairs"][0](spark, SF_SMALL))
    assert not [ln for ln in p.split("\n") if "Exchange hashpartitioning" in ln and "idx" in ln.split("ENSURE")[0]]


def test_lists_of_predictions_are_measured_where_they_are_made(spark):
    """one move of states and texts a chunk; the lists of structs are neither shuffled nor sorted for a join."""
    for q in ("attach_predictions", "length_mismatch", "encode_predictions"):
        p = plan(REGISTRY[q][0](spark, SF_SMALL))
        moved = [ln for ln in p.split("\n") if "Exchange" in ln or "Sort [" in ln]
        assert moved and "spanlab_tokens" not in p and "lidx" not in p, q
        above = p.split("SortMergeJoin")[-1] if "SortMergeJoin" in p else p
        assert "predicted_mask" not in "".join(ln for ln in above.split("\n") if "Exchange" in ln), q


def test_words_meet_lists_as_they_meet_rows(spark):
    """long and short tokens, blank, null and surplus words, empty and null lists; no token or word is moved."""
    rnd = random.Random(5)
    bits = ["a", "ab", "b", "bc", " c ", "", "é", " x", "abc" * 5, "日本", "q" * 30, None]
    toks = [[rnd.choice(["ab", "abcabc", "é", "xyz", "日本語", "q" * 40, "abc" * 9, "z", "bcd" + "q" * 29]) for _ in range(12)] for _ in range(14)]
    lists = [("AB"[i % 2], i, m, t, None if i == 3 else [(f"B-{k}", rnd.choice(bits[i % 3 * 3:]), 1.0) for k in range(0 if i == 4 else rnd.randint(1, 40))])
             for i, t in enumerate(toks) for m in ("m", "n")]
    lists += [("A", 50, m, ["ab", "z", "ab"], [("B-1", "z", 1.0), ("B-2", "a", 1.0)]) for m in ("m", "n")]
    x = spark.createDataFrame([(*r[:4], r[4], list(range(1, len(r[3]) + 1))) for r in lists], PREDS.replace("predicted_mask", "tok array<string>, predicted_mask") + ", at array<int>")
    tokens = spark.createDataFrame([(o, i, k, t) for o, i, m, ts, _ in lists if m == "m" for k, t in enumerate(ts, 1)], "origin string, doc_id bigint, idx int, tok string")
    want = predict.word_match_align(tokens, x.select("origin", "doc_id", "model_id", "predicted_mask"))
    got = predict.word_match_align(x, along=["at"])
    cols = ["origin", "doc_id", "model_id", "idx", "entity"]
    assert rows(got, cols) == rows(want, cols) and got.where("at <> idx").count() == 0
    assert len({r.entity for r in got.collect()}) > 8
    for q in ("word_match_align", "flat_true_tokens"):
        p = plan(REGISTRY[q][0](spark, SF_SMALL))
        assert "Join" not in p and "token_grams" not in p and "spanlab_tokens" not in p, q


def test_nested_dataset_is_made_of_lists(spark):
    """F8: no token row is gathered; lists that are there already are padded as they are."""
    x = spark.createDataFrame([("A", 1, [0, 3], [2, 5], [7, -100])], "origin string, doc_id bigint, start array<int>, end array<int>, true_id array<int>")
    r = align.nest_labels(x, ["origin", "doc_id"]).first()
    assert [tuple(o) for o in r.offset_mapping] == [(0, 2), (3, 5)] and r.true_labels == [-100, 7, -100, -100]

"""Hand-written cases (FIXTURES.md section 3) and properties."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from spanlab.functions import taxonomy as tx
from spanlab.operators import align, evaluate as E, lexer, predict
from spanlab.sources import io
from spanlab.sources.corpus import DOC_KEY

SPAN_SCHEMA = "origin string, doc_id bigint, ann_pos int, start int, end int, label string"


def _align(spark, text, spans, origin="B"):
    docs = spark.createDataFrame([(origin, 1, text)], "origin string, doc_id bigint, source_text string")
    p = lexer.pieces(docs)
    s = spark.createDataFrame([(origin, 1, i, a, b, lab) for i, (a, b, lab) in enumerate(spans)], SPAN_SCHEMA)
    loc = align.locate(s, p)
    al = align.align(lexer.tokens_from_pieces(p), loc)
    return loc, al


def _tags(al, taxonomy, **kw):
    rows = al.select("idx", "tok", align.tag(None, taxonomy, F.col("span_label"), **kw).alias("tag")) \
        .orderBy("idx").collect()
    return [(r.tok, r.tag) for r in rows]


def test_blank_led_span_is_unmappable(spark):
    text = "Yo, Elica Qu's birthday is 22/04/2022, we're planning a surprise at Saint-Nicolas"
    city = text.index("Saint") - 1          # the annotation starts on the blank
    spans = [(4, 12, "GIVENNAME"), (27, 37, "DATE"), (city, len(text), "CITY")]
    loc, al = _align(spark, text, spans)
    status = {r.label: r.status for r in loc.collect()}
    assert status == {"GIVENNAME": "ok", "DATE": "ok", "CITY": "no_token"}
    tags = dict(_tags(al, "B"))
    assert tags["Elic"] == "B-GIVENNAME" and tags["22"] == "B-DATE"
    assert "B-CITY" not in dict((t, k) for k, t in _tags(al, "B"))


def test_overlaps_later_span_inside_is_skipped(spark):
    words = [f"w{i:02d}" for i in range(40)]
    text = " ".join(words)
    pos = [text.index(w) for w in words]
    spans = [(pos[2], pos[4] + 3, "DATE"), (pos[3], pos[8] + 3, "TIME"), (pos[9], pos[10] + 3, "STREET")]
    loc, al = _align(spark, text, spans)
    acc = {r.label for r in align.resolve_overlaps(loc).collect()}
    assert acc == {"DATE", "STREET"}


def test_same_start_last_label_wins(spark):
    text = "call 555 123 4567 now"
    spans = [(5, 17, "TELEPHONENUM"), (5, 17, "SOCIALNUM")]
    loc, al = _align(spark, text, spans)
    acc = align.resolve_overlaps(loc).collect()
    assert [r.label for r in acc] == ["SOCIALNUM"]


def test_zero_length_span_is_dropped_not_looping(spark):
    loc, al = _align(spark, "abc def", [(0, 0, "DATE"), (4, 7, "CITY")])
    st = {r.label: r.status for r in loc.collect()}
    assert st == {"DATE": "empty", "CITY": "ok"}


def test_label_without_i_tag_repeats_b(spark):
    text = "sex is male female here"
    s = text.index("male")
    _, al = _align(spark, text, [(s, s + len("male female"), "SEX")])
    tags = [t for _, t in _tags(al, "B") if t not in ("O", None)]
    assert tags == ["B-SEX", "B-SEX"]
    tags_a = [t for _, t in _tags(al, "A") if t not in ("O", None)]
    assert tags_a == ["B-SEX", "I-SEX"]


def test_short_prediction_truncates_like_zip(spark):
    true = spark.createDataFrame([("A", 1, i, 56) for i in range(1, 6)],
                                 "origin string, doc_id bigint, idx int, true_id int")
    mask = [Row(entity="O", word="x", score=1.0)] * 3
    preds = spark.createDataFrame([("A", 1, "m", mask)],
                                  "origin string, doc_id bigint, model_id string, "
                                  "predicted_mask array<struct<entity:string,word:string,score:double>>")
    got = sorted((r.idx, r.pred_id) for r in predict.zip_pairs(true, preds, "A").collect())
    assert got == [(1, 56), (2, 56), (3, 56), (4, -100)]


def test_support_zero_tags_count_in_macro(spark):
    conf = spark.createDataFrame([("A", "A", "m", 56, 56, 10)],
                                 "taxonomy string, origin string, model_id string, true_id int, pred_id int, n long")
    rep = E.classification_report(conf)
    rows = {(r.eval_set, r.tag): r for r in rep.collect()}
    assert rows[("own", "O")].f1 == 1.0
    assert rows[("own", "B-EMAIL")].precision == 0.0 and rows[("own", "B-EMAIL")].support == 0
    avg = {(r.eval_set, r.average): r for r in E.report_averages(rep).collect()}
    n_scope = len(tx.scope_ids("A"))
    assert abs(avg[("own", "macro")].f1 - round(1.0 / n_scope, 6)) < 1e-6
    assert avg[("own", "micro")].f1 == 1.0


def test_python_literal_parses_quotes_and_none(spark):
    df = spark.createDataFrame([
        ("[{'value': \"21 o'clock\", 'start': 5, 'end': 9, 'label': 'TIME'}]",),
        ("[{'value': 'x', 'start': 1, 'end': 2, 'label': 'DATE', 'label_index': None}]",),
    ], "t string")
    out = df.select(io.parse_literal(F.col("t")).alias("m")).collect()
    assert out[0].m[0].value == "21 o'clock" and out[0].m[0].label == "TIME"
    assert out[1].m[0].label_index is None and out[1].m[0].label == "DATE"


def test_decimal_is_not_a_gold_phone_but_a_loose_one(spark):
    from spanlab.sources.corpus import spans as gold_spans
    docs = spark.createDataFrame([("A", 2, "score 0.85763847 and 0.5")],
                                 "origin string, doc_id bigint, source_text string")
    assert not [r for r in gold_spans(docs).collect() if r.label in ("TEL", "SOCIALNUMBER")]
    loose = predict.loose_spans(docs).collect()
    assert [r.label for r in loose] == ["PHONE"]


def test_lexer_is_lossless(spark):
    from spanlab.plans.lineage import lineage
    from conftest import SF_SMALL
    L = lineage(spark, SF_SMALL)
    rebuilt = L.pieces.groupBy(*DOC_KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))),
                                 lambda x: x["piece"]), "").alias("t"))
    bad = rebuilt.join(L.docs_en, DOC_KEY).where(F.col("t") != F.col("source_text")).count()
    assert bad == 0


def test_token_totals_add_up(spark):
    """B + I + O + ignored = tokens + 2 x documents (special tokens)."""
    from spanlab.plans.registry import REGISTRY
    from spanlab.plans.lineage import lineage
    from conftest import SF_SMALL
    tot = {r.taxonomy: r for r in REGISTRY["token_label_counts"][0](spark, SF_SMALL).collect()
           if r.label == "(total)"}
    L = lineage(spark, SF_SMALL)
    n_tok, n_docs = L.tokens.count(), L.docs_en.count()
    for t in tx.TAXONOMIES:
        r = tot[t]
        assert r.b_count + r.i_count + r.o_count + r.ignored_count == n_tok + 2 * n_docs


def test_concat_support_is_sum_of_origins(spark):
    from spanlab.plans.lineage import lineage
    from conftest import SF_SMALL
    conf = E.confusion(lineage(spark, SF_SMALL).pairs)
    per_origin = {(r.taxonomy, r.model_id, r.true_id, r.origin): r.n for r in
                  conf.groupBy("taxonomy", "model_id", "true_id", "origin").agg(F.sum("n").alias("n")).collect()}
    rep = E.classification_report(conf).where("eval_set = 'concat'").collect()
    for r in rep:
        exp = sum(v for (t, m, i, o), v in per_origin.items() if (t, m, i) == (r.taxonomy, r.model_id, r.tag_id))
        assert r.support == exp


def test_relabel_idempotent_and_no_foreign_labels(spark):
    from spanlab.plans.registry import REGISTRY
    from conftest import SF_SMALL
    lab = F.col("l")
    df = spark.createDataFrame([(x,) for x in tx.KEEP_LABELS["B"]], "l string")
    once = df.select(tx.map_label(lab, "B", "A").alias("l"))
    twice = once.select(tx.map_label(lab, "B", "A").alias("l"))
    assert sorted(r.l for r in once.collect()) == sorted(r.l for r in twice.collect())
    assert REGISTRY["assert_no_foreign"][0](spark, SF_SMALL).count() == 0


def test_model_ignore_list_replaces_with_o(spark):
    df = spark.createDataFrame([("B-IP",), ("I-IP",), ("B-EMAIL",), ("O",)], "e string")
    out = [r.x for r in df.select(predict.drop_entities(F.col("e"), "A").alias("x")).collect()]
    assert out == ["O", "O", "B-EMAIL", "O"]


def test_word_match_takes_first_prediction_containing_word(spark):
    toks = spark.createDataFrame([("A", 1, 1, "hello"), ("A", 1, 2, "xyz")],
                                 "origin string, doc_id bigint, idx int, tok string")
    mask = [Row(entity="B-X", word=" ell ", score=1.0), Row(entity="B-Y", word="hello", score=1.0),
            Row(entity="B-Z", word="q", score=1.0)]
    preds = spark.createDataFrame([("A", 1, "m", mask)],
                                  "origin string, doc_id bigint, model_id string, "
                                  "predicted_mask array<struct<entity:string,word:string,score:double>>")
    got = {r.idx: r.entity for r in predict.word_match_align(toks, preds).collect()}
    assert got == {1: "B-X", 2: "O"}


PREDS = ("origin string, doc_id bigint, model_id string, "
         "predicted_mask array<struct<entity:string,word:string,score:double>>")


def test_word_match_strips_unicode_blanks_and_keeps_unmatched_documents(spark):
    toks = spark.createDataFrame([("A", d, i, t) for d in (1, 2, 3, 4) for i, t in ((1, "hello"), (2, "xyz"))],
                                 "origin string, doc_id bigint, idx int, tok string")
    preds = spark.createDataFrame([
        ("A", 1, "m", [Row(entity="B-X", word="\tell\u00a0", score=1.0)]), ("A", 2, "m", []), ("A", 3, "m", None),
        ("A", 4, "m", [Row(entity="B-Q", word="ellx", score=1.0), Row(entity="B-N", word=None, score=1.0)])], PREDS)
    got = {(r.doc_id, r.idx): r.entity for r in predict.word_match_align(toks, preds).collect()}
    assert got == {(1, 1): "B-X", (1, 2): "O", (2, 1): "O", (2, 2): "O", (3, 1): "O", (3, 2): "O",
                   (4, 1): "B-N", (4, 2): "B-N"}


def test_word_match_equals_brute_force_on_long_tokens(spark):
    import random
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, n)))
    toks = [("A", d, i, word(12)) for d in range(10) for i in range(1, 8)]
    lists = {d: [("T%d" % k, word(6)) for k in range(5)] for d in range(10)}
    preds = spark.createDataFrame([("A", d, "m", [Row(entity=e, word=w, score=1.0) for e, w in l])
                                   for d, l in lists.items()], PREDS)
    got = {(r.doc_id, r.idx): r.entity for r in predict.word_match_align(
        spark.createDataFrame(toks, "origin string, doc_id bigint, idx int, tok string"), preds).collect()}
    assert got == {(d, i): next((e for e, w in lists[d] if w.strip() in t), "O") for _, d, i, t in toks}


def test_python_literal_as_repr_writes_it(spark):
    values = ["a, None, b", "\xa0x\u200b", "it's \"so\"", "back\\slash", "\\x41 \\", "tab\tnew\nline", "[True]", "é", ""]
    rows = [[{"value": v, "start": 1, "end": 2, "label": "DATE", "label_index": None}] for v in values]
    df = spark.createDataFrame([(i, repr(r)) for i, r in enumerate(rows)], "i int, t string")
    out = {r.i: r.m for r in df.select("i", io.parse_literal(F.col("t")).alias("m")).collect()}
    assert [out[i][0].value for i in range(len(values))] == values
    assert all(m[0].label_index is None and m[0].start == 1 for m in out.values())
    back = {r.i: r.t for r in io.restore_lists(df, "t").collect()}
    assert back == out
    lists = df.select(io.parse_literal(F.col("t")).alias("t"))
    assert io.restore_lists(lists, "t").schema == lists.schema        # lists stay as they are


def test_compare_models_of_any_name(spark):
    conf = spark.createDataFrame([("B", "B", "x/1", 0, 0, 4), ("B", "B", "y", 0, 1, 4)],
                                 "taxonomy string, origin string, model_id string, true_id int, pred_id int, n long")
    rep = E.classification_report(conf)
    tag = tx.id2tag("B")[0]
    in_scope = 0 in tx.scope_ids("B")
    got = {r.tag: r for r in E.compare_models(rep, "x/1", "y").collect()}
    if in_scope:
        assert (got[tag].f1_a, got[tag].f1_b, got[tag].better) == (1.0, 0.0, "x/1")
    assert {r.better for r in got.values()} <= {"x/1", "y", "tie"}
    absent = E.compare_models(rep, "x/1", "nobody").collect()
    assert absent and all(r.f1_b is None and r.delta is None and r.better is None for r in absent)


def test_missing_scores_fail_parity(spark):
    schema = "doc_id int, idx int, class int, score double"
    a = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.25)], schema)
    b = spark.createDataFrame([(1, 0, 0, 0.5)], schema)
    r = E.score_parity(a, b).first()
    assert r.n == 1 and r.within_tolerance is False
    assert E.score_parity(a, a).first().within_tolerance is True


def test_label_set_assertion_fires_both_ways(spark):
    from spanlab.operators import prep
    rows = [(t, lab) for t in tx.TAXONOMIES for lab in tx.KEEP_LABELS[t] if (t, lab) != ("A", "SEX")]
    spans = spark.createDataFrame(rows + [("B", "TAXNUM")], "origin string, label string")
    got = sorted(tuple(r) for r in prep.assert_label_set(spans).collect())
    assert got == [("A", "SEX", "expected_not_observed"), ("B", "TAXNUM", "observed_not_expected")]


def test_confusion_counts_equal_those_of_pairs(spark):
    from spanlab.plans.lineage import lineage
    from conftest import SF_SMALL
    L = lineage(spark, SF_SMALL)
    a, b = L.confusion, E.confusion(L.pairs)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count() > 0


def test_scorer_is_an_argument(spark):
    docs = spark.createDataFrame([("A", i, "x y" if i else None) for i in range(70)],
                                 "origin string, doc_id bigint, source_text string").coalesce(1)

    def make_scorer():
        return lambda texts: [[{"entity": "B-EMAIL", "word": w, "score": 0.5} for w in (t or "").split()]
                              for t in texts if len(texts) <= 32]
    got = {r.doc_id: [e.word for e in r.predicted_mask] for r in
           predict.score_batches(docs, make_scorer, "mine").collect()}
    assert got == {i: ["x", "y"] if i else [] for i in range(70)}


def test_latency_counts_every_document(spark):
    from spanlab.plans.lineage import lineage
    from spanlab.plans.registry import REGISTRY
    from conftest import SF_SMALL
    (r,) = REGISTRY["latency_report"][0](spark, SF_SMALL).collect()
    assert r.n_samples == lineage(spark, SF_SMALL).docs_en.count() and r.total_sec >= 0


def test_schema_is_described(spark):
    df = spark.createDataFrame([], "a int, m array<struct<value:string,start:int>>")
    assert io.describe_schema(df) == [("a", "int"), ("m", "array<struct<value:string,start:int>>"),
                                      ("m.value", "string"), ("m.start", "int")]

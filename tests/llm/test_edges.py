"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlab.llm import (html_consensus, line_dedup, minhash_dedup, mixture_lid, nnls_packing, ordinal_quality, passage_dedup,
                         pivot_topk, queries, sharding, suffix_decon, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, doc int, slot int"
LONG = "one two three four five six seven eight nine ten eleven twelve. " * 3000
ROWS = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "short", "en", "a", 5), (3, "short", "en", "a", 5),
        (None, "no id here", None, None, 3), (4, LONG, "en", "b", len(LONG)), (5, LONG, "de", "b", len(LONG)), (6, " \n ", "en", "b", 3)]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    rows = [(*r, 1.0, "x", 7, 9) for r in ROWS] if request.param == "rows" else []
    return spark.createDataFrame(rows, DOCS)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_sharding(docs):
    out = sharding.shard_documents(docs, 3).collect()
    assert len(out) == docs.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_scores(spark, docs):
    for model in (toxicity.train(*toxicity.labelled_rows(docs, labels(spark, k), "toxic", 100)) for k in (0, 8)):
        assert toxicity.score(docs, model).count() == docs.count()
    for k in (0, 8):
        model = ordinal_quality.train(*toxicity.labelled_rows(docs, labels(spark, k), "quality", 100, even=False))
        out = ordinal_quality.grade_rows(docs, model, 1, ["doc_id", "score"])
        assert out.count() == docs.count()
        assert k or out.where("tail < 1").count() == 0


def test_languages(docs):
    out = mixture_lid.predict(docs, mixture_lid.train(docs.select("text", "lang"))).collect()
    assert len(out) == docs.count()
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (1, 2, 6))


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", "<p>a<br>b &amp; c</p><nav>menu</nav><p cla"),
            (3, "http://h/y", "<p>a<br>b &amp; c</p><nav>menu</nav><p cla"), (4, None, "<div class='c'>x<script>1<2</script> y</div>")]
    for part in (rows, []):
        out = html_consensus.main_text(spark.createDataFrame(part, "page_id long, url string, html string")).collect()
        assert sorted((r["page_id"], r["text"]) for r in out) == (
            [(1, ""), (2, ""), (3, "a b & c"), (3, "a b & c"), (4, "x y")] if part else [])


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-3.0, 0.5]),
            (5, [-3.0, 0.5]), (6, []), (7, [1.0])]
    out = pivot_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 5)]
    none = pivot_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") == 0)
    assert none.count() == 0


def test_vectors_null_id(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 2.0]), (None, None), (1, [1.0, 2.0]), (5, [-3.0, 0.5])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = pivot_topk.top_k(data, F.col("id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 5)]


def test_vectors_own_row():
    """More than k near copies in one block: a query's own row takes none of the k places."""
    x = np.array([[256.0 + i, 512.0, 128.0] for i in range(9)] + [[-256.0, 64.0, i] for i in range(20)])
    ids = np.arange(len(x), dtype=np.int64)
    best, queries_ = pivot_topk.Best(9, 5), np.arange(9)
    for part in (ids[::2], ids[1::2]):  # in two blocks, in any order
        best.add(queries_, part[::-1], pivot_topk._scores(x[:9], x[part[::-1]]), ids[:9, None] != part[::-1])
    for q in range(9):
        assert best.id[q].tolist() == [i for i in range(8, -1, -1) if i != q][:5] and best.found[q].all()


def brute_topk(data, k):
    out = set()
    for q, x in data:
        if q % 50 == 0:
            found = sorted((-int(x @ y), i) for i, y in data if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("kind", ["clustered", "random", "equal", "far"])
def test_index_is_exact_and_rules_out(spark, monkeypatch, kind):
    """Exact on vectors of every kind; on clustered ones most pairs are never compared."""
    rng = np.random.default_rng(3)
    n, dim = 3000, 16
    x = {"clustered": rng.normal(size=(30, dim))[rng.integers(0, 30, n)] * 4 + rng.normal(size=(n, dim)) * .1,
         "random": rng.normal(size=(n, dim)), "equal": np.ones((n, dim)), "far": rng.normal(size=(n, dim)) + 50}[kind]
    x[7] = x[100]  # ties
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    data = [(i, np.floor(256 * v).astype(np.int64)) for i, v in enumerate(x)]
    monkeypatch.setattr(pivot_topk, "QUERY_BYTES", 40 * (dim + 2) * 8)  # several blocks of queries
    compared = spark.sparkContext.accumulator(0)
    got = pivot_topk.top_k(table, F.col("id") % 50 == 0, 5, compared=compared).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_topk(data, 5) and len(got) == 300
    if kind == "clustered":
        assert compared.value < 0.3 * n * 60
    elif kind == "equal":
        assert compared.value < 60 * 10  # of equal vectors k + 1 are candidates


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "Two three"), (2, None), (None, "short"), (4, "!!")], "item_id long, text string")
    out = suffix_decon.report(docs, bench)
    assert out.count() == docs.count()
    assert {r[0] for r in out.where("contaminated").select("doc.doc_id").collect()} == ({3, 4, 5} if docs.count() else set())
    blocks = suffix_decon.find_matches(docs, bench, block_bytes=4).where(F.size("spans") > 0)
    assert blocks.count() == out.where("contaminated").count()
    assert suffix_decon.decontaminate(docs, bench).columns == docs.columns


def test_near_duplicates(docs):
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert out == ({(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (5, 4, False), (6, 6, True)}
                   if docs.count() else set())


def test_bucket_pairs_at_the_threshold():
    """No link is dropped whose sets are kept whole but whose union is larger than a sample."""
    p, rng, lost, of = minhash_dedup.Params(), np.random.default_rng(5), 0, 0
    for size in (230, 240, 250, 256):
        for _ in range(100):
            both = -(-size * 2 * 75 // 175)
            h = rng.choice(1 << 32, 2 * size - both, replace=False).astype(np.uint32)
            bottom = np.empty(2, object)
            bottom[:] = [np.sort(h[:size]), np.sort(h[size - both:])]
            ids, same = np.array([1, 2]), np.zeros((2, p.bands * p.rows), np.uint8)
            found = minhash_dedup._bucket_pairs(7, ids, ids, np.array([size, size]), same, np.full((2, p.bands), 7), bottom, p)
            lost, of = lost + (list(found) != [(1, 2)]), of + 1
    assert (lost, of) == (0, 400)


def test_packing(docs):
    out = nnls_packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    assert sum(r["start"] == 0 for r in out) == docs.count()


def test_line_dedup(docs):
    out = line_dedup.dedup(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        if r["doc"]["doc_id"] in (1, 2, 3, 6):
            assert r["kept_text"] == r["doc"]["text"] and r["spans"] is None
        if r["doc"]["doc_id"] == 5:
            assert r["kept_text"] == ""


def surviving(texts, n=50):
    """The documents that keep a window of n tokens that also stands earlier (own copies: without overlap)."""
    seen, out = {}, set()
    for i, text in sorted(texts):
        w = passage_dedup._TOKEN.findall((text or "").lower())
        for a in range(len(w) - n + 1):
            j, b = seen.setdefault(tuple(w[a:a + n]), (i, a))
            if j != i or a >= b + n:
                out.add(i)
    return out


def test_passages_left_by_units(spark, tmp_path):
    poem = "\n".join(f"line {i} of a short poem" for i in range(30))
    han = "".join(chr(0x4E00 + 7 * i) for i in range(120))
    short = " ".join(f"word{i} and two more." for i in range(20))
    inside = " ".join(f"mid{i}" for i in range(70))
    rows = [(1, poem), (2, "Own start.\n" + poem), (3, han), (4, "\u5f00\u59cb" + han + "\u3002"), (5, short), (6, "One more here. " + short),
            (7, f"A start {inside} and an end."), (8, f"Another one {inside} ends otherwise here."), (9, poem), (9, poem), (None, None),
            (10, " ".join(["again"] * 160)), (11, "plain words only")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.substring_dedup(spark, docs, str(tmp_path)).collect()]
    assert len(out) == len(rows) and surviving(t for t in dict(out).items() if t[0]) == set()
    kept = dict(out)
    assert [kept[i] for i in (None, 1, 3, 5, 7, 11)] == [dict(rows)[i] for i in (None, 1, 3, 5, 7, 11)]
    assert len(kept[10].split()) >= 50


def test_stages_keep_columns(spark, docs, tmp_path):
    for name in ("labels", "benchmark"):
        kind = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}[name]
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_stages_keep_rows_and_clashing_columns(spark, tmp_path):
    """Columns named like the stages' own, map columns, several texts and null texts under one doc_id."""
    kinds = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([(i, i % 2, 0) for i in range(8)] if name == "labels" else [], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    words = [f"w{i}" for i in range(400)]
    text = lambda a: " ".join(words[a:a + 40])
    rows = [(1, text(0)), (1, text(0)), (1, text(50)), (1, None), (2, text(100)), (2, text(0)), (3, text(100)), (4, None), (None, text(200)),
            (None, text(200)), (5, ""), (5, ""), (6, text(300))]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), {"k": n}, .5, True, "x", 7, 8) for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, tail double, accepted boolean, "
        "expected_grade string, kept_text int, c0__ int").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    kept = out.collect()
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    # text(0) stands under 1 (twice) and 2, text(100) under 2 and 3: one of each group stays
    assert {t for _, t in got} == {t for _, t in rows}
    assert [t for i, t in got if i is not None and t].count(text(0)) == 1 and [t for i, t in got if t == text(100)] == [text(100)]
    assert [(i, t) for i, t in got if i is None] == [(None, text(200))] * 2
    assert [(i, t) for i, t in got if not t] == [(1, None), (4, None), (5, "")]
    for r in kept:
        n = r["tags"]["k"]
        assert rows[n] == (r["doc_id"], r["text"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.schema["tags"].dataType == docs.schema["tags"].dataType, name
        assert all(r["c0__"] == 8 and r["expected_grade"] == "x" for r in got.collect()), name
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).where("start = 0").count() == len(rows)


ARTICLE = "First sentence of the article, long enough to count. " * 4
ONE = ARTICLE.strip()


@pytest.mark.parametrize("page, want", [
    (f"<div class='content-with-sidebar'><p>{ARTICLE}</p></div>", ONE),
    (f"<article><div class='social-policy'><p>{ARTICLE}</p></div></article>", ONE),
    (f"<body><nav><a href=x>Menu</a><article><p>{ARTICLE}</p></article></body>", ONE),
    (f"<article><h2 id='search-engines'>On search</h2><p>{ARTICLE}</p><p id='related-work'>Related work.</p></article>", f"On search {ONE} Related work."),
    (f"<article><p>{ARTICLE}</p><ins class='adsbygoogle'>Buy now</ins><p>End <ins>really</ins>.</p></article>", f"{ONE} End really."),
    (f"<div id='sidebar'><p>{ARTICLE}</p></div><footer>(c)</footer>", ONE),
    (f"<main><p>{ARTICLE}</p><div class='sidebar-left'><p>Teaser text here.</p></div><div class='post-comments'><p>{'I like it. ' * 90}</p></div></main>", ONE),
    (f"<div class='cookie-banner'>We use cookies.</div><div><div><p>{ARTICLE}</p></div><div><p>Second &lt;part&gt;.</p></div></div>", f"{ONE} Second <part>."),
    (f"<table><tr><td>{ARTICLE}<td>cell</table><aside>note</aside><form>mail <input></form>", f"{ONE} cell"),
    (f"<article><section><p>{ARTICLE}</p></section><section class='newsletter-signup'>Sign up</section><section><p>{ARTICLE}</p></section></article>", f"{ONE} {ONE}"),
])
def test_pages_that_are_no_plain_article(page, want):
    assert html_consensus.extract(page, []) == want


def test_host_path_needs_nearly_all(spark):
    """Most pages of a host use a narrower container than some: their text isn't cut for it."""
    narrow = [(i, "http://h/x", f"<article><div class='b'><p>{ARTICLE}</p></div></article>", 1) for i in range(6)]
    wide = [(10, "http://h/y", f"<article><div class='b'><p>{ARTICLE}</p></div><div class='b2'><p>{ARTICLE}</p></div><div class='c'><p>{ARTICLE}</p></div></article>", 1)]
    long = [(11, None, "<article>" + f"<p>{ARTICLE}</p>" * 5000 + "</article>", 1)]
    rows = spark.createDataFrame(narrow + wide + long, "page_id long, url string, html string, host int").withColumns({"text": F.lit(5), "paths": F.lit("p")})
    for limit in (html_consensus.BROADCAST_BYTES, -1):  # broadcast, and salted groups
        before, html_consensus.BROADCAST_BYTES = html_consensus.BROADCAST_BYTES, limit
        try:
            got = {r["page_id"]: r["text"] for r in html_consensus.main_text(rows).collect()}
        finally:
            html_consensus.BROADCAST_BYTES = before
        assert all(got[i] == ONE for i in range(6)) and got[10] == f"{ONE} {ONE} {ONE}" and got[11] == " ".join([ONE] * 5000)


def test_release_removes_what_was_written(spark):
    import os

    from spanlab.llm import common
    common.release(spark)
    df = common.written(spark.range(5).toDF("x"), "some")
    (path,) = common._MADE[spark.sparkContext.applicationId]
    assert df.count() == 5 and os.path.exists(path.removeprefix("file:"))
    assert common.release(spark) == 1 and not os.path.exists(path.removeprefix("file:")) and common.release(spark) == 0

"""Chunked lexing, span lookup on any tokenizer's tokens, entity decoding by parts, shared tables: each
against a plain version of the rule."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlab.operators import align, evaluate as E, lexer
from spanlab.sources.corpus import DOC_KEY
from test_alignment_property import SPAN_SCHEMA

DOCS = "origin string, doc_id bigint, source_text string"


def plain_pieces(text):
    """(piece, start, end, token, tokens so far, subword) of every piece."""
    out, n, before = [], 0, False
    for m in regex.finditer(lexer.LEX_RX, text):
        tok = m.group()[0] not in " \t\n\r"
        n += tok
        out.append((m.group(), m.start(), m.end(), tok, n, before))
        before = tok
    return out


def texts():
    rnd = random.Random(5)
    out = ["", " ", "x", "ab" * 700, "7" * 515, " " * 333, "a" * 64 + "1" * 64 + " " * 64, "é" * 63 + "😀" * 5 + "é" * 129, "." * 200]
    for _ in range(40):
        out.append("".join(rnd.choice(["a", "é", "7", "٣", " ", "\n", ".", "😀"]) * rnd.choice([1, 1, 2, 3, 5, 66, 131]) for _ in range(rnd.randint(1, 30))))
    return out


@pytest.mark.parametrize("chunk", [64, 128, 1_000_000])
def test_pieces_do_not_depend_on_the_chunk(spark, chunk):
    docs = spark.createDataFrame([*[("A", i, t) for i, t in enumerate(texts())], ("A", 999, None)], DOCS)
    got = {}
    for r in lexer.pieces(docs, chunk).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.piece, r.pstart, r.pend, r.is_tok, r.idx_upto, r.is_subword, r.n_tok))
    for i, t in enumerate(texts()):
        want = plain_pieces(t)
        n = want[-1][4] if want else 0
        assert sorted(got.get(i, [])) == [(k, *p, n) for k, p in enumerate(want)], (chunk, i)
    assert 999 not in got


def test_long_text_is_spread(spark):
    """5 MB in one text: every window holds one chunk, and the chunks lie in many tasks."""
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    text = " ".join(rnd.choice(words) for _ in range(700_000))[:5_000_000]
    docs = spark.createDataFrame([("A", 1, text)], DOCS)
    t = lexer.token_chunks(docs)
    per = t.groupBy("chunk", F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("e")).collect()
    assert sum(r.n for r in per) == sum(p[3] for p in plain_pieces(text))
    assert len({r.task for r in per}) > 4 and max(r.n for r in per) <= lexer.CHUNK
    totals = {r.chunk: r for r in lexer.chunk_totals(t).collect()}
    assert len(totals) == -(-len(text) // lexer.CHUNK)
    last = totals[max(totals)]
    assert last.base + last.n == last.n_tok == sum(r.n for r in per)


def random_tokens(rnd, n):
    """Tokens of 1 to 200 characters, some glued and some after gaps, a few very long ones."""
    out, at = [], rnd.choice([0, 0, 70])
    for _ in range(n):
        size = rnd.choice([1, 2, 5, 64, 200])
        out.append((at, at + size))
        at += size + rnd.choice([0, 0, 1, 3, 100, 400])
    return out


def plain_located(tokens, start, end):
    first = [i for i, (a, b) in enumerate(tokens, 1) if a <= start < b]
    if end <= start:
        return None, None, "empty"
    if not first:
        return None, None, "no_token"
    return first[0], max(i for i, (a, _) in enumerate(tokens, 1) if a < end), "ok"


def plain_cover(tokens, spans):
    """Token: (label, first) by the rule."""
    heads = {}
    for s, e, lab in spans:
        first, last, status = plain_located(tokens, s, e)
        if status == "ok":
            heads[first] = (last, lab)
    out = {}
    for first, (last, lab) in sorted(heads.items()):
        if first not in out:
            out |= {i: (lab, i == first) for i in range(first, last + 1)}
    return out


@pytest.mark.parametrize("chunk", [64, 256, lexer.CHUNK])
def test_any_tokens(spark, chunk):
    rnd = random.Random(chunk)
    tokens, spans, want, covers = [], [], [], {}
    for d in range(25):
        own = random_tokens(rnd, rnd.randint(0, 25))
        length = own[-1][1] if own else 50
        tokens += [("B", d, f"t{i}", a, b, i) for i, (a, b) in enumerate(own, 1)] + [("B", d, "[CLS]", 0, 0, 0)]
        mine = []
        for i in range(rnd.randint(0, 9)):
            s = rnd.choice([rnd.randint(0, length + 60), rnd.choice(own)[0] if own else 3])
            mine.append((s, s + rnd.choice([0, 1, 7, 90, 700, 10 ** 6]), rnd.choice(["DATE", "CITY"])))
        spans += [("B", d, i, *m) for i, m in enumerate(mine)]
        want += [(d, i, *plain_located(own, s, e)) for i, (s, e, _) in enumerate(mine)]
        covers |= {(d, i): v for i, v in plain_cover(own, mine).items()}
    tdf = spark.createDataFrame(tokens, "origin string, doc_id bigint, tok string, start int, end int, given int").repartition(4)
    sdf = spark.createDataFrame(spans, SPAN_SCHEMA)
    located = align.locate(sdf, tdf, chunk=chunk)
    assert sorted(map(str, ((r.doc_id, r.ann_pos, r.start_idx, r.end_idx, r.status) for r in located.collect()))) == sorted(map(str, want))
    aligned = align.align_tokens(sdf, tdf, chunk)
    rows = aligned.collect()
    assert {(r.doc_id, r.idx): (r.span_label, r.is_first) for r in rows if r.span_label} == covers
    assert sorted((r.doc_id, r.idx) for r in rows) == sorted((r[1], r[5]) for r in tokens if r[4] > r[3])
    assert all(r.idx == r.given for r in rows)
    for df in (located, aligned):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_any_tokens_empty(spark):
    none = spark.createDataFrame([], "origin string, doc_id bigint, start int, end int")
    spans = spark.createDataFrame([("A", 1, 0, 0, 5, "CITY")], SPAN_SCHEMA)
    assert [r.status for r in align.locate(spans, none).collect()] == ["no_token"]
    assert align.align_tokens(spans, none).count() == 0
    with pytest.raises(ValueError):
        lexer.index_tokens(none, 100)


def test_users_tokenizer(spark):
    docs = spark.createDataFrame([("A", 1, "Ann lives-in Rome"), ("A", 2, None), ("B", 3, "")], DOCS)

    def factory():
        import re
        return lambda texts: [[(0, 0), *(m.span() for m in re.finditer(r"\w+|-", t))] for t in texts]

    rows = sorted((r.origin, r.doc_id, r.idx, r.tok, r.start, r.end, r.is_subword) for r in lexer.tokenize(docs, factory).collect())
    assert rows == [("A", 1, 1, "Ann", 0, 3, False), ("A", 1, 2, "lives", 4, 9, False), ("A", 1, 3, "-", 9, 10, True),
                    ("A", 1, 4, "in", 10, 12, True), ("A", 1, 5, "Rome", 13, 17, False)]


def plain_entities(tags):
    out, before = set(), (0, None)
    for i, (px, et) in enumerate(tags, 1):
        if px == 1 or (px == 2 and before != (1, et) and before != (2, et)):
            out.add((i, i, et))
        elif px == 2:
            first, last, _ = next(e for e in out if e[1] == i - 1)
            out.remove((first, last, et))
            out.add((first, i, et))
        before = (px, et)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_entities_by_parts(spark, size):
    rnd = random.Random(size)
    rows, want = [], set()
    for d in range(30):
        tags = [rnd.choice([(0, None), (1, 1), (2, 1), (2, 1), (2, 1), (2, 2)]) for _ in range(rnd.randint(0, 40))]
        want |= {(d, *e) for e in plain_entities(tags)}
        for i, (px, et) in enumerate(tags, 1):
            part = (i - 1) // size
            if px:
                rows.append((d, part, i, i > 1 and (i - 1) % size == 0, px, et))
    df = spark.createDataFrame(rows, "d int, part int, pos int, opens boolean, px int, et int").repartition(5)
    got = {(r.d, r["first"], r["last"], r.etype) for r in E.entities(df, ["d"]).collect()}
    assert got == want


def test_entity_report_moves_no_o(spark):
    """Both ways into the report agree, and what moves is one row a tag that isn't O."""
    from spanlab.plans.lineage import lineage
    from spanlab.plans.registry import REGISTRY
    L = lineage(spark, SF_SMALL)
    a = {tuple(r) for r in REGISTRY["entity_report"][0](spark, SF_SMALL).collect()}
    assert a == {tuple(r) for r in E.entity_report(L.pairs.drop("tok")).collect()}
    assert L.tagged.where("px = 0 or et is null").count() == 0


def test_written_tables_are_shared_and_released(spark, tmp_path):
    import os
    import shutil

    from spanlab.plans import checkpoints
    from spanlab.plans.lineage import Lineage
    sf = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, sf)
    app = spark.sparkContext.applicationId
    first = Lineage(spark, sf)
    want = first.geometry.count()
    held = dict(checkpoints._HELD[(app, sf)])
    marks = {p: os.stat(f"{p.removeprefix('file:')}/_SUCCESS").st_mtime_ns for p in held.values()}
    assert len(held) == 2
    # another session: no catalog entry, a lease of its own
    for t, p in held.items():
        spark.sql(f"DROP TABLE {t}")
        open(f"{p.removeprefix('file:')}.leases/other", "w").close()
    checkpoints._HELD.pop((app, sf))
    second = Lineage(spark, sf)
    assert second.geometry.count() == want
    assert marks == {p: os.stat(f"{p.removeprefix('file:')}/_SUCCESS").st_mtime_ns for p in held.values()}
    second.release()
    assert all(os.path.exists(p.removeprefix("file:")) for p in held.values())  # the other one holds them
    for p in held.values():
        os.remove(f"{p.removeprefix('file:')}.leases/other")
    third = Lineage(spark, sf)
    assert third.geometry.count() == third.token_table.count() == want
    third.release()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in held.values())
    assert not any(spark.catalog.tableExists(t) for t in held)
    # other input, other table
    before = checkpoints.fingerprint(spark, sf)
    os.utime(f"{sf}/documents.parquet", (1, 1))
    assert checkpoints.fingerprint(spark, sf) != before

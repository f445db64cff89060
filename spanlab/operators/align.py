"""Character spans -> token tags.

Semantics (per document, tokens ``idx`` 1..n, special tokens outside):

1. the start token of a span is the token containing its first character;
   none (the span starts on a blank, or is empty) -> the span is dropped and
   reported as unmappable;
2. per start token the **last** annotation in list order wins;
3. in start order a span is accepted iff its start token is not before the
   first token after the previously accepted span;
4. an accepted span covers tokens from its start token while
   ``token.start < span.end``.  Its first token is ``B-``; later tokens are
   ignored (-100) when they are subwords, else ``I-`` (``B-`` again when the
   label has no I- tag).  Tokens outside spans are ``O`` (-100 when subword).

Steps 1 and 4 are point lookups "token at character c" in a table of tokens of any length, with gaps: a
binned interval join.  Every token enters each bin of ``BIN`` characters that it, or the gap
after it, touches; a span boundary looks up one bin and then tests the interval.  Steps 2-3 are one ordered fold
per overlap cluster of spans (a recurrence, not a join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..session import shuffle_partitions
from ..sources.corpus import DOC_KEY
from . import lexer
from .lexer import BIN, CHUNK, CHUNK_KEY

SPAN_COLS = [*DOC_KEY, "ann_pos", "start", "end", "label"]
_PLACES = ["start_chunk", "end_chunk"]


def locate(spans: DataFrame, tokens: DataFrame, extra_key: list[str] | None = None, *, totals: DataFrame | None = None,
           chunk: int = CHUNK, places: bool = False, near: bool = False) -> DataFrame:
    """Start and end token of every span (O21 ``char_to_token``).

    ``tokens``: pieces of the lexer, ``lexer.token_lists``, ``lexer.token_marks``, ``lexer.token_chunks``, or any table of ``origin, doc_id, start, end``
    (``lexer.index_tokens`` says what it may hold).  ``totals``: its ``lexer.chunk_totals``, if written before.

    Output: span columns + ``start_idx`` (null = unmappable), ``end_idx``
    (last token starting before ``end``), ``status`` in
    ``ok | no_token | empty``; with ``places`` also the chunks of both tokens.

    Bins lie inside chunks, and both sides meet on the chunk's key: a span boundary finds at most
    the tokens that touch ``BIN`` characters, whatever the document's length; with ``lexer.token_lists`` it meets one row and
    counts bits.  A token that began in an earlier chunk is found in the chunk's totals.

    ``near``: spans and tokens (``lexer.token_marks``) are placed by document; then no span moves.  A span inside one chunk is one row.
    """
    ek = extra_key or []
    cols = [*ek, *SPAN_COLS]
    if "is_tok" in tokens.columns:
        tokens = lexer.tokens_from_pieces(tokens)
    listed = "starts" in tokens.columns
    if not listed and not {"chunk", "lidx", "nxt"} <= set(tokens.columns):
        tokens = lexer.index_tokens(tokens, chunk)
    totals = lexer.chunk_totals(tokens) if totals is None else totals

    live = F.col("end") > F.col("start")
    if near and not listed:
        raise ValueError("near: tokens of lexer.token_marks")
    if near:
        return _near(spans, cols, live, tokens, totals, chunk, places)
    # Every span keeps at least one row (empty spans get a null one) and the joins are left joins, so the
    # per-span aggregate sees every span once: no self-join that would evaluate the span stream twice.
    targets = F.when(live, F.array(
        F.struct(F.lit(0).alias("kind"), F.col("start").alias("target")),
        F.struct(F.lit(1).alias("kind"), (F.col("end") - 1).alias("target")),
    )).otherwise(F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("int").alias("target"))))
    t = spans.select(*cols, F.explode(targets).alias("t")).select(*cols, "t.kind", "t.target")
    t = t.select("*", F.expr(f"target div {chunk}").cast("int").alias("chunk"), F.expr(f"target div {BIN}").alias("bin"))
    # The boundaries move to where the tokens are, else the tokens would move to where the documents are.
    t = t.repartition(shuffle_partitions(spans.sparkSession), *CHUNK_KEY)
    hit = _at_lists(t, tokens, chunk) if listed else _at_rows(t, tokens, chunk)
    hit = hit.select(*cols, "kind", "target", "chunk", "lidx", "inside").join(totals.hint("merge"), CHUNK_KEY, "left")

    first, first_chunk, last, last_chunk = _ends(F.col("target"), F.col("lidx"), F.col("inside"))

    def of(kind, value):
        return F.max(F.when(F.col("kind") == kind, value))
    # the last chunk of a text that a span's end lies beyond has no totals: its last token counts
    g = hit.groupBy(*cols).agg(
        of(0, first).alias("_s"), of(0, first_chunk).alias("_s_chunk"), of(1, last).alias("_e"),
        of(1, F.when(last.isNotNull(), last_chunk)).alias("_e_chunk"), F.max("n_tok").alias("n_tok"))
    return _located(g, cols, live, chunk, places)


def _ends(target: Column, lidx: Column, inside: Column) -> tuple[Column, Column, Column, Column]:
    """The token that a span starts or ends in at ``target``, and their chunks, of rows with their chunk's totals."""
    found = lidx.isNotNull()
    after = F.coalesce(target >= F.col("last_start"), F.lit(False))  # past the chunk's last token
    first = F.when(found & inside, F.col("base") + lidx).when(~found & (target < F.col("before_end")), F.col("base"))
    first_chunk = F.when(found, F.col("chunk")).otherwise(F.col("before_chunk"))
    last = F.when(found, F.col("base") + lidx).when(after, F.col("base") + F.col("n")).otherwise(F.col("base"))
    last_chunk = F.when(found | after, F.col("chunk")).otherwise(F.col("before_chunk"))
    return first, first_chunk, last, last_chunk


def _near(spans: DataFrame, cols: list[str], live: Column, marks: DataFrame, totals: DataFrame, chunk: int, places: bool) -> DataFrame:
    """``locate`` where the spans lie: kind 2 has both ends in its chunk, 0 and 1 one of them, -1 none (empty)."""
    at = [F.expr(f"{c} div {chunk}").cast("int") for c in ("`start`", "(`end` - 1)")]

    def row(kind, c):
        return F.struct(F.lit(kind).alias("kind"), c.alias("chunk"))
    rows = F.when(~F.coalesce(live, F.lit(False)), F.array(row(-1, F.lit(None).cast("int")))).when(
        at[0] == at[1], F.array(row(2, at[0]))).otherwise(F.array(row(0, at[0]), row(1, at[1])))
    t = spans.select(*cols, F.explode(rows).alias("t")).select(*cols, "t.kind", "t.chunk")
    held = marks.select(*CHUNK_KEY, F.col("n").alias("here"), *_bits_of(marks))
    x = t.join(held.hint("merge"), CHUNK_KEY, "left")
    ends = {"s": "`start`", "e": "(`end` - 1)"}
    x = x.select(*t.columns, *[c.alias(f"{k}_{name}") for k, e in ends.items() for name, c in zip(("lidx", "inside"), _counted_bits(
        e, F.col("here"), chunk, "many" in held.columns))])
    x = x.join(totals.hint("merge"), CHUNK_KEY, "left")
    first, first_chunk, _, _ = _ends(F.col("start"), F.col("s_lidx"), F.col("s_inside"))
    _, _, last, last_chunk = _ends(F.col("end") - 1, F.col("e_lidx"), F.col("e_inside"))
    opens, ends_here = F.col("kind").isin(0, 2), F.col("kind").isin(1, 2)
    g = x.groupBy(*cols).agg(
        F.max(F.when(opens, first)).alias("_s"), F.max(F.when(opens, first_chunk)).alias("_s_chunk"), F.max(F.when(ends_here, last)).alias("_e"),
        F.max(F.when(ends_here & last.isNotNull(), last_chunk)).alias("_e_chunk"), F.max("n_tok").alias("n_tok"))
    return _located(g, cols, live, chunk, places)


def _located(g: DataFrame, cols: list[str], live: Column, chunk: int, places: bool) -> DataFrame:
    """``locate``'s columns of spans with the tokens found at both ends."""
    start_idx = F.when(live, F.col("_s"))
    status = F.when(~live, F.lit("empty")).when(start_idx.isNull(), F.lit("no_token")).otherwise(F.lit("ok"))
    out = g.select(
        *cols, start_idx.cast("int").alias("start_idx"),
        F.when(start_idx.isNotNull(), F.coalesce(F.col("_e"), "n_tok")).cast("int").alias("end_idx"),
        status.alias("status"),
        F.when(start_idx.isNotNull(), F.col("_s_chunk")).alias("start_chunk"),
        # beyond the text: up to where the span ends, as far as the document has chunks
        F.when(start_idx.isNotNull(), F.coalesce(F.col("_e_chunk"), F.expr(f"(end - 1) div {chunk}").cast("int"))).alias("end_chunk"))
    return out if places else out.drop(*_PLACES)


def _at_rows(t: DataFrame, tokens: DataFrame, chunk: int) -> DataFrame:
    """``t`` with ``lidx`` of the chunk's token that ``target`` lies in or in the gap after (else null), and whether ``inside`` it."""
    border = (F.col("chunk") + 1) * F.lit(chunk)
    until = F.coalesce("nxt", F.least(F.col("end"), border))
    held = tokens.select(*CHUNK_KEY, "lidx", F.col("start").alias("tstart"), F.col("end").alias("tend"), until.alias("until"))
    bins = F.sequence(F.expr(f"tstart div {BIN}"), F.expr(f"(until - 1) div {BIN}"))
    held = held.select("*", F.explode(bins).alias("bin"))
    # Size estimates ignore how many rows an explode makes: without the hint Spark
    # may take the whole token stream for small enough to broadcast.
    inside = (F.col("t.target") >= F.col("h.tstart")) & (F.col("t.target") < F.col("h.until"))
    same = [F.col(f"t.{c}") == F.col(f"h.{c}") for c in (*CHUNK_KEY, "bin")]
    return t.alias("t").join(held.hint("merge").alias("h"), [*same, inside], "left").select(
        "t.*", "lidx", (F.col("t.target") < F.col("tend")).alias("inside"))


def _at_lists(t: DataFrame, lists: DataFrame, chunk: int) -> DataFrame:
    """``_at_rows`` in ``lexer.token_lists``: a target meets its chunk's one row, and counts the starts up to it in its bin."""
    held = lists.select(*CHUNK_KEY, "n", *_bits_of(lists))
    lidx, inside = _counted_bits("target", F.col("n"), chunk, "many" in held.columns)
    return t.join(held.hint("merge"), CHUNK_KEY, "left").select(*t.columns, lidx.alias("lidx"), inside.alias("inside"))


def _bits_of(lists: DataFrame) -> list[str]:
    return [c for c in ("upto", "starts", "covered", "many") if c in lists.columns]


def _counted_bits(target: str, n: Column, chunk: int, many: bool) -> tuple[Column, Column]:
    """``lidx`` and ``inside`` of ``target`` (SQL) in a row with ``upto, starts, covered``, ``n`` tokens and, if tokens may begin at the same
    character, ``many``.  A target past the chunk's last token is in no token of it."""
    at, off = f"CAST({target} % {chunk} div {BIN} AS INT)", f"CAST({target} % {BIN} AS INT)"
    k = F.expr(f"get(upto, {at}) + bit_count(get(starts, {at}) & shiftrightunsigned(-1L, {BIN - 1} - {off}))")
    lidx = F.coalesce(F.get("many", k - 1), k) if many else k
    inside = F.expr(f"shiftrightunsigned(get(covered, {at}), {off}) & 1L = 1L")
    return F.when((k > 0) & ((lidx < n) | inside), lidx), inside


def unmappable(located: DataFrame) -> DataFrame:
    """Spans that no token can carry (start on a blank, or empty span)."""
    return located.where(F.col("status") != "ok")


def last_span_wins(located: DataFrame) -> DataFrame:
    """Per start token keep the annotation that comes last in the list."""
    w = Window.partitionBy(*DOC_KEY, "start_idx").orderBy(F.col("ann_pos").desc())
    return (located.where(F.col("status") == "ok")
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def resolve_overlaps(located: DataFrame, extra_key: list[str] | None = None) -> DataFrame:
    """O55 + O56: greedy left-to-right acceptance of mappable spans.

    Spans are ordered by (start token, list position descending); taking the
    first span of each start token is exactly "last annotation wins", and
    every later span on that start token is then inside it and skipped.

    The greedy rule is a recurrence, so it needs a fold -- but only inside
    an *overlap cluster*: a span starting after every earlier span ended
    (running max of ``end_idx``) is always accepted and opens a new
    cluster.  Clusters are one window away and almost always a single span,
    so the fold stays linear in the number of spans, whatever the document
    length.
    """
    ek = extra_key or []
    places = [c for c in _PLACES if c in located.columns]
    ok = located.where(F.col("status") == "ok").select(
        *DOC_KEY, *ek, F.col("start_idx").cast("int").alias("start_idx"),
        (-F.col("ann_pos")).cast("int").alias("neg_pos"), F.col("end_idx").cast("int").alias("end_idx"),
        F.col("ann_pos").cast("int").alias("ann_pos"), "label", *places)
    w = Window.partitionBy(*DOC_KEY, *ek).orderBy("start_idx", "neg_pos")
    prev_end = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (prev_end.isNull() | (F.col("start_idx") > prev_end)).cast("int")
    ok = ok.withColumn("_open", opens)
    ok = ok.withColumn("cluster", F.sum("_open").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_cluster = ok.groupBy(*DOC_KEY, *ek, "cluster").agg(F.array_sort(F.collect_list(F.struct(
        "start_idx", "neg_pos", "end_idx", "ann_pos", "label", *places))).alias("cands"))
    none = F.array().cast(per_cluster.schema["cands"].dataType)
    init = F.struct(F.lit(0).alias("nf"), none.alias("acc"))
    accepted = F.when(F.size("cands") == 1, F.col("cands")).otherwise(F.aggregate(
        "cands", init,
        lambda st, x: F.when(
            x["start_idx"] >= st["nf"],
            F.struct((x["end_idx"] + 1).alias("nf"), F.concat(st["acc"], F.array(x)).alias("acc")),
        ).otherwise(st),
        lambda st: st["acc"],
    ))
    return (per_cluster.select(*DOC_KEY, *ek, F.explode(accepted).alias("a"))
            .select(*DOC_KEY, *ek, "a.ann_pos", "a.start_idx", "a.end_idx", "a.label", *[f"a.{c}" for c in places]))


def cover(accepted: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The tokens each accepted span covers (``idx, span_label, is_first``)."""
    extra = extra or []
    return (accepted.select(*DOC_KEY, "ann_pos", "start_idx", "label", *extra,
                            F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
            .select(*DOC_KEY, "idx", "ann_pos", F.col("label").alias("span_label"),
                    (F.col("idx") == F.col("start_idx")).alias("is_first"), *extra))


def cover_chunks(accepted: DataFrame, totals: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``cover`` by the tokens' places in their chunks (``chunk, lidx`` for ``idx``).

    ``accepted``: resolved spans with the chunks of their tokens (``locate(places=True)``).
    """
    extra = extra or []
    x = accepted.select(*DOC_KEY, "ann_pos", "start_idx", "end_idx", "label", *extra,
                        F.explode(F.sequence("start_chunk", F.greatest("start_chunk", "end_chunk"))).alias("chunk"))
    x = x.join(totals.select(*CHUNK_KEY, "base", "n").hint("merge"), CHUNK_KEY)
    lo = F.greatest(F.col("start_idx") - F.col("base"), F.lit(1))
    hi = F.least(F.col("end_idx") - F.col("base"), F.col("n"))
    return (x.select("*", F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("lidx"))
            .select(*CHUNK_KEY, "lidx", "ann_pos", F.col("label").alias("span_label"),
                    (F.col("base") + F.col("lidx") == F.col("start_idx")).alias("is_first"), *extra))


def cover_lists(accepted: DataFrame, totals: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``cover_chunks`` as one row a chunk: ``covers``, a list of ``lo, hi`` (places in the chunk), ``first`` (its first token
    opens the span), ``ann_pos`` and ``extra``."""
    extra = extra or []
    x = accepted.select(*DOC_KEY, "ann_pos", "start_idx", "end_idx", *extra,
                        F.explode(F.sequence("start_chunk", F.greatest("start_chunk", "end_chunk"))).alias("chunk"))
    x = x.join(totals.select(*CHUNK_KEY, "base", "n").hint("merge"), CHUNK_KEY)
    lo = F.greatest(F.col("start_idx") - F.col("base"), F.lit(1)).alias("lo")
    hi = F.least(F.col("end_idx") - F.col("base"), F.col("n")).alias("hi")
    x = x.select("*", lo, hi).where("lo <= hi").withColumn("first", F.col("base") + F.col("lo") == F.col("start_idx"))
    return x.groupBy(*CHUNK_KEY).agg(F.collect_list(F.struct("lo", "hi", "first", "ann_pos", *extra)).alias("covers"))


def spread(lists: DataFrame) -> DataFrame:
    """Rows of ``lexer.token_lists`` with ``base``, ``n_tok`` and ``covers`` (``cover_lists`` with ``gold``, ``code``) -> token rows:
    ``doc_id, chunk, origin, lidx, idx, tok, start, end, is_subword, n_tok, scored``, of the gold span ``g_code, g_first, ann_pos``, of
    the other ``l_code, l_first`` (null: none).

    ``scored`` counts the chunk's tokens that begin a word or a gold span.  Spans of a kind don't overlap; all is laid
    on the lists, so no token is sorted or joined.
    """
    from pyspark.sql import types as T

    keys, lists_of = list(CHUNK_KEY), ["tok", "start", "end", "is_subword"]
    number, flag = T.IntegerType(), T.BooleanType()
    kinds = {"lidx": number, "idx": number, "tok": T.StringType(), "start": number, "end": number, "is_subword": flag, "n_tok": number,
             "scored": number, "g_code": number, "g_first": flag, "ann_pos": number, "l_code": number, "l_first": flag}
    schema = T.StructType([*[lists.schema[k] for k in keys], *[T.StructField(c, t) for c, t in kinds.items()]])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            n = b.column("n").to_numpy().astype(np.int64)
            row, opens = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            lidx = np.arange(len(row)) - opens[row] + 1
            tok, start, end, sub = (b.column(c).flatten() for c in lists_of)

            counts = pc.fill_null(b.column("covers").value_lengths(), 0).to_numpy()
            spans = b.column("covers").flatten()
            value = {f: c.to_numpy(zero_copy_only=False) for f, c in zip(spans.type.names, spans.flatten())}
            lo = opens[np.repeat(np.arange(len(n)), counts)] + value["lo"] - 1
            size = (value["hi"] - value["lo"] + 1).astype(np.int64)

            def laid(kind):
                """Which span of a kind lies on each token (-1: none)."""
                out, mine = np.full(len(row), -1), np.flatnonzero(value["gold"].astype(bool) == kind)
                m = size[mine]
                out[np.repeat(lo[mine] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = np.repeat(mine, m)
                return out

            def of(name, at, kind):
                if not len(value[name]):
                    return pa.nulls(len(at), kind)
                return pa.array(value[name][at], kind, mask=at < 0)
            gold, loose = laid(True), laid(False)

            def begins(at):
                first = np.zeros(len(at), bool)
                if len(lo):
                    first = (at >= 0) & (lo[at] == np.arange(len(at))) & value["first"].astype(bool)[at]
                return first
            g_first = begins(gold)
            counted = np.cumsum(~sub.to_numpy(zero_copy_only=False).astype(bool) | g_first)
            scored = counted - np.concatenate([[0], counted])[opens][row]
            i32, bits = pa.int32(), pa.bool_()
            base, n_tok = (b.column(c).to_numpy()[row] for c in ("base", "n_tok"))
            keyed = pa.array(row)
            yield pa.record_batch([
                *[b.column(k).take(keyed) for k in keys], pa.array(lidx, i32), pa.array(base + lidx, i32), tok, start, end, sub,
                pa.array(n_tok, i32), pa.array(scored, i32), of("code", gold, i32), pa.array(g_first, bits, mask=gold < 0),
                of("ann_pos", gold, i32), of("code", loose, i32), pa.array(begins(loose), bits, mask=loose < 0)], names=schema.names)

    return lists.select(*keys, "n", *lists_of, "base", "n_tok", "covers").mapInArrow(run, schema)


def counted(marks: DataFrame) -> DataFrame:
    """Rows of ``lexer.token_marks`` with ``base`` and ``covers`` (``cover_lists`` with ``code``) -> how many tokens there are of each
    ``origin, code, is_first, is_subword`` (``code``, ``is_first`` null: outside spans): ``n``, and ``docs`` (those that open a text).

    What ``spread`` lays on token rows is laid on the bits and counted, some chunks at a time.
    """
    from pyspark.sql import types as T

    number, flag = T.LongType(), T.BooleanType()
    schema = T.StructType([marks.schema["origin"], *[T.StructField(c, t) for c, t in (
        ("code", T.IntegerType()), ("is_first", flag), ("is_subword", flag), ("n", number), ("docs", number))]])
    names_of = schema.names

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            n, names = b.column("n").to_numpy().astype(np.int64), b.column("origin").dictionary_encode()
            opens, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            words = -(-n // 64)
            packed = np.unpackbits(b.column("glued").flatten().to_numpy().view(np.uint8), bitorder="little")
            sub = packed[((np.cumsum(words) - words) * 64 - opens)[row] + np.arange(len(row))]

            counts = pc.fill_null(b.column("covers").value_lengths(), 0).to_numpy()
            spans = dict(zip(("lo", "hi", "first", "ann_pos", "code"), b.column("covers").flatten().flatten()))
            code, begins = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            if counts.sum():
                lo, hi = (spans[c].to_numpy() for c in ("lo", "hi"))
                size = (hi - lo + 1).astype(np.int64)
                lo = opens[np.repeat(np.arange(len(n)), counts)] + lo - 1
                laid = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                code[laid] = np.repeat(pc.fill_null(spans["code"], 0).to_numpy(), size)
                begins[lo] = spans["first"].to_numpy(zero_copy_only=False)
            heads = np.zeros(len(row), np.int64)
            heads[opens[b.column("base").to_numpy() == 0]] = 1

            most = int(code.max(initial=0)) + 1
            kinds = ((names.indices.to_numpy()[row] * most + code) * 2 + begins) * 2 + sub
            total, docs = np.bincount(kinds), np.bincount(kinds, weights=heads).astype(np.int64)
            seen = np.flatnonzero(total)
            outside = seen // 4 % most == 0
            yield pa.record_batch([
                names.dictionary.take(pa.array(seen // 4 // most)), pa.array((seen // 4 % most).astype(np.int32), mask=outside),
                pa.array(seen // 2 % 2 == 1, mask=outside), pa.array(seen % 2 == 1), pa.array(total[seen]), pa.array(docs[seen])],
                names=names_of)

    got = marks.select("origin", "n", "glued", "base", "covers").mapInArrow(run, schema)
    return got.groupBy("origin", "code", "is_first", "is_subword").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def laid(lists: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Rows of ``lexer.tokenize_lists`` or ``lexer.token_lists`` with ``base`` and ``covers`` (``cover_lists`` with ``label``) -> token rows:
    ``origin, doc_id, idx, tok, start, end, is_subword``, of the span on them ``span_label, is_first, ann_pos`` (null: outside).

    ``tags``: names of structs in ``covers`` with the ``span_tags`` ``first, cont``; then the rows are ``origin, doc_id, idx, tok`` and
    of each name the token's tag (``token_tag``).  As in ``spread``, spans don't overlap and no token is sorted or joined.
    """
    from pyspark.sql import types as T

    number, flag, text = T.IntegerType(), T.BooleanType(), T.StringType()
    kinds = {"idx": number, "tok": text, "start": number, "end": number, "is_subword": flag, "span_label": text, "is_first": flag,
             "ann_pos": number} if tags is None else {"idx": number, "tok": text, **dict.fromkeys(tags, text)}
    schema = T.StructType([*[lists.schema[k] for k in DOC_KEY], *[T.StructField(c, t) for c, t in kinds.items()]])
    keys, names_of, lists_of = list(DOC_KEY), schema.names, ["tok", "is_subword", *(["start", "end"] if tags is None else [])]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            n = b.column("n").to_numpy().astype(np.int64)
            opens = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            idx = np.arange(len(row)) + (b.column("base").to_numpy() - opens + 1)[row]
            counts = pc.fill_null(b.column("covers").value_lengths(), 0).to_numpy()
            spans = b.column("covers").flatten()
            spans = dict(zip(spans.type.names, spans.flatten()))
            on, begins = np.full(len(row), -1), np.zeros(len(row), bool)
            if counts.sum():
                lo, hi = (spans[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
                size = hi - lo + 1
                lo = opens[np.repeat(np.arange(len(n)), counts)] + lo - 1
                on[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(np.arange(len(size)), size)
                begins[lo] = spans["first"].to_numpy(zero_copy_only=False)
            outside, keyed = on < 0, pa.array(row)
            held = {c: b.column(c).flatten() for c in lists_of}
            out = [*[b.column(k).take(keyed) for k in keys], pa.array(idx.astype(np.int32)), held["tok"]]
            if tags is None:
                at = pa.array(on, mask=outside)
                out += [held["start"], held["end"], held["is_subword"], spans["label"].take(at), pa.array(begins, mask=outside), spans["ann_pos"].take(at)]
            else:
                m, sub = counts.sum(), held["is_subword"].to_numpy(zero_copy_only=False).astype(bool)
                at = pa.array(np.where(outside, 2 * m, on + m * ~begins), mask=sub & ~begins)
                out += [pa.concat_arrays([*spans[t].flatten(), pa.array(["O"])]).take(at) for t in tags]
            yield pa.record_batch(out, names=names_of)

    return lists.select(*keys, "n", *lists_of, "base", "covers").mapInArrow(run, schema)


def align_tokens(spans: DataFrame, tokens: DataFrame, chunk: int = CHUNK, tags: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """``align`` for any tokenizer's tokens (``origin, doc_id, start, end`` and more columns): all their
    columns, ``idx`` (1..n over those with characters), ``span_label``, ``is_first`` and ``ann_pos``.

    ``tokens`` may be ``lexer.tokenize_lists``: then tokens become rows at the end only, and where spans are placed by document they stay there.
    ``tags`` (with these): ``span_tags`` of an accepted span's ``origin, label``, by name; then the rows are ``origin, doc_id, idx, tok`` and
    of each name the token's tag."""
    if "starts" in tokens.columns:
        totals = lexer.chunk_totals(tokens)
        accepted = resolve_overlaps(locate(spans, tokens, totals=totals, chunk=chunk, places=True, near=True))
        accepted = accepted.withColumns({t: F.struct(first.alias("first"), cont.alias("cont")) for t, (first, cont) in (tags or {}).items()})
        cov = cover_lists(accepted, totals, ["label"] if tags is None else [*tags]).hint("merge")
        numbered = tokens.join(totals.select(*CHUNK_KEY, "base").hint("merge"), CHUNK_KEY)
        return laid(numbered.join(cov, CHUNK_KEY, "left"), None if tags is None else [*tags])
    if tags:
        raise ValueError("tags: tokens of lexer.tokenize_lists")
    t = lexer.index_tokens(tokens.drop("idx"), chunk)
    totals = lexer.chunk_totals(t)
    accepted = resolve_overlaps(locate(spans, t, totals=totals, chunk=chunk, places=True))
    cov = cover_chunks(accepted, totals)
    out = lexer.numbered(t, totals).join(cov.hint("merge"), [*CHUNK_KEY, "lidx"], "left")
    return out.drop("chunk", "lidx", "nxt", "n_tok")


def align(tokens: DataFrame, located: DataFrame) -> DataFrame:
    """Token table with the covering span: ``span_label`` (null = outside),
    ``is_first``, ``ann_pos``.  Taxonomy-independent geometry."""
    cov = cover(resolve_overlaps(located))
    return tokens.join(cov.hint("merge"), [*DOC_KEY, "idx"], "left")


def tag(aligned: DataFrame, taxonomy: str, label: Column | None = None, *, iob: bool = True,
        ignore_subwords: bool = True) -> Column:
    """Tag text of each token (``None`` = ignored, -100).

    ``label`` is the span label already expressed in ``taxonomy``.
    """
    label = F.col("span_label") if label is None else label
    first, cont = span_tags(taxonomy, label) if iob else (label, label)
    return token_tag(first, cont, ignore_subwords=ignore_subwords)


def span_tags(taxonomy, label: Column) -> tuple[Column, Column]:
    """Tag texts of the first and of the further tokens of a span with ``label``, which is expressed in ``taxonomy``."""
    begin = F.concat(F.lit("B-"), label)
    return begin, F.when(tx.has_i_t(label, taxonomy), F.concat(F.lit("I-"), label)).otherwise(begin)


def token_tag(first: Column, cont: Column, *, ignore_subwords: bool = True) -> Column:
    """Tag text of a token whose span has these ``span_tags``."""
    sub = F.col("is_subword") if ignore_subwords else F.lit(False)
    null = F.lit(None).cast("string")
    return (F.when(F.col("span_label").isNull(), F.when(sub, null).otherwise(F.lit("O")))
            .when(F.col("is_first"), first)
            .when(sub, null)
            .otherwise(cont))


def label_in(taxonomy, origin: Column = None, span_label: Column = None) -> Column:
    """Span label of a document of either origin expressed in ``taxonomy``
    (a taxonomy name or a column holding one)."""
    origin = F.col("origin") if origin is None else origin
    span_label = F.col("span_label") if span_label is None else span_label
    return tx.relabel_t(span_label, origin, taxonomy)


def gather(tokens: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """Rows of a chunked token table (``origin, doc_id, chunk, lidx``) -> one row a document with ``lists`` in token order.

    Rows are gathered chunk by chunk, where a table bucketed on the chunk's key holds them; only the chunks' lists
    move to their documents, plain values without a key or a struct a token, texts as one text a
    chunk.  Texts hold no blank (``" "``), as the lexer's tokens.
    """
    x = tokens.select(*CHUNK_KEY, "lidx", *[c.alias(n) for n, c in lists.items()])
    texts = {n for n in lists if x.schema[n].dataType.simpleString() == "string"}
    x = x.groupBy(*CHUNK_KEY).agg(F.sort_array(F.collect_list(F.struct("lidx", *lists))).alias("l"))
    x = x.select(*CHUNK_KEY, *[(F.array_join(F.col("l")[n], " ") if n in texts else F.col("l")[n]).alias(n) for n in lists])
    x = x.groupBy(*DOC_KEY).agg(F.sort_array(F.collect_list(F.struct("chunk", *lists))).alias("l"))
    return x.select(*DOC_KEY, *[(F.split(F.array_join(F.col("l")[n], " "), " ") if n in texts else F.flatten(F.col("l")[n])).alias(n) for n in lists])


def nest_labels(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Token rows -> one row per ``key``: ``offset_mapping`` and the ``*_id`` columns as
    ``*_labels`` lists with an ignored position at either end (special tokens).  Rows of a chunked
    token table (``chunk, lidx`` for ``idx``) are gathered where they lie; rows of a ``key`` with lists in these columns stay as they are."""
    ids = [c for c in tokens.columns if c.endswith("_id") and c != "doc_id"]
    cols = ["start", "end", *ids]
    if tokens.schema["start"].dataType.typeName() == "array":
        l = tokens
    elif {"chunk", "lidx"} <= set(tokens.columns) and sorted(key) == sorted(DOC_KEY):
        l = gather(tokens, {c: F.col(c) for c in cols})
    else:
        l = tokens.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("idx", *cols))).alias("_l"))
        l = l.select(*key, *[F.col("_l")[c].alias(c) for c in cols])
    pad = F.array(F.lit(tx.IGNORE_ID))

    def labels(c: str) -> Column:
        return F.concat(pad, F.col(c).cast("array<int>"), pad).alias(c[:-3] + "_labels")
    return l.select(*key, F.arrays_zip("start", "end").alias("offset_mapping"), *[labels(c) for c in ids])

"""Model predictions: native rule predictors, the Arrow scorer slot, and
prediction encoding (O18, O27, O50, O63, O64).

Two predictors are native column expressions, so they have SQL oracles:

* ``rule_loose``: e-mail and IP shapes, any loose phone shape, and every
  capitalised word as a given name; tagged B-/I- over all tokens the span
  covers (a model tags every token, subwords included).  Taxonomy B has no
  IP label: IP-shaped tokens are predicted ``O`` there.
* ``noisy``: the gold tag of each token, perturbed by a hash of
  ``(origin, doc_id, idx)``; every token is predicted, and the list of
  some documents ends with one entity too many.

The Python scorer (O63) is the slot for a real model: ``mapInArrow`` over
documents, one scorer per task, Arrow batches of
``SCORER_BATCH`` texts.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions.text import strip
from ..sources.corpus import DOC_KEY, EMAIL_RX, IP_RX, LOOSE_PHONE_RX, CAPITALISED_RX, place_documents

MODELS = ("rule_loose", "noisy")
# ``noisy`` lists of documents with this remainder carry one surplus entity at their end.
SURPLUS_MOD, SURPLUS_AT = 20, 3

# rule_loose rules in list order -> label per taxonomy.
LOOSE_RULES = [("EMAIL", EMAIL_RX), ("IP", IP_RX), ("PHONE", LOOSE_PHONE_RX),
               ("CAPWORD", CAPITALISED_RX)]
LOOSE_LABELS = {
    "A": {"EMAIL": "EMAIL", "IP": "IP", "PHONE": "TEL", "CAPWORD": "GIVENNAME1"},
    "B": {"EMAIL": "EMAIL", "PHONE": "TELEPHONENUM", "CAPWORD": "GIVENNAME"},
}


def loose_spans(docs: DataFrame) -> DataFrame:
    """Predicted spans of ``rule_loose``: ``origin, doc_id, ann_pos, start, end, label``
    with ``label`` the rule name."""
    from pyspark.sql import Window

    from ..sources.corpus import _zip, explode_matches
    x = explode_matches(docs, [(i + 1, _zip(F.col("source_text"), rx))
                               for i, (_, rx) in enumerate(LOOSE_RULES)])
    names = F.element_at(F.array(*[F.lit(n) for n, _ in LOOSE_RULES]), F.col("rule"))
    w2 = Window.partitionBy(*DOC_KEY).orderBy("rule", "pos")
    return x.select(
        *DOC_KEY,
        (F.row_number().over(w2) - 1).cast("int").alias("ann_pos"),
        F.col("mstart").cast("int").alias("start"),
        F.col("mend").cast("int").alias("end"),
        names.alias("label"),
    )


def drop_entities(entity: Column, taxonomy: str, replace: bool = True) -> Column:
    """Model-side ignore list applied to the bare label of a tag.

    Matching rows are replaced by ``O`` (not deleted), so positions stay aligned.
    """
    bare = F.regexp_replace(entity, r"^[BI]-", "")
    hit = bare.isin(*tx.MODEL_IGNORE[taxonomy])
    return F.when(hit, F.lit("O") if replace else F.lit(None).cast("string")).otherwise(entity)


def encode_predictions(mask: Column, taxonomy: str) -> Column:
    """``predicted_mask`` -> ``[-100] + ids + [-100]``."""
    ids = F.transform(mask, lambda e: tx.tag_id(e["entity"], taxonomy))
    pad = F.array(F.lit(tx.IGNORE_ID))
    return F.concat(pad, ids, pad)


def logits_argmax(logits: Column) -> Column:
    """Index of the first maximum of a score vector (0-based)."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


# ---------------------------------------------------------------------------
# The scorer slot (mapInArrow).  The built-in scorer reproduces
# rule_loose in Python so the Arrow path can be checked against the native one.
# ---------------------------------------------------------------------------

SCORER_SCHEMA = ("origin string, doc_id bigint, model_id string, "
                 "predicted_mask array<struct<entity:string,word:string,score:double>>, "
                 "elapsed_ns bigint")


def _scorer_spec(taxonomy: str) -> dict:
    """Plain values the worker-side scorer needs (no reference to this package,
    so executors only need ``regex`` and ``pandas``)."""
    from .lexer import LEX_RX
    return {"lex": LEX_RX, "rules": list(LOOSE_RULES), "labels": dict(LOOSE_LABELS[taxonomy]),
            "no_i": sorted(tx.NO_I_TAG[taxonomy])}


SCORER_BATCH = 32  # texts that the model gets at once


def rule_scorer(taxonomy: str):
    """Scorer factory of ``rule_loose`` written in Python."""
    spec = _scorer_spec(taxonomy)

    def make_scorer():
        import bisect
        import itertools

        import regex
        lex = regex.compile(spec["lex"])
        rules = [(name, regex.compile(rx)) for name, rx in spec["rules"]]
        labels, no_i = spec["labels"], set(spec["no_i"])

        def score(text):
            text = text or ""
            pieces = lex.findall(text)                  # lossless: a piece ends where the lengths so far say
            toks = [(e - len(p), e, p) for p, e in zip(pieces, itertools.accumulate(map(len, pieces))) if p[0] not in " \t\n\r"]
            starts = [a for a, _, _ in toks]
            located = {}
            for name, rx in rules:                      # list order = rule, then start
                if name == "EMAIL" and "@" not in text:
                    continue
                for m in rx.finditer(text):
                    s, e = m.start(), m.end()
                    k = bisect.bisect_right(starts, s) - 1
                    if k < 0 or not (toks[k][0] <= s < toks[k][1]):
                        continue
                    located[k] = (bisect.bisect_left(starts, e) - 1, name)   # last one wins
            out = ["O"] * len(toks)
            nf = 0
            for k in sorted(located):
                if k < nf:
                    continue
                last, name = located[k]
                label = labels.get(name)
                for j in range(k, last + 1):
                    if label is None:
                        out[j] = "O"
                    elif j == k or label in no_i:
                        out[j] = "B-" + label
                    else:
                        out[j] = "I-" + label
                nf = last + 1
            return [{"entity": t, "word": w, "score": 1.0} for t, (_, _, w) in zip(out, toks)]
        return lambda texts: [score(t) for t in texts]
    return make_scorer


def score_batches(docs: DataFrame, make_scorer, model_id: str, clock=time.perf_counter_ns) -> DataFrame:
    """Run a Python scorer over ``source_text`` in Arrow batches.

    ``make_scorer()`` is called once per task and loads the model there; the scorer it
    returns gets up to ``SCORER_BATCH`` texts (a null text as None) and returns one list of
    ``{"entity", "word", "score"}`` per text, one entity per token.  Each row carries
    its share of its batch's latency by ``clock`` (nanoseconds); the shares of a batch add up exactly.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size, arrow = SCORER_BATCH, to_arrow_schema(StructType.fromDDL(SCORER_SCHEMA))

    def run(batches):
        import pyarrow as pa
        score = make_scorer()
        for b in (b.slice(i, size) for b in batches for i in range(0, b.num_rows, size)):
            texts = b.column("source_text").to_pylist()
            t0 = clock()
            masks = score(texts)
            ns = clock() - t0
            if len(masks) != len(texts):
                raise ValueError(f"scorer {model_id}: {len(masks)} results for {len(texts)} texts")
            shares = [ns // len(texts) + (i < ns % len(texts)) for i in range(len(texts))]
            # entities become a column at once, not one by one
            columns = [b.column("origin"), b.column("doc_id"), [model_id] * len(texts), list(masks), shares]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types)], names=arrow.names)

    return docs.select(*DOC_KEY, "source_text").mapInArrow(run, SCORER_SCHEMA)


def score_corpus(docs: DataFrame, make_scorer, model_id: str, path: str, clock=time.perf_counter_ns) -> tuple[DataFrame, DataFrame]:
    """O63 + O51 in one pass: the scored rows, written to ``path`` and read back, and the latency
    ``model_id, n_samples, total_sec, mean_ms_per_sample`` that was observed while they were written."""
    spark = docs.sparkSession
    seen = Observation()
    scored = score_batches(docs, make_scorer, model_id, clock)
    scored.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("elapsed_ns").alias("ns")).write.parquet(path)
    n, ns = seen.get["n"], seen.get["ns"] or 0
    latency = spark.createDataFrame([(model_id, n, ns / 1e9, ns / 1e6 / n if n else None)],
                                    "model_id string, n_samples bigint, total_sec double, mean_ms_per_sample double")
    return spark.read.schema(scored.schema).parquet(path), latency


def predicted_lists(lists: DataFrame, sides: list[tuple[str, str, list | None]]) -> DataFrame:
    """Native models' lists of ``aligned.aligned_lists`` with a column ``k_model`` each (the list's length), one row a document and side:
    ``taxonomy, origin, doc_id, n_tok, model_id, predicted_mask`` (entity, word, score).

    ``sides``: taxonomy, model, and by a token's state the tag (null: no entity; then the list is filled up to its length with ``O``).
    Without tags (None for all sides) an entity is the state itself, which tells the tags of both taxonomies, none is added or left out, and the rows
    have ``tok`` and ``state`` of all tokens, so that nothing must be joined to them.  Chunks move to their documents; lists are made
    of them on arrays.
    """
    from pyspark.sql import types as T

    attached = sides[0][2] is None
    entity = T.ShortType() if attached else T.StringType()
    mask = T.ArrayType(T.StructType([T.StructField("entity", entity), T.StructField("word", T.StringType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([
        T.StructField("taxonomy", T.StringType()), lists.schema["origin"], lists.schema["doc_id"], T.StructField("n_tok", T.IntegerType()),
        T.StructField("model_id", T.StringType()), *([T.StructField("tok", T.ArrayType(T.StringType())), lists.schema["state"]] if attached else []),
        T.StructField("predicted_mask", mask)])
    names_of = schema.names

    def coded(tags):
        """Tags by state as numbers in a short list of names (the last: none)."""
        names = sorted({x for x in tags if x is not None})
        at = {x: i for i, x in enumerate(names)}
        return names, bytes(at.get(x, len(names)) for x in tags)
    told = [(t, m, by if attached else coded(by)) for t, m, by in sides]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def few():
            """Chunks of some whole documents at a time."""
            held = None
            for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
                if held is not None:
                    b = pa.concat_batches([held, b])
                ids, names = b.column("doc_id").to_numpy(), np.array(b.column("origin").to_pylist(), object)
                heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])))
                held = b.slice(heads[-1])
                if heads[-1]:
                    yield b.slice(0, heads[-1]), heads[:-1]
            if held is not None and held.num_rows:
                yield held, np.zeros(1, np.int64)

        def slots(counts):
            return pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))

        for b, heads in few():
            n = np.add.reduceat(b.column("n").to_numpy().astype(np.int64), heads)
            row = np.repeat(np.arange(len(heads)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            flat = b.column("state").flatten()
            state = flat.to_numpy()
            data = np.frombuffer(" ".join(b.column("words").to_pylist()).encode() + b" ", np.uint8)
            stops = np.flatnonzero(data == 32)
            opens = np.append(0, stops[:-1] + 1)
            ends = np.append(0, np.cumsum(stops - opens)).astype(np.int32)
            # a word more than the tokens: that of entities too many
            tok = pa.StringArray.from_buffers(len(row) + 1, pa.py_buffer(np.append(ends, ends[-1:])), pa.py_buffer(data[data != 32]))
            docs = b.take(pa.array(heads))
            for t, m, by in told:
                k = docs.column(f"k_{m}").to_numpy().astype(np.int64)
                if attached:
                    own = np.flatnonzero(place < k[row])
                    counts = np.bincount(row[own], minlength=len(heads))
                    said = pa.array(state[own])
                else:
                    names, codes = by
                    code = np.frombuffer(codes, np.uint8)[state]
                    own = np.flatnonzero((place < k[row]) & (code < len(names)))
                    counts = np.bincount(row[own], minlength=len(heads))
                    more = np.maximum(k - counts, 0)
                    owner = np.append(row[own], np.repeat(np.arange(len(heads)), more))
                    order = np.argsort(owner, kind="stable")
                    own = np.append(own, np.full(more.sum(), len(row)))[order]
                    said = pa.array([*names, "O"], pa.string()).take(pa.array(np.append(code, len(names))[own]))
                    counts = counts + more
                mine = pa.StructArray.from_arrays([said, tok.take(pa.array(own)), pa.array(np.ones(len(own)))], ["entity", "word", "score"])
                lists_of = [pa.ListArray.from_arrays(slots(n), tok.slice(0, len(row))), pa.ListArray.from_arrays(slots(n), flat)] if attached else []
                yield pa.record_batch([
                    pa.array([t] * len(heads), pa.string()), docs.column("origin"), docs.column("doc_id"), pa.array(n.astype(np.int32)),
                    pa.array([m] * len(heads), pa.string()), *lists_of, pa.ListArray.from_arrays(slots(counts), mine)], names=names_of)

    lengths = sorted({f"k_{m}" for _, m, _ in sides})
    x = lists.select(*DOC_KEY, "chunk", "n", "words", "state", *lengths)
    x = place_documents(x).sortWithinPartitions(*DOC_KEY, "chunk")
    return x.mapInArrow(run, schema)


def zip_pairs(aligned_true: DataFrame, preds: DataFrame, taxonomy: str,
              models: list[str] | None = None) -> DataFrame:
    """O19 + O20: attach predictions by document key and pair token by token.

    ``aligned_true``: ``origin, doc_id, idx, true_id`` for idx 1..n; or one row a document with the list ``true_ids``, then lists are
    joined and paired place by place, and no token is moved.
    ``preds``: ``origin, doc_id, model_id, predicted_mask``.
    The prediction list is padded like ``[-100] + p + [-100]``; the join on
    position truncates to the shorter side exactly as ``zip``.  A document for which one
    of ``models`` has no row, or a null list, is paired with ``O`` throughout, so that
    its entities count as missed; without ``models`` it is left out.
    """
    enc = F.concat(F.transform("predicted_mask", lambda e: tx.tag_id(e["entity"], taxonomy)),
                   F.array(F.lit(tx.IGNORE_ID)))
    if "true_ids" in aligned_true.columns:
        return _zip_lists(aligned_true, preds, enc, F.lit(tx.tag2id(taxonomy)["O"]), models)
    p = (preds.select(*DOC_KEY, "model_id", F.posexplode(enc).alias("p0", "pred_id"))
         .select(*DOC_KEY, "model_id", (F.col("p0") + 1).alias("idx"), "pred_id"))
    if models is None:
        return aligned_true.join(p, [*DOC_KEY, "idx"], "inner")
    lists = preds.where(F.col("predicted_mask").isNotNull()).groupBy(*DOC_KEY, "model_id").agg(
        F.max(F.size("predicted_mask")).alias("_k"))
    want = aligned_true.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))
    x = want.join(lists, [*DOC_KEY, "model_id"], "left").join(p, [*DOC_KEY, "model_id", "idx"], "left")
    x = x.where(F.col("_k").isNull() | (F.col("idx") <= F.col("_k") + 1))
    o_id = F.lit(tx.tag2id(taxonomy)["O"])
    return x.withColumn("pred_id", F.when(F.col("_k").isNull(), o_id).otherwise(F.col("pred_id"))).drop("_k")


def _zip_lists(aligned_true: DataFrame, preds: DataFrame, enc: Column, o_id: Column, models: list[str] | None) -> DataFrame:
    """``zip_pairs`` of lists: ids of a byte a token meet on the document's key."""
    p = preds.where(F.col("predicted_mask").isNotNull()).select(*DOC_KEY, "model_id", enc.cast("array<tinyint>").alias("pred_ids"))
    if models is None:
        x = aligned_true.join(p, DOC_KEY, "inner")
    else:
        x = aligned_true.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models]))).join(p, [*DOC_KEY, "model_id"], "left")
    n = F.least(F.size("true_ids"), F.when(F.col("pred_ids").isNull(), F.size("true_ids")).otherwise(F.size("pred_ids")))
    # the shorter list ends the pairs: past it nothing is paired
    x = x.withColumn("true_ids", F.slice("true_ids", F.lit(1), n))
    x = x.select(*[c for c in x.columns if c != "true_ids"], F.posexplode("true_ids").alias("_at", "true_id"))
    pred = F.when(F.col("pred_ids").isNull(), o_id).otherwise(F.get("pred_ids", "_at").cast("int"))
    return x.select(*[c for c in x.columns if c not in ("pred_ids", "_at", "true_id")], (F.col("_at") + 1).alias("idx"),
                    F.col("true_id").cast("int").alias("true_id"), pred.alias("pred_id"))


GRAM = 3  # characters of a word by which it meets tokens


def token_grams(tok: Column) -> Column:
    """Distinct substrings of a token of up to ``GRAM`` characters, the empty one included
    (a blank word matches every token); their number grows with the token's length."""
    n = F.length(tok)

    def of(k: int) -> Column:
        last = F.greatest(n - (k - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(tok, i, F.lit(k)))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(k) for k in range(1, GRAM + 1)]))


def word_matches(tokens_df: DataFrame, words: DataFrame) -> DataFrame:
    """Per token text of a document and model, ``ppos`` of the first prediction whose stripped ``word`` is a substring of it.

    ``words``: ``origin, doc_id, model_id, ppos, word``.  What a token matches depends on its text alone, so every text of a
    document is looked up once.  All models of a document share one index: a word is
    listed once, with each model's first place of it, and meets the tokens once.  A word in a token starts with one of
    the token's short substrings, so words meet tokens in an equi-join on ``(origin, doc_id, first
    characters)``, then the whole word is tested -- never tokens x predictions.  ``tokens_df`` placed by document
    (``place_documents``) stays there: substrings are given out after the move, not before it.
    """
    w = words.select(*DOC_KEY, "model_id", "ppos", strip(F.coalesce(F.col("word"), F.lit(""))).alias("word"))
    w = w.groupBy(*DOC_KEY, "word", "model_id").agg(F.min("ppos").alias("ppos"))
    w = w.groupBy(*DOC_KEY, "word").agg(F.collect_list(F.struct("model_id", "ppos")).alias("firsts")) \
        .withColumn("gram", F.substring("word", 1, GRAM))
    grams = tokens_df.select(*DOC_KEY, "tok").distinct().select(*DOC_KEY, "tok", F.explode(token_grams(F.col("tok"))).alias("gram"))
    j = grams.join(w.hint("merge"), [*DOC_KEY, "gram"], "inner").where(F.contains("tok", "word"))
    return j.select(*DOC_KEY, "tok", F.explode("firsts").alias("f")).groupBy(*DOC_KEY, "tok", "f.model_id").agg(
        F.min("f.ppos").alias("ppos"))


def _matched_lists(rows: DataFrame) -> DataFrame:
    """``word_matches`` of rows with ``tok`` and ``predicted_mask`` (both lists): the other columns, ``entities`` and for each token ``ppos`` (-1: none).

    A document's tokens with one text are looked up once: a token's substrings of the words' lengths in a table of the words, or
    the words in the token, whichever are fewer.  Models that say the same words share the result.
    """
    from pyspark.sql import types as T

    kept = [c for c in rows.columns if c not in ("tok", "predicted_mask")]
    x = rows.select(*kept, "tok", F.col("predicted_mask.word").alias("words"), F.col("predicted_mask.entity").alias("entities"))
    schema = T.StructType([*[x.schema[c] for c in kept], x.schema["entities"], T.StructField("ppos", T.ArrayType(T.IntegerType()))])
    names_of, keys = schema.names, list(DOC_KEY)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        short, memo = {}, {}  # substrings of short texts; what the last documents gave

        def substrings(t):
            out = short.get(t)
            if out is None:
                out = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)} | {""}
                if len(short) < 200_000:
                    short[t] = out
            return out

        def places(toks, words):
            first = {}
            for w, p in dict(zip(reversed(words), range(len(words) - 1, -1, -1))).items():  # each word's first place
                w = (w or "").strip()
                if p < first.get(w, p + 1):
                    first[w] = p
            widths, found = {len(w) for w in first}, {}
            for t in set(toks):
                if len(t) <= 8:
                    some = [first[x] for x in substrings(t) if x in first]
                elif len(widths) * len(t) < len(first):
                    some = [first[x] for k in widths for x in (t[i:i + k] for i in range(len(t) - k + 1)) if x in first]
                else:
                    some = [p for w, p in first.items() if w in t]
                found[t] = min(some, default=-1)
            return [found[t] for t in toks]

        def texts_of(col):
            """A column of texts as a list; cut from one text, as pyarrow takes texts out one by one slowly."""
            if col.null_count or not len(col):
                return col.to_pylist()
            col = col.cast(pa.string())
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
            text, at = data.tobytes().decode(), at - at[0]
            if len(text) < len(data):
                at = np.append(0, np.cumsum(data & 0xC0 != 0x80))[at]
            at = at.tolist()
            return [text[i:j] for i, j in zip(at, at[1:])]

        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            out, sizes = [], []
            lists = []
            for c in ("tok", "words"):
                col = b.column(c)
                flat, long = texts_of(col.flatten()), np.append(0, np.cumsum([x or 0 for x in col.value_lengths().to_pylist()]))
                lists.append([flat[i:j] for i, j in zip(long[:-1], long[1:])])
            for key, toks, words in zip(zip(*(b.column(c).to_pylist() for c in keys)), *lists):
                had = memo.get(key)
                if had is None or had[0] != words or had[1] != toks:
                    if key not in memo and len(memo) >= 256:
                        memo.pop(next(iter(memo)))
                    had = memo[key] = words, toks, places(toks, words)
                out += had[2]
                sizes.append(len(toks))
            ppos = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(out, pa.int32()))
            yield pa.record_batch([*[b.column(c) for c in names_of[:-1]], ppos], names=names_of)
    return x.mapInArrow(run, schema)


def word_match_align(tokens_df: DataFrame, preds: DataFrame | None = None, along: list[str] | None = None,
                     outside: Column | None = None) -> DataFrame:
    """Per token, the first prediction (list order) whose stripped
    ``word`` is a substring of the token; ``O`` when none matches, also
    for an empty or null list.  A null word counts as an empty one.

    ``tokens_df``: ``origin, doc_id, idx, tok`` and more columns, which are kept (the gold row's own
    ids, ignored positions included).  ``preds``: ``origin, doc_id, model_id, predicted_mask`` of any
    number of models; an entity is text, or a struct with one text a taxonomy.

    Without ``preds``: rows of ``tokens_df`` are a document and model each, with the lists ``tok`` and ``predicted_mask``, and lists of
    a value a token, ``along``, which become those tokens' columns.  Then no token or word is moved.  ``outside``: what stands for ``O`` where
    an entity isn't text.
    """
    if preds is None:
        x = _matched_lists(tokens_df)
        along, o = along or [], F.lit("O") if outside is None else outside
        plain = [c for c in x.columns if c not in ("entities", "ppos", *along)]
        x = x.select(*plain, "entities", *along, F.posexplode("ppos").alias("_at", "_p"))
        entity = F.when(F.col("_p") >= 0, F.get("entities", "_p"))
        return x.select(*plain, (F.col("_at") + 1).alias("idx"), *[F.get(c, "_at").alias(c) for c in along], F.coalesce(entity, o).alias("entity"))
    tokens_df = place_documents(tokens_df)  # once; all below meets by document
    long = preds.select(*DOC_KEY, "model_id", F.posexplode("predicted_mask").alias("ppos", "e"))
    hit = word_matches(tokens_df, long.select(*DOC_KEY, "model_id", "ppos", F.col("e.word").alias("word")))
    hit = hit.join(long.select(*DOC_KEY, "model_id", "ppos", F.col("e.entity").alias("entity")).hint("merge"), [*DOC_KEY, "model_id", "ppos"])
    models = preds.select(*DOC_KEY, "model_id").distinct()
    kind = long.schema["e"].dataType["entity"].dataType
    o = F.struct(*[F.lit("O").alias(f.name) for f in kind.fields]) if hasattr(kind, "fields") else F.lit("O")
    return (tokens_df.join(models, DOC_KEY, "inner").join(hit.drop("ppos").hint("merge"), [*DOC_KEY, "model_id", "tok"], "left")
            .withColumn("entity", F.coalesce("entity", o)))

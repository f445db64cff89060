"""Sequence-label evaluation.

Everything is computed from a long ``pairs`` table (one row per scored
token x model) reduced first to a ``confusion`` table of
``(taxonomy, origin, model_id, true_id, pred_id, n)``: a partial + final hash
aggregate whose size is bounded by the tag sets, not by the data.  Reports,
averages and accuracy are then second-level aggregates of that small table.

Report arithmetic (zero_division = 0): ``precision = tp / pred_n``,
``recall = tp / support``, ``f1 = 2 tp / (pred_n + support)``; macro is the
plain mean over the in-scope tags including support-0 tags; weighted is
the support-weighted mean; micro applies the formulas to the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions.text import round6, safe_ratio, surface_shape
from ..sources.corpus import DOC_KEY

CONF_KEY = ["taxonomy", "origin", "model_id"]


def mask_ignored(pairs: DataFrame) -> DataFrame:
    """Keep positions whose true tag is scored (true != -100)."""
    return pairs.where(F.col("true_id") != tx.IGNORE_ID)


def confusion(pairs: DataFrame) -> DataFrame:
    """(true, pred) pair counts of the scored positions."""
    return (mask_ignored(pairs).groupBy(*CONF_KEY, "true_id", "pred_id")
            .agg(F.count(F.lit(1)).alias("n")))


def eval_sets(conf: DataFrame) -> DataFrame:
    """Own corpus (origin = taxonomy) and concatenated corpus (all origins).

    One pass: each confusion row is emitted into every set it belongs to.
    """
    sets = F.when(F.col("origin") == F.col("taxonomy"), F.array(F.lit("own"), F.lit("concat"))) \
        .otherwise(F.array(F.lit("concat")))
    return (conf.select("*", F.explode(sets).alias("eval_set"))
            .groupBy("taxonomy", "eval_set", "model_id", "true_id", "pred_id")
            .agg(F.sum("n").alias("n")))


def _scope_structs(taxonomy: Column) -> Column:
    """All in-scope ``(tag_id, tag)`` of the row's taxonomy, as a literal array."""
    def arr(t):
        return F.array(*[F.struct(F.lit(i).alias("tag_id"), F.lit(tag).alias("tag"))
                         for i, tag, *_, in_scope, _ in tx.label_rows(t) if in_scope])
    return F.when(taxonomy == "A", arr("A")).otherwise(arr("B"))


def _scope_tag(taxonomy: Column, tag_id: Column) -> Column:
    """Tag text of an in-scope tag id, null otherwise."""
    d = {f"{t}|{i}": tag for t in tx.TAXONOMIES
         for i, tag, *_, in_scope, _ in tx.label_rows(t) if in_scope}
    return F.element_at(tx._map(d), F.concat(taxonomy, F.lit("|"), tag_id.cast("string")))


def classification_report(conf: DataFrame) -> DataFrame:
    """O46 + O17: per in-scope tag tp / pred_n / support / P / R / F1.

    Out-of-scope predictions are not removed: they are misses of the true
    tag.  Tags never seen still get a row (support 0): every confusion row
    also contributes zeros to all in-scope tags of its taxonomy, so the
    report is a single aggregation with no scaffold join.
    """
    sets = eval_sets(conf)
    zero = F.lit(0).cast("bigint")
    contrib = F.concat(
        F.array(
            F.struct(F.col("true_id").alias("tag_id"),
                     F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(zero).alias("tp"),
                     zero.alias("pred_n"), F.col("n").alias("support")),
            F.struct(F.col("pred_id").alias("tag_id"), zero.alias("tp"), F.col("n").alias("pred_n"),
                     zero.alias("support"))),
        F.transform(_scope_structs(F.col("taxonomy")),
                    lambda s: F.struct(s["tag_id"].alias("tag_id"), zero.alias("tp"), zero.alias("pred_n"),
                                       zero.alias("support"))))
    per_tag = (sets.select("taxonomy", "eval_set", "model_id", F.explode(contrib).alias("c"))
               .groupBy("taxonomy", "eval_set", "model_id", F.col("c.tag_id").alias("tag_id"))
               .agg(F.sum("c.tp").alias("tp"), F.sum("c.pred_n").alias("pred_n"),
                    F.sum("c.support").alias("support")))
    tag = _scope_tag(F.col("taxonomy"), F.col("tag_id"))
    r = per_tag.where(tag.isNotNull()).select(
        "taxonomy", "eval_set", "model_id", F.col("tag_id").cast("int").alias("tag_id"), tag.alias("tag"),
        F.col("tp").cast("bigint").alias("tp"), F.col("pred_n").cast("bigint").alias("pred_n"),
        F.col("support").cast("bigint").alias("support"))
    return _with_prf(r)


def _with_prf(r: DataFrame) -> DataFrame:
    return r.select(
        "*",
        round6(safe_ratio(F.col("tp"), F.col("pred_n"))).alias("precision"),
        round6(safe_ratio(F.col("tp"), F.col("support"))).alias("recall"),
        round6(safe_ratio(2 * F.col("tp"), F.col("pred_n") + F.col("support"))).alias("f1"),
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Micro / macro / weighted rows over the in-scope tags."""
    key = ["taxonomy", "eval_set", "model_id"]
    p = safe_ratio(F.col("tp"), F.col("pred_n"))
    rc = safe_ratio(F.col("tp"), F.col("support"))
    f = safe_ratio(2 * F.col("tp"), F.col("pred_n") + F.col("support"))
    g = report.groupBy(*key).agg(
        F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"), F.sum("support").alias("support"),
        F.avg(p).alias("macro_p"), F.avg(rc).alias("macro_r"), F.avg(f).alias("macro_f"),
        F.sum(p * F.col("support")).alias("w_p"), F.sum(rc * F.col("support")).alias("w_r"),
        F.sum(f * F.col("support")).alias("w_f"),
    )
    rows = F.array(
        F.struct(F.lit("micro").alias("average"), safe_ratio(F.col("tp"), F.col("pred_n")).alias("precision"),
                 safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
                 safe_ratio(2 * F.col("tp"), F.col("pred_n") + F.col("support")).alias("f1")),
        F.struct(F.lit("macro").alias("average"), F.col("macro_p").alias("precision"),
                 F.col("macro_r").alias("recall"), F.col("macro_f").alias("f1")),
        F.struct(F.lit("weighted").alias("average"), safe_ratio(F.col("w_p"), F.col("support")).alias("precision"),
                 safe_ratio(F.col("w_r"), F.col("support")).alias("recall"),
                 safe_ratio(F.col("w_f"), F.col("support")).alias("f1")))
    out = g.select(*key, "support", F.explode(rows).alias("a"))
    return out.select(*key, "a.average", round6(F.col("a.precision")).alias("precision"),
                      round6(F.col("a.recall")).alias("recall"), round6(F.col("a.f1")).alias("f1"),
                      F.col("support").cast("bigint").alias("support"))


def masked_accuracy(conf: DataFrame) -> DataFrame:
    """Correct / scored tokens per eval set and model."""
    sets = eval_sets(conf)
    return sets.groupBy("taxonomy", "eval_set", "model_id").agg(
        F.sum(F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0))
        .cast("bigint").alias("correct"),
        F.sum("n").cast("bigint").alias("scored"),
    ).withColumn("accuracy", round6(safe_ratio(F.col("correct"), F.col("scored"))))


# ---------------------------------------------------------------------------
# Entity level
# ---------------------------------------------------------------------------

def _id_arrays():
    """Per taxonomy, arrays indexed by tag id (O(1) ``element_at``, unlike a
    map lookup which scans its keys): prefix code (0 = O, 1 = B, 2 = I) and
    label code; plus label code -> label text."""
    px, lab, names = {}, {}, []
    all_labels = sorted({lab for t in tx.TAXONOMIES for lab in tx.RAW_LABELS[t]})
    for t in tx.TAXONOMIES:
        rows = sorted(tx.label_rows(t))
        px[t] = F.expr("array(" + ", ".join(
            "1" if r[3] == "B" else "2" if r[3] == "I" else "0" for r in rows) + ")")
        lab[t] = F.expr("array(" + ", ".join(
            str(all_labels.index(r[2])) if r[2] is not None else "NULL" for r in rows) + ")")
    names = F.expr("array(" + ", ".join(f"'{x}'" for x in all_labels) + ")")
    return px, lab, names


def positions(pairs: DataFrame) -> DataFrame:
    """Any scored pairs with ``part, pos, opens`` (see ``entities``): each sequence is one part."""
    w = Window.partitionBy("taxonomy", "model_id", *DOC_KEY).orderBy("idx")
    return pairs.select("*", F.lit(0).alias("part"), F.row_number().over(w).alias("pos"), F.lit(False).alias("opens"))


def _runs(rows: DataFrame, order, end: str, begin: str, kind: str) -> DataFrame:
    """Numbers the runs of rows that go on with what ended right before them."""
    on = F.coalesce((F.col("px") == 2) & (F.lag(end).over(order) == F.col(begin) - 1)
                    & (F.lag(kind).over(order) == F.col(kind)), F.lit(False))
    rows = rows.withColumn("_new", (~on).cast("int"))
    return rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def entities(tagged: DataFrame, key: list[str]) -> DataFrame:
    """Entities ``key.., part, first, last, etype`` of tag sequences.

    ``tagged`` holds ``key.., part, pos, opens, px, et`` of the positions that aren't ``O`` only: ``pos`` numbers
    the scored positions of a sequence, so a number that is missing is an ``O``; ``part`` is a
    stretch of them, ascending with ``pos``; ``opens``: the first scored position of a part that another
    one precedes.  An entity starts at ``B-``, or at ``I-`` after an ``O`` or another type.

    Every part is decoded on its own, without its neighbours; entities are its summary, and only they move (``_joined``).
    """
    inside = Window.partitionBy(*key, "part").orderBy("pos")
    e = _runs(tagged, inside, "pos", "pos", "et").groupBy(*key, "part", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("et").alias("etype"), F.min_by("px", "pos").alias("px"),
        F.min_by("opens", "pos").alias("opens")).drop("run")
    return _joined(e, key)


def _joined(e: DataFrame, key: list[str]) -> DataFrame:
    """Entities of sequences from those of their parts (``key.., part, first, last, etype, px, opens``): one
    that begins with ``I-`` where its part opens goes on with the one that ended right before it, if of
    the same type; a run may go through any number of parts."""
    # what doesn't stand where its part opens can't go on with an earlier part
    e = e.withColumn("px", F.when(F.col("opens"), F.col("px")).otherwise(F.lit(1)))
    across = Window.partitionBy(*key).orderBy("first")
    return _runs(e, across, "last", "first", "etype").groupBy(*key, "run").agg(
        F.min("part").alias("part"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.first("etype").alias("etype")).select(*key, "part", "first", "last", "etype")


Sides = list[tuple[str, str, list, list]]


def entities_of_lists(lists: DataFrame, sides: Sides) -> DataFrame:
    """``entities`` of documents of ``aligned.aligned_lists``: ``doc_id, origin, taxonomy, model_id, part, first, last, etype``.

    ``sides``: taxonomy and model (``*``: the truth), and by a token's state its prefix code and label code (``tag_codes``; null: none).  A part is a
    chunk, decoded on arrays; no position becomes a row.
    """
    return _joined(_decoded(lists, sides), ["doc_id", "origin", "taxonomy", "model_id"])


def _decoder(sides: Sides):
    """The entities of some rows of ``aligned.aligned_lists`` (a closure, so that tasks get it by value)."""
    tables = [[bytes(255 if v is None else v for v in values) for values in (px, et)] for _, _, px, et in sides]

    def decode(b):
        """Of every side: rows, first and last scored position in the chunk, label codes, prefix codes."""
        import numpy as np

        n = b.column("n").to_numpy().astype(np.int64)
        row, state = np.repeat(np.arange(len(n)), n), b.column("state").flatten().to_numpy().astype(np.int64)
        scored = np.flatnonzero((state >> 6 & 1 == 0) | (state >> 7 & 1 == 1))  # begins a word or a gold span
        row, state = row[scored], state[scored]
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(heads, np.diff(heads, append=len(row))) + 1
        for px, et in ([np.frombuffer(x, np.uint8) for x in two] for two in tables):
            p = px[state]
            at = np.flatnonzero((p == 1) | (p == 2))
            p, e, r = p[at], et[state[at]], row[at]
            new = np.ones(len(at), bool)
            new[1:] = ~((p[1:] == 2) & (at[1:] == at[:-1] + 1) & (e[1:] == e[:-1]) & (r[1:] == r[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[:len(first)] - 1
            yield r[first], place[at[first]], place[at[last]], e[first].astype(np.int64), p[first]
    return decode


def _decoded(lists: DataFrame, sides: Sides) -> DataFrame:
    """Entities of each chunk on its own: ``doc_id, origin, taxonomy, model_id, part, first, last, etype, px, opens`` of ``entities``."""
    from pyspark.sql import types as T

    number = T.IntegerType()
    schema = T.StructType([*[lists.schema[c] for c in DOC_KEY], *[T.StructField(c, number) for c in ("side", "part", "first", "last", "etype", "px")],
                           T.StructField("opens", T.BooleanType())])
    names_of, decode = schema.names, _decoder(sides)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            before = b.column("before").to_numpy().astype(np.int64)
            for side, (r, first, last, e, p) in enumerate(decode(b)):
                owner = b.take(pa.array(r))
                yield pa.record_batch([
                    *[owner.column(c) for c in ("origin", "doc_id")], pa.array(np.full(len(r), side, np.int32)), owner.column("chunk"),
                    *[pa.array(x.astype(np.int32)) for x in (first + before[r], last + before[r], e, p)], pa.array((first == 1) & (before[r] > 0))], names=names_of)

    got = lists.select(*DOC_KEY, "chunk", "n", "before", "state").mapInArrow(run, schema)
    of = {c: F.get(F.array(*[F.lit(side[i]) for side in sides]), "side") for i, c in enumerate(("taxonomy", "model_id"))}
    return got.withColumns(of).drop("side")


def matched_lists(lists: DataFrame, sides: Sides) -> DataFrame:
    """``matched`` of the entities of documents with one chunk, decoded and matched where their lists lie: what leaves a task is counts."""
    from pyspark.sql import types as T

    counts = ["tp", "n_pred", "n_true"]
    schema = T.StructType([lists.schema["origin"], T.StructField("side", T.IntegerType()), T.StructField("etype", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in counts]])
    names_of, decode = schema.names, _decoder(sides)
    truth = {t: i for i, (t, m, _, _) in enumerate(sides) if m == "*"}
    pairs = [(truth[t], i) for i, (t, m, _, _) in enumerate(sides) if m != "*"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            origins = b.column("origin").dictionary_encode()
            origin, found = origins.indices.to_numpy().astype(np.int64), list(decode(b))
            kinds = [origin[r] * 256 + e for r, _, _, e, _ in found]
            keys = [((r << 17 | first) << 17 | last) << 8 | e for r, first, last, e, _ in found]
            for true, side in pairs:
                hit = kinds[side][np.isin(keys[side], keys[true])]
                n = [np.bincount(x, minlength=256 * len(origins.dictionary)) for x in (hit, kinds[side], kinds[true])]
                some = np.flatnonzero(n[1] + n[2])
                yield pa.record_batch([origins.dictionary.take(pa.array(some // 256)), pa.array(np.full(len(some), side, np.int32)),
                                       pa.array((some % 256).astype(np.int32)), *[pa.array(x[some]) for x in n]], names=names_of)

    got = lists.select("origin", "n", "state").mapInArrow(run, schema)
    of = {c: F.get(F.array(*[F.lit(side[i]) for side in sides]), "side") for i, c in enumerate(("taxonomy", "model_id"))}
    return got.withColumns(of).groupBy("taxonomy", "model_id", "origin", "etype").agg(*[F.sum(c).alias(c) for c in counts])


def entity_report(pairs: DataFrame) -> DataFrame:
    """Entity-level P/R/F1 per type and overall (exact span + type match).

    ``pairs``: ``taxonomy, model_id, origin, doc_id, true_id, pred_id`` of scored positions, with ``idx``, or with
    ``part, pos, opens`` of ``entities`` (then positions that are ``O`` on both sides may be missing).

    Tags are decoded to integer codes and ``O`` is dropped before anything moves; true and
    predicted entities are matched by grouping on ``(span, type)`` -- no self-join.
    """
    if "pos" not in pairs.columns:
        pairs = positions(pairs)
    px_arr, lab_arr, _ = _id_arrays()

    def side(is_true, c):
        def look(arrs):
            return F.when(F.col("taxonomy") == "A", _by_id(arrs["A"], F.col(c))).otherwise(_by_id(arrs["B"], F.col(c)))
        return F.struct(F.lit(is_true).alias("is_true"), F.coalesce(look(px_arr), F.lit(0)).alias("px"), look(lab_arr).alias("et"))

    seq = ["doc_id", "origin", "model_id", "taxonomy"]
    tagged = pairs.select(*seq, "part", "pos", "opens", F.explode(F.array(side(1, "true_id"), side(0, "pred_id"))).alias("s")).select(
        *seq, "part", "pos", "opens", "s.*").where("px <> 0")
    return entity_scores(entities(tagged, [*seq, "is_true"]))


def _by_id(arr: Column, tag_id: Column) -> Column:
    return F.when(tag_id >= 0, F.element_at(arr, tag_id + 1))


def tag_codes(taxonomy: str) -> list[tuple[int, int | None]]:
    """By tag id of one taxonomy: prefix code (0 = O, 1 = B, 2 = I) and label code."""
    labels = sorted({lab for t in tx.TAXONOMIES for lab in tx.RAW_LABELS[t]})
    return [({"B": 1, "I": 2}.get(r[3], 0), None if r[2] is None else labels.index(r[2])) for r in sorted(tx.label_rows(taxonomy))]


def matched(ents: DataFrame) -> DataFrame:
    """Entities of both sides matched on ``(span, type)``: ``taxonomy, model_id, origin, etype, tp, n_pred, n_true``."""
    m = ents.groupBy("doc_id", "origin", "model_id", "taxonomy", "part", "first", "last", "etype").agg(
        F.max("is_true").alias("it"), F.max(1 - F.col("is_true")).alias("ip"))
    return m.groupBy("taxonomy", "model_id", "origin", "etype").agg(
        F.sum(F.col("it") * F.col("ip")).alias("tp"), F.sum("ip").alias("n_pred"), F.sum("it").alias("n_true"))


def entity_scores(ents: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """O49 from decoded entities: ``doc_id, origin, model_id, taxonomy, is_true, part, first, last, etype``; ``counted``: those of
    other documents, ``matched`` already."""
    names = _id_arrays()[2]
    sets = F.when(F.col("origin") == F.col("taxonomy"), F.array(F.lit("own"), F.lit("concat"))) \
        .otherwise(F.array(F.lit("concat")))
    key = ["taxonomy", "model_id"]
    counted = matched(ents) if counted is None else matched(ents).unionByName(counted)
    per = counted.select(*key, F.explode(sets).alias("eval_set"), "etype", "tp", "n_pred", "n_true")
    per = per.select(*key, "eval_set", F.explode(F.array(F.col("etype"), F.lit(-1))).alias("etype"), "tp", "n_pred", "n_true")
    r = per.groupBy(*key, "eval_set", "etype").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")])
    etype = F.when(F.col("etype") == -1, F.lit("ALL")).otherwise(F.element_at(names, F.col("etype") + 1))
    return r.select(
        "taxonomy", "eval_set", "model_id", etype.alias("entity_type"),
        F.col("tp").cast("bigint").alias("tp"), F.col("n_pred").cast("bigint").alias("n_pred"),
        F.col("n_true").cast("bigint").alias("n_true"),
        round6(safe_ratio(F.col("tp"), F.col("n_pred"))).alias("precision"),
        round6(safe_ratio(F.col("tp"), F.col("n_true"))).alias("recall"),
        round6(safe_ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_true"))).alias("f1"))


# ---------------------------------------------------------------------------
# Comparisons
# ---------------------------------------------------------------------------

def compare_models(report: DataFrame, model_a: str, model_b: str, eval_set: str = "concat") -> DataFrame:
    """Two models' per-tag F1 side by side on one taxonomy: ``f1_a, f1_b, delta,
    best_f1, better`` (a model's name or ``tie``).

    Labels of taxonomy A are mapped into B first so both reports share one
    label space.  A tag that one model has no row for keeps its row: that
    side's F1, ``delta`` and ``better`` are null.
    """
    r = report.where((F.col("eval_set") == eval_set) & (F.col("tag") != "O")
                     & F.col("model_id").isin(model_a, model_b))
    lab = F.substring(F.col("tag"), 3, 1 << 20)
    pref = F.substring(F.col("tag"), 1, 2)
    mapped = F.when(F.col("taxonomy") == "A", tx.map_label(lab, "A", "B")).otherwise(lab)
    x = r.select("taxonomy", "model_id", F.concat(pref, mapped).alias("tag_b"), "tp", "pred_n", "support")
    g = x.groupBy("taxonomy", "model_id", "tag_b").agg(
        F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"), F.sum("support").alias("support"))
    g = g.withColumn("f1", round6(safe_ratio(2 * F.col("tp"), F.col("pred_n") + F.col("support"))))
    j = g.groupBy("taxonomy", F.col("tag_b").alias("tag")).agg(
        F.max(F.when(F.col("model_id") == model_a, F.col("f1"))).alias("f1_a"),
        F.max(F.when(F.col("model_id") == model_b, F.col("f1"))).alias("f1_b"))
    fa, fb = F.col("f1_a"), F.col("f1_b")
    return j.select(
        "taxonomy", "tag", fa, fb, round6(fb - fa).alias("delta"), round6(F.greatest(fa, fb)).alias("best_f1"),
        F.when(fa > fb, F.lit(model_a)).when(fb > fa, F.lit(model_b)).when(fa == fb, F.lit("tie"))
        .alias("better"))


def score_parity(a: DataFrame, b: DataFrame, atol: float = 1e-5) -> DataFrame:
    """Max absolute difference of two score tables for the same input.

    ``n`` counts the scores that both sides have; a score that one side lacks
    puts the result out of tolerance."""
    key = ["doc_id", "idx", "class"]
    j = a.select(*key, F.col("score").alias("score_a")).join(
        b.select(*key, F.col("score").alias("score_b")), key, "full")
    d = F.abs(F.col("score_a") - F.col("score_b"))
    return j.agg(F.count(d).alias("n"), F.max(d).alias("max_abs_diff"),
                 F.sum((d > atol).cast("int")).cast("bigint").alias("n_over"),
                 F.count_if(d.isNull()).alias("n_missing")) \
        .withColumn("atol", F.lit(atol)).withColumn(
            "within_tolerance", (F.coalesce("n_over", F.lit(0)) == 0) & (F.col("n_missing") == 0)) \
        .drop("n_missing")


def hard_negatives(tokens: DataFrame, wrong: dict[tuple[str, str], Column]) -> DataFrame:
    """False positives (true O, predicted entity) grouped by surface shape: ``taxonomy, model_id, pred_tag, shape, n``.

    ``tokens``: rows with ``tok``.  ``wrong``: for each (taxonomy, model) the predicted tag id of a false positive, else
    null.  Tokens are counted by shape and all their ids first, in one pass for all models.
    """
    x = tokens.select(surface_shape(F.col("tok")).alias("shape"), *[c.alias("_".join(k)) for k, c in wrong.items()])
    x = x.where(F.coalesce(*["_".join(k) for k in wrong]).isNotNull())
    x = x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(t).alias("taxonomy"), F.lit(m).alias("model_id"), F.col(f"{t}_{m}").alias("id")) for t, m in wrong])
    x = x.select("shape", "n", F.explode(rows).alias("x")).where("x.id IS NOT NULL")
    x = x.groupBy("x.taxonomy", "x.model_id", "x.id", "shape").agg(F.sum("n").alias("n"))
    tag = F.when(F.col("taxonomy") == "A", tx.tag_text(F.col("id"), "A")).otherwise(tx.tag_text(F.col("id"), "B"))
    return x.select("taxonomy", "model_id", tag.alias("pred_tag"), "shape", "n")

"""The shared lineage ``corpus -> spans -> tokens -> aligned -> pairs``.

Every evaluation and audit query starts from the same few tables, so they
are defined once here.  Texts are lexed once, chunk by chunk, into a table bucketed on the chunk's key; the
span lookup, the token join and the aligned table keep that placement, and only spans move.

Two label taxonomies are evaluated.  Both corpora keep their own allow-list
and the other corpus is relabelled into the evaluated taxonomy; because
relabelling only renames, the alignment geometry (which token each span
covers) is computed once and the tags of both taxonomies are projections of
it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions.text import hash_bucket, is_blank
from ..operators import align, aligned, evaluate, lexer, predict
from . import checkpoints
from ..sources import corpus as C
from ..sources.corpus import DOC_KEY


def keep_labels_long(spans: DataFrame) -> DataFrame:
    """O12 in long form: each corpus keeps its own allow-list."""
    return spans.where(
        ((F.col("origin") == "A") & F.col("label").isin(*tx.KEEP_LABELS["A"]))
        | ((F.col("origin") == "B") & F.col("label").isin(*tx.KEEP_LABELS["B"])))


def english(c: DataFrame) -> DataFrame:
    """O09 + O10: English documents, no blank text (tested on the raw code, which the scan filters by)."""
    return c.where((F.col("lang") == "en") & ~is_blank(F.col("source_text")))


def word_tokenizer():
    """A tokenizer as a user may give one: offsets of up to 200 characters without a blank."""
    import re
    word = re.compile(r"[^ \t\n\r]{1,200}")
    return lambda texts: [[m.span() for m in word.finditer(t)] for t in texts]


def _span_rows() -> dict[str, dict[str, list]]:
    """``origin|label`` (gold) or ``loose|rule``, in the order of their codes (from 1) -> by taxonomy the tag ids of the first and of further
    tokens, and of both with the label that a wrong prediction takes instead."""
    def ids(t, lab):
        number, hi = tx.tag2id(t), tx.has_i(t)
        if lab is None:  # a rule without a label in this taxonomy predicts O
            return [number["O"]] * 4
        alt = tx.alt_label(t).get(lab, tx.alt_label(t)[None])
        inner = hi.get(lab, True)
        return [number.get(x) for x in (f"B-{lab}", f"{'I' if inner else 'B'}-{lab}", f"B-{alt}",
                                        f"{'I' if inner and hi.get(alt, True) else 'B'}-{alt}")]

    rows = {f"{o}|{lab}": {t: ids(t, lab if o == t else tx.MAPPINGS[(o, t)].get(lab, lab)) for t in tx.TAXONOMIES}
            for o in tx.TAXONOMIES for lab in tx.RAW_LABELS[o]}
    return rows | {f"loose|{rule}": {t: ids(t, predict.LOOSE_LABELS[t].get(rule)) for t in tx.TAXONOMIES} for rule, _ in predict.LOOSE_RULES}


def _span_ids() -> tuple[Column, Column, Column]:
    """Literals: a map ``origin|label`` (gold) or ``loose|rule`` -> code, and by code the labels and the tag ids in both taxonomies:
    ``b`` and ``c`` of the first and the further tokens, ``ob`` and ``oc`` of the label that a wrong prediction takes instead."""
    rows = _span_rows()
    names = [f"{p}_{t}" for t in tx.TAXONOMIES for p in ("b", "c", "ob", "oc")]
    codes = F.expr("map(" + ", ".join(f"{tx._sql_lit(k)}, {i}" for i, k in enumerate(rows, 1)) + ")")
    labels = F.expr("array(" + ", ".join(tx._sql_lit(k.split("|")[1]) for k in rows) + ")")
    return codes, labels, F.expr("array(" + ", ".join("named_struct(" + ", ".join(
        f"'{n}', CAST({tx._sql_lit(v)} AS INT)" for n, v in zip(names, [x for t in tx.TAXONOMIES for x in r[t]])) + ")"
        for r in rows.values()) + ")")


def state_tables(t: str) -> dict[str, list]:
    """Tag ids in taxonomy ``t`` by the parts of a token's state (``aligned.parts``): ``raw`` by ``g``, ``loose`` by ``l``, ``noisy`` by four times ``g``
    and ``noise``."""
    number, codes = tx.tag2id(t), _span_rows()
    o, other = number["O"], number["B-" + tx.alt_label(t)[None]]

    def by_state(outside, first, on, loose=False):
        """Values of the states 0 (outside), 1 (none) and of every code's further tokens and first token."""
        return [outside, None, *[r[t][i] for k, r in codes.items() if k.startswith("loose|") == loose for i in (on, first)]]
    raw, swapped, changed = by_state(o, 0, 1), by_state(o, 1, 0), by_state(other, 2, 3)
    return {"raw": raw, "loose": by_state(o, 0, 1, loose=True), "noisy": [x for r, s, c in zip(raw, swapped, changed) for x in (o, s, c, r)]}


def state_ids(t: str, state: Column | None = None) -> dict[str, Column]:
    """``Lineage._ids`` by the state of a token (rows of ``aligned.rows``, or a value of the list): the same ids, looked up in arrays."""
    tables = state_tables(t)
    of = {c: F.col(c) for c in ("g", "l", "is_subword", "noise")} if state is None else aligned.parts(state)

    def look(name, at):
        return F.get(F.expr("array(" + ", ".join(f"CAST({tx._sql_lit(v)} AS INT)" for v in tables[name]) + ")"), at)
    seen = look("raw", of["g"])
    return {f"true_{t}": F.when(of["is_subword"] & (of["g"] % 2 == 0), F.lit(tx.IGNORE_ID)).otherwise(seen), f"raw_{t}": seen,
            f"pred_{t}_rule_loose": look("loose", of["l"]), f"pred_{t}_noisy": look("noisy", of["g"] * 4 + of["noise"])}


@dataclass
class Lineage:
    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict)

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    # -- documents --------------------------------------------------------
    @property
    def corpus(self) -> DataFrame:
        return self._get("corpus", lambda: C.place_documents(C.corpus(self.spark, self.sf_dir)))

    @property
    def docs_en(self) -> DataFrame:
        return self._get("docs_en", lambda: english(self.corpus))

    @property
    def spans_all(self) -> DataFrame:
        """Raw annotations of every document (own taxonomy, all labels)."""
        return self._get("spans_all", lambda: C.spans(self.corpus))

    @property
    def gold_spans(self) -> DataFrame:
        """Annotations of the evaluated documents after the allow-lists
        (persisted: alignment and every audit read them)."""
        return self._get("gold_spans", lambda: keep_labels_long(C.spans(self.docs_en)).persist(
            StorageLevel.MEMORY_AND_DISK))

    @property
    def gold_found(self) -> DataFrame:
        """``gold_spans`` without ``value`` for one pass: the persisted rows if a report has asked for them, else found where their
        documents were placed and not stored."""
        found = self.gold_spans if "gold_spans" in self._memo else keep_labels_long(C.spans(self.docs_en))
        return found.drop("value")

    # -- tokens and alignment --------------------------------------------
    @property
    def pieces(self) -> DataFrame:
        """Lexer output, blanks included (lazy)."""
        return self._get("pieces", lambda: lexer.pieces(self.docs_en))

    @property
    def token_table(self) -> DataFrame:
        """Tokens by chunk, one row a token."""
        return self._get("token_table", lambda: lexer.listed_tokens(self.token_lists))

    @property
    def token_lists(self) -> DataFrame:
        """Tokens, one row a chunk, written once: spans are looked up in it and the aligned table is built on it, so
        that no text is lexed twice.  Bucketed on the chunk's key, which every reader below keeps."""
        return self._get("token_lists", lambda: checkpoints.bucketed(
            self.spark, self.sf_dir, "tokens", lambda: lexer.token_lists(english(C.corpus(self.spark, self.sf_dir))), lexer.CHUNK_KEY))

    @property
    def totals(self) -> DataFrame:
        """One row for each chunk of a text: its tokens and those before it (persisted, small)."""
        return self._get("totals", lambda: lexer.chunk_totals(self.token_lists).persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def token_marks(self) -> DataFrame:
        """Where the evaluated documents' tokens are, without their texts, written once and placed by document: what
        locating gold spans and counting tokens needs (far less than ``token_lists`` holds)."""
        return self._get("token_marks", lambda: checkpoints.bucketed(
            self.spark, self.sf_dir, "marks", lambda: lexer.token_marks(english(C.corpus(self.spark, self.sf_dir))), DOC_KEY))

    @property
    def _numbered_lists(self) -> DataFrame:
        t = self.totals.select(*lexer.CHUNK_KEY, "base", "n_tok").hint("merge")
        return self.token_lists.join(t, lexer.CHUNK_KEY)

    @property
    def tokens(self) -> DataFrame:
        return self._get("tokens", lambda: lexer.listed_tokens(self._numbered_lists).select(
            *DOC_KEY, (F.col("base") + F.col("lidx")).alias("idx"), "tok", "start", "end", "is_subword", "n_tok"))

    @property
    def words(self) -> DataFrame:
        """Tokens of a tokenizer given from outside, one row a chunk, written once and placed by document."""
        return self._get("words", lambda: checkpoints.bucketed(
            self.spark, self.sf_dir, "words", lambda: lexer.tokenize_lists(english(C.corpus(self.spark, self.sf_dir)), word_tokenizer), DOC_KEY))

    @property
    def annotated(self) -> DataFrame:
        """Nested view: corpus columns + ``privacy_mask`` (all documents)."""
        return self._get("annotated", lambda: C.annotated(self.spark, self.sf_dir))

    @property
    def annotated_en(self) -> DataFrame:
        """The same of English documents; no other text is read or annotated."""
        return self._get("annotated_en", lambda: C.annotated(self.spark, self.sf_dir, lang="en"))

    # -- audit views -------------------------------------------------------
    @property
    def uspans(self) -> DataFrame:
        """Gold spans once per taxonomy, labels relabelled into it (with
        their surface ``value``)."""
        from ..operators.audit import in_taxonomies
        return self._get("uspans", lambda: in_taxonomies(self.gold_spans))

    def uspans_between(self, lo: int, hi: int, keep: Column | None = None) -> DataFrame:
        """``uspans`` of the documents given under ids in a range; nothing else is read or annotated."""
        from ..operators.audit import in_taxonomies
        x = in_taxonomies(keep_labels_long(C.spans(C.place_documents(english(C.corpus(self.spark, self.sf_dir, ids=(lo, hi)))))))
        return x if keep is None else x.where(keep)

    @property
    def id_range(self) -> tuple[int, int]:
        r = C.documents(self.spark, self.sf_dir).agg(F.min("doc_id"), F.max("doc_id")).first()
        return (r[0], r[1]) if r[0] is not None else (0, -1)

    def first_entities(self, n: int, labels: dict[str, list[str]], keep: Column | None = None) -> DataFrame:
        """The first ``n`` annotations of each label, by rounds over ids that end when all ``labels`` are full."""
        from ..operators import audit
        found = audit.first_in_rounds(lambda a, b: self.uspans_between(a, b, keep), *self.id_range, labels, n)
        return self.uspans.where("false").withColumn("rank", F.lit(1)) if found is None else found

    @property
    def scored(self) -> tuple[DataFrame, DataFrame]:
        """Rows of the Python scorer and its latency, from one pass."""
        from ..sources.io import output_path
        return self._get("scored", lambda: predict.score_corpus(
            self.docs_en, predict.rule_scorer("A"), "rule_loose", output_path(self.spark, "scored")))

    @property
    def uspans_located(self) -> DataFrame:
        """Same rows as ``uspans`` without ``value``, read from the persisted
        located spans (no second regex pass)."""
        from ..operators.audit import in_taxonomies
        return self._get("uspans_located", lambda: in_taxonomies(
            self.located.select(*DOC_KEY, "ann_pos", "start", "end", "label")))

    @property
    def located_t(self) -> DataFrame:
        from ..operators.audit import in_taxonomies
        return self._get("located_t", lambda: in_taxonomies(self.located))

    def kinds(self, ignore_subwords: bool = True) -> DataFrame:
        """Token rows per taxonomy: ``tag`` text (null = ignored), ``kind``
        (B/I/O/IGN) and ``label``, decoded from the integer tag id through
        arrays indexed by id (O(1) per token, no map scans)."""
        def build():
            def arr(values):
                return F.expr("array(" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + ")")
            rows = {t: sorted(tx.label_rows(t)) for t in tx.TAXONOMIES}
            tag_arr = {t: arr([r[1] for r in rows[t]]) for t in tx.TAXONOMIES}
            kind_arr = {t: arr([r[3] for r in rows[t]]) for t in tx.TAXONOMIES}
            lab_arr = {t: arr([r[2] for r in rows[t]]) for t in tx.TAXONOMIES}
            ids = F.array(*[F.struct(F.lit(t).alias("taxonomy"),
                                     self.true_id(t, ignore_subwords).alias("id")) for t in tx.TAXONOMIES])
            x = self.geometry.select(*DOC_KEY, "idx", F.explode(ids).alias("z")).select(
                "z.taxonomy", *DOC_KEY, "idx", F.col("z.id").alias("id"))
            is_a = F.col("taxonomy") == "A"
            i = F.col("id") + 1

            def look(arrs):
                return F.when(F.col("id") < 0, F.lit(None).cast("string")).when(
                    is_a, F.element_at(arrs["A"], i)).otherwise(F.element_at(arrs["B"], i))
            return x.select("taxonomy", *DOC_KEY, "idx", look(tag_arr).alias("tag"),
                            F.coalesce(look(kind_arr), F.lit("IGN")).alias("kind"),
                            look(lab_arr).alias("label"))
        return self._get(f"kinds_{ignore_subwords}", build)

    def tag_counts(self, ignore_subwords: bool = True) -> DataFrame:
        """``taxonomy, id, n, docs``: tokens by tag id, and how many of them open a document.  Tokens are
        counted by both taxonomies' ids at once and only the counts are given out."""
        if "geometry" in self._memo:
            ids = {t: self.true_id(t, ignore_subwords) for t in tx.TAXONOMIES}
            c = self.geometry.groupBy(*[x.alias(f"id_{t}") for t, x in ids.items()]).agg(
                F.count(F.lit(1)).alias("n"), F.sum((F.col("idx") == 1).cast("long")).alias("docs"))
        else:
            ids = {t: self._ids(t)[f"{'true' if ignore_subwords else 'raw'}_{t}"] for t in tx.TAXONOMIES}
            c = self.gold_counts.select(*[x.alias(f"id_{t}") for t, x in ids.items()], "n", "docs")
        rows = F.array(*[F.struct(F.lit(t).alias("taxonomy"), F.col(f"id_{t}").alias("id")) for t in ids])
        return c.select(F.explode(rows).alias("x"), "n", "docs").select("x.*", "n", "docs").groupBy("taxonomy", "id").agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    @property
    def span_stream(self) -> DataFrame:
        """Gold annotations (after the allow-lists) and rule_loose spans of the
        evaluated documents, extracted in one Generate (``src`` = gold | loose)."""
        def build():
            x = C.all_spans(self.docs_en, predict.LOOSE_RULES)
            kept = ((F.col("origin") == "A") & F.col("label").isin(*tx.KEEP_LABELS["A"])) | \
                   ((F.col("origin") == "B") & F.col("label").isin(*tx.KEEP_LABELS["B"]))
            return x.where((F.col("src") == "loose") | kept)
        return self._get("span_stream", build)

    @property
    def both_located(self) -> DataFrame:
        """Gold and rule_loose spans located against the tokens in one join;
        persisted (small) because alignment and every audit read it."""
        return self._get("both_located", lambda: align.locate(
            self.span_stream, self.token_lists, extra_key=["src"], totals=self.totals, places=True).persist(
            StorageLevel.MEMORY_AND_DISK))

    @property
    def located(self) -> DataFrame:
        """Gold spans with start/end token and status (``ok | no_token | empty``)."""
        return self._get("located", lambda: self._gold_located.drop("start_chunk", "end_chunk"))

    @property
    def _gold_located(self) -> DataFrame:
        """``located`` with the chunks of both tokens: of ``both_located`` if a report has made it, else gold spans alone are
        found and meet the marks where their documents lie (persisted)."""
        if "both_located" in self._memo:
            return self.both_located.where(F.col("src") == "gold").drop("src")
        return self._get("gold_located", lambda: align.locate(
            keep_labels_long(C.spans(self.docs_en)).drop("value"), self.token_marks, totals=lexer.chunk_totals(self.token_marks),
            places=True, near=True).persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def gold_counts(self) -> DataFrame:
        """``origin, span_label, is_first, is_subword, g, n, docs``: tokens by what decides their true tag, and how many of
        them open a document; ``g`` as in ``aligned_plan``.  Counted on the marks, so that no token becomes a row."""
        def build():
            codes, labels, ids = _span_ids()
            acc = align.resolve_overlaps(C.place_documents(self._gold_located)).withColumn(
                "code", F.element_at(codes, F.concat("origin", F.lit("|"), "label")))
            totals = lexer.chunk_totals(self.token_marks)
            cov = align.cover_lists(acc, totals, ["code"]).hint("merge")
            numbered = self.token_marks.join(totals.select(*lexer.CHUNK_KEY, "base").hint("merge"), lexer.CHUNK_KEY)
            x = align.counted(numbered.join(cov, lexer.CHUNK_KEY, "left"))
            x = x.withColumn("g", F.when(F.col("code").isNotNull(), F.struct(
                F.element_at(labels, F.col("code")).alias("span_label"), "is_first", F.element_at(ids, F.col("code")).alias("ids"))))
            return x.select("origin", "g.span_label", "is_first", "is_subword", "g", "n", "docs")
        return self._get("gold_counts", build)

    @property
    def label_counts(self) -> DataFrame:
        """``origin, span_label, is_first, is_subword, n``: tokens by what decides their true tag."""
        key = ["origin", "span_label", "is_first", "is_subword"]
        if "geometry" in self._memo:
            return self.geometry.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return self.gold_counts.select(*key, "n")

    @property
    def loose_located(self) -> DataFrame:
        return self._get("loose_located",
                         lambda: self.both_located.where(F.col("src") == "loose").drop("src", "start_chunk", "end_chunk"))

    @property
    def aligned_plan(self) -> DataFrame:
        """Tokens + covering gold span + covering rule_loose span, with every
        tag id both taxonomies need already resolved per span (lazy): by the operators step by step, on tables of tokens and spans.
        The reports read ``geometry``, the same rows made in one pass.

        Label lookups happen once per *span*, in one literal map; the per-token work is integer CASE
        logic that leaves one column a tag sequence.
        """
        def build():
            # A cached table does not advertise its partitioning: re-place the
            # (small) located spans once for the fold.
            acc = align.resolve_overlaps(C.place_documents(self.both_located), extra_key=["src"])
            is_gold = F.col("src") == "gold"
            codes, labels, ids = _span_ids()
            acc = acc.withColumns({"gold": is_gold, "code": F.element_at(
                codes, F.concat(F.when(is_gold, F.col("origin")).otherwise(F.col("src")), F.lit("|"), F.col("label")))})
            cov = align.cover_lists(acc, self.totals, ["gold", "code"])
            g = align.spread(self._numbered_lists.join(cov.hint("merge"), lexer.CHUNK_KEY, "left"))

            def span(code, first, *more):
                own = F.struct(F.element_at(labels, F.col(code)).alias("span_label"), F.col(first).alias("is_first"), *more,
                               F.element_at(ids, F.col(code)).alias("ids"))
                return F.when(F.col(code).isNotNull(), own)
            g = g.withColumns({"g": span("g_code", "g_first", "ann_pos"), "l": span("l_code", "l_first")})
            g = g.withColumn("h", hash_bucket(F.col("origin"), F.col("doc_id"), F.col("idx")))
            return g.select(
                *lexer.CHUNK_KEY, "lidx", "idx", "tok", "start", "end", "is_subword", "n_tok", "scored", "g.span_label", "g.is_first",
                "g.ann_pos", *[c.alias(n) for t in tx.TAXONOMIES for n, c in self._ids(t).items()])
        return self._get("aligned_plan", build)

    @staticmethod
    def _ids(t: str) -> dict[str, Column]:
        """Tag ids of a token in taxonomy ``t``: scored, with subwords, and of either model."""
        o, ign = F.lit(tx.tag2id(t)["O"]), F.lit(tx.IGNORE_ID)
        first = F.col("g.is_first")
        begin, go_on, other, other_on = (F.col(f"g.ids.{c}_{t}") for c in ("b", "c", "ob", "oc"))
        outside, sub = F.col("g.span_label").isNull(), F.col("is_subword")
        raw = F.when(outside, o).when(first, begin).otherwise(go_on)
        swapped = F.when(outside, o).when(first, go_on).otherwise(begin)
        changed = F.when(outside, F.lit(tx.tag2id(t)["B-" + tx.alt_label(t)[None]])).when(first, other).otherwise(other_on)
        h = F.col("h")
        return {
            f"true_{t}": F.when(sub & ~F.coalesce(first, F.lit(False)), ign).otherwise(raw), f"raw_{t}": raw,
            f"pred_{t}_rule_loose": F.when(F.col("l.span_label").isNull(), o).when(
                F.col("l.is_first"), F.col(f"l.ids.b_{t}")).otherwise(F.col(f"l.ids.c_{t}")),
            f"pred_{t}_noisy": F.when(h < 3, o).when(h < 5, swapped).when(h < 6, changed).otherwise(raw)}

    @property
    def aligned_lists(self) -> DataFrame:
        """The aligned tokens as lists, one row a chunk, materialised.

        It is the persist point every report reuses: written once as Parquet
        under the shared ``spark.checkpoint.dir`` and read back, which cuts
        the lineage (a lost executor re-reads files instead of re-lexing)
        and lets each report read only the columns it needs.  Sessions over the same input share it
        (``checkpoints``); ``release`` gives it up.
        """
        def build():
            lists = checkpoints.bucketed(self.spark, self.sf_dir, "aligned", lambda: aligned.aligned_lists(
                english(C.corpus(self.spark, self.sf_dir)), {k: i for i, k in enumerate(_span_rows(), 1)}, predict.LOOSE_RULES), [])
            self._memo["places"] = checkpoints.bucketed(self.spark, self.sf_dir, "places", lambda: lists.select(
                *lexer.CHUNK_KEY, "n", "base", "before", "n_tok"), [])
            return lists
        return self._get("aligned_lists", build)

    @property
    def places(self) -> DataFrame:
        """One row a chunk of ``aligned_lists`` without its lists, written beside them: counts of tokens, for what needs no token."""
        self.aligned_lists
        return self._memo["places"]

    @property
    def geometry(self) -> DataFrame:
        """The aligned token table: the rows of ``aligned_plan``, read from ``aligned_lists`` (a few bytes a token)."""
        def build():
            labels = [None, None, *[k.split("|")[1] for k in _span_rows() for _ in "cb"]]
            label = F.get(F.expr("array(" + ", ".join(f"CAST({tx._sql_lit(v)} AS STRING)" for v in labels) + ")"), F.col("g"))
            return aligned.rows(self.aligned_lists).select(
                *lexer.CHUNK_KEY, "lidx", "idx", "tok", "start", "end", "is_subword", "n_tok", label.alias("span_label"),
                F.when(F.col("g") > 0, F.col("g") % 2 == 1).alias("is_first"),
                *[c.alias(n) for t in tx.TAXONOMIES for n, c in state_ids(t).items()])
        return self._get("geometry", build)

    def release(self) -> None:
        """Give up the written and persisted tables; those that no other session uses are removed."""
        for name in ("totals", "both_located", "gold_located", "gold_spans"):
            if name in self._memo:
                self._memo[name].unpersist()
        self._memo.clear()
        checkpoints.release(self.spark, self.sf_dir)

    @staticmethod
    def true_tag(taxonomy=None, *, ignore_subwords: bool = True, iob: bool = True) -> Column:
        """Tag text in ``taxonomy`` (a name or a column) for geometry rows."""
        taxonomy = F.col("taxonomy") if taxonomy is None else taxonomy
        return align.tag(None, taxonomy, align.label_in(taxonomy), iob=iob,
                         ignore_subwords=ignore_subwords)

    @staticmethod
    def true_id(t: str, ignore_subwords: bool = True) -> Column:
        return F.col(f"{'true' if ignore_subwords else 'raw'}_{t}")

    @staticmethod
    def pred_id(t: str, model_id: str) -> Column:
        return F.col(f"pred_{t}_{model_id}")

    @staticmethod
    def n_pred(model_id: str) -> Column:
        """Length ``k`` of the model's prediction list for the document."""
        if model_id == "noisy":
            surplus = F.col("doc_id") % predict.SURPLUS_MOD == predict.SURPLUS_AT
            return F.col("n_tok") + surplus.cast("int")
        return F.col("n_tok")

    @property
    def pairs(self) -> DataFrame:
        """Scored positions ``taxonomy, model_id, origin, doc_id, idx, true_id, pred_id``.

        Pairing follows ``zip`` of ``true`` (n+2 entries) with
        ``[-100] + p + [-100]``: token ``idx`` is paired iff ``idx <= k + 1``
        and meets the -100 pad at ``k + 1``.
        """
        def build():
            combos = []
            for t in tx.TAXONOMIES:
                for m in predict.MODELS:
                    k = self.n_pred(m)
                    combos.append(F.struct(
                        F.lit(t).alias("taxonomy"), F.lit(m).alias("model_id"),
                        self.true_id(t).alias("true_id"),
                        F.when(F.col("idx") <= k, self.pred_id(t, m))
                        .otherwise(F.lit(tx.IGNORE_ID)).alias("pred_id"),
                        (F.col("idx") <= k + 1).alias("paired")))
            x = self.geometry.select(*DOC_KEY, "idx", "tok", F.explode(F.array(*combos)).alias("c"))
            return (x.where(F.col("c.paired") & (F.col("c.true_id") != tx.IGNORE_ID))
                    .select("c.taxonomy", "c.model_id", *DOC_KEY, "idx", "tok", "c.true_id", "c.pred_id"))
        return self._get("pairs", build)

    @property
    def sides(self) -> list[tuple[str, str, list, list]]:
        """The truth (``*``) and the models in both taxonomies: prefix codes and label codes by a token's state.

        Lists of predictions are never shorter than the text here (``n_pred``), so all models share the truth's sequence of scored positions.
        """
        def build():
            sides = []
            for t in tx.TAXONOMIES:
                tables, codes = state_tables(t), evaluate.tag_codes(t)
                states = range(len(tables["raw"]) << 7)

                def at(name, i):
                    return tables[name][i] if i < len(tables[name]) else None
                ids = {"*": [at("raw", v >> 7) for v in states], "rule_loose": [at("loose", v >> 2 & 15) for v in states],
                       "noisy": [at("noisy", (v >> 7) * 4 + v % 4) for v in states]}
                for m in ("*", *predict.MODELS):
                    of = [(0, None) if i is None else codes[i] for i in ids[m]]
                    sides.append((t, m, [x for x, _ in of], [x for _, x in of]))
            return sides
        return self._get("sides", build)

    @property
    def tagged(self) -> DataFrame:
        """Tags that aren't ``O``, of the truth (``model_id`` ``*``) and of each model, in both taxonomies, as rows with their places
        among the scored positions of the text (``part, pos, opens`` of ``evaluate.entities``): what ``matched`` decodes on lists."""
        def build():
            x = aligned.rows(self.aligned_lists).join(self.places.select(*lexer.CHUNK_KEY, "before"), lexer.CHUNK_KEY)
            x = x.where(~F.col("is_subword") | (F.col("g") % 2 == 1))
            scored = F.row_number().over(Window.partitionBy(*lexer.CHUNK_KEY).orderBy("lidx"))
            said = []
            for t in tx.TAXONOMIES:
                ids, codes = state_ids(t), evaluate.tag_codes(t)
                px, et = (F.expr("array(" + ", ".join("CAST(NULL AS INT)" if c[i] is None else str(c[i]) for c in codes) + ")") for i in (0, 1))
                for m, c in [("*", f"true_{t}"), *[(m, f"pred_{t}_{m}") for m in predict.MODELS]]:
                    said.append(F.struct(F.lit(t).alias("taxonomy"), F.lit(m).alias("model_id"), F.get(px, ids[c]).alias("px"), F.get(et, ids[c]).alias("et")))
            x = x.withColumn("scored", scored).select(
                *DOC_KEY, F.col("chunk").alias("part"), (F.col("before") + F.col("scored")).alias("pos"),
                ((F.col("scored") == 1) & (F.col("before") > 0)).alias("opens"), F.explode(F.array(*said)).alias("s"))
            return x.select(*DOC_KEY, "part", "pos", "opens", "s.*").where("px <> 0")
        return self._get("tagged", build)

    @property
    def entities(self) -> DataFrame:
        """Entities of the documents of several chunks, the truth's once for every model."""
        def build():
            e = evaluate.entities_of_lists(self.aligned_lists.where("n < n_tok"), self.sides)
            models = F.when(F.col("model_id") == "*", F.array(*[F.lit(m) for m in predict.MODELS])).otherwise(F.array("model_id"))
            return e.withColumns({"is_true": (F.col("model_id") == "*").cast("int"), "model_id": F.explode(models)})
        return self._get("entities", build)

    @property
    def matched(self) -> DataFrame:
        """Entities of all other documents, decoded and matched chunk by chunk."""
        return self._get("matched", lambda: evaluate.matched_lists(self.aligned_lists.where("n = n_tok"), self.sides))

    @property
    def confusion(self) -> DataFrame:
        """O45 of every taxonomy and model: tokens are counted by their few tag ids
        first, and only those counts are given out per taxonomy and model."""
        def build():
            ids, combos = {}, []
            for t in tx.TAXONOMIES:
                ids[f"true_{t}"] = self.true_id(t)
                for m in predict.MODELS:
                    k = self.n_pred(m)
                    ids[f"pred_{t}_{m}"] = F.when(F.col("idx") <= k, self.pred_id(t, m)).when(
                        F.col("idx") == k + 1, F.lit(tx.IGNORE_ID))
                    ids[f"paired_{m}"] = F.col("idx") <= k + 1
                    combos.append(F.struct(
                        F.lit(t).alias("taxonomy"), F.lit(m).alias("model_id"), F.col(f"true_{t}").alias("true_id"),
                        F.col(f"pred_{t}_{m}").alias("pred_id"), F.col(f"paired_{m}").alias("paired")))
            counts = self.geometry.select("origin", *[c.alias(n) for n, c in ids.items()]).groupBy(
                "origin", *ids).agg(F.count(F.lit(1)).alias("n"))
            x = counts.select("origin", "n", F.explode(F.array(*combos)).alias("c")).select("origin", "n", "c.*")
            return evaluate.mask_ignored(x.where("paired")).groupBy(
                *evaluate.CONF_KEY, "true_id", "pred_id").agg(F.sum("n").alias("n"))
        return self._get("confusion", build)


_LINEAGES: dict = {}


def lineage(spark: SparkSession, sf_dir: str) -> Lineage:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _LINEAGES:
        _LINEAGES[key] = Lineage(spark, sf_dir)
    return _LINEAGES[key]

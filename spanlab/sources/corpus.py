"""Annotated corpus built from the ``documents`` table.

Two corpora stand in for the reference's two annotated datasets: origin
``A`` (even ``doc_id``) and origin ``B`` (odd ``doc_id``), each with its own
label taxonomy and language spelling.  Annotations are found by plain
regular expressions; a few faults are planted deterministically so that
every audit operator has something to find.

Offsets of regex matches: Spark has no "find all with positions", so each
rule yields the matches (``regexp_extract_all``) and the text between them
(``split``); a match starts where the running sum of both lengths says.
All rules of a document are exploded in one ``Generate`` and the running
sum is one window over the document partition (no join, no shuffle beyond
the one that places each document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..session import shuffle_partitions

DOC_KEY = ["origin", "doc_id"]

# ---------------------------------------------------------------------------
# Rules of the stand-in annotator (plain regex, no look-around)
# ---------------------------------------------------------------------------
EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TEL_RX = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP_RX = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DIGITS_RX = r"[0-9]{16,}"  # maximal digit runs of 16+ (only length 16 is kept)
HEX40_RX = r"[0-9a-f]{40}"
NAME_PAIR_RX = r"\p{Lu}\p{Ll}+ \p{L}+"
LOOSE_PHONE_RX = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
CAPITALISED_RX = r"\p{Lu}\p{Ll}+"
BLANK_TEXT = " \t\n\u00a0 "

# Rule numbers give the annotation order (ann_pos = rule, then start).
R_EMAIL, R_TEL, R_IP, R_CARD, R_HEX, R_GIVEN, R_LAST, R_SOCIAL, R_EMPTY = range(1, 10)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
           ids: tuple[int, int] | None = None) -> DataFrame:
    """``origin, doc_id, language, lang, split, source_text`` (one row per document); ``ids``: those
    given under ids in this range (both ends), which the scan filters by.

    Documents are hash-placed on ``(origin, doc_id)`` once; every later
    per-document window, aggregate and join reuses that placement.
    """
    d = documents(spark, sf_dir)
    if ids is not None:
        d = d.where(F.col("doc_id").between(*ids))
    origin = F.when(F.col("doc_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))

    def rows(d: DataFrame, doc_id: Column, text: Column) -> DataFrame:
        return d.select(
            origin.alias("origin"),
            doc_id.alias("doc_id"),
            tx.language_name(F.col("lang"), origin).alias("language"),
            F.col("lang"),
            F.when(F.col("doc_id") % 10 < 5, F.lit("validation")).otherwise(F.lit("train")).alias("split"),
            text.alias("source_text"),
        )

    # Planted blank and null texts are rows of their own, under negative ids.
    blank = F.when(F.col("doc_id") % 97 == 13, F.lit(BLANK_TEXT))
    c = rows(d, F.col("doc_id"), F.col("text")).union(
        rows(d.where((F.col("doc_id") % 97).isin(13, 14)), -1 - F.col("doc_id"), blank))
    if columns is not None:
        c = c.select(*columns)
    return c


def place_documents(df: DataFrame) -> DataFrame:
    """Hash-partition a per-document table on the document key."""
    spark = df.sparkSession
    return df.repartition(shuffle_partitions(spark), *DOC_KEY)


_ZIP_TYPE = "array<struct<m:string,gap:string>>"


# What every match of a slow rule holds: a text without it is passed over by a plain search.
_HOLDS = {EMAIL_RX: "@", TEL_RX: " ("}


def _zip(text: Column, pattern: str) -> Column:
    """``[(match, text before it)]`` for every match, plus one trailing
    ``(null, tail)`` element; null for a text without a match, which one search settles.  ``arrays_zip`` keeps this in generated code
    (a lambda ``transform`` would be interpreted per element)."""
    some = text.rlike(pattern)
    if pattern in _HOLDS:
        some = text.contains(_HOLDS[pattern]) & some
    return F.when(some, F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"),
                                     F.split(text, pattern, -1).alias("gap")).cast(_ZIP_TYPE))


def explode_matches(docs: DataFrame, rules: list[tuple[int, Column]]) -> DataFrame:
    """Explode the matches of several rules in one ``Generate`` and give each
    its character offsets: one running sum per (document, rule) over
    ``len(gap) + len(match)``.

    ``rules``: ``(rule number, zipped array column)``; the rule of an element
    is recovered from cumulative array sizes, so no per-element lambda runs.
    Output: ``origin, doc_id, rule, pos, m, mstart, mend``.
    """
    # Arrays and their sizes are computed once per document in a projection
    # *below* the Generate; the Generate then only references columns
    # (expressions next to a generator would be re-evaluated per output row).
    arrays = docs.where(F.col("source_text").isNotNull()).select(
        *DOC_KEY, *[F.coalesce(z, F.array().cast(_ZIP_TYPE)).alias(f"_z{i}") for i, (_, z) in enumerate(rules)])
    arrays = arrays.select(*DOC_KEY, *[F.size(f"_z{i}").alias(f"_n{i}") for i in range(len(rules))],
                           F.concat(*[F.col(f"_z{i}") for i in range(len(rules))]).alias("_all"))
    acc = F.lit(0)
    cum = []
    for i in range(len(rules)):
        acc = acc + F.col(f"_n{i}")
        cum.append(acc.alias(f"_c{i}"))
    arrays = arrays.select(*DOC_KEY, *cum, "_all")
    # posexplode_outer: a plain posexplode makes Catalyst infer
    # ``size(_all) > 0`` and push it (with every regex inside it) below the
    # document placement, running all rules twice, the first time in the
    # scan stage.  Rows of documents without matches carry a null match and
    # are dropped below.
    x = arrays.select(*DOC_KEY, *[f"_c{i}" for i in range(len(rules))],
                      F.posexplode_outer("_all").alias("pos", "x"))
    rule = F.lit(rules[-1][0])
    for i in range(len(rules) - 2, -1, -1):
        rule = F.when(F.col("pos") < F.col(f"_c{i}"), F.lit(rules[i][0])).otherwise(rule)
    x = x.where(F.col("pos").isNotNull()).select(
        *DOC_KEY, rule.alias("rule"), "pos", F.col("x.m").alias("m"), F.col("x.gap").alias("gap"))
    w = (Window.partitionBy(*DOC_KEY, "rule").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("mend", F.sum(F.length("gap") + F.coalesce(F.length("m"), F.lit(0))).over(w))
    return (x.where(F.col("m").isNotNull())
            .withColumn("mstart", F.col("mend") - F.length("m")))


def _annotations(x: DataFrame) -> Column:
    """Annotation structs ``(r, start, end, label, value)`` of one match row."""
    origin = F.col("origin")
    rule, m, mstart, mend = F.col("rule"), F.col("m"), F.col("mstart"), F.col("mend")
    first_len = F.length(F.substring_index(m, " ", 1))
    second = F.substring(m, first_len + 2, 1 << 30)
    second_len = F.length(second)
    is_a = origin == "A"

    def ann(r, start, end, label, value=m):
        return F.struct(F.lit(r).alias("r"), start.cast("int").alias("start"),
                        end.cast("int").alias("end"), label.alias("label"), value.alias("value"))

    card_label = F.when(is_a, F.lit("IDCARD")).when(F.substring(m, 1, 1) == "4",
                                                   F.lit("CREDITCARDNUMBER")).otherwise(F.lit("IDCARDNUM"))
    last_label = F.when(is_a, F.concat(F.lit("LASTNAME"), (1 + second_len % 3).cast("string"))) \
        .otherwise(F.lit("SURNAME"))
    last_start = mstart + first_len + 1 - F.when(~is_a & (second_len % 5 == 0), 1).otherwise(0)
    return (
        F.when(rule == R_EMAIL, F.array(ann(R_EMAIL, mstart, mend, F.lit("EMAIL"))))
        .when(rule == R_TEL, F.array(ann(R_TEL, mstart, mend,
                                         F.when(is_a, F.lit("TEL")).otherwise(F.lit("TELEPHONENUM")))))
        .when(rule == R_IP, F.array(ann(R_IP, mstart, mend, F.lit("IP"))))
        .when((rule == R_CARD) & (F.length(m) == 16), F.array(ann(R_CARD, mstart, mend, card_label)))
        .when(rule == R_HEX, F.array(ann(R_HEX, mstart, mend,
                                         F.when(is_a, F.lit("PASS")).otherwise(F.lit("TAXNUM")))))
        .when(rule == R_GIVEN, F.array(
            ann(R_GIVEN, mstart, mstart + first_len,
                F.when(is_a, F.lit("GIVENNAME1")).otherwise(F.lit("GIVENNAME")),
                F.substring_index(m, " ", 1)),
            ann(R_LAST, last_start, mend, last_label,
                F.when(~is_a & (second_len % 5 == 0), F.concat(F.lit(" "), second)).otherwise(second))))
        .when(rule == R_SOCIAL, F.array(ann(R_SOCIAL, mstart, mend,
                                            F.when(is_a, F.lit("SOCIALNUMBER")).otherwise(F.lit("SOCIALNUM")))))
        .when(rule == R_EMPTY, F.array(ann(R_EMPTY, F.lit(0), F.lit(0), F.lit("DATE"), F.lit(""))))
    )


def spans(docs: DataFrame) -> DataFrame:
    """Rule annotations ``origin, doc_id, ann_pos, start, end, label, value``.

    ``docs`` must carry ``origin, doc_id, source_text`` (already placed).
    Labels are in the document's own taxonomy and include out-of-scope ones.
    """
    text = F.col("source_text")
    origin = F.col("origin")
    doc_id = F.col("doc_id")
    empty_span = F.array(F.struct(F.lit("").alias("m"), F.lit("").alias("gap"))).cast(_ZIP_TYPE)
    x = explode_matches(docs, [
        (R_EMAIL, _zip(text, EMAIL_RX)),
        (R_TEL, _zip(text, TEL_RX)),
        (R_IP, F.when(origin == "A", _zip(text, IP_RX))),
        (R_CARD, _zip(text, DIGITS_RX)),
        (R_HEX, _zip(text, HEX40_RX)),
        (R_GIVEN, _zip(text, NAME_PAIR_RX)),
        (R_SOCIAL, F.when(doc_id % 10 < 2, _zip(text, LOOSE_PHONE_RX))),
        (R_EMPTY, F.when(doc_id % 50 == 7, empty_span)),
    ])

    anns = _annotations(x)
    a = (x.select(*DOC_KEY, F.explode(anns).alias("a"))
         .select(*DOC_KEY, "a.r", "a.start", "a.end", "a.label", "a.value"))
    w2 = Window.partitionBy(*DOC_KEY).orderBy("r", "start")
    return a.select(
        *DOC_KEY,
        (F.row_number().over(w2) - 1).cast("int").alias("ann_pos"),
        "start", "end", "label", "value",
    )


def all_spans(docs: DataFrame, loose_rules: list[tuple[str, str]]) -> DataFrame:
    """Gold annotations and predicted (rule-model) spans of the same documents
    from ONE ``Generate``: ``src, origin, doc_id, ann_pos, start, end, label``.

    Keeping both in one stream (instead of a union of two streams) keeps the
    ``(origin, doc_id)`` placement, so everything downstream stays
    partition-local.
    """
    text = F.col("source_text")
    origin = F.col("origin")
    doc_id = F.col("doc_id")
    empty_span = F.array(F.struct(F.lit("").alias("m"), F.lit("").alias("gap"))).cast(_ZIP_TYPE)
    base = 100
    x = explode_matches(docs, [
        (R_EMAIL, _zip(text, EMAIL_RX)),
        (R_TEL, _zip(text, TEL_RX)),
        (R_IP, F.when(origin == "A", _zip(text, IP_RX))),
        (R_CARD, _zip(text, DIGITS_RX)),
        (R_HEX, _zip(text, HEX40_RX)),
        (R_GIVEN, _zip(text, NAME_PAIR_RX)),
        (R_SOCIAL, F.when(doc_id % 10 < 2, _zip(text, LOOSE_PHONE_RX))),
        (R_EMPTY, F.when(doc_id % 50 == 7, empty_span)),
    ] + [(base + i + 1, _zip(text, rx)) for i, (_, rx) in enumerate(loose_rules)])
    gold = _annotations(x.where(F.col("rule") < base))
    rule, m = F.col("rule"), F.col("m")
    names = F.element_at(F.array(*[F.lit(n) for n, _ in loose_rules]), rule - base)
    pred = F.array(F.struct(rule.alias("r"), F.col("mstart").cast("int").alias("start"),
                            F.col("mend").cast("int").alias("end"), names.alias("label"),
                            F.lit(None).cast("string").alias("value")))
    anns = F.when(rule < base, gold).otherwise(pred)
    a = (x.select(*DOC_KEY, F.when(rule < base, F.lit("gold")).otherwise(F.lit("loose")).alias("src"),
                  "pos", F.explode(anns).alias("a"))
         .select(*DOC_KEY, "src", "pos", "a.r", "a.start", "a.end", "a.label", "a.value"))
    w = Window.partitionBy(*DOC_KEY, "src").orderBy("r", "start", "pos")
    return a.select("src", *DOC_KEY, (F.row_number().over(w) - 1).cast("int").alias("ann_pos"),
                    "start", "end", "label", "value")


MASK_TYPE = "array<struct<value:string,start:int,end:int,label:string>>"
MASK_TYPE_B = "array<struct<value:string,start:int,end:int,label:string,label_index:int>>"


def annotated(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """The corpus (of one language code, if given) with ``privacy_mask``."""
    c = corpus(spark, sf_dir)
    return annotate(c if lang is None else c.where(F.col("lang") == lang))


def annotate(docs: DataFrame) -> DataFrame:
    """Nested view of some documents: corpus columns + ``privacy_mask``.

    Origin B carries ``label_index`` (0-based position among annotations of
    the same label) like the second reference dataset; origin A leaves it
    null.  The nested form is an edge format; operators work in long form.
    """
    c = place_documents(docs)
    s = spans(c)
    s = s.withColumn(
        "label_index",
        F.when(F.col("origin") == "B",
               F.row_number().over(Window.partitionBy(*DOC_KEY, "label").orderBy("ann_pos")) - 1)
        .cast("int"))
    per_doc = s.groupBy(*DOC_KEY).agg(
        F.array_sort(F.collect_list(F.struct("ann_pos", "value", "start", "end", "label",
                                             "label_index"))).alias("anns"))
    per_doc = per_doc.select(*DOC_KEY, F.transform(
        "anns", lambda a: F.struct(a["value"].alias("value"), a["start"].alias("start"),
                                   a["end"].alias("end"), a["label"].alias("label"),
                                   a["label_index"].alias("label_index"))).alias("privacy_mask"))
    out = c.join(per_doc, DOC_KEY, "left")
    return out.withColumn("privacy_mask", F.coalesce(
        F.col("privacy_mask"), F.array().cast(MASK_TYPE_B)))


def explode_mask(docs: DataFrame, mask: str = "privacy_mask") -> DataFrame:
    """Nested annotations -> long form ``origin, doc_id, ann_pos, start, end, label, value``."""
    return (docs.select(*DOC_KEY, F.posexplode(mask).alias("ann_pos", "a"))
            .select(*DOC_KEY, F.col("ann_pos").cast("int"), F.col("a.start").cast("int").alias("start"),
                    F.col("a.end").cast("int").alias("end"), F.col("a.label").alias("label"),
                    F.col("a.value").alias("value")))

"""Annotation audit.

Inputs are the located spans (one row per annotation with its start/end
token) and the aligned token table.  Counts are partial + final hash
aggregates keyed by label, so a hot label (``O`` holds most tokens) is
pre-aggregated on every partition before the small shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions.text import mean_1dp, percent_0dp, half_even_div
from ..sources.corpus import DOC_KEY

TOTAL = "(total)"

# Labels spot-checked per taxonomy.
SPOT_LABELS = {
    "A": ["GIVENNAME1", "LASTNAME1", "SEX", "TITLE", "BUILDING", "EMAIL"],
    "B": ["GIVENNAME", "SURNAME", "TITLE", "BUILDINGNUM", "SEX", "EMAIL"],
}


def in_taxonomies(df: DataFrame, label: str = "label") -> DataFrame:
    """One copy of each row per taxonomy with ``label`` relabelled into it."""
    x = df.withColumn("taxonomy", F.explode(F.array(*[F.lit(t) for t in tx.TAXONOMIES])))
    return x.withColumn(label, tx.relabel_t(F.col(label), F.col("origin"), F.col("taxonomy")))


def annotation_counts(uspans: DataFrame) -> DataFrame:
    """O37 + O38: annotations per label with min / max / mean character length."""
    ln = F.col("end") - F.col("start")
    g = uspans.groupBy("taxonomy", "label").agg(
        F.count(F.lit(1)).alias("annotations"), F.min(ln).cast("int").alias("min_len"),
        F.max(ln).cast("int").alias("max_len"), F.sum(ln).cast("bigint").alias("_sum"))
    return g.select("taxonomy", "label", "annotations", "min_len", "max_len",
                    mean_1dp(F.col("_sum"), F.col("annotations")).alias("mean_len"))


def token_label_counts(counts: DataFrame, located_t: DataFrame) -> DataFrame:
    """B, I and B+I tokens per label, plus a ``(total)`` row with the
    O and ignored totals (two special tokens per document count as ignored)
    and the start-token failures.

    ``counts``: ``taxonomy, id, n, docs`` (tokens by tag id, documents opened).  Labels and totals are the two
    grouping sets of one aggregate.
    """
    dim = {t: sorted(tx.label_rows(t)) for t in tx.TAXONOMIES}

    def look(at):
        arrays = {t: F.array(*[F.lit(r[at]).cast("string") for r in rows]) for t, rows in dim.items()}
        return F.when(F.col("id") < 0, F.lit(None)).when(F.col("taxonomy") == "A", F.element_at(arrays["A"], F.col("id") + 1)) \
            .otherwise(F.element_at(arrays["B"], F.col("id") + 1))
    fails = located_t.groupBy("taxonomy", "label").agg(F.sum((F.col("status") != "ok").cast("int")).alias("failures"))
    x = counts.select("taxonomy", look(3).alias("kind"), look(2).alias("label"), "n", "docs")
    x = x.groupBy("taxonomy", "label").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (
            ("b_count", F.col("kind") == "B"), ("i_count", F.col("kind") == "I"), ("o_count", F.col("kind") == "O"),
            ("ignored", F.col("kind").isNull()))], F.sum("docs").alias("docs")).join(fails, ["taxonomy", "label"], "full")
    total = F.grouping("label") == 1
    names = ["b_count", "i_count", "o_count", "ignored", "docs", "failures"]
    g = x.groupingSets([["taxonomy", "label"], ["taxonomy"]], "taxonomy", "label").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names], total.alias("total"))
    zero = F.lit(0).cast("bigint")
    bi = F.col("b_count") + F.col("i_count")
    return g.where(F.col("total") | (F.col("label").isNotNull() & (bi > 0))).select(
        "taxonomy", F.when(F.col("total"), F.lit(TOTAL)).otherwise(F.col("label")).alias("label"), "b_count", "i_count", bi.alias("bi_count"),
        F.when(F.col("total"), F.col("o_count")).otherwise(zero).alias("o_count"),
        F.when(F.col("total"), F.col("ignored") + 2 * F.col("docs")).otherwise(zero).alias("ignored_count"),
        F.col("failures").alias("start_failures"))


def coverage_join(ann: DataFrame, tok: DataFrame) -> DataFrame:
    """Label union of annotation and token counts; missing counts are 0."""
    j = ann.select("taxonomy", "label", "annotations").join(
        tok.select("taxonomy", "label", "b_count", "i_count"), ["taxonomy", "label"], "full")
    z = F.lit(0).cast("bigint")
    return j.select("taxonomy", "label", F.coalesce("annotations", z).alias("annotations"),
                    F.coalesce("b_count", z).alias("b_count"), F.coalesce("i_count", z).alias("i_count"),
                    (F.coalesce("b_count", z) + F.coalesce("i_count", z)).alias("bi_count"))


def coverage_report(cov: DataFrame) -> DataFrame:
    """``Match`` = (B+I)/annotations as a rounded percentage; ``OK``
    when both are 0; ``+n`` when tokens carry a label nobody annotated."""
    m = (F.when(F.col("annotations") > 0, percent_0dp(F.col("bi_count"), F.col("annotations")))
         .when(F.col("bi_count") == 0, F.lit("OK"))
         .otherwise(F.concat(F.lit("+"), F.col("bi_count").cast("string"))))
    return cov.withColumn("match", m)


def coverage_anomalies(cov: DataFrame) -> DataFrame:
    """``[!]`` annotations but no B token; ``[?]`` B count off by > 5 %."""
    a, b = F.col("annotations"), F.col("b_count")
    sev = (F.when((a > 0) & (b == 0), F.lit("[!]"))
           .when((a > 0) & (F.abs(b - a) * 100 > a * 5), F.lit("[?]")))
    return cov.select("taxonomy", "label", "annotations", "b_count", sev.alias("severity"),
                      half_even_div(b * 100, a).alias("b_pct")).where(F.col("severity").isNotNull())


def count_mismatch(located: DataFrame, accepted: DataFrame) -> DataFrame:
    """Documents whose number of B tags added differs from their
    number of annotations (overlaps, unmappable and empty spans)."""
    n_ann = located.groupBy(*DOC_KEY).agg(F.count(F.lit(1)).alias("annotations"))
    n_b = accepted.groupBy(*DOC_KEY).agg(F.count(F.lit(1)).alias("b_added"))
    j = n_ann.join(n_b, DOC_KEY, "left").select(
        *DOC_KEY, "annotations", F.coalesce("b_added", F.lit(0)).cast("bigint").alias("b_added"))
    return j.where(F.col("annotations") != F.col("b_added")) \
        .withColumn("diff", F.col("annotations") - F.col("b_added"))


def first_per_label(uspans: DataFrame, n: int) -> DataFrame:
    """The first ``n`` annotations of each taxonomy and label, with ``rank``: of the taxonomy's own corpus
    first, then by document and list order."""
    own_first = (F.col("origin") != F.col("taxonomy")).cast("int")
    w = Window.partitionBy("taxonomy", "label").orderBy(own_first, "doc_id", "ann_pos")
    return uspans.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rounds(lo: int, hi: int, first: int = 64) -> Iterator[tuple[int, int]]:
    """Ranges of ids that double in size, from a ``first``-th part of all."""
    step = max(1, -(-(hi - lo + 1) // first))
    while lo <= hi:
        yield lo, min(hi, lo + step - 1)
        lo, step = lo + step, step * 2


def first_in_rounds(spans_of: Callable[[int, int], DataFrame], lo: int, hi: int, wanted: dict[str, Iterable[str]], n: int) -> DataFrame:
    """``first_per_label``, reading ids upwards in ranges and stopping once every wanted label is full.

    ``spans_of(lo, hi)``: the annotations of the documents with ids in a range, in both taxonomies.  Ids ascend, so a
    label of which the taxonomy's own corpus has ``n`` can't change any more; a rare one has all ranges read.  Between
    rounds there are ``n`` rows a label, whatever the corpus's size.
    """
    held, schema, spark = [], None, SparkSession.active()
    for a, b in rounds(lo, hi):
        found = spans_of(a, b)
        schema = found.schema
        rows = first_per_label(found, n).drop("rank")
        if held:
            rows = first_per_label(rows.unionByName(spark.createDataFrame(held, schema)), n).drop("rank")
        held = rows.collect()  # at most n for each taxonomy and label
        full = Counter((r["taxonomy"], r["label"]) for r in held if r["origin"] == r["taxonomy"])
        if all(full[t, lab] >= n for t, labels in wanted.items() for lab in labels):
            break
    return first_per_label(spark.createDataFrame(held, schema), n) if schema is not None else None


def sample_entities(uspans: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` surface texts per label (document, then list order)."""
    return first_per_label(uspans, n).select("taxonomy", "label", "rank", "origin", "doc_id", "ann_pos", "value")


def of_interest() -> Column:
    """Labels that are spot-checked."""
    return F.when(F.col("taxonomy") == "A", F.col("label").isin(*SPOT_LABELS["A"])) \
        .otherwise(F.col("label").isin(*SPOT_LABELS["B"]))


def spot_check(located_t: DataFrame, tokens: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` annotations of each label of interest, walked token
    by token: FIRST for the start token, SUB for a subword, CONT otherwise;
    ``NONE`` when the start character has no token."""
    picked = first_per_label(located_t.where(of_interest() & (F.col("status") != "empty")), n)
    walk = picked.select("taxonomy", "label", F.col("rank").alias("ann_rank"), *DOC_KEY, "ann_pos", "start_idx",
                         F.explode_outer(F.sequence("start_idx", "end_idx")).alias("idx"))
    j = walk.join(tokens.select(*DOC_KEY, "idx", "tok", "start", "end", "is_subword"),
                  [*DOC_KEY, "idx"], "left")
    flag = (F.when(F.col("idx").isNull(), F.lit("NONE"))
            .when(F.col("idx") == F.col("start_idx"), F.lit("FIRST"))
            .when(F.col("is_subword"), F.lit("SUB")).otherwise(F.lit("CONT")))
    return j.select("taxonomy", "label", "ann_rank", *DOC_KEY, "ann_pos", "idx", "tok",
                    F.col("start").alias("tok_start"), F.col("end").alias("tok_end"), flag.alias("flag"))

"""Label taxonomies, tag ids, label mappings and reporting scope.

Taxonomy ``A`` is the 28-label set of the first annotated corpus, ``B`` the
20-label set of the second one.  Tag ids are generated by rule from the
sorted label list, exactly as the two models number them:

* A: ``I-<label>`` = rank, ``B-<label>`` = 28 + rank, ``O`` = 56.
* B: ``B-<label>`` = rank, then ``I-<label>`` for every label that has an
  I- tag, in label order, then ``O``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's label sets and mappings)
# ---------------------------------------------------------------------------

RAW_LABELS = {
    "A": ["BOD", "BUILDING", "CARDISSUER", "CITY", "COUNTRY", "DATE", "DRIVERLICENSE",
          "EMAIL", "GEOCOORD", "GIVENNAME1", "GIVENNAME2", "IDCARD", "IP", "LASTNAME1",
          "LASTNAME2", "LASTNAME3", "PASS", "PASSPORT", "POSTCODE", "SECADDRESS", "SEX",
          "SOCIALNUMBER", "STATE", "STREET", "TEL", "TIME", "TITLE", "USERNAME"],
    "B": ["AGE", "BUILDINGNUM", "CITY", "CREDITCARDNUMBER", "DATE", "DRIVERLICENSENUM",
          "EMAIL", "GENDER", "GIVENNAME", "IDCARDNUM", "PASSPORTNUM", "SEX", "SOCIALNUM",
          "STREET", "SURNAME", "TAXNUM", "TELEPHONENUM", "TIME", "TITLE", "ZIPCODE"],
}

# Labels of taxonomy B that have no I- tag (their continuation tokens repeat B-).
NO_I_TAG = {"B": ["AGE", "CREDITCARDNUMBER", "GENDER", "IDCARDNUM", "PASSPORTNUM", "SEX"],
            "A": []}

# Allow-lists applied to each corpus before the union.
KEEP_LABELS = {
    "A": ["TIME", "DATE", "EMAIL", "STREET", "CITY", "SEX", "TITLE", "SOCIALNUMBER", "IDCARD",
          "BUILDING", "POSTCODE", "PASSPORT", "TEL", "DRIVERLICENSE", "GIVENNAME1",
          "LASTNAME1", "LASTNAME2", "LASTNAME3"],
    "B": ["TIME", "DATE", "EMAIL", "STREET", "CITY", "SEX", "TITLE", "SOCIALNUM", "IDCARDNUM",
          "BUILDINGNUM", "ZIPCODE", "PASSPORTNUM", "TELEPHONENUM", "DRIVERLICENSENUM",
          "GIVENNAME", "SURNAME"],
}

# Label mappings between the taxonomies: (from, to) -> {from_label: to_label}.
MAPPINGS = {
    ("A", "B"): {"SOCIALNUMBER": "SOCIALNUM", "IDCARD": "IDCARDNUM", "BUILDING": "BUILDINGNUM",
                 "POSTCODE": "ZIPCODE", "PASSPORT": "PASSPORTNUM", "TEL": "TELEPHONENUM",
                 "DRIVERLICENSE": "DRIVERLICENSENUM", "GIVENNAME1": "GIVENNAME",
                 "LASTNAME1": "SURNAME", "LASTNAME2": "SURNAME", "LASTNAME3": "SURNAME"},
    ("B", "A"): {"SOCIALNUM": "SOCIALNUMBER", "IDCARDNUM": "IDCARD", "BUILDINGNUM": "BUILDING",
                 "ZIPCODE": "POSTCODE", "PASSPORTNUM": "PASSPORT", "TELEPHONENUM": "TEL",
                 "DRIVERLICENSENUM": "DRIVERLICENSE", "GIVENNAME": "GIVENNAME1",
                 "SURNAME": "LASTNAME1"},
}

# Labels reported by the classification report (B- and I- tags of these,
# plus O).  A adds GIVENNAME2, which is reported although never kept.
REPORT_LABELS = {
    "A": KEEP_LABELS["A"] + ["GIVENNAME2"],
    "B": KEEP_LABELS["B"],
}

# Labels a model pipeline drops from its own output (ignore list).
MODEL_IGNORE = {
    "A": ["USERNAME", "COUNTRY", "STATE", "PASS", "BOD", "IP", "SECADDRESS", "GEOCOORD",
          "CARDISSUER"],
    "B": ["AGE", "TAXNUM", "CREDITCARDNUMBER", "GENDER"],
}

# How each corpus spells its languages.
LANGUAGE_NAMES = {
    "A": {"en": "English", "fr": "French", "de": "German", "es": "Spanish"},
    "B": {"en": "en", "fr": "fr", "de": "de", "es": "es"},
}

IGNORE_ID = -100
TAXONOMIES = ("A", "B")
OTHER = {"A": "B", "B": "A"}

# ---------------------------------------------------------------------------


@lru_cache(maxsize=None)
def label_rows(taxonomy: str) -> tuple:
    """Rows ``(tag_id, tag, label, prefix, in_scope, has_i)`` generated by rule."""
    labels = sorted(RAW_LABELS[taxonomy])
    no_i = set(NO_I_TAG[taxonomy])
    scope = set(REPORT_LABELS[taxonomy])
    rows = []
    if taxonomy == "A":
        for rank, label in enumerate(labels):
            rows.append((rank, f"I-{label}", label, "I", label in scope, True))
        for rank, label in enumerate(labels):
            rows.append((len(labels) + rank, f"B-{label}", label, "B", label in scope, True))
    else:
        for rank, label in enumerate(labels):
            rows.append((rank, f"B-{label}", label, "B", label in scope, label not in no_i))
        next_id = len(labels)
        for label in labels:
            if label not in no_i:
                rows.append((next_id, f"I-{label}", label, "I", label in scope, True))
                next_id += 1
    rows.append((len(rows), "O", None, "O", True, False))
    return tuple(rows)


def tag2id(taxonomy: str) -> dict[str, int]:
    return {tag: tag_id for tag_id, tag, *_ in label_rows(taxonomy)}


def id2tag(taxonomy: str) -> dict[int, str]:
    return {tag_id: tag for tag_id, tag, *_ in label_rows(taxonomy)}


def has_i(taxonomy: str) -> dict[str, bool]:
    return {label: hi for _, _, label, prefix, _, hi in label_rows(taxonomy) if prefix == "B"}


def plain2id(taxonomy: str) -> dict[str, int]:
    """Ids of tags without B-/I-: labels in alphabetical order, ``O`` last."""
    return {label: i for i, label in enumerate([*sorted(RAW_LABELS[taxonomy]), "O"])}


def scope_ids(taxonomy: str) -> list[int]:
    return [tag_id for tag_id, _, _, _, in_scope, _ in label_rows(taxonomy) if in_scope]


def alt_label(taxonomy: str) -> dict[str | None, str]:
    """Deterministic 'other label' used by the noisy predictor: the next
    reported label in alphabetical order (cyclic); ``O`` maps to the first."""
    labels = sorted(REPORT_LABELS[taxonomy])
    out = {None: labels[0]}
    for i, label in enumerate(labels):
        out[label] = labels[(i + 1) % len(labels)]
    return out


def label_dim(spark: SparkSession) -> DataFrame:
    """Dimension table of both taxonomies (57 + 35 rows)."""
    rows = [(t, *r) for t in TAXONOMIES for r in label_rows(t)]
    return spark.createDataFrame(
        rows,
        "taxonomy string, tag_id int, tag string, label string, prefix string, "
        "in_scope boolean, has_i boolean",
    )


# --- column helpers: literal maps, evaluated inside codegen, no join -------

def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(d: dict) -> Column:
    """A literal map built from one SQL expression (one JVM call, not one per entry)."""
    body = ", ".join(f"{_sql_lit(k)}, {_sql_lit(v)}" for k, v in d.items())
    return F.expr(f"map({body})")


def map_label(label: Column, src: str, dst: str) -> Column:
    """Relabel from taxonomy ``src`` to ``dst``; unmapped labels pass through."""
    if src == dst:
        return label
    return F.coalesce(F.element_at(_map(MAPPINGS[(src, dst)]), label), label)


def tag_id(tag: Column, taxonomy: str) -> Column:
    """Tag text -> id (null for an unknown tag: the caller decides)."""
    ids = tag2id(taxonomy)  # a lookup goes through the keys in order: the one that most tokens have comes first
    return F.element_at(_map({"O": ids["O"]} | ids), tag)


def plain_tag_id(tag: Column, taxonomy: str) -> Column:
    """The same for tags without B-/I-."""
    return F.element_at(_map(plain2id(taxonomy)), tag)


def tag_text(tag_id_col: Column, taxonomy: str, ignore_text: str = "SPEC") -> Column:
    return F.when(tag_id_col == IGNORE_ID, F.lit(ignore_text)).otherwise(
        F.element_at(_map(id2tag(taxonomy)), tag_id_col))


def language_name(lang: Column, origin: Column) -> Column:
    a = _map(LANGUAGE_NAMES["A"])
    return F.when(origin == "A", F.coalesce(F.element_at(a, lang), lang)).otherwise(lang)


# --- taxonomy given as a column: one combined literal map keyed "T|key" ----

def _tkey(taxonomy, key: Column) -> Column:
    t = F.lit(taxonomy) if isinstance(taxonomy, str) else taxonomy
    return F.concat(t, F.lit("|"), key)


def _combined(build) -> Column:
    d = {}
    for t in TAXONOMIES:
        for k, v in build(t).items():
            d[f"{t}|{k}"] = v
    return _map(d)


def tag_id_t(tag: Column, taxonomy) -> Column:
    return F.element_at(_combined(tag2id), _tkey(taxonomy, tag))


def has_i_t(label: Column, taxonomy) -> Column:
    return F.coalesce(F.element_at(_combined(has_i), _tkey(taxonomy, label)), F.lit(True))


def alt_label_t(label: Column, taxonomy) -> Column:
    firsts = _combined(lambda t: {"": alt_label(t)[None]})
    others = _combined(lambda t: {k: v for k, v in alt_label(t).items() if k is not None})
    return F.coalesce(F.element_at(others, _tkey(taxonomy, F.coalesce(label, F.lit("")))),
                      F.element_at(firsts, _tkey(taxonomy, F.lit(""))))


def relabel_t(label: Column, src, dst) -> Column:
    """Relabel ``label`` of taxonomy ``src`` into ``dst`` (columns or strings)."""
    src_c = F.lit(src) if isinstance(src, str) else src
    dst_c = F.lit(dst) if isinstance(dst, str) else dst
    m = _map({f"{a}>{b}|{k}": v for (a, b), mp in MAPPINGS.items() for k, v in mp.items()})
    key = F.concat(src_c, F.lit(">"), dst_c, F.lit("|"), label)
    return F.when(src_c == dst_c, label).otherwise(F.coalesce(F.element_at(m, key), label))

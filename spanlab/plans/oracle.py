"""DuckDB SQL for every registered query (the correctness oracle).

The oracle rebuilds the same lineage as ``lineage.py`` from the raw
``documents`` view with plain SQL: regex lists, window sums, joins and a
``list_reduce`` fold.  It is written independently of the Spark code path
(direct range joins instead of bounded candidate joins, SQL ``CASE`` and
dimension joins instead of literal maps) so that agreement means something.

``sql(body, *ctes)`` prefixes ``body`` with the named CTEs and everything
they depend on.
"""

from __future__ import annotations

from ..functions import taxonomy as tx
from ..functions.text import NON_BLANK
from ..operators.lexer import LEX_RX
from ..operators.predict import LOOSE_LABELS, LOOSE_RULES, SURPLUS_AT, SURPLUS_MOD
from ..sources.corpus import (DIGITS_RX, EMAIL_RX, HEX40_RX, IP_RX, LOOSE_PHONE_RX, NAME_PAIR_RX,
                              TEL_RX)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(cols)})"


def _label_dim() -> str:
    rows = [(t, *r) for t in tx.TAXONOMIES for r in tx.label_rows(t)]
    return _values(rows, ["taxonomy", "tag_id", "tag", "label", "prefix", "in_scope", "has_i"])


def _mapping() -> str:
    rows = [(a, b, k, v) for (a, b), m in tx.MAPPINGS.items() for k, v in m.items()]
    return _values(rows, ["src", "dst", "from_label", "to_label"])


def _alt() -> str:
    rows = []
    for t in tx.TAXONOMIES:
        for k, v in tx.alt_label(t).items():
            rows.append((t, "" if k is None else k, v))
    return _values(rows, ["taxonomy", "label", "alt"])


def _loose_labels() -> str:
    rows = [(t, r, lab) for t in tx.TAXONOMIES for r, lab in LOOSE_LABELS[t].items()]
    return _values(rows, ["taxonomy", "rule", "label"])


def _keep() -> str:
    rows = [(t, lab) for t in tx.TAXONOMIES for lab in tx.KEEP_LABELS[t]]
    return _values(rows, ["origin", "label"])


BLANK_SQL = "' ' || chr(9) || chr(10) || chr(160) || ' '"
LANG_A = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in tx.LANGUAGE_NAMES["A"].items())


def _spans_of(src: str) -> str:
    """Rule annotations of the documents in CTE ``src`` (mirrors sources/corpus.py)."""
    def rule(n, rx, where=""):
        w = f"WHERE {where}" if where else ""
        return (f"SELECT origin, doc_id, {n} AS rule, regexp_extract_all(source_text, {q(rx)}) AS ms, "
                f"regexp_split_to_array(source_text, {q(rx)}) AS gs FROM {src} {w}")
    arrays = " UNION ALL ".join([
        rule(1, EMAIL_RX), rule(2, TEL_RX), rule(3, IP_RX, "origin = 'A'"), rule(4, DIGITS_RX),
        rule(5, HEX40_RX), rule(6, NAME_PAIR_RX), rule(8, LOOSE_PHONE_RX, "doc_id % 10 < 2"),
        f"SELECT origin, doc_id, 9 AS rule, [''] AS ms, ['', ''] AS gs FROM {src} WHERE doc_id % 50 = 7",
    ])
    return f"""(
  WITH ra AS (SELECT * FROM ({arrays}) WHERE ms IS NOT NULL),
  mm AS (
    SELECT origin, doc_id, rule, ms[i] AS m,
      CAST(list_sum(list_transform(gs[1:i], lambda y: length(y)))
           + coalesce(list_sum(list_transform(ms[1:i-1], lambda y: length(y))), 0) AS BIGINT) AS mstart
    FROM ra, range(1, len(ms) + 1) r(i)
  ),
  nm AS (
    SELECT origin, doc_id, mstart, m, split_part(m, ' ', 1) AS w1, substr(m, length(split_part(m, ' ', 1)) + 2) AS w2
    FROM mm WHERE rule = 6
  ),
  ann AS (
    SELECT origin, doc_id, 1 AS r, mstart AS s, mstart + length(m) AS e, 'EMAIL' AS label, m AS value FROM mm WHERE rule = 1
    UNION ALL SELECT origin, doc_id, 2, mstart, mstart + length(m), CASE WHEN origin = 'A' THEN 'TEL' ELSE 'TELEPHONENUM' END, m FROM mm WHERE rule = 2
    UNION ALL SELECT origin, doc_id, 3, mstart, mstart + length(m), 'IP', m FROM mm WHERE rule = 3
    UNION ALL SELECT origin, doc_id, 4, mstart, mstart + length(m),
      CASE WHEN origin = 'A' THEN 'IDCARD' WHEN substr(m, 1, 1) = '4' THEN 'CREDITCARDNUMBER' ELSE 'IDCARDNUM' END, m
      FROM mm WHERE rule = 4 AND length(m) = 16
    UNION ALL SELECT origin, doc_id, 5, mstart, mstart + length(m), CASE WHEN origin = 'A' THEN 'PASS' ELSE 'TAXNUM' END, m FROM mm WHERE rule = 5
    UNION ALL SELECT origin, doc_id, 6, mstart, mstart + length(w1), CASE WHEN origin = 'A' THEN 'GIVENNAME1' ELSE 'GIVENNAME' END, w1 FROM nm
    UNION ALL SELECT origin, doc_id, 7,
      mstart + length(w1) + 1 - CASE WHEN origin = 'B' AND length(w2) % 5 = 0 THEN 1 ELSE 0 END,
      mstart + length(m),
      CASE WHEN origin = 'A' THEN 'LASTNAME' || CAST(1 + length(w2) % 3 AS VARCHAR) ELSE 'SURNAME' END,
      CASE WHEN origin = 'B' AND length(w2) % 5 = 0 THEN ' ' || w2 ELSE w2 END FROM nm
    UNION ALL SELECT origin, doc_id, 8, mstart, mstart + length(m), CASE WHEN origin = 'A' THEN 'SOCIALNUMBER' ELSE 'SOCIALNUM' END, m FROM mm WHERE rule = 8
    UNION ALL SELECT origin, doc_id, 9, 0, 0, 'DATE', '' FROM mm WHERE rule = 9
  )
  SELECT origin, doc_id, CAST(row_number() OVER (PARTITION BY origin, doc_id ORDER BY r, s) - 1 AS INTEGER) AS ann_pos,
         CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", label, value
  FROM ann
)"""


def _loose_spans_of(src: str) -> str:
    arrays = " UNION ALL ".join(
        f"SELECT origin, doc_id, {i + 1} AS rule, {q(name)} AS rname, regexp_extract_all(source_text, {q(rx)}) AS ms, "
        f"regexp_split_to_array(source_text, {q(rx)}) AS gs FROM {src}"
        for i, (name, rx) in enumerate(LOOSE_RULES))
    return f"""(
  WITH ra AS (SELECT * FROM ({arrays}) WHERE ms IS NOT NULL),
  mm AS (
    SELECT origin, doc_id, rule, rname, i, ms[i] AS m,
      CAST(list_sum(list_transform(gs[1:i], lambda y: length(y)))
           + coalesce(list_sum(list_transform(ms[1:i-1], lambda y: length(y))), 0) AS BIGINT) AS mstart
    FROM ra, range(1, len(ms) + 1) r(i)
  )
  SELECT origin, doc_id, CAST(row_number() OVER (PARTITION BY origin, doc_id ORDER BY rule, i) - 1 AS INTEGER) AS ann_pos,
         CAST(mstart AS INTEGER) AS start, CAST(mstart + length(m) AS INTEGER) AS "end", rname AS label
  FROM mm
)"""


def _locate(spans: str) -> str:
    return f"""(
  WITH lk AS (
    SELECT origin, doc_id, ann_pos, 0 AS kind, start AS target FROM {spans} WHERE "end" > start
    UNION ALL SELECT origin, doc_id, ann_pos, 1 AS kind, "end" - 1 AS target FROM {spans} WHERE "end" > start
  ),
  hit AS (
    SELECT lk.origin, lk.doc_id, lk.ann_pos, lk.kind, p.is_tok, p.idx_upto, p.n_tok
    FROM lk JOIN pieces p ON p.origin = lk.origin AND p.doc_id = lk.doc_id
      AND p.pstart <= lk.target AND lk.target < p.pend
  ),
  found AS (
    SELECT origin, doc_id, ann_pos,
      max(CASE WHEN kind = 0 AND is_tok THEN idx_upto END) AS start_idx,
      max(CASE WHEN kind = 1 THEN idx_upto END) AS end_hit, max(n_tok) AS n_tok
    FROM hit GROUP BY origin, doc_id, ann_pos
  )
  SELECT s.origin, s.doc_id, s.ann_pos, s.start, s."end", s.label,
    CAST(CASE WHEN s."end" > s.start THEN f.start_idx END AS INTEGER) AS start_idx,
    CAST(CASE WHEN f.start_idx IS NOT NULL AND s."end" > s.start THEN coalesce(f.end_hit, f.n_tok) END AS INTEGER) AS end_idx,
    CASE WHEN s."end" <= s.start THEN 'empty' WHEN f.start_idx IS NULL THEN 'no_token' ELSE 'ok' END AS status
  FROM {spans} s LEFT JOIN found f ON f.origin = s.origin AND f.doc_id = s.doc_id AND f.ann_pos = s.ann_pos
)"""


_ACC = "STRUCT(start_idx INTEGER, neg_pos INTEGER, end_idx INTEGER, ann_pos INTEGER, label VARCHAR)"


def _accepted(located: str) -> str:
    return f"""(
  WITH per_doc AS (
    SELECT origin, doc_id,
      list_reduce(
        list_sort(list({{'start_idx': start_idx, 'neg_pos': -ann_pos, 'end_idx': end_idx, 'ann_pos': ann_pos, 'label': label}}::{_ACC})),
        lambda st, x: CASE WHEN x.start_idx >= st.nf
                           THEN {{'nf': CAST(x.end_idx + 1 AS INTEGER), 'acc': list_append(st.acc, x)}}
                           ELSE st END,
        {{'nf': CAST(0 AS INTEGER), 'acc': CAST([] AS {_ACC}[])}}
      ).acc AS acc
    FROM {located} WHERE status = 'ok' GROUP BY origin, doc_id
  ),
  u AS (SELECT origin, doc_id, unnest(acc) AS a FROM per_doc)
  SELECT origin, doc_id, a.ann_pos AS ann_pos, a.start_idx AS start_idx, a.end_idx AS end_idx, a.label AS label FROM u
)"""


def _cover(accepted: str) -> str:
    return f"""(
  SELECT origin, doc_id, CAST(idx AS INTEGER) AS idx, ann_pos, label AS span_label, idx = start_idx AS is_first
  FROM (SELECT *, unnest(generate_series(start_idx, end_idx)) AS idx FROM {accepted})
)"""


_TAG_SQL = """CASE WHEN {span} IS NULL THEN (CASE WHEN {sub} THEN NULL ELSE 'O' END)
     WHEN {first} THEN 'B-' || {lab}
     WHEN {sub} THEN NULL
     WHEN coalesce({hi}, TRUE) THEN 'I-' || {lab}
     ELSE 'B-' || {lab} END"""


CTES: dict[str, tuple[str, list[str]]] = {
    "label_dim": (_label_dim(), []),
    "mapping": (_mapping(), []),
    "alt": (_alt(), []),
    "loose_labels": (_loose_labels(), []),
    "keep": (_keep(), []),
    "corpus": (f"""SELECT CASE WHEN given % 2 = 0 THEN 'A' ELSE 'B' END AS origin, doc_id,
       CASE WHEN given % 2 = 0 THEN (CASE lang {LANG_A} ELSE lang END) ELSE lang END AS language,
       lang,
       CASE WHEN given % 10 < 5 THEN 'validation' ELSE 'train' END AS split,
       text AS source_text
FROM (SELECT doc_id AS given, doc_id, lang, text FROM documents
      UNION ALL SELECT doc_id, -1 - doc_id, lang, CASE WHEN doc_id % 97 = 13 THEN {BLANK_SQL} END
      FROM documents WHERE doc_id % 97 IN (13, 14))""", []),
    "docs_en": (f"""SELECT * FROM corpus
WHERE ((origin = 'A' AND language = 'English') OR (origin = 'B' AND language = 'en'))
  AND source_text IS NOT NULL AND regexp_matches(source_text, {q(NON_BLANK)})""", ["corpus"]),
    "spans_all": (f"SELECT * FROM {_spans_of('corpus')}", ["corpus"]),
    "gold_spans": (f"""SELECT s.* FROM {_spans_of('docs_en')} s
JOIN keep k ON k.origin = s.origin AND k.label = s.label""", ["docs_en", "keep"]),
    "pieces": (f"""SELECT origin, doc_id, pos, piece,
  CAST(sum(length(piece)) OVER w - length(piece) AS INTEGER) AS pstart,
  CAST(sum(length(piece)) OVER w AS INTEGER) AS pend,
  is_tok,
  CAST(sum(CASE WHEN is_tok THEN 1 ELSE 0 END) OVER w AS INTEGER) AS idx_upto,
  coalesce(lag(is_tok) OVER (PARTITION BY origin, doc_id ORDER BY pos), FALSE) AS is_subword,
  CAST(sum(CASE WHEN is_tok THEN 1 ELSE 0 END) OVER (PARTITION BY origin, doc_id) AS INTEGER) AS n_tok
FROM (
  SELECT origin, doc_id, pos, piece, NOT regexp_matches(piece, {q('^[ \t\n\r]')}) AS is_tok
  FROM (SELECT origin, doc_id,
               generate_subscripts(regexp_extract_all(source_text, {q(LEX_RX)}), 1) - 1 AS pos,
               unnest(regexp_extract_all(source_text, {q(LEX_RX)})) AS piece
        FROM docs_en)
)
WINDOW w AS (PARTITION BY origin, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
               ["docs_en"]),
    "tokens": ("""SELECT origin, doc_id, idx_upto AS idx, piece AS tok, pstart AS start, pend AS "end",
  is_subword, n_tok FROM pieces WHERE is_tok""", ["pieces"]),
    "located": (f"SELECT * FROM {_locate('gold_spans')}", ["gold_spans", "pieces"]),
    "accepted": (f"SELECT * FROM {_accepted('located')}", ["located"]),
    "gold_cover": (f"SELECT * FROM {_cover('accepted')}", ["accepted"]),
    "loose_spans": (f"SELECT * FROM {_loose_spans_of('docs_en')}", ["docs_en"]),
    "loose_located": (f"SELECT * FROM {_locate('loose_spans')}", ["loose_spans", "pieces"]),
    "loose_cover": (f"SELECT * FROM {_cover(_accepted('loose_located'))}", ["loose_located"]),
    "geometry": ("""SELECT t.*, g.span_label, g.is_first, g.ann_pos, l.span_label AS lp_rule, l.is_first AS lp_first
FROM tokens t
LEFT JOIN gold_cover g ON g.origin = t.origin AND g.doc_id = t.doc_id AND g.idx = t.idx
LEFT JOIN loose_cover l ON l.origin = t.origin AND l.doc_id = t.doc_id AND l.idx = t.idx""",
                 ["tokens", "gold_cover", "loose_cover"]),
    "by_tax": ("""SELECT x.*,
  """ + _TAG_SQL.format(span="x.span_label", sub="x.is_subword", first="x.is_first", lab="x.lab", hi="h.has_i") + """ AS true_tag,
  """ + _TAG_SQL.format(span="x.span_label", sub="FALSE", first="x.is_first", lab="x.lab", hi="h.has_i") + """ AS raw_tag
FROM (
  SELECT g.*, tx.taxonomy, coalesce(mp.to_label, g.span_label) AS lab
  FROM geometry g CROSS JOIN (VALUES ('A'), ('B')) tx(taxonomy)
  LEFT JOIN mapping mp ON mp.src = g.origin AND mp.dst = tx.taxonomy AND mp.from_label = g.span_label
) x
LEFT JOIN label_dim h ON h.taxonomy = x.taxonomy AND h.prefix = 'B' AND h.label = x.lab""",
               ["geometry", "mapping", "label_dim"]),
    "all_preds": (f"""SELECT b.taxonomy, m.model_id, b.origin, b.doc_id, b.idx, b.tok, b.true_tag,
    b.n_tok + CASE WHEN m.model_id = 'noisy' AND b.doc_id % {SURPLUS_MOD} = {SURPLUS_AT} THEN 1 ELSE 0 END AS k,
    CASE WHEN m.model_id = 'rule_loose' THEN
      (CASE WHEN b.lp_rule IS NULL OR ll.label IS NULL THEN 'O'
            WHEN b.lp_first THEN 'B-' || ll.label
            WHEN coalesce(hl.has_i, TRUE) THEN 'I-' || ll.label
            ELSE 'B-' || ll.label END)
    ELSE
      (CASE WHEN b.h < 3 THEN 'O'
            WHEN b.h < 5 THEN (CASE WHEN b.raw_tag = 'O' THEN 'O'
                                    WHEN substr(b.raw_tag, 1, 1) = 'B' AND coalesce(hn.has_i, TRUE) THEN 'I-' || substr(b.raw_tag, 3)
                                    ELSE 'B-' || substr(b.raw_tag, 3) END)
            WHEN b.h < 6 THEN (CASE WHEN substr(b.raw_tag, 1, 1) = 'I' AND coalesce(ha.has_i, TRUE) THEN 'I-' || a.alt
                                    ELSE 'B-' || a.alt END)
            ELSE b.raw_tag END)
    END AS pred
  FROM (SELECT *, CAST(('0x' || substr(md5(origin || ',' || CAST(doc_id AS VARCHAR) || ',' || CAST(idx AS VARCHAR)), 1, 4)) AS INTEGER) % 100 AS h,
               CASE WHEN raw_tag = 'O' THEN NULL ELSE substr(raw_tag, 3) END AS raw_label
        FROM by_tax) b
  CROSS JOIN (VALUES ('rule_loose'), ('noisy')) m(model_id)
  LEFT JOIN loose_labels ll ON ll.taxonomy = b.taxonomy AND ll.rule = b.lp_rule
  LEFT JOIN label_dim hl ON hl.taxonomy = b.taxonomy AND hl.prefix = 'B' AND hl.label = ll.label
  LEFT JOIN label_dim hn ON hn.taxonomy = b.taxonomy AND hn.prefix = 'B' AND hn.label = b.raw_label
  LEFT JOIN alt a ON a.taxonomy = b.taxonomy AND a.label = coalesce(b.raw_label, '')
  LEFT JOIN label_dim ha ON ha.taxonomy = b.taxonomy AND ha.prefix = 'B' AND ha.label = a.alt""", ["by_tax", "loose_labels", "label_dim", "alt"]),
    "tag_pairs": ("""SELECT taxonomy, model_id, origin, doc_id, idx, tok, true_tag,
  CASE WHEN idx <= k THEN pred END AS pred_tag
FROM all_preds WHERE true_tag IS NOT NULL AND idx <= k + 1""", ["all_preds"]),
    "pairs": ("""SELECT p.taxonomy, p.model_id, p.origin, p.doc_id, p.idx, t.tag_id AS true_id,
  CASE WHEN p.pred_tag IS NULL THEN -100 ELSE u.tag_id END AS pred_id
FROM tag_pairs p
LEFT JOIN label_dim t ON t.taxonomy = p.taxonomy AND t.tag = p.true_tag
LEFT JOIN label_dim u ON u.taxonomy = p.taxonomy AND u.tag = p.pred_tag""", ["tag_pairs", "label_dim"]),
    "confusion": ("""SELECT taxonomy, origin, model_id, true_id, pred_id, count(*) AS n
FROM pairs WHERE true_id <> -100 GROUP BY ALL""", ["pairs"]),
    "conf_sets": ("""SELECT taxonomy, eval_set, model_id, true_id, pred_id, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, 'own' AS eval_set FROM confusion WHERE origin = taxonomy
  UNION ALL SELECT *, 'concat' AS eval_set FROM confusion
) GROUP BY ALL""", ["confusion"]),
    "report": ("""SELECT f.taxonomy, f.eval_set, f.model_id, f.tag_id, f.tag,
  CAST(coalesce(c.tp, 0) AS BIGINT) AS tp, CAST(coalesce(c.pred_n, 0) AS BIGINT) AS pred_n,
  CAST(coalesce(c.support, 0) AS BIGINT) AS support
FROM (SELECT DISTINCT s.taxonomy, s.eval_set, s.model_id, d.tag_id, d.tag
      FROM conf_sets s JOIN label_dim d ON d.taxonomy = s.taxonomy AND d.in_scope) f
LEFT JOIN (
  SELECT taxonomy, eval_set, model_id, tag_id, sum(tp) AS tp, sum(pred_n) AS pred_n, sum(support) AS support FROM (
    SELECT taxonomy, eval_set, model_id, true_id AS tag_id, CASE WHEN true_id = pred_id THEN n ELSE 0 END AS tp, 0 AS pred_n, n AS support FROM conf_sets
    UNION ALL SELECT taxonomy, eval_set, model_id, pred_id, 0, n, 0 FROM conf_sets
  ) GROUP BY ALL
) c ON c.taxonomy = f.taxonomy AND c.eval_set = f.eval_set AND c.model_id = f.model_id AND c.tag_id = f.tag_id""",
               ["conf_sets", "label_dim"]),
}


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def half_even_div(num: str, den: str) -> str:
    qq = f"CAST(floor(({num}) / ({den})) AS BIGINT)"
    r = f"(({num}) - {qq} * ({den}))"
    return (f"({qq} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {qq} % 2 = 1) "
            f"THEN 1 ELSE 0 END)")


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order) + "\n" + body


def _in_tax(src: str, label: str = "label") -> str:
    """Rows of ``src`` once per taxonomy with ``label`` relabelled into it."""
    return f"""SELECT t.taxonomy, s.* REPLACE (coalesce(mp.to_label, s.{label}) AS {label})
FROM {src} s CROSS JOIN (VALUES ('A'), ('B')) t(taxonomy)
LEFT JOIN mapping mp ON mp.src = s.origin AND mp.dst = t.taxonomy AND mp.from_label = s.{label}"""


def _kinds(col: str) -> str:
    return f"""SELECT taxonomy, origin, doc_id, idx,
  CASE WHEN {col} IS NULL THEN 'IGN' WHEN {col} = 'O' THEN 'O' ELSE substr({col}, 1, 1) END AS kind,
  CASE WHEN {col} IS NOT NULL AND {col} <> 'O' THEN substr({col}, 3) END AS label
FROM by_tax"""


def _tlc(kinds: str) -> str:
    return f"""SELECT * FROM (
  SELECT taxonomy, label, b_count, i_count, b_count + i_count AS bi_count, CAST(0 AS BIGINT) AS o_count,
         CAST(0 AS BIGINT) AS ignored_count, start_failures
  FROM tlc_j_{kinds} WHERE label IS NOT NULL AND b_count + i_count > 0
  UNION ALL
  SELECT j.taxonomy, '(total)', CAST(sum(b_count) AS BIGINT), CAST(sum(i_count) AS BIGINT),
         CAST(sum(b_count) + sum(i_count) AS BIGINT), CAST(sum(o_count) AS BIGINT),
         CAST(sum(ignored_count) + 2 * max(n.n_docs) AS BIGINT), CAST(sum(start_failures) AS BIGINT)
  FROM tlc_j_{kinds} j JOIN n_docs n ON n.taxonomy = j.taxonomy GROUP BY j.taxonomy
)"""


def _tlc_j(kinds: str) -> str:
    return f"""SELECT coalesce(p.taxonomy, f.taxonomy) AS taxonomy, coalesce(p.label, f.label) AS label,
  CAST(coalesce(p.b_count, 0) AS BIGINT) AS b_count, CAST(coalesce(p.i_count, 0) AS BIGINT) AS i_count,
  CAST(coalesce(p.o_count, 0) AS BIGINT) AS o_count, CAST(coalesce(p.ignored_count, 0) AS BIGINT) AS ignored_count,
  CAST(coalesce(f.start_failures, 0) AS BIGINT) AS start_failures
FROM (SELECT taxonomy, label, sum(CASE WHEN kind = 'B' THEN 1 ELSE 0 END) AS b_count,
             sum(CASE WHEN kind = 'I' THEN 1 ELSE 0 END) AS i_count,
             sum(CASE WHEN kind = 'O' THEN 1 ELSE 0 END) AS o_count,
             sum(CASE WHEN kind = 'IGN' THEN 1 ELSE 0 END) AS ignored_count
      FROM {kinds} GROUP BY taxonomy, label) p
FULL JOIN (SELECT taxonomy, label, sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS start_failures
           FROM located_t GROUP BY taxonomy, label) f
  ON p.taxonomy = f.taxonomy AND p.label = f.label"""


CTES.update({
    "spans_li": ("""SELECT *, CASE WHEN origin = 'B' THEN CAST(row_number() OVER (PARTITION BY origin, doc_id, label ORDER BY ann_pos) - 1 AS INTEGER) END AS label_index
FROM spans_all""", ["spans_all"]),
    "annotated": ("""SELECT c.*, coalesce(m.privacy_mask, []) AS privacy_mask FROM corpus c
LEFT JOIN (SELECT origin, doc_id, list({'value': value, 'start': start, 'end': "end", 'label': label, 'label_index': label_index} ORDER BY ann_pos) AS privacy_mask
           FROM spans_li GROUP BY origin, doc_id) m ON m.origin = c.origin AND m.doc_id = c.doc_id""",
                  ["corpus", "spans_li"]),
    "uspans": (_in_tax("gold_spans"), ["gold_spans", "mapping"]),
    "located_t": (_in_tax("located"), ["located", "mapping"]),
    "n_docs": ("""SELECT t.taxonomy, count(*) AS n_docs FROM docs_en CROSS JOIN (VALUES ('A'), ('B')) t(taxonomy)
GROUP BY t.taxonomy""", ["docs_en"]),
    "kinds": (_kinds("true_tag"), ["by_tax"]),
    "kinds_raw": (_kinds("raw_tag"), ["by_tax"]),
    "tlc_j_kinds": (_tlc_j("kinds"), ["kinds", "located_t"]),
    "tlc_j_kinds_raw": (_tlc_j("kinds_raw"), ["kinds_raw", "located_t"]),
    "tlc": (_tlc("kinds"), ["tlc_j_kinds", "n_docs"]),
    "tlc_raw": (_tlc("kinds_raw"), ["tlc_j_kinds_raw", "n_docs"]),
    "ann_counts": ("""SELECT taxonomy, label, count(*) AS annotations, CAST(min("end" - start) AS INTEGER) AS min_len,
  CAST(max("end" - start) AS INTEGER) AS max_len, CAST(sum("end" - start) AS BIGINT) AS _sum
FROM uspans GROUP BY taxonomy, label""", ["uspans"]),
    "coverage": ("""SELECT coalesce(a.taxonomy, t.taxonomy) AS taxonomy, coalesce(a.label, t.label) AS label,
  CAST(coalesce(a.annotations, 0) AS BIGINT) AS annotations, CAST(coalesce(t.b_count, 0) AS BIGINT) AS b_count,
  CAST(coalesce(t.i_count, 0) AS BIGINT) AS i_count,
  CAST(coalesce(t.b_count, 0) + coalesce(t.i_count, 0) AS BIGINT) AS bi_count
FROM ann_counts a FULL JOIN (SELECT * FROM tlc WHERE label <> '(total)') t
  ON a.taxonomy = t.taxonomy AND a.label = t.label""", ["ann_counts", "tlc"]),
})


CTES.update({
    "preds_loose_a": ("""SELECT g.origin, g.doc_id, g.idx, g.tok,
  CASE WHEN g.lp_rule IS NULL OR ll.label IS NULL THEN 'O' WHEN g.lp_first THEN 'B-' || ll.label
       WHEN coalesce(h.has_i, TRUE) THEN 'I-' || ll.label ELSE 'B-' || ll.label END AS pred_tag
FROM geometry g
LEFT JOIN loose_labels ll ON ll.taxonomy = 'A' AND ll.rule = g.lp_rule
LEFT JOIN label_dim h ON h.taxonomy = 'A' AND h.prefix = 'B' AND h.label = ll.label""",
                      ["geometry", "loose_labels", "label_dim"]),
    "flat": ("""SELECT b.taxonomy, f.model_id, coalesce(b.true_tag, 'O') AS t, p.pred AS p
FROM by_tax b JOIN matched f ON f.origin = b.origin AND f.doc_id = b.doc_id AND f.idx = b.idx
JOIN all_preds p ON p.taxonomy = b.taxonomy AND p.model_id = f.model_id AND p.origin = f.origin AND p.doc_id = f.doc_id AND p.idx = f.first""",
             ["by_tax", "all_preds", "matched"]),
})


CTES.update({
    # stage-2 view: English documents before the blank-text filter
    "spans_en_kept": ("""SELECT s.* FROM spans_all s
JOIN corpus c ON c.origin = s.origin AND c.doc_id = s.doc_id
JOIN keep k ON k.origin = s.origin AND k.label = s.label
WHERE (c.origin = 'A' AND c.language = 'English') OR (c.origin = 'B' AND c.language = 'en')""",
                      ["spans_all", "corpus", "keep"]),
    "uspans_en": (_in_tax("spans_en_kept"), ["spans_en_kept", "mapping"]),
})


#: Tokens of a user's tokenizer: up to 200 characters without a blank (``lineage.word_tokenizer``).
WORD_RX = r"[^ \t\n\r]{1,200}"

CTES.update({
    "words": (f"""SELECT *, CAST("end" - length(tok) AS INTEGER) AS start,
  coalesce(lag("end") OVER (PARTITION BY origin, doc_id ORDER BY idx) = "end" - length(tok), FALSE) AS is_subword
FROM (SELECT origin, doc_id, CAST(idx AS INTEGER) AS idx, tok,
        CAST(sum(length(tok) + length(gap)) OVER (PARTITION BY origin, doc_id ORDER BY idx) AS INTEGER) AS "end"
      FROM (SELECT origin, doc_id, generate_subscripts(ms, 1) AS idx, unnest(ms) AS tok, unnest(gs[1:len(ms)]) AS gap
            FROM (SELECT origin, doc_id, regexp_extract_all(source_text, {q(WORD_RX)}) AS ms,
                         regexp_split_to_array(source_text, {q(WORD_RX)}) AS gs FROM docs_en)))""", ["docs_en"]),
    "located_words": ("""SELECT s.origin, s.doc_id, s.ann_pos, s.start, s."end", s.label,
  CASE WHEN s."end" > s.start THEN w.idx END AS start_idx, CASE WHEN s."end" > s.start AND w.idx IS NOT NULL THEN l.idx END AS end_idx,
  CASE WHEN s."end" <= s.start THEN 'empty' WHEN w.idx IS NULL THEN 'no_token' ELSE 'ok' END AS status
FROM gold_spans s
LEFT JOIN words w ON w.origin = s.origin AND w.doc_id = s.doc_id AND w.start <= s.start AND s.start < w."end"
ASOF LEFT JOIN words l ON l.origin = s.origin AND l.doc_id = s.doc_id AND l.start < s."end" """, ["gold_spans", "words"]),
    "cover_words": (f"SELECT * FROM {_cover(_accepted('located_words'))}", ["located_words"]),
})

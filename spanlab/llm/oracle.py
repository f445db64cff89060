"""DuckDB SQL for the queries that SQL can express, each over the whole tables."""

from __future__ import annotations

from .url_markov import END, START, Params, Rule


def _crc_table() -> list[int]:
    """The remainder that each byte leaves."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an expression."""
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(0, (length({digits}) // 2)::BIGINT), lambda i: ('0x' || substr({digits}, (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {values}), lambda c, x: "
            f"xor(c >> 8, {_crc_table()}[xor(c & 255, x) + 1])), 4294967295::BIGINT)")


def op1(shards: int) -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32("coalesce(text, '')")} AS text_crc32, row_number() OVER () AS r
  FROM documents),
draws AS (
  SELECT r, i, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS cost
  FROM rows, range({shards + 1}) t(i)),
homes AS (
  SELECT r, arg_min(i, cost) FILTER (i < {shards}) AS shard, arg_min(i, cost) AS grown_shard FROM draws GROUP BY r),
placed AS (
  SELECT rows.*, shard, grown_shard,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_crc32), 1, 8))::BIGINT % 1024 AS bucket FROM rows JOIN homes USING (r))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
"""


def _leaf(n_chars: str) -> str:
    def part(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} END AS other
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS parts FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, pos AS i, parts AS n, subroot AS d FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT p.lang, p.i, 0 AS part, a.lvl, CASE WHEN (p.i >> a.lvl) % 2 = 1 THEN 'L' ELSE 'R' END AS side, s.d
  FROM placed p JOIN (SELECT DISTINCT lang, lvl, n FROM nodes WHERE n > 1) a ON p.lang IS NOT DISTINCT FROM a.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.lvl = a.lvl AND s.i = xor(p.i >> a.lvl, 1)
  UNION ALL
  SELECT p.lang, p.i, 1, a.lvl, CASE WHEN (r.pos >> a.lvl) % 2 = 1 THEN 'L' ELSE 'R' END, s.d
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT DISTINCT lvl, n FROM tops WHERE n > 1) a
  LEFT JOIN tops s ON s.lvl = a.lvl AND s.i = xor(r.pos >> a.lvl, 1)),
proofs AS (
  SELECT lang, i, list(side || coalesce(d, '') ORDER BY part, lvl) AS proof, string_agg(coalesce(d, ''), '' ORDER BY part, lvl) AS siblings
  FROM steps GROUP BY lang, i),
folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(p.other, p.leaf)], coalesce(q.proof, [])), lambda a, s:
      sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.i = q.i)
SELECT *, folded_root = root AS verified FROM folded
"""


OP11 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS d FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, d, w, length(w) AS n FROM words WHERE length(w) > 0),
total AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l FROM sized),
items AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM items) GROUP BY ALL),
postings AS (
  SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(w) AS t FROM sized)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY t),
impacts AS (
  SELECT d, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_all) // l))) AS impact FROM postings, total),
scored AS (
  SELECT q, item_id, d, doc_id, sum(times * w * impact)::BIGINT AS score FROM asked JOIN weights USING (t) JOIN impacts USING (t)
  GROUP BY q, item_id, d, doc_id HAVING sum(times * w * impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored) WHERE rank <= 20
"""


def op13(rules: list[Rule], p: Params = Params()) -> str:
    k = p.order
    ruled = "NULL", "NULL"
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        ruled = (f"CASE WHEN {fits} THEN '{r.host}{r.path}' ELSE {ruled[0]} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {ruled[1]} END")
    start, end = f"chr({ord(START)})", f"chr({ord(END)})"
    levels = []
    for j in range(k + 1):
        shorter = "1.0 / count(*) OVER () AS s_a, 1.0 / count(*) OVER () AS s_r" if j == 0 else "p.p_a AS s_a, p.p_r AS s_r"
        join = "" if j == 0 else f"JOIN level{j - 1} p ON p.gram = right(c.gram, {j})"
        smooth = ", ".join(f"CASE WHEN n_{c} >= {p.least} THEN ({c} + t_{c} * s_{c}) / (n_{c} + t_{c})::DOUBLE ELSE s_{c} END AS p_{c}" for c in "ar")
        stats = ", ".join(f"sum({c}) OVER w AS n_{c}, count(*) FILTER ({c} > 0) OVER w AS t_{c}" for c in "ar")
        levels.append(f"""level{j} AS (SELECT gram, {smooth} FROM (
  SELECT c.gram, a, r, {stats}, {shorter} FROM (
    SELECT right(gram, {j + 1}) AS gram, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM counted GROUP BY 1) c {join}
  WINDOW w AS (PARTITION BY left(c.gram, {j}))))""")
    return f"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM split),
ruled AS (SELECT *, {ruled[0]} AS rule, {ruled[1]} AS decided FROM parts),
urls AS (
  SELECT url, any_value(decided) AS decided, count(*) AS n, any_value(decided) IS NOT NULL AND {crc32("url")} % 4 <> 2 AS fit FROM ruled GROUP BY url),
positions AS (
  SELECT url, n, decided, fit, substr(repeat({start}, {k}) || url || {end}, i::BIGINT, {k + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM urls)),
counted AS (
  SELECT gram, sum(CASE WHEN fit AND decided = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN fit AND decided = 'block' THEN n ELSE 0 END) AS r
  FROM positions GROUP BY gram),
{", ".join(levels)},
binned AS (
  SELECT url, floor(greatest(least(avg(ln(p_a) - ln(p_r)), {p.edge}), -{p.edge}) * {p.bins})::BIGINT AS bin
  FROM positions JOIN level{k} USING (gram) WHERE NOT fit GROUP BY url),
seen AS (
  SELECT bin, sum(CASE WHEN decided = 'allow' THEN n ELSE 0 END)::HUGEINT AS a, sum(CASE WHEN decided = 'block' THEN n ELSE 0 END)::HUGEINT AS r
  FROM binned JOIN urls USING (url) WHERE decided IS NOT NULL GROUP BY bin),
ends AS (SELECT bin AS e, a, r FROM seen UNION ALL SELECT max(abs(bin)) + 1, 0, 0 FROM seen),
losses AS (
  SELECT least(greatest(0, coalesce(lag(e) OVER (ORDER BY e) + 1, -max(e) OVER ())), e) AS e,
    (sum(a) OVER (ORDER BY e) - a) * sum(r) OVER () + (sum(r) OVER () - sum(r) OVER (ORDER BY e) + r) * sum(a) OVER () AS loss,
    sum(a) OVER () AS all_a, sum(r) OVER () AS all_r FROM ends),
chosen AS (SELECT coalesce((SELECT e FROM losses WHERE all_a > 0 AND all_r > 0 ORDER BY loss, abs(e), e LIMIT 1), 0) AS e),
kinds AS (SELECT count(DISTINCT decided) FILTER (fit) AS k FROM urls)
SELECT page_id, host, path, rule, CASE WHEN decided IS NOT NULL THEN decided WHEN (SELECT k FROM kinds) < 2 THEN 'allow'
  WHEN bin >= (SELECT e FROM chosen) THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN binned USING (url)
"""


# The k-th best alone are kept, ties to smaller ids; components as whole numbers.
OP4 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
usual AS (SELECT len(x) AS dim FROM vectors GROUP BY 1 ORDER BY count(*) DESC, dim DESC LIMIT 1),
kept AS (SELECT DISTINCT vec_id, x FROM vectors WHERE len(x) = (SELECT dim FROM usual)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


OP6 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT d, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT d, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM windows))),
hits AS (SELECT d, p.size, i, item_id FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
hit AS (SELECT d, count(DISTINCT place) AS n FROM (SELECT d, unnest(range(i, i + size)) AS place FROM hits) GROUP BY d),
own AS (SELECT d, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT d, item_id FROM hits) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM w LEFT JOIN hit USING (d) LEFT JOIN own USING (d)
"""


# Equal sets are one class; classes are linked, then documents take their class's component.
OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.c AS x, b.c AS y FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT x AS c, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN component USING (c)
"""

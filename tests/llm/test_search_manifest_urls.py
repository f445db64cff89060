"""Ranked search, Merkle manifest and URL filter: brute force, SQL, properties and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.llm import merkle_manifest, nra_search, queries as Q, url_markov
from spanlab.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    got = compare(Q.QUERIES[name](spark, SF), duck(SF), Q.ORACLE_SQL[name])
    assert got["match"], got


# -- ranked search ---------------------------------------------------------------

def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, k):
    bags = [(i, Counter(WORD.findall(lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        terms = WORD.findall(lower(text))
        found = []
        for i, b, s in bags:
            m = 75 + 25 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
                        for t in terms if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [
    nra_search.Params(k=4), nra_search.Params(k=4, shard_docs=3, first_read=1, seed_shards=2),
    nra_search.Params(k=1, shard_postings=5, first_read=2, seed_shards=3, block_bytes=20)])
def test_search_brute_force(spark, p):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["Été", "ÉTÉ", "été"]
    docs = [(i, " ".join(rng.choices(words, range(15, 0, -1), k=rng.randint(1, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!?"), (None, "w1 w1 w2"), (None, "w1 w1 w2"), (7, "w3"), (103, "w5 " * 5000)]
    docs += [(200 + i, "w9 w9 tie") for i in range(9)]
    items = [(0, "w1 w2 W2 w9"), (1, None), (2, "unknown"), (3, "tie"), (3, "tie"), (None, "ÉTÉ w11"), (4, " ".join(words)), (5, "")]
    table = spark.createDataFrame([(*d, 0, "x", 1.0) for d in docs], "doc_id long, text string, q int, score string, rank double")
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = nra_search.search(table.repartition(3), asked, p).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute_search(docs, items, p.k)


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert nra_search.search(none, some).count() == 0
    assert nra_search.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), some.where("false")).count() == 0


def impact_lists(full):
    order = np.argsort(-full, axis=1, kind="stable")
    return [(3, o, x[o]) for o, x in zip(order, full)]


def test_nra_stops_early_and_exactly():
    rng = np.random.default_rng(3)
    full = (1e6 * rng.pareto(2, 5000) * rng.uniform(.7, 1, (3, 5000))).astype(np.int64)
    total = 3 * full.sum(axis=0)
    best = np.sort(total)[::-1][:5]
    docs, scores, read = nra_search.nra(impact_lists(full), 5000, 5, 1, 16)
    assert (scores == total[docs]).all() and set(np.flatnonzero(total >= best[-1])) == set(docs)
    assert read < 0.1 * full.size
    docs, _, read = nra_search.nra(impact_lists(full), 5000, 5, int(best[0]) + 1, 16)
    assert not len(docs) and read < 0.01 * full.size


def test_nra_ties_and_missing_documents():
    rng = np.random.default_rng(4)
    for _ in range(200):
        full = rng.integers(0, 4, (int(rng.integers(1, 5)), 30))
        lists = []
        for x in full:
            held = np.flatnonzero(x)
            held = held[np.argsort(-x[held], kind="stable")]
            if len(held):
                lists.append((2, held, x[held].astype(np.int64)))
        total, k = 2 * full.sum(axis=0), int(rng.integers(1, 40))
        docs, scores, _ = nra_search.nra(lists, 30, k, 1, 1) if lists else (np.zeros(0, int), np.zeros(0, int), 0)
        least = max(1, np.sort(total)[::-1][k - 1] if k <= 30 else 1)
        assert set(docs) == set(np.flatnonzero(total >= least)) and (scores == total[docs]).all()


# -- manifest --------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fanout):
    """The root, and each leaf's (before, after) on every level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % fanout
            proofs[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + fanout])))
        nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], proofs


def brute_manifest(rows, fanout):
    parts = defaultdict(list)
    for part, i, leaf, other in rows:
        parts[part].append((i is not None, i or 0, leaf, i, other))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = [brute_tree([r[2] for r in sorted(parts[p])], fanout) for p in names]
    root, upper = brute_tree([t[0] for t in trees], fanout)
    out = []
    for name, (subroot, proofs), top in zip(names, trees, upper):
        for (_, _, leaf, i, other), own in zip(sorted(parts[name], key=lambda r: r[:3]), proofs):
            out.append((i, leaf, other, tuple(own + top), subroot, root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout, levels", [(2, 12), (2, 0), (2, 1), (3, 1), (4, 2), (5, 0)])
def test_manifest_brute_force(spark, fanout, levels):
    rng = random.Random(fanout + levels)
    rows = []
    for part, n in ((None, 1), ("", 2), ("a", 37), ("b", 1), ("é", 9), ("z", 16), ("Z", 5)):
        rows += [(part, i, sha(f"{part}/{i}"), sha("x") if i % 7 == 0 else None) for i in range(n)]
    rows += [("a", 5, sha("a/5"), None), ("a", None, sha("no id"), None), ("b", 0, sha("twin"), None)]
    rows = [(p, i, leaf, None) if p == "a" and i == 5 else (p, i, leaf, o) for p, i, leaf, o in rows]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "part string, id long, leaf string, other string").repartition(4)
    got = merkle_manifest.prove(table, fanout, levels)
    out = sorted(((r["id"], r["leaf"], r["other"], tuple((s["before"], s["after"]) for s in r["proof"]), r["subroot"], r["root"])
                  for r in got.collect()), key=str)
    assert out == brute_manifest(rows, fanout)
    folded = got.select((merkle_manifest.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect()
    assert [r["ok"] for r in folded] == [True]


def test_manifest_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "s", "en", None, "t", 1), (7, "é", "en", (1 << 63) - 1, "", 2), (7, "é", "en", (1 << 63) - 1, "", 2),
            (3, None, None, 0, "x" * 100000, 3), *((i, "s", "de", i, "same", 4) for i in range(40))]
    names = "doc_id long, source string, lang string, n_chars long, text string, root int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.op12_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
    got = Q.op12_merkle_manifest(spark, f"{tmp_path}/some").collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    for r in got:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        null = r["doc_id"] in (None, 1)
        assert r["verified"] == (r["folded_root"] == r["root"]) == (not hit or null)
    leaves = {r["doc_id"]: r["leaf"] for r in got}
    assert leaves[None] == sha("-----") and leaves[7] == sha("1:72:é2:en19:92233720368547758070:")


# -- URL filter ------------------------------------------------------------------

def brute_urls(urls, rules, p):
    """Host, path, rule and verdict of each url; models and threshold by plain counting."""
    def part(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (lower(m[1]), m[2]) if m else ("", "")

    def ruled(url):
        host, path = part(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    def grams(url):
        chars = [url_markov.START] * p.order + list(url) + [url_markov.END]
        return [tuple(chars[i:i + p.order + 1]) for i in range(len(url) + 1)]

    distinct = Counter(u or "" for u in urls)
    kinds = {u: (r.verdict if (r := ruled(u)) else None) for u in distinct}
    learnt = {u for u in distinct if kinds[u] and zlib.crc32(u.encode()) % 4 != 2}
    alphabet = {g[-1] for u in distinct for g in grams(u)}
    models = {}
    for kind in ("allow", "block"):
        counts = defaultdict(Counter)
        for u in learnt:
            if kinds[u] == kind:
                for g in grams(u):
                    for k in range(p.order + 1):
                        counts[g[p.order - k:p.order]][g[-1]] += distinct[u]
        models[kind] = counts

    def probability(kind, g):
        out = 1 / len(alphabet)
        for k in range(p.order + 1):
            seen = models[kind].get(g[p.order - k:p.order], {})
            n = sum(seen.values())
            if n >= p.least:
                out = (seen.get(g[-1], 0) + len(seen) * out) / (n + len(seen))
        return out

    if len({kinds[u] for u in learnt}) == 2:
        bins = {}
        for u in distinct.keys() - learnt:
            ratios = [math.log(probability("allow", g)) - math.log(probability("block", g)) for g in grams(u)]
            bins[u] = math.floor(max(min(sum(ratios) / len(ratios), p.edge), -p.edge) * p.bins)
        known = [(b, distinct[u], kinds[u]) for u, b in bins.items() if kinds[u]]
        total = Counter()
        for _, n, kind in known:
            total[kind] += n
        edge = 0
        if total["allow"] and total["block"]:
            def loss(e):
                return (sum(n for b, n, kind in known if kind == "allow" and b < e) * total["block"]
                        + sum(n for b, n, kind in known if kind == "block" and b >= e) * total["allow"])
            edges = {e for b, _, _ in known for e in (b, b + 1)} | {0}
            edge = min(edges, key=lambda e: (loss(e), abs(e), e))
        verdict = {u: "allow" if b >= edge else "block" for u, b in bins.items()}
    else:
        verdict = dict.fromkeys(distinct, "allow")
    for u in urls:
        r = ruled(u)
        yield (*part(u), r and r.host + r.path, r.verdict if r else verdict[u or ""])


def check_urls(spark, urls, rules, p):
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, n int").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_markov.judge(table, rules, p).collect()}
    assert [got[i] for i in range(len(urls))] == list(brute_urls(urls, rules, p)) and len(got) == len(urls)
    return got


RULES = Q.URL_RULES


def test_urls_brute_force(spark):
    rng = random.Random(11)
    good, bad = ["learn", "wiki", "news"], ["casino", "win", "adult"]
    urls = []
    for i in range(240):
        ok = rng.random() < .5
        word = rng.choice(good if ok else bad)
        host = rng.choice(["example.net", "www.example.org"] if ok else ["shop.net", "a.example.com"])
        lang = {"example.net": "en", "www.example.org": "fr", "a.example.com": "de"}.get(host, "xx")
        if rng.random() < .3:
            host, lang = "plain.info", "it"
        urls.append(f"https://{word}-{rng.randint(0, 9)}.{host}/{lang}/{word}/{rng.randint(0, 30)}{rng.choice(['', '?q=' + word, '#top'])}")
    urls += [None, None, "", "no scheme", "://", "http://NET", "http://NET/x", "http://net?x", "http://x.net/", "http://xnet/", "ftp://h\n/p\n", "é://É.NET/",
             "http://a.example.com/de", "http://a.example.com/de/", "http://example.net:80/en/", "a://b://c/d", "x://" + "long/" * 5000]
    urls += ["https://hot.plain.info/it/"] * 200
    check_urls(spark, urls, RULES, url_markov.Params())
    got = check_urls(spark, urls, RULES, url_markov.Params(order=2, least=1))
    by_word = defaultdict(Counter)
    for i, u in enumerate(urls[:240]):
        if "plain.info" in u:
            by_word["good" if any(w in u for w in good) else "bad"][got[i][3]] += 1
    assert by_word["good"]["allow"] > 4 * by_word["good"]["block"] and by_word["bad"]["block"] > 4 * by_word["bad"]["allow"]


@pytest.mark.parametrize("urls", [[], [None], ["http://a.net/x", "http://b.info/"], ["http://only.info/"],
                                  ["http://a.net/x"] * 9 + ["http://a.org/fr/"] * 9])
def test_urls_little_to_learn(spark, urls):
    check_urls(spark, urls, RULES, url_markov.Params())


def test_urls_hot_keys(spark, monkeypatch):
    """Every key on the broadcast path, and none."""
    urls = [f"http://h{i % 5}.{t}/{'en' if t == 'example.net' else 'x'}/{i}" for i in range(40) for t in ("net", "example.net", "info")]
    for hot in (1, 10 ** 9):
        monkeypatch.setattr(url_markov, "HOT", hot)
        check_urls(spark, urls, RULES, url_markov.Params(order=3))

"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks teach two variable-order Markov models, one of accepted and one of
rejected URLs. A character's probability after its context of up to ``order`` characters is smoothed by
Witten and Bell's interpolation: (n(context, char) + kinds(context) x shorter) / (n(context) + kinds(context)),
down to an even share of all characters seen. A context that a model saw fewer than ``least`` times is no node of its
tree; the next shorter one stands in. A URL's score is the mean over its characters and its end of
ln(accepted / rejected). One in four ruled URLs isn't learnt from: on those the threshold is calibrated, the
edge of a 1/1000 bin with the least sum of the shares of accepted URLs below it and rejected ones not below it. URLs
without a rule are allowed from the threshold on.

All counts cover all URLs and stay in Spark tables; nothing learnt is broadcast whole. n-grams are
counted before they are joined, level by level, on keys that meet at most an alphabet of rows. Score and count
tables meet their many rows in two parts: keys that hold over 1 / HOT of all rows, fewer than HOT by
that rule, are broadcast, all others are joined by a shuffle, so that no key's rows fill a task.

Defined results: a null URL, or one without ``://``, has an empty host and path and so no rule; a null URL
scores like an empty one; equal URLs are scored once and get equal verdicts; without learnt URLs of both
kinds no score tells anything and all URLs without a rule are allowed; without both kinds among the calibration
URLs the threshold is 0; of equally good edges the nearest to 0, then the smaller, is taken; an empty table gives
no rows; columns beside page_id and url aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "\u0002", "\u0003"
HOT = 10000  # a key with more than 1 / HOT of all rows is joined by broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block


@dataclass(frozen=True)
class Params:
    order: int = 5
    least: int = 4
    bins: int = 1000  # to a unit of the score
    edge: int = 20  # scores beyond count as this far


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    return (F.coalesce(F.translate(F.regexp_extract(rest, pattern, 1), _UPPER, _LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit("")))


def decide(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule whose host, or a parent domain of it, and path start fit; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column, order: int) -> Column:
    """For every character and the end, it and the ``order`` characters before it (before the first: START)."""
    chars = F.concat(F.array_repeat(F.lit(START), order), F.when(url == "", F.array().cast("array<string>")).otherwise(F.split(url, "")),
                     F.array(F.lit(END)))
    # the inner lambda sees the characters as a variable, so that they are parted once
    return F.flatten(F.transform(F.array(chars), lambda cs: F.transform(
        F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.array_join(F.slice(cs, i, order + 1), ""))))


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row a key and in ``n`` how many of all ``total`` rows hold it."""
    hot = keyed.where(F.col(n) * HOT > total).drop(n)  # fewer than HOT rows
    cold = keyed.where(F.col(n) * HOT <= total).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def log_ratios(counted: DataFrame, p: Params) -> DataFrame:
    """(gram, ratio): ln(accepted / rejected) of the last character of every gram after the rest.

    ``counted``: gram, a and r (occurrences in accepted and rejected URLs learnt from; 0 in others).
    """
    below = None
    for k in range(p.order + 1):  # contexts of k characters
        gram = F.right("gram", F.lit(k + 1))
        level = counted.groupBy(gram.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        level = level.withColumn("context", F.left("gram", F.lit(k)))
        whole = Window.partitionBy("context")
        stats = [s for c in ("a", "r") for s in (
            F.sum(c).over(whole).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).over(whole).alias(f"t_{c}"))]
        if below is None:
            even = (F.lit(1.0) / F.count(F.lit(1)).over(whole))
            level = level.select("gram", "a", "r", *stats, even.alias("s_a"), even.alias("s_r"))
        else:
            level = level.select("gram", "a", "r", *stats, F.right("gram", F.lit(k)).alias("shorter")).join(
                below.select(F.col("gram").alias("shorter"), F.col("p_a").alias("s_a"), F.col("p_r").alias("s_r")), "shorter")
        smooth = [F.when(F.col(f"n_{c}") >= p.least, (F.col(c) + F.col(f"t_{c}") * F.col(f"s_{c}")) / (
            F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"s_{c}")).alias(f"p_{c}") for c in ("a", "r")]
        below = level.select("gram", *smooth)
    return below.select("gram", (F.ln("p_a") - F.ln("p_r")).alias("ratio"))


def threshold(bins: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> int:
    """The bin from which on URLs are allowed."""
    if not accepted.sum() or not rejected.sum():
        return 0
    order = np.argsort(bins)
    bins, a, r = bins[order], accepted[order].astype(object), rejected[order].astype(object)
    low = np.append(0, np.cumsum(a))
    high = r.sum() - np.append(0, np.cumsum(r))
    loss = low * r.sum() + high * a.sum()  # in whole numbers, so that ties are ties
    # all edges from behind one bin up to the next part the URLs alike
    ends = [*(int(x) for x in bins), edge_max(bins)]
    begins = [-ends[-1], *(x + 1 for x in ends[:-1])]
    nearest = [min(max(0, x), y) for x, y in zip(begins, ends)]
    return int(min((x, abs(e), e) for x, e in zip(loss, nearest))[2])


def edge_max(bins: np.ndarray) -> int:
    """An edge beyond all bins, on either side of 0."""
    return int(np.abs(bins).max()) + 1


def scores(urls: DataFrame, p: Params = Params()) -> tuple[DataFrame, int] | None:
    """(u, bin) of every row of ``urls`` that isn't learnt from, and the threshold; None without URLs of both kinds to learn from.

    ``urls``: u (a unique id), url, n (how many rows hold it), verdict (its rule's, or null).
    """
    fit = F.col("verdict").isNotNull() & (F.crc32(F.col("url").cast("binary")) % 4 != 2)
    kinds = {r["verdict"] for r in urls.where(fit).select("verdict").distinct().collect()}
    if len(kinds) < 2:
        return None
    positions = urls.select("u", "n", "verdict", fit.alias("fit"), F.explode(grams(F.col("url"), p.order)).alias("gram"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counted = written(positions.groupBy("gram").agg(
        count(F.col("fit") & (F.col("verdict") == "allow")).alias("a"),
        count(F.col("fit") & (F.col("verdict") == "block")).alias("r"),
        F.sum((~F.col("fit")).cast("long")).alias("asked")), "grams")
    total = counted.agg(F.sum("asked")).first()[0]
    if not total:
        return urls.where("false").select("u", F.lit(0).cast("long").alias("bin")), 0
    ratios = written(log_ratios(counted, p).join(counted.select("gram", "asked").where("asked > 0"), "gram"), "ratios")
    asked = positions.where(~F.col("fit")).select("u", "gram")
    sums = join_counted(asked, ratios, "gram", "asked", total).groupBy("u").agg(F.avg("ratio").alias("score"))
    score = F.greatest(F.least(F.col("score"), F.lit(float(p.edge))), F.lit(float(-p.edge)))
    binned = written(sums.select("u", F.floor(score * p.bins).cast("long").alias("bin")), "url-scores")
    seen = binned.join(urls.where("verdict is not null").select("u", "n", "verdict"), "u").groupBy("bin").agg(
        count(F.col("verdict") == "allow").alias("a"), count(F.col("verdict") == "block").alias("r"))
    got = seen.toArrow()  # at most 2 x edge x bins + 1 rows
    edge = threshold(*(got.column(c).to_numpy().astype(np.int64) for c in ("bin", "a", "r"))) if got.num_rows else 0
    return binned, edge


def judge(pages: DataFrame, rules: list[Rule], p: Params = Params()) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_path(url)
    rows = pages.select("page_id", url.alias("url")).select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", decide(F.col("host"), F.col("path"), rules))
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.first("hit.verdict").alias("verdict"))
    urls = written(urls.withColumn("u", F.monotonically_increasing_id()), "urls")
    scored = scores(urls, p)
    ruled = rows.where("hit is not null").select("page_id", "host", "path", "hit.rule", "hit.verdict")
    rest = rows.where("hit is null").select("page_id", "url", "host", "path")
    total = urls.where("verdict is null").agg(F.sum("n")).first()[0]
    if scored is None or not total:
        rest = rest.withColumn("verdict", F.lit("allow"))
    else:
        binned, edge = scored
        judged = binned.join(urls.where("verdict is null").select("u", "url", "n"), "u").select(
            "url", "n", F.when(F.col("bin") >= edge, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))
        rest = join_counted(rest, judged, "url", "n", total)
    return ruled.unionByName(rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict"))

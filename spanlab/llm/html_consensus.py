"""Main text of web pages by consensus host paths.

Every page's containers are scored by the running text inside them, less link lists and
named page furniture; the best one is named by its generalised path of tags and
classes (numbers stripped). Pages of a host vote in Spark, and the text is
extracted again from the containers on the host's winning path; a page that lacks it
uses the host's next path, and at last its own best container.

Inside the chosen containers menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, known by tag, role and class words. A class or id names furniture
only if all its words do (``sidebar-left``, but not ``content-with-sidebar``), and a container that holds most of the page's
running text is none, whatever its name, unless it holds comments. Blocks are joined in page order; white
space inside a block becomes one space. A host's path is taken if it holds nearly all of the running text
of a page's own best container, else that container is.

Every page is parsed once; its blocks are written. Votes are summed before they are ranked. The hosts' paths meet the
pages by a broadcast while they are small, else in salted groups, so that a host with a third of
all pages is spread over many tasks.

Defined results: null or empty html gives an empty text; a null url is a host of its
own; truncated tags at the end are dropped; repeated rows give equal texts; columns other than
page_id, url and html aren't read.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HOST_PATHS = 8  # paths tried for each host, best first, before a page's own best container
NEARLY_ALL = 0.9  # share of the own container's running text that a host's path must hold
BROADCAST_BYTES = 32 << 20  # of all hosts' paths
SALTS = 32

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z|</?\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME_WORDS = re.compile(r"[a-z]+")

# HTML's own element kinds
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FORMAT = frozenset("b i em strong u s small big sub sup code kbd samp var tt font mark abbr acronym cite q del ins "
                    "time dfn bdi bdo ruby rt rp data output".split())
_INLINE = _FORMAT | frozenset("a span label picture img wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr tbody thead tfoot".split())
_CLOSED_BY_BLOCK = frozenset("p".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table".split())

# Page furniture
_FURNITURE_TAGS = frozenset("nav header footer aside form noscript template svg button select object applet dialog menu "
                            "head canvas audio video map fieldset".split()) | _RAW
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                             "menubar toolbar".split())
_FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu sidebar sidenav aside footer header masthead topbar toolbar "
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe signup login comment comments commentlist respond reply replies disqus "
    "share sharing social related recommended recommendations adsbygoogle breadcrumb breadcrumbs pagination pager popup modal overlay "
    "widget widgets search searchform form copyright legal colophon disclaimer skip hidden".split())
_COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
# words that say where furniture stands or what holds it
_PLACE_WORDS = frozenset(
    "site page main primary secondary global top bottom left right inner outer upper lower post article entry box block container "
    "wrapper wrap area section list item items links link bar slot unit button buttons group row col column holder panel text title "
    "js el module component region zone content center google adsense".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(raw)} if raw.strip(" /") else {}


def _furniture(tag: str, attrs: dict[str, str]) -> str:
    """``tag`` (by tag, role or being hidden), ``name`` (by class or id), ``comments`` (by a name, too) or an empty string."""
    if tag in _FURNITURE_TAGS:
        return "tag"
    if not attrs:
        return ""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return "tag"
    if tag in ("article", "main", "body", "html"):
        return ""
    if attrs.get("role", "").lower() in _FURNITURE_ROLES:
        return "tag"
    # a heading's or paragraph's id is an anchor's name
    for name in f"{attrs.get('class', '')} {'' if tag in _LEAF else attrs.get('id', '')}".split():
        words = set(_NAME_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
        if words & _FURNITURE_WORDS and words <= _FURNITURE_WORDS | _PLACE_WORDS:
            return "comments" if words & _COMMENT_WORDS else "name"
    return ""


def _step(tag: str, attrs: dict[str, str]) -> str:
    """Generalised step of a path: tag, classes and id without numbers."""
    names = [*attrs.get("class", "").split()[:3], *(["#" + attrs["id"]] if attrs.get("id") else [])]
    names = [re.sub(r"\d+", "", n.lower()).replace("/", "").strip("-_") for n in names]
    return ".".join([tag, *[n for n in names if n]])


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """(container path, text, characters inside links, page furniture) of every block of text."""
    out: list[tuple[str, str, int, bool, frozenset]] = []
    # an open element: tag, path of containers, furniture by tag or comments, link, furniture by name around it
    stack: list[tuple[str, str, bool, bool, frozenset]] = [("", "", False, False, frozenset())]
    parts: list[str] = []
    linked = named = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                _, path, sure, _, names = stack[-1]
                out.append((path, text, linked, sure, names))
            parts.clear()
        linked = 0

    def close(tags, scope=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                if not all(s[0] in _INLINE for s in stack[i:]) or (stack[-1][2], stack[-1][4]) != (stack[i - 1][2], stack[i - 1][4]):
                    flush()
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            parts.append(text)
            if stack[-1][3]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in ("br", "hr"):
                flush()
            elif tag not in _FORMAT or any(s[0] == tag for s in stack):
                close((tag,))
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        raw = m[3] if m[2] else m[6]
        attrs = _attributes(raw)
        kind = _furniture(tag, attrs)
        if tag in _FORMAT and not kind:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in _INLINE:
                flush()
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
            close(_CLOSED_BY_BLOCK, _SCOPE | {"div", "article", "section", "td", "li"})
            if tag in ("article", "main"):
                close(("nav", "header", "footer", "menu"))  # left open
            if tag in _SIBLINGS:
                close(_SIBLINGS[tag], _SCOPE)
        _, path, sure, link, names = stack[-1]
        if kind == "name":
            named += 1
            names = names | {named}
        sure = sure or kind in ("tag", "comments")
        if not inline and tag not in _LEAF and tag not in ("html", "body"):
            path = f"{path}/{_step(tag, attrs)}"
        if not raw.endswith("/") or tag not in ("path", "g", "rect"):
            if inline and (sure, names) != (stack[-1][2], stack[-1][4]):
                flush()
            stack.append((tag, path, sure, link or tag == "a", names))
    flush()
    # a name makes no furniture of what holds most of the running text
    held: dict[int, int] = {}
    total = 0
    for _, text, linked, sure, names in out:
        if not sure and 2 * linked <= len(text):
            total += len(text)
            for i in names:
                held[i] = held.get(i, 0) + len(text)
    most = {i for i, k in held.items() if 2 * k > total}
    return [(path, text, linked, sure or bool(names - most)) for path, text, linked, sure, names in out]


def path_scores(found) -> dict[str, tuple[float, float]]:
    """(running text, other text) in characters inside each container path."""
    sums: dict[str, list[float]] = {"": [0.0, 0.0]}
    for path, text, linked, furniture in found:
        bad = furniture or 2 * linked > len(text)
        steps = path.split("/")
        for i in range(1, len(steps) + 1):
            sums.setdefault("/".join(steps[:i]), [0.0, 0.0])[bad] += len(text)
    return {k: (a, b) for k, (a, b) in sums.items()}


def best_path(scores) -> str | None:
    """Most running text less half the rest; the deeper path among equals."""
    good = [(a - b / 2, k.count("/"), k) for k, (a, b) in scores.items() if a > 0]
    return max(good)[2] if good else None


def choose(found, own: str | None, host_paths: list[str]) -> str:
    """The text of a page's blocks (path, text, furniture, running) inside the host's first path that holds nearly all of
    the running text of its ``own`` container, or inside that."""
    if own is None:
        return ""

    def inside(path, of):
        return not of or path == of or path.startswith(of + "/")

    def held(of):
        return sum(len(t) for p, t, furniture, running in found if running and not furniture and inside(p, of))
    enough = NEARLY_ALL * held(own)
    path = next((p for p in host_paths if held(p) >= enough), own)
    return " ".join(t for p, t, furniture, _ in found if not furniture and inside(p, path))


def extract(page: str, host_paths: list[str]) -> str:
    found = blocks(page)
    return choose([(p, t, f, 2 * k <= len(t)) for p, t, k, f in found], best_path(path_scores(found)), host_paths)


_BLOCK = pa.struct([("path", pa.string()), ("text", pa.string()), ("furniture", pa.bool_()), ("running", pa.bool_())])
_PARSED = "blocks array<struct<path:string,text:string,furniture:boolean,running:boolean>>, own string"


def _parse(batches):
    for batch in batches:
        every, own = [], []
        for x in batch.column("html").to_pylist():
            found = blocks(x) if x else []
            own.append(best_path(path_scores(found)) if found else None)
            every.append([{"path": p, "text": t, "furniture": f, "running": 2 * k <= len(t)} for p, t, k, f in found])
        yield pa.record_batch([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(every, pa.list_(_BLOCK)), pa.array(own, pa.string())],
                              names=["page_id", "url", "host", "blocks", "own"])


def _choose(batches):
    for batch in batches:
        texts = [choose([(b["path"], b["text"], b["furniture"], b["running"]) for b in found], own, paths or []) for found, own, paths in
                 zip(*(batch.column(c).to_pylist() for c in ("blocks", "own", "paths")))]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url):
    """Host of a URL, without user and port, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks and own (its best container) of every page, written."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return written(rows.mapInArrow(_parse, f"page_id {kind}, url string, host string, {_PARSED}"), "blocks")


def consensus(found: DataFrame) -> DataFrame:
    """(host, paths): each host's container paths by votes, at most HOST_PATHS."""
    counted = found.where("own is not null").groupBy("host", F.col("own").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc(F.length("path")), "path")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HOST_PATHS)
    return top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("r", "path")))["path"].alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = parsed(pages)
    paths = written(consensus(found), "paths")
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = found.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = found.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "blocks", "own", "paths").mapInArrow(
        _choose, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

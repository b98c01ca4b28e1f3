"""Main text of web pages with site templates removed.

The subtree of each element that may be a template part, menus and adverts included, gets a
hash of its tag, texts and hashed children. Spark counts, per host, on how many different
articles each hash stands; subtrees that recur on many of them are the site's template and
are deleted. Then what the markup itself names as navigation, advert, form or reader
comments goes, however rare; in pages with an article element, the article is the main text.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, stage_table

#: A subtree is template if it stands on this many articles of the host, and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.3
#: On this many articles a container is template on a host of any size; single paragraphs, cells and items need the share.
MANY_PAGES = 10
#: A page is cut only if this share of its main text stays, inside an article and on pages without one;
#: what recurs beyond that is a near copy's own text.
LEAST_LEFT, LEAST_LEFT_PAGE = 0.5, 0.2

#: Most template names that are sent to every task (16 MB); beyond, they are joined.
MOST_SENT = 1 << 21

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style noscript textarea template iframe svg math object canvas audio video title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_JUNK = frozenset("nav aside form footer button select dialog menu head".split()) | _RAW
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th caption thead tbody tfoot section article main "
                   "blockquote pre figure figcaption header footer nav aside form address body html br hr details summary".split())
_CLOSES_P = _BLOCK - {"br"}
#: Elements in an article whose recurring subtrees are template; its paragraphs and headings never are.
_PART = frozenset("div section ul ol table header figure details dl address".split())
#: Elements that a class or id may mark; html, body, article, main, paragraphs, headings and inline text never are.
_HOLDERS = frozenset("div section ul ol li dl table header details figure address center".split())
#: Whole class tokens that name an advert, site or sharing part; looser words are left to the counts per host.
_NAMES = frozenset("ad ads advert adverts advertisement sponsored promo cookie-notice cookie-banner cookie-consent newsletter "
                   "newsletter-signup popup modal sidebar navbar nav navigation menu breadcrumb breadcrumbs footer site-footer "
                   "masthead share sharing share-buttons social-share related-posts related-articles recommended toolbar".split())
#: Whole class tokens and ids of the site's own parts, outside the main element only.
_SITE = frozenset("header site-header topbar sidebar navbar nav navigation menu breadcrumb breadcrumbs footer site-footer masthead".split())
#: Whole class tokens and ids of a list or block of reader comments.
_READERS = frozenset("comments comment comment-list comments-list commentlist comments-area comments-section comment-section "
                     "comment-thread comment-respond disqus_thread disqus-thread disqus".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; the first of a name counts, one without a value has an empty one."""
    out: dict[str, str] = {}
    for name, *vals in _ATTR.findall(text):
        out.setdefault(name.lower(), "".join(vals))
    return out


def _is_readers(tag: str, attrs: dict[str, str]) -> bool:
    return tag in _HOLDERS and not _READERS.isdisjoint((attrs.get("class", "") + " " + attrs.get("id", "")).lower().split())


def _is_junk(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _JUNK or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("article", "main", "body", "html"):
        return False
    if tag in _HOLDERS:
        classes, ids = attrs.get("class", "").lower().split(), attrs.get("id", "").lower().split()
        if not _NAMES.isdisjoint(classes) or not in_article and not _SITE.isdisjoint(classes + ids):
            return True
    return (attrs.get("role", "").lower() in _ROLES or attrs.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None
            or attrs.get("hidden", "until-found").lower() != "until-found")


class _Open:
    """An open element. ``block``: place of the innermost block element on the stack; ``part`` and ``marked``: the
    innermost hashed element around it that no mark covers, and that a mark does."""

    __slots__ = ("tag", "junk", "main", "readers", "block", "part", "marked")

    def __init__(self, tag, junk, main, readers, block, part, marked):
        self.tag, self.junk, self.main, self.readers = tag, junk, main, readers
        self.block, self.part, self.marked = block, part, marked


class _Part:
    __slots__ = ("digest", "key", "up", "container", "depth")

    def __init__(self, tag, sort, up, depth):
        self.digest = hashlib.blake2b((sort + tag).encode("utf-8", "surrogatepass"), digest_size=8)
        self.key, self.up, self.container, self.depth = None, up, tag in _PART, depth


_IMPLIED = ((_CLOSES_P, "p"), (("li",), "li"), (("dt", "dd"), "dd"), (("dt", "dd"), "dt"), (("tr",), "tr"), (("td", "th", "tr"), "td"))


def parse(page: str | None) -> dict:
    """``blocks``: (text, key of the innermost hashed element around it or None, in the main element or not) in
    page order; ``marked``: the same of what the markup names as no main text; ``hashes``: by key, the 64-bit hash of an element's subtree (its texts and its hashed children's hashes);
    ``up``: by key, that of the next hashed element around it or -1, always smaller.
    Every element is touched when it opens and when it closes only: linear in the page, however deep."""
    blocks, hashes, up, stack, buf, marked = [], [], [], [], [], []
    out = {"blocks": blocks, "marked": [], "hashes": hashes, "up": up}
    if not page:
        return out
    top, open_ = _Open("", False, False, False, -1, None, None), {}

    def emit(pieces, part, main, to):
        t = " ".join(htmllib.unescape("".join(pieces)).split())
        pieces.clear()
        if t:
            need, o = [], part
            while o is not None and o.key is None:
                need.append(o)
                o = o.up
            for o in reversed(need):
                o.key = len(hashes)
                hashes.append(0)
                up.append(-1 if o.up is None else o.up.key)
            if part is not None:
                part.digest.update(b"\n" + t.encode("utf-8", "surrogatepass"))
            to.append((t, None if part is None else part.key, main))

    def flush():
        cur = stack[-1] if stack else top
        if buf:
            emit(buf, cur.part, cur.main, blocks)
        if marked:
            emit(marked, cur.marked, False, out["marked"])

    def close(k):
        while len(stack) > k:
            o = stack.pop()
            open_[o.tag] -= 1
            p = o.marked if o.junk else o.part
            if o.junk and marked and not (stack and stack[-1].junk):
                emit(marked, p, False, out["marked"])  # the mark ends here, its text is no one else's
            if p is not None and p.depth == len(stack) and p.key is not None:
                h = int.from_bytes(p.digest.digest(), "little", signed=True)
                hashes[p.key] = h | 1 if p.container else h & ~1          # the lowest bit tells containers
                if p.up is not None:
                    p.up.digest.update(b"\0" + p.digest.digest())

    def text(t):
        (marked if stack and stack[-1].junk else buf).append(t)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        if not m[1]:
            continue                                  # comment, declaration or a broken tag
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag in _BLOCK:
            flush()
        if closing:
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _RAW:                               # its content is not markup
            if not m[2].endswith("/"):
                e = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = e.end() if e else n
            continue
        if tag in _VOID:
            continue
        for closes, within in _IMPLIED:
            if tag in closes and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag == within:
                close(stack[-1].block)
        cur = stack[-1] if stack else top
        is_main = tag in ("article", "main") and not cur.readers
        attrs = _attributes(m[2])
        readers = cur.readers or _is_readers(tag, attrs)
        junk = False if is_main and not cur.main else cur.junk or readers or _is_junk(tag, attrs, cur.main)
        if junk:                                      # the marked element itself and its containers
            part = not cur.junk or tag in _PART
        else:
            part = tag in _PART if cur.main else tag in _BLOCK and not is_main and tag not in ("html", "body")
        if not m[2].endswith("/") or tag in _BLOCK:
            depth, main = len(stack), cur.main or is_main
            stack.append(_Open(tag, junk, main, readers, depth if tag in _BLOCK else cur.block,
                               _Part(tag, "main " if main else "", cur.part, depth) if part and not junk else cur.part,
                               _Part(tag, "marked ", cur.marked if cur.junk else None, depth) if part and junk else cur.marked))
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    close(0)
    if any(b[2] for b in blocks):
        out["blocks"] = [b for b in blocks if b[2]]
    return out


def main_text(page: dict, is_template) -> tuple[str, int]:
    """The main text, and how many blocks the counts deleted. ``is_template`` tells it of each subtree hash.

    Blocks in recurring subtrees go first, then what the markup names. A page whose recurring subtrees hold
    too much of its main text (``LEAST_LEFT``) is a near copy and keeps that."""
    gone = []
    for k, p in enumerate(page["up"]):
        gone.append(bool(is_template[k]) or p >= 0 and gone[p])
    blocks = page["blocks"]
    kept = [t for t, k, _ in blocks if k is None or not gone[k]]
    cut = sum(k is not None and gone[k] for _, k, _ in page["marked"])
    least = LEAST_LEFT if any(main for *_, main in blocks) else LEAST_LEFT_PAGE
    if sum(map(len, kept)) < least * sum(len(t) for t, *_ in blocks):
        kept = [t for t, *_ in blocks]
    return "\n".join(kept), cut + len(blocks) - len(kept)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def named(hashes: list[int], host: str) -> np.ndarray:
    """Names of subtrees of one host: equal for equal subtrees of the same host; the lowest bit stays."""
    h = np.array(hashes, np.int64).view(np.uint64)
    salt = np.array([_digest64(host.encode("utf-8", "surrogatepass"))], np.int64).view(np.uint64)
    return ((mix64(h ^ salt) & ~np.uint64(1)) | (h & np.uint64(1))).view(np.int64)


def _page_key() -> Column:
    """Digest of what a page's text depends on: rows of the same key have the same text."""
    return F.unhex(F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\0"), F.coalesce("html", F.lit(""))), 256))


def outlines(pages: DataFrame) -> DataFrame:
    """key, host, article (hash of its main text), hashes (names of its distinct subtrees); texts stay behind."""
    def run(batches):
        for b in batches:
            hosts = [host_of(u) for u in b.column(1).to_pylist()]
            docs = [parse(h.as_py()) for h in b.column(2)]
            sig = [_digest64("\n".join(x[0] for x in d["blocks"]).encode("utf-8", "surrogatepass")) for d in docs]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(hosts, pa.string()), pa.array(sig, pa.int64()),
                pa.array([np.unique(named(d["hashes"], h)) for d, h in zip(docs, hosts)], pa.list_(pa.int64()))],
                ["key", "host", "article", "hashes"])

    return pages.select(_page_key().alias("key"), "url", "html").mapInArrow(run, "key binary, host string, article long, hashes array<long>")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """hash (name) of the subtrees that stand on ``min_pages`` and ``min_share`` of their host's different articles; for
    containers ``many_pages`` are enough, so that a section's block goes on a large host as on a small one.
    ``pages`` as of :func:`outlines`. Distinct rows and counts combine in the map tasks, so a large host is no hot spot."""
    n = pages.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    seen = (pages.select("host", "article", F.explode("hashes").alias("hash")).distinct()
            .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    container = F.col("hash").bitwiseAND(F.lit(1)) == 1
    often = (F.col("n") >= min_share * F.col("n_host")) | container & (F.col("n") >= many_pages)
    return seen.join(n, "host").where(often).select("hash").distinct()


def _texts(rows: DataFrame, id_col: str, id_type: str, found) -> DataFrame:
    """Second reading of the pages (id, url, html and, without a broadcast table, cut): id, url, text, n_chars, n_cut."""
    def run(batches):
        for b in batches:
            texts, cuts = [], []
            own = b.column(3) if found is None else [None] * b.num_rows
            for u, h, c in zip(b.column(1), b.column(2), own):
                page = parse(h.as_py())
                names = named(page["hashes"], host_of(u.as_py()))
                if found is not None:
                    table = found.value
                    at = np.searchsorted(table, names)
                    hit = table[np.minimum(at, len(table) - 1)] == names if len(table) else np.zeros(len(names), bool)
                else:
                    hit = np.isin(names, np.array(c.as_py() or [], np.int64))
                t, cut = main_text(page, hit)
                texts.append(t)
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64()), pa.array(cuts, pa.int64())],
                                             [id_col, "url", "text", "n_chars", "n_cut"])

    return rows.mapInArrow(run, f"{id_col} {id_type}, url string, text string, n_chars long, n_cut long")


def extract(pages: DataFrame, id_col: str = "page_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, n_cut (blocks deleted by the counts).

    Null and empty html give an empty text; a null url is a host of its own; repeated rows
    each give a row; an empty table gives none; other columns are not read. Character
    references are decoded, white space in a block becomes one space, blocks join by a
    line feed. Long and deeply nested pages take time in proportion to their length.

    The pages are read twice: for the subtree names, of which alone a table is written and counted, and for the
    texts. Up to ``most_sent`` names of templates (a checked count) go to every task; more stay distributed and are
    joined to their pages by the page's digest."""
    id_type = pages.schema[id_col].dataType.simpleString()
    seen = stage_table(outlines(pages), "pages-outline")
    names = stage_table(templates(seen, min_pages, min_share), "pages-templates")
    if names.count() <= most_sent:
        table = np.sort(names.toArrow().column("hash").to_numpy())
        return _texts(pages.select(id_col, "url", "html"), id_col, id_type, pages.sparkSession.sparkContext.broadcast(table))
    hits = (seen.select("key", F.explode("hashes").alias("hash")).join(names, "hash")
            .groupBy("key").agg(F.collect_set("hash").alias("cut")))                 # one page's subtrees at most
    rows = pages.select(id_col, "url", "html", _page_key().alias("_key")).join(hits.withColumnRenamed("key", "_key"), "_key", "left")
    return _texts(rows.select(id_col, "url", "html", "cut"), id_col, id_type, None)

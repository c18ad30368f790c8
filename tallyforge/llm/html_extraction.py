"""HTML extraction by nearest-URL page differencing.

A page is cut into blocks of text. Within each host, pages are ordered by URL path; a page's partner is the neighbour
whose path has the longer prefix in common. The two pages' lines are aligned by longest common subsequence, and lines
that they share are deleted: what pages of a site have in common is the site's, not the article's.

Two kinds of block are not left to the comparison, because it can't judge them: what the markup declares to be other than
the article (navigation, footers, asides, forms, elements classed as adverts, comments and the like) goes even where no
page shares it; what stands inside an article or main element stays even where the neighbour has it too, since copies of
an article and passages that many articles quote are text all the same. Everything else is decided by differencing.

A class, an id or a role rules an element out by a whole name only ("sidebar", not "has-sidebar"), and neither it nor a
form does so to an element outside articles that has an article or main element in it. Names that articles use too
(related, share, notice, header and the like) rule nothing out: blocks named so are decided by differencing, in articles too. Elements whose
name is about reader comments ("user-comments", "comment-list", "comments-1") go, in articles too, unless a page has nothing else or, outside
articles, they have an article in them. Elements inside a line (span, a, b) start no block; if a name rules one out, only its words go.

Blocks: character references decoded, white space to one space, trimmed, blank ones dropped, joined by \\n.

Defined results. Null or empty html, or a page of boilerplate only: empty text. Null url: a host of its own kind, the
empty one. Ties between neighbours: the one before. Rows equal in page_id, url and html get equal results. A host with a
single page: nothing to compare, only declared blocks go. Unclosed elements end with their parent; a truncated tag at the
end is dropped. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, ranged, stored
from .url_filter import url_host, url_path

# Attributes: a quote opens a string only where a value begins; elsewhere it is a character like others.
_ATTRIBUTES = r"""(?>=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|[^>=])*+"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)(" + _ATTRIBUTES + r")>|</?[a-zA-Z][^<>]*\Z|[^<]+|<", re.S)
TRUNCATED = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements that start and end blocks; elements that are never article text; words in class, id or role that say so.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("nav footer aside form button select menu dialog head object audio video canvas".split())
#: Elements whose content isn't parsed. The first two end with the page at the latest, of the others only the tag goes where no end follows.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs footer site-footer"
    " page-footer masthead site-header page-header cookie cookies cookie-banner cookie-notice consent popup modal newsletter subscribe signup login comment comments respond"
    " disqus disqus_thread replies pagination pager toolbar widget complementary contentinfo".split()
)
#: Names of reader comments rule out articles too, each comment being one.
COMMENTS = frozenset("comment comments comment-body reply replies respond".split())
#: What a name says of its kind after its head word.
KINDS = frozenset("area block body box container content form item list section thread wrap wrapper".split())


def about_comments(name: str) -> bool:
    """Whether a class or id has comments as its head word: user-comments, comment-list, comments-1; not comment-status-open."""
    parts = [x for x in re.split("[-_]", name) if x and not x.isdigit()]
    while len(parts) > 1 and parts[-1] in KINDS:
        parts.pop()
    return bool(parts) and parts[-1] in ("comment", "comments", "replies")


def tokens(page: str) -> Iterator[tuple[str | None, str, str]]:
    """Tag name, attributes and whole text of each token, in time linear in the page."""
    at, last, endless = 0, page.rfind(">"), set()
    while at < len(page):
        if at > last:  # no tag ends any more
            cut = page.rfind("<", at)
            yield None, "", page[at : cut if cut >= 0 and TRUNCATED.match(page, cut) else len(page)]
            return
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[1] and m[1].lower()
        yield tag, m[2] or "", m[0]
        if tag in RAW and m[0][1] != "/" and not m[0].endswith("/>") and tag not in endless:
            end = _ends[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW[:2]:
                return
            else:
                endless.add(tag)


_ends = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
WEAK = frozenset("search header notice notification alert promo promotion share sharing social related recommended copyright disclaimer".split())


class _Named:
    """An element that its name rules out, unless an article follows in it; soft: only where the page has something else. outer: one it stands in."""

    def __init__(self, soft: bool, outer: _Named | None):
        self.holds, self.soft, self.outer = True, soft, outer
        self.known: tuple[bool, bool] | None = None

    def rules_out(self) -> tuple[bool, bool]:
        """At the end of the page: whether it, or one it stands in, still holds; and whether one does that isn't soft."""
        path, it = [], self
        while it and it.known is None:
            path.append(it)
            it = it.outer
        some, hard = it.known if it else (False, False)
        for it in reversed(path):
            some, hard = it.known = some or it.holds, hard or (it.holds and not it.soft)
        return some, hard


def blocks_of(page: str | None) -> list[tuple[str, bool]]:
    """Text blocks that the markup doesn't rule out, in page order: (text, whether it stands in an article or main element)."""
    out: list[tuple[str, bool, _Named | None]] = []
    text: list[str] = []
    # open element, whether it is ruled out for good, what rules it out by name, whether it is in an article or main, in an article
    stack: list[tuple[str, bool, _Named | None, bool, bool]] = []
    many: Counter[str] = Counter()
    ruled_out = inside = in_article = False
    named: _Named | None = None

    def flush() -> None:
        if text:
            if block := " ".join("".join(text).split()):
                out.append((block, inside, named))
            text.clear()

    def reset() -> None:
        nonlocal ruled_out, named, inside, in_article
        _, ruled_out, named, inside, in_article = stack[-1] if stack else ("", False, None, False, False)

    def pop(k: int) -> None:
        many.subtract(x[0] for x in stack[k:])
        del stack[k:]
        reset()

    for tag, attributes, got in tokens(page or ""):
        if tag is None:
            if not ruled_out and (got[:1] != "<" or got == "<"):
                text.append(html.unescape(got))
            continue
        if tag == "br" and not ruled_out:
            text.append(" ")
        if tag in BLOCKS:
            flush()
        if got[1] == "/":
            if many[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if any(x[0] in BLOCKS for x in stack[k:]):
                            flush()
                        pop(k)
                        break
                    if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                        break  # a stray end tag doesn't close the article
            continue
        if tag in BLOCKS:
            while stack and stack[-1][0] in CLOSED_BY_BLOCK and (tag not in ("ul", "ol", "p", "div") or stack[-1][0] != "li"):
                pop(len(stack) - 1)
        if tag in VOID or tag in RAW or got.endswith("/>"):
            continue
        said = [a.lower() for x in ATTRIBUTE.finditer(attributes) for a in x.groups()[1:] if a] if "=" in attributes else []
        article, block = tag in ("article", "main"), tag in BLOCKS
        names = {n for a in said for n in a.split()}
        may = not article and tag not in ("body", "html")
        by_name = may and (tag == "form" or not names.isdisjoint(BOILERPLATE))
        soft = may and not by_name and any(map(about_comments, names))
        out_now = (tag in NOT_TEXT and tag != "form") or (tag == "header" and not inside) or (by_name and (in_article or not block)) or (tag == "article" and not names.isdisjoint(COMMENTS))
        weak = block and not article and not names.isdisjoint(WEAK)
        if out_now or by_name or soft or article or weak or tag in ("div", "section", "body", "header", "ul", "ol", "table") or said or tag in CLOSED_BY_BLOCK:
            if article and not in_article and not out_now:  # what it stands in isn't ruled out by names
                for frame in stack:
                    if frame[2]:
                        frame[2].holds = False
                named = None
            mine = _Named(soft, named) if block and (by_name or soft) and not out_now else named
            stack.append((tag, ruled_out or out_now or (soft and not block), mine, (inside or article) and not weak, in_article or tag == "article"))
            many[tag] += 1
            reset()
    flush()
    kept = [(block, within) for block, within, by in out if not (by and by.rules_out()[0])]
    return kept or [(block, within) for block, within, by in out if not by.rules_out()[1]]


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in a and in b of a longest common subsequence: the longest chain among the matching places."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            ends[k : k + 1], links[k : k + 1] = [j], [link]
    pairs, at = [], links[-1] if links else None
    while at:
        pairs.append(at[:2])
        at = at[2]
    pairs.reverse()
    return [i for i, _ in pairs], [j for _, j in pairs]


def _lines(texts: pa.Array) -> pa.Array:
    """Hashes of the undecided blocks."""
    return pa.array([[xxhash.xxh3_64_intdigest(t.encode()) - 2**63 for t, inside in blocks_of(x) if not inside] for x in texts.to_pylist()], pa.list_(pa.int64()))


def _blocks(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_())]))
    return pa.array([[{"text": t, "inside": i} for t, i in blocks_of(x)] for x in texts.to_pylist()], kind)


def _kept(pages: pa.Array, shared: pa.Array) -> pa.Array:
    """Pages' blocks without the undecided ones of these numbers, as texts; null where nothing is shared."""
    out = []
    for blocks, numbers in zip(pages.to_pylist(), shared.to_pylist()):
        if blocks is None:
            out.append(None)
            continue
        gone, n, lines = frozenset(numbers or ()), -1, []
        for block in blocks:
            n += not block["inside"]
            if block["inside"] or n not in gone:
                lines.append(block["text"])
        out.append("\n".join(lines))
    return pa.array(out, pa.string())


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (a before b) -> for either: its place, length of the common path prefix, which side, its shared lines."""
    for batch in batches:
        pos, near, side, shared = [], [], [], []
        for p, x, y, a, b in zip(*(batch.column(n).to_pylist() for n in ("pos", "path_a", "path_b", "a", "b"))):
            n = next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            i, j = common_lines(a, b)
            pos += [p, p + 1]
            near += [n, n]
            side += [0, 1]
            shared += [i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos, pa.int64()), pa.array(near, pa.int32()), pa.array(side, pa.int32()), pa.array(shared, pa.list_(pa.int32()))], ["pos", "near", "side", "shared"]
        )


ORDER = ["host", "path", "url", "page_id", "_h"]


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text."""
    lines, blocks, kept = F.arrow_udf(_lines, "array<bigint>"), F.arrow_udf(_blocks, "array<struct<text:string,inside:boolean>>"), F.arrow_udf(_kept, "string")
    own_key = [F.col("page_id").alias("_id"), F.xxhash64("page_id", "url", "html").alias("_h")]
    keyed = pages.select("page_id", "url", *own_key, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), lines(F.col("html")).alias("lines"))
    ordered = positions(ranged(stored(keyed, "lines"), ORDER, "pages"), ORDER).select(F.col("_pos").alias("pos"), "_id", "_h", "host", "path", "lines")
    before = ordered.select("pos", "host", F.col("path").alias("path_a"), F.col("lines").alias("a"))
    after = ordered.select((F.col("pos") - 1).alias("pos"), "host", F.col("path").alias("path_b"), F.col("lines").alias("b"))
    pairs = before.join(after, ["pos", "host"]).select("pos", "path_a", "path_b", "a", "b")
    judged = pairs.mapInArrow(_align, "pos bigint, near int, side int, shared array<int>")
    nearest = judged.groupBy("pos").agg(F.max(F.struct("near", "side", "shared"))["shared"].alias("shared"))  # side 1: its partner is the one before
    gone = ordered.select("pos", "_id", "_h").join(nearest.where(F.size("shared") > 0), "pos").groupBy(F.col("_id").alias("g_id"), F.col("_h").alias("g_h")).agg(F.first("shared").alias("shared"))
    cut = pages.select("page_id", "url", *own_key, blocks(F.col("html")).alias("blocks"))
    both = cut.join(gone, (F.col("_h") == F.col("g_h")) & F.col("_id").eqNullSafe(F.col("g_id")), "left")
    whole = F.array_join(F.transform("blocks", lambda x: x["text"]), "\n")
    some = kept(F.when(F.col("shared").isNotNull(), F.col("blocks")), F.col("shared"))
    return both.select("page_id", "url", F.coalesce(some, whole).alias("text"))

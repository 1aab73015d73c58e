"""Main text of web pages by consensus of a host's pages.

1. Each page's containers are scored: text outside links and outside boilerplate
   counts fully for the container it stands in, and half as much at every step outwards.
2. Each page votes for its best containers' generalised paths (tag names and
   classes from the root, digits made one sign); votes are summed per host and
   path with map-side partial sums, so a host with a third of all pages is a few
   rows per task.
3. Each page is read again and its text taken from the host's winning path, or
   from the page's own best container where the page lacks that path. The container is widened
   to the outermost article or main element around it; where there is none, outwards below the
   body as long as what is added is mostly text outside links.

Class words of boilerplate count anywhere outside an article or main element. Inside one they count
only as a whole class, or beside words of page furniture (``share-buttons``, not ``share-price``). A
header inside an article keeps its headings.

Defined results: null html or url is empty; a page without text outside
boilerplate gives ''; tags may stay open or end the page; a repeated row is
extracted like the others; no column but page_id, url and html is read.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices, stored

MAX_HOSTS = 100_000  # whose paths (some 100 bytes each) are shipped

# Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "svg", "canvas", "object", "embed", "audio", "video", "menu", "dialog", "iframe", "header", "title"}
MAIN = {"article": 3.0, "main": 2.0}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Class and id words that name boilerplate, and words of page furniture that stand beside them.
_WORDS = (r"ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|toolbar"
          r"|comments?|commentlist|respond|replies|reply|disqus|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social"
          r"|related|recommended|pagination|pager|tags|copyright|legal|disclaimer")
_BAD = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
_FURNITURE = (r"bar|box|list|links?|buttons?|btn|icons?|slot|unit|block|section|area|wrap|wrapper|container|inner|outer|holder|panel|form|text|title|items?|group|row|col|column"
              r"|site|page|post|posts|article|articles|entry|content|main|global|primary|secondary|top|bottom|left|right|sticky|fixed|mobile|desktop|small|large|js|\d+")
_BAD_CLASS = re.compile(rf"(?:^|\s)(?=\S*(?<![^\s_-])(?:{_WORDS})(?![^\s_-]))(?:{_WORDS}|{_FURNITURE})(?:[_-]+(?:{_WORDS}|{_FURNITURE}))*(?=\s|$)", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*|[^>]*)(?:>|$)", re.S)  # a quote left open ends with its tag
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
# Elements that a new block closes if they are still open.
_CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "figure", "address"}
_CLOSES_SELF = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


def _named(attributes: str, inside: bool = False) -> tuple[str, bool]:
    """(class text, whether the element is boilerplate or hidden by its attributes); ``inside`` an article whole classes decide."""
    kind, bad, words = "", False, _BAD_CLASS if inside else _BAD
    for name, a, b, c in _NAMES.findall(attributes):
        value, name = entities.unescape(a or b or c), name.lower()
        if name == "class":
            kind = value
            bad |= bool(words.search(value))
        elif name == "id":
            bad |= bool(words.search(value))
        elif name == "role":
            bad |= value.lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
        elif name == "hidden":
            bad = True
        elif name == "aria-hidden":
            bad |= value.lower() == "true"
        elif name == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return kind, bad


def _step(tag: str, kind: str) -> str:
    """A path step: the tag and its classes, digit runs as one sign."""
    names = sorted({re.sub(r"\d+", "#", k.lower()) for k in kind.split()})
    return ".".join([tag, *names])


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Text blocks outside boilerplate, in page order: (container path, text, characters inside links)."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str, int]] = []  # (tag, path step, 1 for boilerplate, -1 for a heading that is kept in it)
    text: list[str] = []
    links = dropped = link_chars = mains = 0
    path: tuple[str, ...] = ("page",)

    def close_block() -> None:
        nonlocal text, link_chars
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append((path, joined, min(link_chars, len(joined))))
            text = []
        link_chars = 0

    def pop_to(k: int) -> None:
        nonlocal links, dropped, mains, path
        while len(stack) > k:
            tag, _, bad = stack.pop()
            links -= tag == "a"
            mains -= tag in MAIN
            dropped -= bad
        path = ("page", *(s for t, s, _ in stack if t not in INLINE and t != "p" and t not in HEADINGS))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not dropped:
            piece = page[at:stop]
            text.append(piece)
            if links:
                link_chars += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes up to its element, if that is open
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag not in INLINE:
                close_block()
            if k >= 0 and (tag not in INLINE or all(t in INLINE for t, _, _ in stack[k:])):
                pop_to(k)
            continue
        if tag in RAW:
            found = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                text.append(" " * (tag == "br" and not dropped))
            elif not m[3].endswith("/"):
                kind, bad = _named(m[3], mains > 0) if m[3] else ("", False)
                stack.append((tag, tag, int(bad)))
                links += tag == "a"
                dropped += bad
            continue
        close_block()
        if tag in _CLOSES_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] not in INLINE), -1)
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        if tag in _CLOSES_SELF:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or stack[i][0] in _CLOSES_SELF[tag]), -1)
            if k >= 0 and stack[k][0] == tag:
                pop_to(k)
        if tag in VOID:
            continue
        kind, named = _named(m[3], mains > 0) if m[3] else ("", False)
        bad = int((named or tag in DROPPED) and tag not in MAIN and tag not in ("html", "body"))
        if tag in HEADINGS and not bad and dropped == 1 and mains and next(t for t, _, x in reversed(stack) if x == 1) == "header":
            bad = -1  # the heading of an article's own header
        mains += tag in MAIN
        stack.append((tag, _step(tag, kind), bad))
        dropped += bad
        if tag != "p" and tag not in HEADINGS:
            path = (*path, stack[-1][1])
    close_block()
    return out


def container_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Score per container path: text outside links, halved at every step outwards, raised for main elements."""
    scores: dict[str, float] = {}
    for path, text, linked in found:
        worth = max(0.0, len(text) - 2.0 * linked)
        for k in range(len(path), 0, -1):
            name = "/".join(path[:k])
            scores[name] = scores.get(name, 0.0) + worth * MAIN.get(path[k - 1].split(".")[0], 1.0) * 0.5 ** (len(path) - k)
    return scores


def widened(found: list[tuple[tuple[str, ...], str, int]], winner: str) -> tuple[str, ...]:
    """The container to take: the outermost article or main around ``winner``, else as far out as mostly plain text is added."""
    path = tuple(winner.split("/"))
    for k, step in enumerate(path):
        if step.split(".")[0] in MAIN:
            return path[:k + 1]
    while len(path) > 1 and path[-2].split(".")[0] not in ("page", "html", "body"):
        outer = path[:-1]
        added = [(len(text), linked) for p, text, linked in found if p[:len(outer)] == outer and p[:len(path)] != path]
        if 2 * sum(x for _, x in added) > sum(n for n, _ in added):
            break
        path = outer
    return path


def take(found: list[tuple[tuple[str, ...], str, int]], winner: str) -> str:
    """Text of the blocks under ``winner``, widened where any is there, one line each."""
    own = tuple(winner.split("/"))
    if not any(path[:len(own)] == own for path, _, _ in found):
        return ""
    want = widened(found, winner)
    return "\n".join(text for path, text, _ in found if path[:len(want)] == want)


def best(scores: dict[str, float]) -> str:
    return min(scores, key=lambda p: (-scores[p], len(p), p)) if scores else ""


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _votes(batches):
    """Votes of a batch's pages, already summed by host and path."""
    for b in slices(batches, "html"):
        votes: dict[tuple[str, str], list[float]] = {}
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            scores = container_scores(blocks(page))
            total = sum(scores.values())
            top = best(scores)
            for path, s in scores.items():
                if s > 0.25 * scores[top]:
                    v = votes.setdefault((host_of(url), path), [0.0, 0])
                    v[0] += s / total
                    v[1] += path == top
        if votes:
            yield record_batch({"host": pa.array([h for h, _ in votes], pa.string()), "path": pa.array([p for _, p in votes], pa.string()),
                                "share": pa.array([round(v[0] * 1e6) for v in votes.values()], pa.int64()), "firsts": pa.array([v[1] for v in votes.values()], pa.int64())})


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning container path, by summed shares, then first places, then name."""
    votes = arrow_map(pages.select("url", "html"), _votes, "host string, path string, share long, firsts long")
    summed = votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.sum("firsts").alias("firsts"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("share", "firsts", F.negate(F.length("path")), "path")).alias("path"))


def _extract(batches):
    for b in slices(batches, "html"):
        texts = []
        for page, winner in zip(b.column("html").to_pylist(), b.column("path").to_pylist()):
            found = blocks(page)
            text = take(found, winner) if winner else ""
            if not text and found:  # the page lacks the host's path
                text = take(found, best(container_scores(found)))
            texts.append(text)
        yield record_batch({"page_id": b.column("page_id"), "url": b.column("given_url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Up to ``MAX_HOSTS`` hosts' paths are shipped to the pages, which then stay where they are; more
    are joined on the host, and Spark splits a hot host's partition.
    """
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("given_url"),
                      F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    hosts = pages.withColumn("host", host_column())
    paths = stored(host_paths(pages), "host-paths")
    few = paths.count() <= MAX_HOSTS
    joined = hosts.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "given_url", "html", "path")
    return arrow_map(joined, _extract, f"page_id {kind}, url string, text string, n_chars long")


def host_column():
    """The url's host, as ``host_of`` has it."""
    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of)
    return host("url")

"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored and its best one votes, by its path of generalised tags and classes, for its
host; Spark counts the votes. The winning paths of a host then say which containers of each of its pages are read,
so that a page whose own scores mislead is read like the rest of its host. Names of classes only say what may be
noise: a page whose whole text is under such names is scored with them. A page is read once from start to end; what
an odd one costs does not grow faster than its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, slices

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select button audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article body div html main section td".split())
BOILER = frozenset("aside dialog footer form head menu nav".split())
#: Words of classes, ids and roles that mark what is not the article, and words that say nothing beside them.
NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup popular promo promoted promotion promotions recommended related replies reply respond responses search share sharing shares sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
NEUTRAL = frozenset(
    "area article articles bar block blog body bottom box button buttons container content cta desktop entry fixed global group holder icon icons inline inner item items left link links list main middle mobile module news outer page panel post posts primary right row secondary section site slot small sticky stories story text title top unit wrap wrapper zone".split()
)
#: A header of these belongs to the article.
OWN = frozenset("article content entry post story".split())
# A tag ends at its `>`; where a `<` comes first it is text, so no start is searched twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
#: A container gives way to the one around it while that holds at most this much more text.
GROWTH = 1.3
#: Steps of a path, counted from its container outwards.
STEPS = 8
#: The least share of a host's votes that makes a path a winner.
SHARE = 0.05


class Node:
    """A container: its path, the nearest one around it or itself that may hold an article, and how sure it is noise (NEVER, NAMED, 0)."""

    __slots__ = ("tag", "steps", "parent", "noise", "holder", "semantic", "chars", "total")

    def __init__(self, tag: str, steps: tuple[str, ...], parent: Node | None, noise: int):
        self.tag, self.steps, self.parent, self.noise = tag, steps, parent, noise
        self.holder = self if tag in HOLDS else parent.holder if parent else None
        self.semantic = tag in ("article", "main") or parent is not None and parent.semantic
        self.chars = self.total = 0.0


NEVER, NAMED = 2, 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text and not text.isspace() else {}


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """How sure an element is no article text; inside: it lies in an article or main element."""
    if tag in BOILER or tag == "header" and not inside:
        return NEVER
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return NEVER
    if tag in ("body", "html", "article", "main") and "comment" not in attrs.get("class", ""):
        return 0
    return NAMED if any(_names_noise(name) for k in ("class", "id", "role") for name in attrs.get(k, "").lower().split()) else 0


def _names_noise(name: str) -> bool:
    """A name of noise words and words that say nothing beside them: site-header, comments2, ad-slot; not social-history, has-comments, entry-header."""
    words = _WORD.findall(name)
    if not words or words[0] in ("has", "is", "no", "not", "with") or words[-1] == "header" and words[0] in OWN:
        return False
    return any(w in NOISE for w in words) and all(w in NOISE or w in NEUTRAL or len(w) < 3 for w in words)


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes, without their digits."""
    if "class" not in attrs:
        return tag
    names = sorted({re.sub(r"[\d_-]+", "", c) for c in attrs.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The containers of a page and its blocks (container node, text) in page order, without what is never article text."""
    root = Node("html", ("html",), None, 0)
    stack, nodes, blocks, parts = [root], [root], [], []
    opened: dict[str, int] = {}  # block elements of each tag on the stack
    quiet: list[str] = []  # open elements inside a paragraph that are noise, and those of the same tag in them
    closers: dict[str, int] = {}  # where the next closing tag of a raw element is, or the page's end
    link = 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text and stack[-1].noise < NEVER:
            plain = len(" ".join("".join(t for t, in_link in parts if not in_link).split()))
            blocks.append((stack[-1], text))
            stack[-1].chars += plain
        parts.clear()

    def pop(to: int) -> None:
        for node in stack[to:]:
            opened[node.tag] -= 1
        del stack[to:]
        quiet.clear()

    def say(text: str) -> None:
        if not quiet:
            parts.append((text, link > 0))

    at, end = 0, len(page)
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            say(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            say(m[1])
        closing, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if quiet and tag == quiet[-1]:
                quiet.pop()
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK and opened.get(tag):
                flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if closers.get(tag, -1) < at:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                closers[tag] = close.end() if close else end + 1
            at = closers[tag] if closers[tag] <= end else end if tag in ("script", "style", "title", "textarea") else at
            say(" ")
            continue
        if tag == "br":
            say(" ")
        elif tag in BLOCK:
            flush()
            if tag in VOID:
                continue
            for count in _implied(stack, tag):
                pop(len(stack) - count)
            if tag in ("html", "body") and opened.get(tag):
                continue
            attrs = _attributes(rest)
            steps = (*stack[-1].steps[1 - STEPS :], _step(tag, attrs))
            node = Node(tag, steps, stack[-1], max(stack[-1].noise, NAMED if quiet else 0, _noise(tag, attrs, stack[-1].semantic)))
            nodes.append(node)
            if not rest.rstrip().endswith("/"):
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        elif tag not in VOID and not rest.endswith("/"):
            if quiet:
                quiet.extend([tag] if tag == quiet[-1] else [])
            elif rest and _noise(tag, _attributes(rest), True):
                quiet.append(tag)
            if tag == "a":
                link += 1
    if at < end:
        say(entities.unescape(page[at:]))
    flush()
    return nodes, blocks


def _implied(stack: list[Node], tag: str) -> Iterator[int]:
    """How many of the innermost elements the start of `tag` ends by itself: a paragraph, a list item, a cell, a row."""
    if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
        yield 1
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "body": ("head",)}.get(tag, ())
    while len(stack) > 1 and stack[-1].tag in same:
        yield 1


def best(nodes: list[Node]) -> Node | None:
    """The container that scores best: its own text and half of what each level below holds, then grown outwards.

    Containers that only a name marks as noise count if there is no text elsewhere.
    """
    for limit in (0, NAMED):
        if chosen := _best(nodes, limit):
            return chosen
    return None


def _best(nodes: list[Node], limit: int) -> Node | None:
    score: dict[int, float] = {}
    for node in nodes:
        node.total = node.chars if node.noise <= limit else 0.0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.total += node.total
    for node in nodes:
        holder, share = node.holder, 1.0
        while holder is not None and node.chars and node.noise <= limit and share > 1e-6:
            score[id(holder)] = score.get(id(holder), 0.0) + node.chars * share
            share /= 2
            holder = holder.parent.holder if holder.parent is not None else None
    chosen = up = max((n for n in nodes if id(n) in score and n.noise <= limit), key=lambda n: score[id(n)], default=None)
    size = chosen.total if chosen is not None else 0.0
    while up is not None and up.tag not in ("article", "main") and up.parent is not None and up.parent.total <= GROWTH * size:
        up = up.parent
        if up.total > chosen.total:  # the innermost that holds so much
            chosen = up
    return chosen


def text_under(roots: list[Node], nodes: list[Node], blocks: list[tuple[Node, str]]) -> str:
    """The blocks inside containers, less what is more surely noise than they are; nodes in page order, so a parent comes before its children."""
    inside = {id(n): n.noise for n in roots}
    for n in nodes:
        if id(n) not in inside and n.parent is not None and id(n.parent) in inside and n.noise <= inside[id(n.parent)]:
            inside[id(n)] = inside[id(n.parent)]
    return "\n\n".join(text for owner, text in blocks if id(owner) in inside)


def best_path(page: str) -> str | None:
    node = best(parse(page)[0])
    return ">".join(node.steps) if node else None


def extract(page: str, winners: list[str]) -> str:
    """The text of all containers on the first of the winning paths that holds any; of the page's own best if none does."""
    nodes, blocks = parse(page)
    own = best(nodes)
    for path in winners:
        steps = tuple(path.split(">"))
        if found := [n for n in nodes if n.steps == steps and n.total and n.noise <= (own.noise if own else 0)]:
            return text_under(found, nodes, blocks)
    return text_under([own], nodes, blocks) if own else ""


def host_of(column: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that got SHARE of the host's votes or more, most first, ties by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                paths = [best_path(h or "") for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.string())], ["host", "path"])

    each = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).mapInArrow(run, "host string, path string").where("path is not null")
    count = each.groupBy("host", "path").agg(F.count("*").alias("n"))
    ranked = count.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("v"), F.sum("n").alias("all"))
    return ranked.select("host", F.expr(f"transform(filter(v, x -> -x.n >= {SHARE} * all), x -> x.path)").alias("paths"))


#: The winners are broadcast up to so many bytes; beyond this they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text), one row per row.

    Null and empty html and pages without text give ''. A null url is of the host ''. Repeated rows vote and are read
    alike; ties of votes go to the path that sorts first. An empty table gives no rows. Other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")
    winners = cut(votes(rows))
    size = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", ","))), F.count("*")).first()
    small = (size[0] or 0) + 64 * size[1] <= BROADCAST_BYTES
    joined = rows.withColumn("_host", host_of(F.col("url"))).join(F.broadcast(winners) if small else winners, F.col("_host") == F.col("host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(h or "", p or []) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")

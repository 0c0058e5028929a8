"""Main text of web pages by wrappers that are inferred for each host.

A page is read as a stream of tokens: block tags and texts. Pages of a host are aligned one after
another with the host's wrapper, a union-free regular expression: texts that differ become slots, runs
of the same group become repeated groups, and what only some pages have becomes optional. Each group
of the wrapper sums up what it has held: letters, letters in links, pages. From these sums one region of
the wrapper is the host's main region; a page gives the texts of its part that matches, without menus,
adverts, forms and the like.

Wrappers grow where the pages lie, one for each host of a task. Only they are shuffled: equal ones are
summed up, those of a host are merged. A wrapper has no text and few nodes, so a host with a third of
all pages costs no more than others.
"""

from __future__ import annotations

import html as entities
import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_batch

# Fixed values of HTML: what stands inside a line, what has no end tag, what is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video head select option button".split())
# A start tag of these ends an open paragraph or item of the same list.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Elements and names of classes, ids and roles that say: not the article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|"
    r"header|masthead|comments?|respond|replies|disqus|cookies?|consent|notice|notices|alert|gdpr|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|search|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|complementary|contentinfo|toc)(?:$|[\s_-])", re.I)
MAIN_TAGS = ("article", "main")
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-?body|main|main-?content|content|post|post-?body|entry|entry-?content|story|body-?text|article-?text)(?:$|[\s_-])", re.I)

# What opens with "<": a comment, a section, a declaration, or a tag with its attributes. Quotes count only behind
# "="; nothing is tried twice, so a tag costs its length.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"""
                   r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)|(?!["'])))*+)>""", re.S)
# The same for what such a tag has no end for: a quote that stays open is a character like others.
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>", re.S)
# Open elements a block is known by. Of deeper ones only the first that sets its text apart counts.
DEPTH = 150
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """A run of text between block tags."""

    path: tuple[str, ...]  # open elements outside in, each "tag" or "tag.names"
    text: str
    linked: int  # letters inside links


def blocks_of(html: str | None) -> list[Block]:
    """The text blocks of a page in order, character references decoded, white space made single.

    Scripts, styles and the like are passed over. Tags that are never closed end with what they are
    in, paragraphs with the next block. Work is in proportion to the page, whatever its tags: elements
    deeper than DEPTH share a path, and quotes that never close are characters.
    """
    out, stack, parts, linked, links, at = [], [], [], 0, 0, 0
    html = html or ""
    raw = None
    last_end = html.rfind(">")  # behind it no tag ends
    token = TOKEN
    depth_of: dict[str, int] = {}  # open elements by tag

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            piece = entities.unescape(html[a:b])
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def close() -> None:
        nonlocal linked
        line = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if line:
            path = tuple(stack) if len(stack) <= DEPTH else (*stack[:DEPTH], *[k for k in stack[DEPTH:] if is_aside(k)][:1])
            out.append(Block(path, line, min(linked, len(line))))
        linked = 0

    def pop() -> str:
        tag = stack.pop().partition(".")[0]
        depth_of[tag] -= 1
        return tag

    pos = 0
    while True:
        if raw is not None:  # up to the end tag of an element that is no text
            end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(html, pos)
            if end is None and raw == "head":
                end = re.compile(r"<body\b", re.I).search(html, pos)
                pos = at = end.start() if end else len(html)
            else:
                pos = at = end.end() if end else len(html)
            raw = None
        start = html.find("<", pos)
        if start < 0 or (start > last_end and not html.startswith(("<!", "<?"), start)):
            break
        m = token.match(html, start)
        if m is None and token is TOKEN and html[start + 1:start + 3].lstrip("/")[:1].isalpha():
            m = LOOSE.match(html, start)
            if m is not None:
                token = LOOSE  # a tag whose quotes never close: from here on they are not looked at
        if m is None:
            pos = start + 1
            continue
        text(at, m.start())
        pos = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                raw = tag
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if m[1] else links + 1
            continue
        close()
        links = 0
        if tag in VOID or (not m[1] and m[3].endswith("/")):
            continue
        if m[1]:
            if depth_of.get(tag):
                while pop() != tag:
                    pass
            continue
        while stack and stack[-1].partition(".")[0] == "p":
            pop()
        if stack and stack[-1].partition(".")[0] in CLOSES.get(tag, ()):
            pop()
        names = " ".join(next(filter(None, g), "") for g in NAMED.findall(m[3]))
        names = SPACE.sub(" ", re.sub(r"\d+", "#", names)).strip().lower()
        if HIDDEN.search(m[3]):
            names = f"{names} hidden".strip()
        stack.append(f"{tag}.{names}" if names else tag)
        depth_of[tag] = depth_of.get(tag, 0) + 1
    text(at, len(html))
    close()
    return out


# A wrapper is a list of nodes [kind, key, stats, children]: "e" an element, "t" a text slot, "r" a
# group that repeats. Stats: pages that have it, letters, letters in links, blocks.
def page_wrapper(blocks: list[Block]) -> list:
    """A page as a wrapper of its own, runs of equal siblings already folded."""
    root: list = []
    open_nodes: list[tuple[str, list]] = []
    before: tuple[str, ...] = ()
    for block in blocks:
        same = 0
        while same < min(len(before), len(block.path), len(open_nodes)) and before[same] == block.path[same]:
            same += 1
        same = same if same < len(block.path) or same < len(before) else max(0, same - 1)
        del open_nodes[same:]
        for key in block.path[same:]:
            node = ["e", key, [1, 0, 0, 0], []]
            (open_nodes[-1][1][3] if open_nodes else root).append(node)
            open_nodes.append((key, node))
        for _, node in open_nodes:
            node[2] = [1, node[2][1] + len(block.text), node[2][2] + block.linked, node[2][3] + 1]
        slot = ["t", "", [1, len(block.text), block.linked, 1], []]
        (open_nodes[-1][1][3] if open_nodes else root).append(slot)
        before = block.path
    return _folded(root)


def _label(node: list) -> str:
    return node[0] if node[0] == "t" else node[1]


def _folded(nodes: list) -> list:
    """Adjacent nodes of one label as one repeated group, at every depth."""
    out: list = []
    for node in nodes:
        node = [node[0], node[1], node[2], _folded(node[3])]
        if out and _label(out[-1]) == _label(node):
            last = out[-1]
            children = align(last[3], node[3])
            out[-1] = ["t" if node[0] == "t" else "r", last[1], _sum(last[2], node[2], same_page=True), children]
        else:
            out.append(node)
    return out


def _sum(a: list[int], b: list[int], same_page: bool = False) -> list[int]:
    return [max(a[0], b[0]) if same_page else a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]]


def align(a: list, b: list) -> list:
    """The wrapper that both match: equal labels in order are joined, the others become optional.

    A node is optional where it has fewer pages than what it stands in. Longest common subsequence;
    the lists are short, as runs are folded.
    """
    if not a or not b:
        return a or b
    left, right = [_label(n) for n in a], [_label(n) for n in b]
    if left == right:
        pairs = list(zip(range(len(a)), range(len(b))))
    else:
        pairs = _common(left, right)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            p, q = a[x], b[y]
            kind = "r" if "r" in (p[0], q[0]) else p[0]
            out.append([kind, p[1], _sum(p[2], q[2]), align(p[3], q[3])])
        i, j = x + 1, y + 1
    return _merged_runs(out)


def _merged_runs(nodes: list) -> list:
    """What the alignment left side by side under one label is a repeated group again."""
    out: list = []
    for node in nodes:
        if out and _label(out[-1]) == _label(node):
            last = out[-1]
            out[-1] = ["t" if node[0] == "t" else "r", last[1], _sum(last[2], node[2], same_page=True), align(last[3], node[3])]
        else:
            out.append(node)
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def is_aside(key: str) -> bool:
    tag, _, names = key.partition(".")
    if tag in ("html", "body", *MAIN_TAGS):
        return False
    return tag in ASIDE_TAGS or "hidden" in names.split() or bool(names and ASIDE_NAMES.search(names) and not MAIN_NAMES.fullmatch(names))


def main_region(wrapper: list) -> list[str]:
    """The path (labels) of the wrapper's main region.

    A region marked as the article or main part, if one holds text on half of the pages or more; else
    the element that holds most of its text itself or in paragraphs: the region is followed down
    from the root as long as one child holds most of the letters that are in no aside and no link.
    """
    total = max((n[2][0] for n in wrapper), default=0)
    marked: list[tuple[int, int, list[str]]] = []

    def walk(nodes: list, path: list[str]) -> None:
        for node in nodes:
            if node[0] == "t" or is_aside(node[1]):
                continue
            here = [*path, node[1]]
            tag, _, names = node[1].partition(".")
            rank = MAIN_TAGS.index(tag) if tag in MAIN_TAGS else 2 if names and MAIN_NAMES.search(names) else None
            if rank is not None and 2 * node[2][0] >= total:
                marked.append((rank, -_weight(node), here))
            walk(node[3], here)

    walk(wrapper, [])
    if marked:
        return min(marked)[2]
    path: list[str] = []
    nodes = wrapper
    while True:
        inner = [n for n in nodes if n[0] != "t" and not is_aside(n[1])]
        own = sum(_weight(n) for n in nodes if n[0] == "t" or n[1].partition(".")[0] in ("p", "h1", "h2", "h3", "h4", "ul", "ol", "pre", "blockquote", "table"))
        best = max(inner, key=_weight, default=None)
        if best is None or best[1].partition(".")[0] in ("p", "h1", "h2", "h3", "h4", "ul", "ol", "pre", "blockquote", "table") or _weight(best) <= own:
            return path
        path, nodes = [*path, best[1]], best[3]


def _weight(node: list) -> int:
    """Letters that are in no link and no aside."""
    if node[0] == "t" or not node[3]:
        return node[2][1] - node[2][2]
    return sum(_weight(c) for c in node[3] if c[0] == "t" or not is_aside(c[1]))


def extract(blocks: list[Block], region: list[str]) -> str:
    """The texts of the blocks inside the region, without asides; if a page has nothing there, of the
    page's own main region."""
    for path in (region, main_region(page_wrapper(blocks))):
        found = [b.text for b in blocks if _inside(b.path, path) and not _set_apart(b.path[len(path):])]
        if found:
            return "\n\n".join(found)
    return ""


def _set_apart(path: tuple[str, ...]) -> bool:
    """In an aside; the headline in an article's own header is not."""
    headline = bool(path) and path[-1].partition(".")[0] == "h1"
    return any(is_aside(key) and not (headline and key == "header") for key in path)


def _inside(path: tuple[str, ...], region: list[str]) -> bool:
    return len(path) >= len(region) and list(path[: len(region)]) == region


def host_of(url):
    """The host of a URL column in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper as JSON) from rows of (host, html): one for each host, of all its pages."""

    def start():
        known: dict[str, list] = {}

        def call(hosts, pages):
            for host, html in zip(hosts, pages):
                known[host] = align(known.get(host, []), page_wrapper(blocks_of(html)))

        def rest():
            yield list(known), [json.dumps(w, ensure_ascii=False) for w in known.values()]

        call.rest = rest
        return call

    local = per_batch(pages, start, "host string, wrapper string")

    def merge(key, rows):
        import pandas as pd

        whole: list = []
        for text in sorted(rows["wrapper"]):
            whole = align(whole, json.loads(text))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(whole, ensure_ascii=False)]})

    return local.groupBy("host").applyInPandas(merge, "host string, wrapper string")


# Regions of all hosts together are broadcast up to this many bytes; beyond it the pages are shuffled.
BROADCAST_BYTES = 32 << 20


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: id, url, host, text: the whole main text, its blocks joined by a
    blank line; empty where there is none.

    Null html is an empty page. Pages without a host are pages of one host "". Repeated rows come out
    repeated; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    wrappers = infer_wrappers(rows.select("host", "html"))

    def regions():
        return lambda hosts, ws: (hosts, ["\n".join(main_region(json.loads(w))) for w in ws])

    known = cut(per_batch(wrappers, regions, "host string, region string"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("region") + 64), F.lit(0))).first()[0]
    side = F.broadcast(known) if size <= BROADCAST_BYTES else known.hint("shuffle_hash")
    matched = rows.join(side, "host").select("id", "url", "host", "html", "region")

    def texts():
        def call(ids, urls, hosts, pages, paths):
            return ids, urls, hosts, [extract(blocks_of(h), p.split("\n") if p else []) for h, p in zip(pages, paths)]

        return call

    return per_batch(matched, texts, "id long, url string, host string, text string")

"""Main text of web pages by scoring their tree of elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# What HTML says of elements.
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCKS - {"body", "head", "html", "title"}
_CLOSED_BY_PEER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Elements, roles and names of classes that are not the article.
_OTHER = frozenset("aside button dialog footer form head header menu nav search select".split())
_OTHER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
_NAME = (
    r"(?:ads?|advert\w*|alert|banner|breadcrumbs?|comments?|consent|cookies?|discussion|disqus|footer|"
    r"gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|"
    r"recommend\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|"
    r"subscription|toolbar|widget)"
)
# A whole name or the head of one tells what an element is; a later part only counts against it.
_OTHER_NAMES = re.compile(rf"(?:^|\s){_NAME}(?:$|[\s_-])", re.I)
_PART_NAMES = re.compile(rf"(?:^|\s)(?!(?:no|not|non|has|have|with|without)[_-])\S*[_-]{_NAME}(?:$|[\s_-])", re.I)
_TALK_NAMES = re.compile(r"(?:^|\s)(?:comments?|discussion|disqus|replies|respond)(?:$|[\s_-])", re.I)
_NO_NAMES = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_PART_POINTS = -5.0
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_START = {"article": 10.0, "main": 10.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}


class _Node:
    __slots__ = ("tag", "parent", "other", "named", "talk", "has_main", "points", "chars", "linked")

    def __init__(self, tag: str, parent: _Node | None, other: bool, names: str = ""):
        self.tag, self.parent, self.other = tag, parent, other
        self.named, self.talk = bool(_OTHER_NAMES.search(names)), bool(_TALK_NAMES.search(names))
        self.has_main, self.points, self.chars, self.linked = False, _START.get(tag, 0.0), 0, 0
        if _PART_NAMES.search(names):
            self.points += _PART_POINTS


def _read(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is surely not of the article, and its class and id."""
    if tag in _OTHER:
        return True, ""
    if not attributes.strip():
        return False, ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = "" if tag in _NO_NAMES else f"{found.get('class', '')} {found.get('id', '')}"
    return bool(
        found.get("role", "").lower() in _OTHER_ROLES
        or found.get("aria-hidden", "").lower() == "true"
        or "hidden" in found
        or re.search(r"(?:^|\s)hidden(?:[\s/]|$)", _ATTRIBUTE.sub(" ", attributes), re.I)
        or _HIDDEN.search(found.get("style", ""))
    ), names


def _is_other(tag: str, attributes: str) -> bool:
    other, names = _read(tag, attributes)
    return other or bool(_OTHER_NAMES.search(names))


def _blocks(page: str) -> list[tuple[_Node, str]]:
    """Blocks of text in page order, each with the innermost block element around it.

    An element named like a part beside the article goes, unless it is around the main element or
    holds most of the page's text outside links; comments may hold most and go nevertheless.
    """
    root = _Node("", None, False)
    stack, blocks, text = [root], [], []
    linked, link_level = 0, 0  # a link counts until it ends or the element around it does

    def count(node: _Node | None, words: str, level: int, sign: int) -> None:
        while node:
            node.chars += sign * len(words)
            node.linked += sign * level
            node = node.parent

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words and not stack[-1].other:
            blocks.append((stack[-1], words, min(linked, len(words))))
            count(*blocks[-1], 1)
        text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        part = html.unescape(part)
        text.append(part)
        if link_level:
            linked += len(part)

    def close(tags: set[str], stop: set[str]) -> None:
        nonlocal link_level
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                if len(stack) < link_level:
                    link_level = 0
                return
            if stack[k].tag in stop:
                return

    at = 0
    while match := _TOKEN.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag, closing = match[2].lower(), bool(match[1])
        if tag == "a":
            is_link = not closing and any(name.lower() == "href" for name, *_ in _ATTRIBUTE.findall(match[3]))
            link_level = len(stack) if is_link else 0
        elif tag == "br":
            text.append(" ")
        elif tag in _RAW:
            if not closing and not match[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in _EMPTY and tag != "hr" or tag not in _BLOCKS and not _is_other(tag, match[3]):
            if not closing and tag in _EMPTY:
                text.append(" ")
            elif closing and any(n.tag == tag for n in stack):
                flush()
                close({tag}, set())
        else:
            flush()
            if closing:
                close({tag}, {"td", "th"} if tag != "table" and tag not in ("td", "th", "tr") and tag not in _BLOCKS else set())
                continue
            if tag in _CLOSES_P:
                close({"p"}, _BLOCKS - {"p"})
            if tag in _CLOSED_BY_PEER:
                close({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, _CLOSED_BY_PEER[tag])
            if tag != "hr":
                other, names = _read(tag, match[3])
                stack.append(_Node(tag, stack[-1], stack[-1].other or tag == "title" or other, names))
                if tag == "main":
                    for node in stack:
                        node.has_main = True
    add(page[at:])
    flush()
    most, left = (root.chars - root.linked) / 2, []
    gone: dict[int, bool] = {}
    for node, _, _ in blocks:
        way = []
        while node and id(node) not in gone:
            way.append(node)
            node = node.parent
        for n in reversed(way):
            keeps = n.has_main or not n.talk and n.chars - n.linked > most
            gone[id(n)] = bool(n.parent and gone[id(n.parent)]) or n.named and not keeps
    for block in blocks:
        if gone[id(block[0])]:
            count(*block, -1)
        else:
            left.append(block[:2])
    return left


def _within(node: _Node | None, chosen: set[int]) -> bool:
    while node:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block; empty if the page has none.

    Every block gives points for its length and commas: all to its container, half to the next, and
    a third, sixth, ... beyond. Points count less the more of an element's text is linked. The best
    container is kept with those of its siblings that have points near its own, or few links, or that
    are headings, and so are the siblings of the elements around it, up to the element marked as the
    article or else the body. Beside a marked one only running text counts, headings, and points; menus, forms, adverts and the like never count and are left out.
    """
    blocks = _blocks(page or "")
    nodes: dict[int, _Node] = {}
    for node, words in blocks:
        points = 1 + sum(words.count(c) for c in ",،、，") + min(len(words) / 100, 3)
        holder = node if node.tag in ("article", "body", "div", "main", "section", "") else node.parent or node
        level = 0
        while holder:
            nodes[id(holder)] = holder
            holder.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            holder, level = holder.parent, level + 1

    def score(node: _Node) -> float:
        return node.points * (1 - node.linked / node.chars) if node.chars else 0.0

    if not nodes:
        return ""
    best = max(nodes.values(), key=score)
    if score(best) <= 0:
        return ""
    enough = max(10.0, 0.2 * score(best))
    chosen = {id(best)}
    while best.parent:
        # outside an element that is marked as the article only what looks like its text
        is_marked = best.tag in ("article", "main")
        seen = set()
        for node, words in blocks:
            while node and node.parent is not best.parent:
                node = node.parent
            if node is None or id(node) in seen or node is best:
                continue
            seen.add(id(node))
            density = node.linked / node.chars
            is_prose = node.tag == "p" and (node.chars > 80 or words.endswith((".", "!", "?")))
            is_text = density < 0.25 and (is_prose or not is_marked)
            if score(node) >= enough or is_text or node.tag in ("h1", "h2", "h3") and density < 0.5:
                chosen.add(id(node))
        if is_marked or best.parent.tag in ("body", "html", ""):
            break
        best = best.parent
    return "\n".join(words for node, words in blocks if _within(node, chosen))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: ``(page_id, url, text, n_chars)``, one row for each row of ``pages``
    (``page_id, url, html``), repeated rows included.

    A null or empty page, and one without an article, gives an empty text; null ids and urls stay
    null; an empty table gives none. Other columns are not read. Nothing is shuffled.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )

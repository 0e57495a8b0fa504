"""Blocks of a web page: leaf runs of text with the path of tags above them."""

from __future__ import annotations

import html
import re
from collections import defaultdict

#: fixed values of HTML: elements that end a run of text, elements without content, elements whose text is never shown
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
                  "td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select iframe object canvas svg annotation annotation-xml title button".split())
#: the hidden ones whose content is plain text up to their end tag, or to the end of the page
RAW = frozenset("script style textarea iframe title".split())
FOREIGN = frozenset(("svg", "math"))
#: an opening tag of the first kind ends an open one of the second
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_CLOSING = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Open:
    """An open element: the one around it, tag, names, number as a hidden element (else 0), innermost block tag so far.

    ``bits`` is the labeller's, a memo.
    """
    __slots__ = ("around", "bits", "hidden", "leaf", "names", "tag")

    def __init__(self, around: Open | None, tag: str, own: tuple[str, ...], hidden: int):
        self.around, self.tag, self.names, self.hidden, self.bits = around, tag, own, hidden, None
        self.leaf = tag if tag in BLOCK and not hidden else around.leaf if around else "body"

    @property
    def parts(self) -> tuple[str, ...]:
        """The tag and its names; a hidden element leaves no trace in the paths of what it does not hide."""
        return () if self.hidden else (self.tag, *("." + n for n in self.names))


class Block:
    __slots__ = ("leaf", "linked", "node", "text")

    def __init__(self, node: Open | None, text: str, linked: int):
        self.node, self.leaf, self.text, self.linked = node, node.leaf if node else "body", text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and names above the block, outermost first."""
        found, node = [], self.node
        while node is not None:
            found.append(node.parts)
            node = node.around
        return tuple(x for parts in reversed(found) for x in parts)


def names(rest: str) -> tuple[str, ...]:
    """Lower-case parts of the class, id and role of a tag."""
    found = []
    for m in _NAMED.finditer(rest):
        found += [p.lower() for p in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """Text blocks in page order: references decoded, white space one blank, ends trimmed, empty ones left out.

    Inline tags do not part a block and a line break is white space.  Unfinished
    tags, comments and raw text at the end of a cut page are dropped.  Text in
    another hidden element is left out if the element's own end tag comes; one
    that is never ended hides nothing and is not in the path.

    Open elements are a linked list with an index by tag, and blocks point into
    it, so the time is that of the page's length however deep it is nested.
    """
    page = page or ""
    # texts (text, in a link, hidden by) and ends of blocks (None, innermost open element, hidden by); the last is 0 or the number of the innermost hidden element
    items: list[tuple] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
    walls: list[int] = []                             # where blocks and hidden elements are
    solid: list[int] = []                             # where blocks are
    veils: list[int] = []                             # where hidden elements are
    outer, ended = [0], [False]  # by number of the hidden element: the one around it, whether its end tag came
    now = anchors = at = 0
    pending = False
    unclosed: set[str] = set()   # raw elements without another end tag on the page

    def flush() -> None:
        nonlocal pending
        if pending:
            items.append((None, stack[-1] if stack else None, now))
            pending = False

    def add(raw: str) -> None:
        nonlocal pending
        items.append((html.unescape(raw) if "&" in raw else raw, anchors > 0, now))
        pending = True

    def close(k: int) -> None:
        nonlocal anchors, now
        while len(stack) > k:
            node = stack.pop()
            places[node.tag].pop()
            anchors -= node.tag == "a"
            if node.hidden:
                now = outer[node.hidden]
            for kept in (walls, solid, veils):
                if kept and kept[-1] == len(stack):
                    kept.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        if m["tag"] is None and not m[0].endswith(">"):
            break  # cut inside a tag
        tag, ending = tag.lower(), m["end"] or m["end2"]
        if ending:
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCK:
                flush()
            if places[tag]:
                k = places[tag][-1]
                if stack[k].hidden:
                    ended[stack[k].hidden] = pending = True  # ends of blocks inside it do not count
                elif solid and solid[-1] >= k:
                    if tag not in BLOCK:
                        continue  # an inline end tag does not close blocks
                    flush()
                close(k)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in ("title", "button"):
            flush()
        if tag in RAW:
            foreign = any(places[t] for t in FOREIGN)
            if not (rest.endswith("/") and (foreign or tag == "iframe")):
                end = None if tag in unclosed else _CLOSING[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                at = end.end() if end else at if foreign else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            if walls and stack[walls[-1]].tag == "p":
                close(walls[-1])  # a block ends an open paragraph and what is open inside it
            if tag in ENDED:
                k = last(ENDED[tag])
                if k > max(last(BARRIER.get(tag, ())), veils[-1] if veils else -1):
                    close(k)
        if tag not in VOID and not rest.endswith("/"):
            if tag == "a":
                anchors += 1
            if tag in HIDDEN:
                outer.append(now)
                ended.append(False)
                now = len(outer) - 1
            k = len(stack)
            places[tag].append(k)
            if tag in HIDDEN:
                veils.append(k)
            if tag in BLOCK:
                solid.append(k)
            if tag in HIDDEN or tag in BLOCK:
                walls.append(k)
            stack.append(Open(stack[-1] if stack else None, tag, names(rest), now if tag in HIDDEN else 0))
    flush()
    for k in range(1, len(outer)):  # what is around comes first
        ended[k] = ended[k] or ended[outer[k]]
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    for text, more, hidden in items:
        if ended[hidden]:
            continue
        if text is not None:
            pieces.append(text)
            linked += len(text) if more else 0
            continue
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(more, text, min(linked, len(text))))
        pieces, linked = [], 0
    return out

"""Leaf blocks of an HTML page: the runs of text between block-level tags, with their ancestors.

One pass of a regular expression over the page; a stack holds the open block-level elements.  Text of
scripts, styles and comments is no text.  Unclosed and misnested tags are closed as the block they
stand in closes; white space in a block (``<br>`` is white space) becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

#: Fixed values of HTML: elements whose content is never text, and elements that begin a block of their own.
RAW = ("script", "style", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "noembed", "noframes", "xmp")
BLOCK = frozenset(
    "html head title body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the start of an element closes, up to the element that bounds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements whose start closes an open paragraph.
ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "select", "textarea", "td", "th", "tr", "caption", "legend", "html", "head", "title", "body", "noscript"}

_P = {"p"}
_P_BOUNDS = BLOCK - {"button", "label"}

_TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
    |[!?][^>]*(?:>|\Z)
    |(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>
    |/[^>]*(?:>|\Z)
    |[a-zA-Z][^>]*\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


#: Open elements of a block that are kept: so many of the outermost and of the innermost.
OUTER, INNER = 8, 16


@dataclass(frozen=True, slots=True)
class Block:
    path: tuple[str, ...]  # the keys of the open elements, outermost first
    text: str
    linked: int  # characters inside links
    links: int


@lru_cache(20_000)
def element_key(name: str, attributes: str) -> str:
    """An element as its name and what its class, id and role say: words of letters, lower case."""
    if not attributes or attributes.isspace():
        return name
    said = []
    for m in _ATTR.finditer(attributes):
        at = m[1].lower()
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if at in ("class", "id", "role", "itemprop", "aria-label"):
            said += [w.lower() for w in _WORD.findall(value)[:8]]
        elif at in ("hidden", "aria-hidden") and value.lower() != "false" or at == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            said.append("!hidden")
    return " ".join([name, *dict.fromkeys(said)])


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    names: list[str] = []  # of the open block-level elements
    keys: list[str] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0
    link_depth = -1  # number of open elements when the open link began

    def flush() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(keys) if len(keys) <= OUTER + INNER else (*keys[:OUTER], *keys[-INNER:])
                out.append(Block(path, text, linked, links))
            parts.clear()
        linked = links = 0

    def cut(depth: int) -> None:
        nonlocal link_depth
        flush()
        for name in names[depth:]:
            opened[name] -= 1
        del names[depth:], keys[depth:]
        if link_depth > depth:
            link_depth = -1

    def innermost(closed: set[str], bounds: set[str]) -> int:
        """Where the innermost element of some names is open, -1 if a bound or nothing comes first."""
        if any([opened[x] for x in closed]):
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in closed:
                    return depth
                if names[depth] in bounds:
                    break
        return -1

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            piece = page[at:upto]
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if link_depth >= 0:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        block = name in BLOCK or "-" in name
        if m[1]:
            if name == "a":
                link_depth = -1
            elif block and opened[name]:
                cut(innermost({name}, set()))
            elif name == "p":
                flush()
        elif name in RAW:
            closing = None if name in ("svg", "math") and m[3].endswith("/") else _RAW_END[name].search(page, at)
            if closing or not m[3].endswith("/"):
                at = closing.end() if closing else end
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth = len(names)
            links += 1
        elif block:
            if name in CLOSES:
                depth = innermost(*CLOSES[name])
            else:
                depth = innermost(_P, _P_BOUNDS) if name in ENDS_P else -1
            if depth >= 0:
                cut(depth)
            flush()
            if name not in VOID:
                names.append(name)
                keys.append(element_key(name, m[3]))
                opened[name] += 1
    flush()
    return out

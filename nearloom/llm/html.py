"""A forgiving HTML reader: markup to block texts, each with the path of its block elements."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Code, which never becomes text even if it is not closed; and elements dropped with what they hold if they are closed.
_CODE, _RAW = "script|style", "template|textarea|iframe|select|title"
_RAW_NAMES = frozenset(_RAW.split("|"))
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_CODE})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<({_RAW})\b[^>]*?(?:/>|>.*?</\2\s*>)|<[/!?a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?a-zA-Z][^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input ins kbd label mark math meta link q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del picture source video audio track area map embed param base svg object mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle mtable mtr mtd semantics annotation g path text tspan".split())
_VOID = frozenset("hr br img input meta link wbr area base col embed param source track".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"body": {"head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond this depth count as what is around them, so a path is bounded; their text stays.
DEEP = 200
_SCOPE = frozenset("ul ol dl table article section div body html nav main aside header footer form".split())


@dataclass
class Block:
    """Text of one block: path of the elements around it, and how much of it lies in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def element_key(name: str, tag: str) -> str:
    """A name with the class, id and role it is written with, which tell one kind of box from another."""
    marks = [f"{k.lower()}={' '.join(sorted((a or b or c).lower().split()))}" for k, a, b, c in _ATTRIBUTE.findall(tag)]
    return f"{name}[{','.join(sorted(marks))}]" if marks else name


def read(source: str) -> tuple[list[Block], dict[tuple[str, ...], int]]:
    """The blocks in page order, and how often each path of elements is opened."""
    path: list[tuple[str, str]] = []
    blocks: list[Block] = []
    opened: dict[tuple[str, ...], int] = {}
    text: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(tuple(k for _, k in path[:DEEP]), joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(names: frozenset | set, within: frozenset = frozenset()) -> None:
        for i in range(len(path) - 1, -1, -1):
            if path[i][0] in names:
                del path[i:]
                return
            if path[i][0] in within:
                return

    for m in _TOKEN.finditer(source):
        t = m.group()
        if t[0] != "<" or len(t) == 1:
            piece = unescape(t)
            text.append(piece)
            if links:
                linked += len(piece)
            continue
        if m.group(1) or m.group(2) or t[1] in "!?":
            continue
        found = _NAME.match(t)
        if not found:
            continue
        name = found.group(1).lower()
        if name == "a":
            links = 0 if t[1] == "/" else 1
        if name == "br":
            text.append(" ")
        if name in _INLINE or name == "br":
            continue
        flush()
        if name in _RAW_NAMES:  # not closed: only its tag goes
            continue
        links = 0
        if t[1] == "/":
            close({name})
            continue
        if name in _CLOSES_P:
            close({"p"}, _SCOPE)
        if name in _SIBLING:
            close(_SIBLING[name], _SCOPE)
        if name in _VOID or t.endswith("/>"):
            continue
        path.append((name, element_key(name, t)))
        if len(path) <= DEEP:
            key = tuple(k for _, k in path)
            opened[key] = opened.get(key, 0) + 1
    flush()
    return blocks, opened

"""A small tree of an HTML page on the standard parser, with the selectors that menu extraction needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
_CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_SCOPES = frozenset("ul ol table dl div section article body".split())
#: What the standard parser reads in one way only: end tags, start tags with quoted values without references, comments.
_SPACE = "[ \\t\\n\\r\\f]"
_END = re.compile(rf"/([a-zA-Z][a-zA-Z0-9]*){_SPACE}*")
_ATTRIBUTE = r"""([a-zA-Z][a-zA-Z0-9_:.-]*)(=(?:"[^"&]*"|'[^'&]*'))?"""
_START = re.compile(rf"([a-zA-Z][a-zA-Z0-9-]*)((?:{_SPACE}+{_ATTRIBUTE})*+){_SPACE}*(/?)")
_SKIPPED = re.compile(r"!doctype html|!--[^<>&!-]*--", re.I)
#: Their contents have rules of their own.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Longer tags are not remembered.
_MOST_TAG = 200


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if type(child) is not str:
                yield child
                stack += reversed(child.children)

    def strings(self) -> Iterator[str]:
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if type(child) is str:
                yield child
            else:
                stack += reversed(child.children)

    def text(self, between: str = "") -> str:
        """Text pieces stripped and joined, without a space by default."""
        if len(self.children) == 1 and type(self.children[0]) is str:
            return self.children[0].strip()
        return between.join([s for x in self.strings() if (s := x.strip())])

    def start(self, most: int) -> str:
        """The text as far as the piece in which it reaches `most` characters."""
        pieces, n = [], 0
        for x in self.strings():
            pieces.append(x.strip())
            n += len(pieces[-1])
            if n >= most:
                break
        return "".join(pieces)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def next_element(self) -> Node | None:
        siblings = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        at = next((i for i, c in enumerate(siblings) if c is self), None)
        return siblings[at + 1] if at is not None and at + 1 < len(siblings) else None

    def matching(self, selector: str) -> Iterator[Node]:
        """Elements below that match tag, .class, [attr], [attr='v'], [attr*='v'], descendants and comma lists."""
        chains = _chains(selector)
        for node in self.walk():
            for chain in chains:
                if _fits(node, chain[-1]) and (len(chain) == 1 or _stands_in(node, chain[:-1])):
                    yield node
                    break

    def select(self, selector: str) -> list[Node]:
        return list(self.matching(selector))

    def first(self, selector: str) -> Node | None:
        return next(self.matching(selector), None)


@lru_cache(maxsize=1024)
def _chains(selector: str) -> list[list[tuple]]:
    return [[_simple(s) for s in part.split()] for part in re.split(r",(?![^\[]*\])", selector) if part.strip()]


def _simple(text: str) -> tuple[str, list[str], list[tuple[str, str, str]]]:
    tag = re.match(r"[\w-]*", text)[0].lower()
    classes = re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", text))
    attrs = re.findall(r"\[([\w-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]", text)
    return tag, classes, attrs


def _fits(node: Node, simple) -> bool:
    tag, classes, attrs = simple
    if tag and node.tag != tag:
        return False
    if classes:
        own = node.attrs.get("class", "").split()
        for c in classes:
            if c not in own:
                return False
    for name, op, value in attrs:
        own = node.attrs.get(name)
        if own is None or op and (value not in own if op == "*=" else own != value):
            return False
    return True


def _stands_in(node: Node, rest: list[tuple]) -> bool:
    up = node.parent
    while rest and up is not None:
        if _fits(up, rest[-1]):
            rest = rest[:-1]
        up = up.parent
    return not rest


@lru_cache(maxsize=1 << 14)
def _tag(inner: str) -> tuple[str, str, dict[str, str]] | None:
    """(kind, name, attributes) of what stands in angle brackets; kinds are end, start, alone (never has contents) and skipped. None for what only the standard parser reads."""
    if m := _END.fullmatch(inner):
        return "end", m[1].lower(), {}
    if _SKIPPED.fullmatch(inner):
        return "skipped", "", {}
    if not (m := _START.fullmatch(inner)) or (name := m[1].lower()) in _RAW:
        return None
    found = re.findall(rf"{_SPACE}{_ATTRIBUTE}", m[2])
    return "alone" if m[5] else "start", name, {k.lower(): v[2:-1] for k, v in reversed(found)}


def _before(at: Node, tag: str) -> Node:
    """Where a start tag stands once it has ended what it ends."""
    up, ended = at, _CLOSES.get(tag, ())
    while ended and up.parent is not None and up.tag not in _SCOPES:
        if up.tag in ended:
            return up.parent
        up = up.parent
    return at


def _after(at: Node, tag: str) -> Node:
    """Where what follows an end tag stands."""
    up = at
    while up.parent is not None and up.tag != tag:
        up = up.parent
    return at if up.parent is None else up.parent


class _Builder(HTMLParser):
    def __init__(self, root: Node, at: Node):
        super().__init__(convert_charrefs=True)
        self.root, self.at = root, at

    def handle_starttag(self, tag, attrs):
        self.at = _before(self.at, tag)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag):
        self.at = _after(self.at, tag)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page: plain tags by _tag, the page from the first other one by the standard parser."""
    text, *pieces = (html or "").split("<")
    root = at = Node("", {}, None)
    if text:
        at.children.append(unescape(text))
    for i, piece in enumerate(pieces):
        inner, ended, text = piece.partition(">")
        known = (_tag if len(inner) <= _MOST_TAG else _tag.__wrapped__)(inner) if ended else None
        if known is None:
            builder = _Builder(root, at)
            builder.feed("<" + "<".join(pieces[i:]))
            builder.close()
            break
        kind, tag, attrs = known
        if kind == "end":
            at = at.parent if at.tag == tag else _after(at, tag)
        elif kind != "skipped":
            if kind == "start" and tag in _CLOSES:
                at = _before(at, tag)
            node = Node(tag, attrs, at)
            at.children.append(node)
            if kind == "start" and tag not in _VOID:
                at = node
        if text:
            at.children.append(unescape(text) if "&" in text else text)
    return root


NOISE = ("script", "style", "nav", "footer", "header", "iframe", "noscript")


def without(root: Node, *tags: str) -> Node:
    for up in {n.parent: None for n in root.find(*tags)}:
        up.children = [c for c in up.children if type(c) is str or c.tag not in tags]
    return root

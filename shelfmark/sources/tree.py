"""A small element tree on the standard parser, for what patterns can't see."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LINKING = {"a", "iframe", "embed", "object", "source"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "strong"}
#: An ampersand that begins no whole numeric reference, with the name and semicolon after it if there are any.
_AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([a-zA-Z][a-zA-Z0-9]*;)?")


class Node:
    __slots__ = ("attrs", "parts", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def text(self) -> str:
        todo, out = [self], []
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.parts)
        return " ".join("".join(out).split())

    def find(self, tags: set[str]) -> Node | None:
        todo = list(reversed(self.parts))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    return x
                todo += reversed(x.parts)
        return None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", {}, None)
        self.linking: list[Node] = []

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag in _LINKING:
            self.linking.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.up

    def handle_endtag(self, tag):
        x = self.at
        while x.up is not None and x.tag != tag:
            x = x.up
        if x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        if self.cdata_elem is None:  # a script is no text
            self.at.parts.append(data)


def _escaped(html: str) -> str:
    """A source in which only numbers and known names with their semicolon are references.

    The standard parser also decodes what was cut (``&amp``, ``&#3``) and beginnings of other words (``?a=1&copy=2``).
    """
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[0][1:]}", html)


def document_links(html: str, url_pattern: str) -> list[tuple[str, list[str]]]:
    """(url, title candidates) of each link to a document, in order."""
    builder = _Builder()
    builder.feed(_escaped(html))
    builder.close()
    out = []
    for node in builder.linking:
        url = next((v for v in (node.attrs.get(k, "").strip() for k in ("href", "src", "data")) if v), "")
        if not url or not re.search(url_pattern, url):
            continue
        found = [node.text()] if node.tag == "a" else []
        found += [node.attrs.get(k, "") for k in ("title", "aria-label", "data-entity-title")]
        up = node.up
        for _ in range(4):
            if up is None or up.up is None:
                break
            if (h := up.find(_HEADING)) is not None:
                found.append(h.text())
            up = up.up
        out.append((url, [c for c in found if c]))
    return out

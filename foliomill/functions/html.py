"""A compact HTML tree: parsing in the manner of browsers, searching, changing and serialising.

Covered: implied html, head and body, void and raw-text elements, noscript as
text, closing of p, li, dd, dt, option and table parts by what follows, and the
reopening of formatting elements that a block cuts short, at most three alike.
Not covered: foster parenting of stray table content, templates, and SVG name
adjustments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RCDATA = frozenset(["title", "textarea"])
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: How many formatting elements of the same tag and attributes are opened again.
ALIKE = 3
SCOPE_ENDS = frozenset("html table td th caption button object template marquee applet".split())
CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "thead": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
    "tfoot": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


@dataclass(eq=False, slots=True)
class Node:
    """An element, text, comment, doctype or document."""

    kind: str
    tag: str = ""
    text: str = ""
    attrs: list[tuple[str, str]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def get(self, name: str) -> str | None:
        """The first attribute of that name."""
        return next((v for n, v in self.attrs if n == name), None)

    def set(self, name: str, value: str | None) -> None:
        """Replace every attribute of that name, or append one; None removes all."""
        if value is None:
            self.attrs = [(n, v) for n, v in self.attrs if n != name]
        elif any(n == name for n, _ in self.attrs):
            self.attrs = [(n, value if n == name else v) for n, v in self.attrs]
        else:
            self.attrs.append((name, value))

    def child(self, tag: str) -> Node | None:
        """The first child element of that tag."""
        return next((c for c in self.children if c.kind == "element" and c.tag == tag), None)

    def walk(self, depth: int = 0) -> Iterator[tuple[Node, int]]:
        """This node and all below, in document order, with depths."""
        stack = [(self, depth)]
        while stack:
            node, d = stack.pop()
            yield node, d
            stack.extend((c, d + 1) for c in reversed(node.children))

    def find(self, *steps: str) -> list[Node]:
        """Elements reached by a path of descendant steps, in document order."""
        found: list[Node] = []
        stack = [(c, 0) for c in reversed(self.children)]
        while stack:
            node, at = stack.pop()
            if node.kind == "element" and node.tag == steps[at]:
                if at == len(steps) - 1:
                    found.append(node)
                else:
                    at += 1
            stack.extend((c, at) for c in reversed(node.children))
        return found

    def release(self) -> None:
        """Take the tree apart once it is done with: nodes hold one another, so else it stays until garbage is collected."""
        stack = [self]
        while stack:
            node = stack.pop()
            stack.extend(node.children)
            node.children.clear()
            node.parent = None

    def content(self) -> str:
        return "".join(n.text for n, _ in self.walk() if n.kind == "text")


def unescape_closed(text: str) -> str:
    """Character references that end in a semicolon; browsers also read some names without one, as ``&amp``."""
    return _CLOSED.sub(lambda m: m[0] if m[1] and m[1] + ";" not in html5 else unescape(m[0]), text)


def tokens(html: str, unescape: Callable[[str], str] = unescape) -> Iterator[tuple]:
    """("text", s), ("start", tag, attrs, closed), ("end", tag), ("comment", s) and ("doctype", s)."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:])
            return
        if lt > at:
            yield "text", unescape(html[at:lt])
        tag = _TAG.match(html, lt)
        if tag:
            attrs, pos = [], tag.end()
            while pos < size and html[pos] != ">":
                m = _ATTR.match(html, pos)
                if not m or m.end() == pos:
                    pos += 1
                    continue
                pos = m.end()
                value = m[2] or ""
                if value[:1] in ('"', "'"):
                    value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
                if all(n != m[1].lower() for n, _ in attrs):
                    attrs.append((m[1].lower(), unescape(value)))
            if pos >= size:
                return
            name = tag[2].lower()
            closed = html[pos - 1] == "/"
            at = pos + 1
            if tag[1]:
                yield "end", name
                continue
            yield "start", name, attrs, closed
            if name in RAW or name in RCDATA:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                stop = end.start() if end else size
                if stop > at:
                    yield "text", unescape(html[at:stop]) if name in RCDATA else html[at:stop]
                at = stop
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            yield "comment", html[lt + 4 : end if end >= 0 else size]
            at = end + 3 if end >= 0 else size
        elif html.startswith(("<!", "<?", "</"), lt):
            end = html.find(">", lt)
            stop = end if end >= 0 else size
            body = html[lt + 2 : stop]
            yield ("doctype", body[7:].strip()) if body[:7].lower() == "doctype" else ("comment", body)
            at = stop + 1
        else:
            yield "text", "<"
            at = lt + 1


class _Builder:
    def __init__(self) -> None:
        self.document = Node("document")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack: list[Node] = []
        self.open: Counter[str] = Counter()  # how often each tag is on the stack
        self.reopen: list[Node] = []
        self.after_head = False

    def reset(self, *nodes: Node) -> None:
        self.stack, self.open = list(nodes), Counter(n.tag for n in nodes)

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1

    def place(self, node: Node) -> int:
        """Where an open node is on the stack, looked for from the inside."""
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i] is node)

    def root(self) -> Node:
        if self.html is None:
            self.html = self.document.add(Node("element", "html"))
        return self.html

    def start_head(self) -> Node:
        if self.head is None:
            self.head = self.root().add(Node("element", "head"))
            self.reset(self.html, self.head)
        return self.head

    def start_body(self) -> Node:
        self.start_head()
        if self.body is None:
            self.body = self.html.add(Node("element", "body"))
            self.reset(self.html, self.body)
        return self.body

    def pop_to(self, node: Node) -> None:
        """Close a node and all open ones in it, remembering formatting elements to open again."""
        i = self.place(node)
        if i:
            self.remember(n for n in self.stack[i + 1 :] if n.tag in FORMATTING)
            self.open.subtract(n.tag for n in self.stack[i:])
            del self.stack[i:]

    def remember(self, nodes: Iterable[Node]) -> None:
        """Formatting elements to open again: of those alike only the last ones, so that unclosed ones don't pile up."""
        kept: list[Node] = []
        seen: Counter[tuple] = Counter()
        for n in reversed([*self.reopen, *nodes]):
            alike = (n.tag, *sorted(n.attrs))
            seen[alike] += 1
            if seen[alike] <= ALIKE:
                kept.append(n)
        self.reopen = kept[::-1]

    def in_scope(self, tags: frozenset[str] | set[str], ends: frozenset[str]) -> Node | None:
        if not any(self.open[t] for t in tags):
            return None
        for n in reversed(self.stack):
            if n.tag in tags:
                return n
            if n.tag in ends:
                return None
        return None

    def restore(self) -> None:
        for n in self.reopen:
            self.push(self.stack[-1].add(Node("element", n.tag, attrs=list(n.attrs))))
        self.reopen = []

    def text(self, text: str) -> None:
        if self.body is None:
            inside = self.stack[-1].tag if self.stack else ""
            if inside in RAW or inside in RCDATA:
                self.put_text(self.stack[-1], text)
                return
            lead = text[: len(text) - len(text.lstrip("\t\n\f\r "))]
            if lead and self.head is not None:
                self.put_text(self.html if self.after_head else self.head, lead)
            text = text[len(lead) :]
            if not text:
                return
            self.start_body()
        if self.stack[-1].tag not in RAW and text.strip("\t\n\f\r "):
            self.restore()
        self.put_text(self.stack[-1], text)

    @staticmethod
    def put_text(parent: Node, text: str) -> None:
        if parent.children and parent.children[-1].kind == "text":
            parent.children[-1].text += text
        else:
            parent.add(Node("text", text=text))

    def start(self, tag: str, attrs: list[tuple[str, str]], closed: bool) -> None:
        if tag in ("html", "body"):
            node = self.root() if tag == "html" else self.start_body()
            node.attrs += [(n, v) for n, v in attrs if node.get(n) is None]
            return
        if tag == "head":
            if self.head is None:
                self.start_head().attrs = attrs
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                head = self.start_head()
                node = head.add(Node("element", tag, attrs=attrs))
                if tag not in VOID:
                    self.reset(self.html, head, node)
                return
            if tag == "frameset":
                self.start_head()
                self.body = self.html.add(Node("element", "frameset", attrs=attrs))
                self.reset(self.html, self.body)
                return
            self.start_body()
        if tag in BLOCKS and (p := self.in_scope({"p"}, SCOPE_ENDS)):
            self.pop_to(p)
        if tag in CLOSED_BY:
            ends = SCOPE_ENDS - {"td", "th"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") else SCOPE_ENDS | {"ul", "ol", "dl", "select"}
            while open_ := self.in_scope(CLOSED_BY[tag], ends):
                self.pop_to(open_)
        if tag in ("tr", "tbody", "thead", "tfoot", "td", "th"):
            if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
                self.push(self.stack[-1].add(Node("element", "tbody")))
            if tag in ("td", "th") and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self.push(self.stack[-1].add(Node("element", "tr")))
        elif tag == "a" and (a := self.in_scope({"a"}, SCOPE_ENDS)):
            self.pop_to(a)
        if tag not in BLOCKS and tag not in CLOSED_BY:
            self.restore()
        node = self.stack[-1].add(Node("element", tag, attrs=attrs))
        if tag not in VOID and not (closed and self.in_scope({"svg", "math"}, frozenset())):
            self.push(node)

    def end(self, tag: str) -> None:
        if self.body is None:
            if tag == "head" and self.head is not None:
                self.reset(self.html)
                self.after_head = True
            elif len(self.stack) > 1 and self.stack[-1].tag == tag:
                self.reset(*(self.stack[:-1] if self.head in self.stack else [self.html]))
            elif tag in ("html", "body", "br"):
                self.start_body()
            return
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", [], False)
            return
        if tag == "p" and not self.in_scope({"p"}, SCOPE_ENDS):
            self.start("p", [], False)
        names = {tag} if not re.fullmatch("h[1-6]", tag) else {f"h{i}" for i in range(1, 7)}
        ends = frozenset(["html"]) if tag in SCOPE_ENDS or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE_ENDS
        node = self.in_scope(names, ends)
        if node is None or node in (self.html, self.body):
            self.reopen = [n for n in self.reopen if n.tag != tag] if tag in FORMATTING else self.reopen
            return
        between = self.stack[self.place(node) + 1 :]
        if tag not in FORMATTING and tag not in BLOCKS and any(n.tag in BLOCKS for n in between):
            return
        self.pop_to(node)


def parse_html(html: str, closed_references: bool = False) -> Node:
    """The tree of a document; always with html, head and body.

    ``closed_references``: only character references that end in a semicolon
    are read.
    """
    b = _Builder()
    for token in tokens(html, unescape_closed if closed_references else unescape):
        kind = token[0]
        if kind == "text":
            b.text(token[1])
        elif kind == "start":
            b.start(*token[1:])
        elif kind == "end":
            b.end(token[1])
        elif kind == "comment":
            (b.stack[-1] if b.stack else b.document).add(Node("comment", text=token[1]))
        elif b.html is None:
            b.document.add(Node("doctype", text=token[1]))
    b.start_body()
    return b.document


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def serialize(node: Node) -> str:
    """HTML text of a node and all in it."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            raw = n.parent is not None and n.parent.tag in RAW
            out.append(n.text if raw else escape_text(n.text))
        elif n.kind == "comment":
            out.append(f"<!--{n.text}-->")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.text.split()[0] if n.text.split() else ''}>")
        else:
            if n.kind == "element":
                out.append(f"<{n.tag}" + "".join(f' {k}="{escape_attr(v)}"' for k, v in n.attrs) + ">")
                if n.tag in VOID and not n.text:
                    continue
                stack.append(f"</{n.tag}>")
            stack.extend(reversed(n.children))
    return "".join(out)


def made(tag: str, **attrs: str) -> Node:
    """A new element; void elements made here are serialised with an end tag, as ones without a namespace are."""
    return Node("element", tag, text="made", attrs=[(k.replace("_", "-"), v) for k, v in attrs.items()])


def change(html: str, rule: Callable[[Node], None]) -> str:
    """Parse, apply a rule to the document and serialise."""
    document = parse_html(html)
    rule(document)
    return serialize(document)

"""A small document tree over the standard library's tokenizer.

Tags aren't closed by implication: what a page leaves open ends with its parent, and an end tag without a start is
passed over. The tree lives inside one Python call and never becomes a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element, or (``tag`` None) a piece of text or (``tag`` "#comment") a comment."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    @property
    def is_text(self) -> bool:
        return self.tag is None

    @property
    def is_element(self) -> bool:
        return self.tag is not None and self.tag != "#comment"

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace_with(self, *nodes: Node) -> None:
        """Put other nodes in this one's place."""
        up = self.parent
        at = next(i for i, c in enumerate(up.children) if c is self)
        up.children[at : at + 1] = nodes
        for n in nodes:
            n.parent = up
        self.parent = None

    def unwrap(self) -> None:
        self.replace_with(*self.children)

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order; no recursion, as pages may nest deeply."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.is_element)

    def find_all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.elements() if (not tags or n.tag in tags) and (where is None or where(n))]

    def find(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next((n for n in self.elements() if (not tags or n.tag in tags) and (where is None or where(n))), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def has_class(self, name: str) -> bool:
        return name in self.classes()

    def get_text(self, separator: str = "", strip: bool = False) -> str:
        parts = [n.text for n in self.walk() if n.is_text]
        if strip:
            parts = [p for p in (x.strip() for x in parts) if p]
        return separator.join(parts)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def next_sibling(self, tag: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        if self.parent is None:
            return None
        after = False
        for c in self.parent.children:
            if after and c.tag == tag and (where is None or where(c)):
                return c
            after = after or c is self
        return None

    def html(self) -> str:
        """Markup of what is below."""
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.is_text:
                out.append(n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif n.tag == "#comment":
                out.append(f"<!--{n.text}-->")
            else:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append(f"</{n.tag}>")
                    stack.extend(reversed(n.children))
        return "".join(out)

    def pretty(self) -> str:
        """Markup with every tag and text on a line of its own, indented by depth."""
        out: list[str] = []
        stack: list[tuple[Node | str, int]] = [(c, 0) for c in reversed(self.children)]
        while stack:
            n, depth = stack.pop()
            if isinstance(n, str):
                out.append(" " * depth + n)
            elif n.is_text:
                text = n.text.strip().replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                if text:
                    out.append(" " * depth + text)
            elif n.is_element:
                attrs = "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
                out.append(" " * depth + f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>", depth))
                    stack.extend((c, depth + 1) for c in reversed(n.children))
        return "\n".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at.append(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            closed = self.at.tag
            self.open[closed] -= 1
            self.at = self.at.parent
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        last = self.at.children[-1] if self.at.children else None
        if last is not None and last.is_text:
            last.text += data
        else:
            self.at.append(Node(None, text=data))

    def handle_comment(self, data: str) -> None:
        self.at.append(Node("#comment", text=data))


def parse_html(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root

"""From a cleaned page to passages with their structural context."""

from __future__ import annotations

from dataclasses import dataclass, field

from clauseframe.functions.tree import Node, parse_html

#: Passage types by the tag around a text.
TYPES = {
    "td": "table_cell", "th": "table_header", "li": "list_item", "p": "text", "div": "text",
    "h1": "headline", "h2": "headline", "h3": "headline", "h4": "headline", "h5": "headline", "h6": "headline",
}
HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A table header of so many words or more is no header.
HEADER_WORDS = 30

Entry = tuple[str, str]  # text, type


@dataclass
class _Walk:
    """State of one document; nothing outlives it."""

    out: list[tuple[str, list[Entry], str]] = field(default_factory=list)
    context: list[Entry] = field(default_factory=list)
    #: The last element that ended, and its text: what may introduce a list or table.
    last: tuple[str, str] = ("", "")

    def children(self, node: Node, extra: list[Entry]) -> None:
        for c in list(node.children):
            if c.is_text:
                text = " ".join(c.text.split())
                if text:
                    self.out.append((TYPES.get(node.tag, f"UNKNOWN_{node.tag}"), [*self.context, *extra], text))
            elif c.is_element:
                self.element(c, extra)

    def element(self, node: Node, extra: list[Entry]) -> None:
        if node.tag in HEADLINES:
            self.children(node, extra)  # still under the headlines before it
            at = next((i for i, (_, kind) in enumerate(self.context) if kind == node.tag), None)
            if at is not None:
                del self.context[at:]
            self.context.append((" ".join(node.get_text(" ").split()), node.tag))
        elif node.tag in ("ul", "ol", "table"):
            tag, text = self.last
            kind = "table_intro" if node.tag == "table" else "list_intro"
            intro = [(text, kind)] if tag in ("p", "div") and text else []
            if node.tag == "table":
                self.table(node, [*extra, *intro])
            else:
                self.children(node, [*extra, *intro])
        else:
            self.children(node, extra)
        self.last = (node.tag, " ".join(node.get_text(" ").split()))

    def table(self, table: Node, extra: list[Entry]) -> None:
        """Cells get the header of their column (by running width) and of their row (its first cell), short ones only."""
        columns: list[str] = []
        for r, row in enumerate(table.find_all("tr", where=lambda n: next((a for a in n.ancestors() if a.tag == "table"), None) is table)):
            x = 0
            cells = [c for c in row.children if c.is_element]
            first = " ".join(cells[0].get_text(" ").split()) if cells else ""
            for k, cell in enumerate(cells):
                span = _span(cell)
                text = " ".join(cell.get_text(" ").split())
                if r == 0:
                    columns += [text] * span
                    more = []
                else:
                    more = [(columns[x], "table_column_header")] if x < len(columns) and _short(columns[x]) else []
                    more += [(first, "table_row_header")] if k and _short(first) else []
                self.children(cell, [*extra, *more])
                x += span


def _span(cell: Node) -> int:
    try:
        return min(1000, max(1, int(cell.attrs.get("colspan") or 1)))
    except ValueError:
        return 1


def _short(text: str) -> bool:
    return 0 < len(text.split()) < HEADER_WORDS


def passages_of(root: Node) -> list[tuple[str, list[Entry], str]]:
    """(type, context, passage) in document order."""
    walk = _Walk()
    walk.children(root, [])
    return walk.out


def parse_passages(cleaned: str | None) -> list[tuple[str, list[Entry], str]]:
    return passages_of(parse_html(cleaned))

"""From a raw page to a simple tree of text blocks: ten steps, each a function on the tree, in a fixed order."""

from __future__ import annotations

import re

from clauseframe.functions.tree import Node, parse_html

#: Elements without text of their own that matters.
DROPPED = frozenset("head title meta link style script noscript iframe object nav footer".split())
#: What classes, roles and ids of page furniture contain.
FURNITURE = re.compile(
    "nav|header|footer|cookie|banner|popup|toolbar|modal|dialog|overlay|consent|dropdown|onetrust|didomi|country-selector", re.IGNORECASE
)
#: Elements inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button center cite code data del dfn em font i img input ins kbd label map mark meter noscript object output picture "
    "progress q ruby s samp script select small span strong sub sup svg template textarea time tt u var wbr".split()
)
#: Elements that stay although they hold no text of their own.
STRUCTURE = frozenset("ul ol li table thead tbody tr td th".split())
PRE_STYLE = re.compile(r"white-space\s*:\s*(pre|pre-line|pre-wrap|break-spaces)\s*(;|$)", re.IGNORECASE)
ODD_SPACES = re.compile("[ ​]")


def drop_surroundings(root: Node) -> Node:
    """Without comments, furniture and all that lies outside the main container (the first that a cascade of tests finds)."""
    for n in [n for n in root.walk() if n.tag == "#comment" or n.tag in DROPPED]:
        n.remove()
    for n in root.find_all("div"):
        if any(FURNITURE.search(n.attrs.get(a, "")) for a in ("class", "role", "id")):
            n.remove()
    return main_container(root)


def main_container(root: Node) -> Node:
    def having(attr: str, word: str):
        return lambda n: n.tag == "div" and word in n.attrs.get(attr, "").lower()

    tests = [
        lambda n: n.tag == "main", lambda n: n.tag == "article", having("class", "article"), having("role", "article"), having("id", "article"),
        having("class", "main"), having("role", "main"),
    ]
    for test in tests:
        found = root.find(where=test)
        if found is not None:
            top = Node("#root")
            found.remove()
            top.append(found)
            return top
    return root


def unwrap_inline(root: Node) -> None:
    for n in root.find_all(*INLINE):
        n.unwrap()
    _join_texts(root)


def split_at_breaks(root: Node) -> None:
    """What stands before a line break, and what stands behind it, become paragraphs."""
    for br in root.find_all("br"):
        up = br.parent
        if up is None:
            continue
        at = next(i for i, c in enumerate(up.children) if c is br)
        before, after = up.children[:at], up.children[at + 1 :]
        up.children = []
        br.parent = None
        for part in (before, after):
            if part:
                p = up.append(Node("p"))
                for c in part:
                    p.append(c)


def split_preformatted(root: Node) -> None:
    """Preformatted text without elements inside: a paragraph for each line."""
    for n in root.find_all(where=lambda n: n.tag == "pre" or bool(PRE_STYLE.search(n.attrs.get("style", "")))):
        if n.parent is None or any(c.is_element for c in n.children):
            continue
        lines = n.get_text().split("\n")
        n.children = []
        for line in lines:
            n.append(Node("p")).append(Node(None, text=line))


def replace_odd_spaces(root: Node) -> None:
    """No-break and zero-width spaces become spaces."""
    for n in root.walk():
        if n.is_text:
            n.text = ODD_SPACES.sub(" ", n.text)


def strip_attributes(root: Node) -> None:
    for n in root.elements():
        n.attrs = {a: n.attrs.get(a) or "1" for a in ("rowspan", "colspan")} if n.tag in ("td", "th") else {}


def _join_texts(root: Node) -> None:
    for n in [root, *root.elements()]:
        joined: list[Node] = []
        for c in n.children:
            if c.is_text and joined and joined[-1].is_text:
                joined[-1].text += c.text
            else:
                joined.append(c)
        n.children = joined


def concatenate_texts(root: Node) -> None:
    """Neighbouring texts are one, white space is single spaces, and empty texts go."""
    _join_texts(root)
    for n in [n for n in root.walk() if n.is_text]:
        n.text = " ".join(n.text.split())
    for n in [root, *root.elements()]:
        n.children = [c for c in n.children if not c.is_text or c.text]


def wrap_texts(root: Node) -> None:
    """A text beside other children gets a paragraph of its own."""
    for n in [root, *root.elements()]:
        if len(n.children) > 1:
            for c in [c for c in n.children if c.is_text]:
                p = Node("p")
                c.replace_with(p)
                p.append(c)


def flatten(root: Node) -> None:
    """Containers without text go, their content stays; list items and cells around one element take over all it holds."""
    for n in root.find_all():
        if n.tag not in STRUCTURE and not any(c.is_text for c in n.children) and n.children:
            n.unwrap()
    for n in root.find_all("li", "tr", "td", "th"):
        only = [c for c in n.children if c.is_element]
        if len(n.children) == 1 and len(only) == 1 and not (n.tag == "tr" and only[0].tag in ("td", "th")) and only[0].tag not in ("ul", "ol", "table"):
            only[0].unwrap()
    _join_texts(root)


def drop_empty(root: Node) -> None:
    for n in reversed(root.find_all()):
        if not n.get_text().strip():
            n.remove()


def simplify(html: str | None) -> Node:
    root = drop_surroundings(parse_html(html))
    for step in (unwrap_inline, split_at_breaks, split_preformatted, replace_odd_spaces, strip_attributes, concatenate_texts, wrap_texts, flatten, drop_empty):
        step(root)
    return root


def clean_html(html: str | None) -> str:
    """The simplified page, one tag or text a line; empty if nothing is left."""
    return simplify(html).pretty()


#: Parts of a page that hold no policy text; parts of class and id names, and of class names only, that mark such.
_ASIDES = ("script", "style", "nav", "header", "footer", "aside")
_MARKED_BOTH = ("ad", "ads", "advertisement")
_MARKED_CLASS = ("tracking", "analytics", "social", "share", "cookie", "banner", "popup", "modal")
#: Where the main content is, in order of preference: (attribute or "tag", value).
_CONTENT = (
    ("tag", "main"), ("role", "main"), ("class", "main"), ("id", "main"), ("class", "content"), ("id", "content"), ("class", "post-content"),
    ("class", "article-content"), ("class", "privacy-content"), ("class", "legal-content"), ("class", "policy-content"),
    ("class", "document-content"), ("class", "page-content"),
)


def main_content(html: str | None) -> str:
    """The markup of a page's main content, or of its body, or the input."""
    root = parse_html(html)

    def marked(n: Node) -> bool:
        names, one = n.attrs.get("class", ""), n.attrs.get("id", "")
        return any(m in names or m in one for m in _MARKED_BOTH) or any(m in names for m in _MARKED_CLASS)

    for n in root.find_all(*_ASIDES) + root.find_all(where=marked):
        n.remove()
    found = None
    for kind, value in _CONTENT:
        tests = {"tag": lambda n, v=value: n.tag == v, "class": lambda n, v=value: n.has_class(v)}
        found = root.find(where=tests.get(kind, lambda n, k=kind, v=value: n.attrs.get(k) == v))
        if found is not None:
            break
    found = found or root.find("body")
    return _outer(found) if found is not None else (html or "")


def _outer(n: Node) -> str:
    top = Node("#root")
    n.remove()
    top.append(n)
    return top.html()


def visible_text(html: str | None) -> str:
    """All text outside scripts and styles."""
    root = parse_html(html)
    for n in root.find_all("script", "style"):
        n.remove()
    return root.get_text()

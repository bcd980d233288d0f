"""Store-page metadata: 25 nullable columns from three parts of an app's page."""

from __future__ import annotations

import re

from clauseframe.functions.tree import Node, parse_html

#: Class names that the store generates. They change; pass a copy with other values to follow.
CLASSES = {
    "stats": "dzkqwc", "info": "HcyOxe", "dev_id": "developer-contacts", "app_name": "AfwdI", "developer": "Vbfug", "rating": "TT9eCd", "reviews": "g1rdde",
    "downloads": "ClM7O", "feature": "UIuSk", "button": "VfPpkd-vQzf8d", "description": "bARER", "label": "TKjAsc", "value": "xg1aie", "categories": "Uc6QCc",
    "link_label": "xFVDSb", "contact": "pSEeg", "company": "HhKIQc", "address": "mHsyY",
}
_PHONE = re.compile(r"^\+?\d[\d\s\-()]+$")


def _text(n: Node | None) -> str | None:
    return (n.get_text(strip=True) or None) if n is not None else None


def _class(name: str):
    return lambda n: n.has_class(name)


def _first(pattern: str, text: str | None, flags: int = 0) -> str | None:
    m = re.search(pattern, text or "", flags)
    return (m[1] if m.groups() else m[0]).strip() if m else None


def _stats(s: Node, c: dict[str, str]) -> dict:
    text = s.get_text(" ")
    out: dict = {}
    out["app_name"] = _text(s.find("span", where=lambda n: n.has_class(c["app_name"]) and n.attrs.get("itemprop") == "name")) or _text(s.find("h1"))
    block = s.find("div", where=_class(c["developer"]))
    link = block.find("a") if block else None
    out["developer"] = _text(link.find("span") if link else None) or _text(s.find("a", where=lambda n: re.search(r"/store/apps/dev", n.attrs.get("href", "")) is not None))
    rating = _first(r"(\d+\.?\d*)", _text(s.find("div", where=_class(c["rating"]))))
    if rating is None:
        aria = s.find(where=lambda n: re.search(r"Rated .* stars", n.attrs.get("aria-label", "")) is not None)
        rating = _first(r"Rated (\d+\.?\d*) stars", aria.attrs["aria-label"]) if aria else None
    out["rating"] = float(rating) if rating else None
    reviews = s.find("div", where=lambda n: n.has_class(c["reviews"]) and "review" in n.get_text().lower())
    out["review_count"] = _first(r"([\d.]+[KMB]?)\s*reviews?", reviews.get_text() if reviews else None)
    for d in s.find_all("div", where=_class(c["downloads"])):
        after = d.next_sibling("div")
        if after is not None and "download" in after.get_text().lower():
            out["download_count"] = _text(d)
            break
    else:
        out["download_count"] = _first(r"([\d.,]+[KMB]?\+)\s*Downloads", text, re.IGNORECASE)
    rated = s.find(where=lambda n: n.attrs.get("itemprop") == "contentRating")
    out["content_rating"] = _text(rated.find("span") if rated else None) or _first(r"((?:USK|PEGI|ESRB)[^\n<]{0,40}?\d*\+?)(?:\s{2}|\n|$)", text)
    out["features"] = [t for t in (_text(n) for n in s.find_all("span", where=_class(c["feature"]))) if t] or None
    icon = s.find("img", where=lambda n: n.attrs.get("itemprop") == "image" and n.attrs.get("alt") == "Icon image")
    icon = icon or s.find("img", where=lambda n: "icon" in n.attrs.get("class", "").lower() and "googleusercontent.com" in n.attrs.get("src", ""))
    out["app_icon_url"] = icon.attrs.get("src") or None if icon else None
    item = s.find(where=lambda n: "data-item-id" in n.attrs)
    package = _first(r"[\"']([^\"']+)[\"']", item.attrs["data-item-id"]) if item else None
    if package is None:
        for n in s.elements():
            for k, v in n.attrs.items():
                if k.startswith("data-") and package is None:
                    package = _first(r"\b([a-zA-Z]\w*\.[a-zA-Z]\w*\.[\w.]*\w)\b", v)
    out["package_id"] = package
    price = s.find("meta", where=lambda n: n.attrs.get("itemprop") == "price")
    content = price.attrs.get("content") if price else None
    out["price"] = ("Free" if content == "0" else content) if content else _first(r"(\$\d+(?:\.\d+)?|\bFree\b|\bPaid\b)", text)
    install = s.find("button", where=lambda n: n.attrs.get("aria-label") == "Install")
    label = _text(install.find("span", where=_class(c["button"])) if install else None)
    label = label or _text(s.find("button", where=lambda n: "install" in n.get_text().lower()))
    out["install_button_text"] = label
    out["available_in_country"] = install is not None or label is not None
    return out


def _info(s: Node, c: dict[str, str]) -> dict:
    out: dict = {}
    described = s.find("div", where=_class(c["description"]))
    out["app_description"] = " ".join(described.get_text(" ").split()) or None if described else None
    meta = s.find("meta", where=lambda n: n.attrs.get("itemprop") == "description")
    out["short_description"] = meta.attrs.get("content") or None if meta else None

    def labelled(word: str) -> str | None:
        label = s.find("div", where=lambda n: n.has_class(c["label"]) and word in n.get_text())
        return _text(label.next_sibling("div", _class(c["value"]))) if label else None

    out["last_updated"] = labelled("Updated on")
    where = s.find("div", where=lambda n: n.has_class(c["label"]) and "Available on" in n.get_text())
    platforms = _text(where.next_sibling("div")) if where else None
    out["available_platforms"] = [p.strip() for p in platforms.split(",") if p.strip()] if platforms else None
    ranking = next((t for t in (_text(b) for b in s.find_all("button") + s.find_all("span", where=_class(c["button"]))) if t and re.search(r"#\d+.*top.*", t, re.IGNORECASE)), None)
    out["app_ranking"] = ranking
    box = s.find("div", where=_class(c["categories"]))
    names = [_text(n) for n in box.find_all("span", where=_class(c["button"]))] if box else []
    out["app_categories"] = [n for n in names if n and n != ranking and not re.search(r"#\d+", n)] or None
    return out


def _dev(s: Node, c: dict[str, str]) -> dict:
    def link(word: str) -> str | None:
        def fits(n: Node) -> bool:
            label = n.find("div", where=_class(c["link_label"]))
            return label is not None and word in label.get_text() and "http" in n.attrs.get("href", "")

        found = s.find("a", where=fits)
        return found.attrs["href"] if found else None

    out: dict = {"developer_website": link("Website"), "privacy_policy_url": link("Privacy Policy")}
    mail = next((t for t in (_text(n) for n in s.find_all("div", where=_class(c["contact"]))) if t and "@" in t), None)
    to = s.find("a", where=lambda n: n.attrs.get("href", "").startswith("mailto:"))
    out["support_email"] = mail or (to.attrs["href"][7:].partition("?")[0] or None if to else None)
    about = s.find("div", where=_class(c["company"]))
    inner = [t for t in (_text(n) for n in about.find_all("div")) if t] if about else []
    out["company_name"] = next((t for t in inner if "@" not in t and "+" not in t), None)
    out["company_email"] = next((t for t in inner if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", t)), None)
    place = s.find("div", where=_class(c["address"]))
    lines = [x.strip() for x in place.get_text("\n").split("\n") if x.strip()] if place else []
    address = ", ".join(lines)
    out["company_address"] = address if len(address) > 10 else next((t for t in inner if len(t) > 15 and re.search(r"\d", t) and re.search(r"[A-Z]{2}", t)), None)
    out["company_phone"] = next((t for t in inner if _PHONE.match(t)), None)
    return out


def parse_store_page(html: str | None, classes: dict[str, str] = CLASSES) -> dict:
    """The metadata of a store page; what isn't found is absent."""
    root = parse_html(html)
    stats = root.find("div", where=_class(classes["stats"]))
    info = root.find(
        "section", where=lambda n: n.has_class(classes["info"]) and n.find("meta", where=lambda m: m.attrs.get("itemprop") == "description") is not None
    )
    dev = root.find("div", where=lambda n: n.attrs.get("id") == classes["dev_id"])
    found: dict = {}
    for part, read in ((stats, _stats), (info, _info), (dev, _dev)):
        if part is not None:
            found |= read(part, classes)
    return {k: v for k, v in found.items() if v is not None}

"""HTML to text, links and hidden spans, in Arrow batches."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.per_text import per_text

MOST_CHARS, MOST_LINKS, MOST_HIDDEN, HIDDEN_CHARS = 1_000_000, 2_000, 100, 20_000

# fixed values
SKIPPED = frozenset({"script", "style", "head", "title", "template", "noscript", "svg"})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "tt", "u", "var", "wbr", "label", "time",
})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "br", "center", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "tr", "ul",
})
NOT_LINKS = ("#", "mailto:", "tel:", "sms:", "cid:", "callto:", "skype:", "whatsapp:")
VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "wbr", "source"})

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tokens(source: str):
    """(text, closing, name, attribute source) in order; name is empty for text."""
    at = 0
    source = source[:MOST_CHARS]
    for m in _TAG.finditer(source):
        if m.start() > at:
            yield source[at : m.start()], False, "", ""
        if m[2]:
            yield "", bool(m[1]), m[2].lower(), m[3]
        at = m.end()
    if at < len(source):
        yield source[at:], False, "", ""


def squeeze(text: str) -> str:
    """Zero-width characters dropped, blanks collapsed, single line ends."""
    text = text.translate(_ZERO)
    text = re.sub(r"[^\S\n]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r" ?\n\s*", "\n", text).strip()


def strip(source: str) -> str:
    """The visible text: block elements end lines, inline ones leave nothing, others a blank."""
    out, inside = [], ""
    for text, closing, name, _ in tokens(source):
        if inside:
            if closing and name == inside:
                inside = ""
        elif not name:
            out.append(html.unescape(text))
        elif name in SKIPPED:
            inside = "" if closing else name
        elif name in BLOCK:
            out.append("\n")
        elif name not in INLINE:
            out.append(" ")
    return squeeze("".join(out))


def normal_href(raw: str) -> str | None:
    href = re.sub(r"[\x00-\x1f\x7f]", "", html.unescape(raw)).strip()
    return None if not href or len(href) > 4096 or href.lower().startswith(NOT_LINKS) else href


def links(source: str) -> list[tuple[str, str]]:
    """Targets and visible text of the anchors and areas; the first of equal targets counts."""
    out: dict[str, tuple[str, str]] = {}
    target, parts, seen = None, [], 0

    def close() -> None:
        if target:
            out.setdefault(target.strip().lower(), (target, squeeze("".join(parts))))

    for text, closing, name, rest in tokens(source):
        if name in ("a", "area") and not closing:
            close()
            seen += 1
            if seen > MOST_LINKS:
                return list(out.values())
            given = attributes(rest)
            target, parts = normal_href(given.get("href", "")), []
            if name == "area":
                parts = [given.get("alt", "")]
                close()
                target = None
        elif name == "a":
            close()
            target = None
        elif name == "img" and target:
            given = attributes(rest)
            parts.append(" " + given.get("alt", given.get("title", "")) + " ")
        elif target is not None:
            parts.append(html.unescape(text) if not name else " " if name in BLOCK else "")
    close()
    return list(out.values())


def _number(value: str) -> float | None:
    m = re.match(r"\s*(-?\d*\.?\d+)", value or "")
    return float(m[1]) if m else None


def colour(raw: str) -> str | None:
    """#rrggbb of #rgb, #rrggbb or rgb()."""
    c = raw.strip().lower()
    if m := re.fullmatch(r"#([0-9a-f])([0-9a-f])([0-9a-f])", c):
        return "#" + "".join(x * 2 for x in m.groups())
    if re.fullmatch(r"#[0-9a-f]{6}", c):
        return c
    if m := re.match(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", c):
        return "#" + "".join(f"{min(255, int(x)):02x}" for x in m.groups())
    return {"white": "#ffffff", "black": "#000000"}.get(c)


def hidden_style(style: str, background: str | None = None) -> bool:
    """The declarations hide what they apply to."""
    given = {k.strip(): v.strip() for k, _, v in (d.partition(":") for d in re.sub(r"!\s*important", "", style.lower()).split(";"))}
    small = lambda k, most: (n := _number(given.get(k, ""))) is not None and n <= most
    back = colour(given.get("background-color", given.get("background", ""))) or (colour(background) if background else None)
    return (
        given.get("display") == "none" or given.get("visibility") in ("hidden", "collapse") or small("opacity", 0.05) or small("font-size", 1) or given.get("mso-hide") == "all"
        or (small("max-height", 0) or small("max-width", 0)) or (small("height", 0) and small("width", 0)) or small("text-indent", -100)
        or (given.get("position") in ("absolute", "fixed") and (small("left", -1000) or small("top", -1000)))
        or (back is not None and colour(given.get("color", "")) == back)
    )


def hidden(source: str) -> list[str]:
    """Text of the outermost hidden elements."""
    out, name_, depth, parts = [], "", 0, []
    for text, closing, name, rest in tokens(source):
        if depth:
            if not name:
                parts.append(html.unescape(text))
            elif name == name_:
                depth += -1 if closing else 1
                if not depth:
                    if t := squeeze("".join(parts)):
                        out.append(t)
                    if len(out) >= MOST_HIDDEN or sum(map(len, out)) >= HIDDEN_CHARS:
                        break
        elif name and not closing and name not in VOID:
            given = attributes(rest)
            if "hidden" in given or hidden_style(given.get("style", ""), given.get("bgcolor")):
                name_, depth, parts = name, 1, []
    return out


_strip = per_text(strip, T.StringType())
_links = per_text(lambda s: [{"href": h, "anchor": a} for h, a in links(s)], T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor", T.StringType())])))
_hidden = per_text(hidden, T.ArrayType(T.StringType()))


def plain_text(source: Column) -> Column:
    """Visible text of HTML; empty for null."""
    return _strip(source)


def links_of(source: Column) -> Column:
    return _links(source)


def hidden_text(source: Column) -> Column:
    """Hidden spans; elements that hide nothing are skipped before the tokenizer where no style could hide."""
    return F.when(F.lower(source).rlike("style|hidden"), _hidden(source)).otherwise(F.array().cast("array<string>"))

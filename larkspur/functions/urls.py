"""Host and domain features of URLs, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import catalogs as cat

_SCHEMES_WITH_BACKSLASH = "http|https|ftp|ws|wss|file"


def listed(value: Column, names) -> Column:
    """The value is one of the names, which have no commas; one literal keeps plans small."""
    return F.lit("," + ",".join(names) + ",").contains(F.concat(F.lit(","), value, F.lit(",")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is written, and computed, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_host(host: Column) -> Column:
    """Lower case, without trailing dots."""
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def browser_href(href: Column) -> Column:
    """What a browser reads: backslashes before the query are slashes, unless the scheme is not a web scheme."""
    scheme = F.regexp_extract(href, r"^([\p{L}\p{N}+.-]*):", 1)
    web = (~href.rlike(r"^[\p{L}\p{N}+.-]*:")) | F.lower(scheme).rlike(f"^(?:{_SCHEMES_WITH_BACKSLASH})$")
    head, tail = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    return F.when(href.contains("\\") & web, F.concat(F.translate(head, "\\", "/"), tail)).otherwise(href)


def host_of(href: Column) -> Column:
    """The host that a browser would visit; null for other schemes, for empty and overlong references."""
    t = browser_href(F.trim(F.regexp_replace(href, r"^[\s]+|[\s]+$", "")))
    no_host = F.lower(t).rlike(r"^(?:mailto:|tel:|sms:|javascript:|data:|cid:|#)") | (t == "") | (F.length(t) > 4096)
    has_scheme = t.contains("://") | t.startswith("//")
    url = F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(has_scheme, t).otherwise(F.concat(F.lit("http://"), t))
    authority = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"(?s)^.*@", "")
    host = normal_host(F.trim(F.when(bare.startswith("["), F.regexp_extract(bare, r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))))
    good = (host != "") & ~host.contains(" ") & (has_scheme | host.contains("."))
    return F.when(~no_host & good, host)


def labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def last(parts: Column, n) -> Column:
    """The last n of an array's parts, joined by dots."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), ".")


def is_ip(host: Column) -> Column:
    """IPv4 in any radix and with any number of parts, or IPv6, with brackets or zone."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\[(.*)\]$", "$1"), r"%.*$", "")

    def number(p: Column) -> Column:
        small = F.length(p) <= 12
        return (
            F.when(small & p.rlike(r"^0x[0-9a-f]+$"), F.conv(F.substring(p, 3, 12), 16, 10))
            .when(small & p.rlike(r"^0[0-7]+$"), F.conv(F.substring(p, 2, 12), 8, 10))
            .when(small & p.rlike(r"^(?:0|[1-9][0-9]*)$"), p)
            .cast("decimal(20,0)")
        )

    def four(values: Column) -> Column:
        n = F.size(values)
        bytes_ = F.forall(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda v: v <= 255)
        return (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & bytes_ & (F.element_at(values, -1) < F.pow(F.lit(256), 5 - n))

    def six(h: Column) -> Column:
        doubles = F.size(F.split(h, "::")) - 1
        groups = F.filter(F.split(F.regexp_replace(h, r"(^|:)\d{1,3}(?:\.\d{1,3}){3}$", "$10:0"), ":"), lambda g: g != "")
        count = F.when(doubles == 1, F.size(groups) <= 7).otherwise(F.size(groups) == 8)
        return h.rlike(r"^[0-9a-f:.]+$") & (doubles <= 1) & F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}$")) & count

    # most hosts end in a letter that no address has
    may = bare.rlike(r"[:]|(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
    found = let(bare, lambda h: F.when(h.contains(":"), six(h)).otherwise(let(F.transform(F.split(h, r"\."), number), four)))
    return F.coalesce(may & (F.length(bare) <= 64) & found, F.lit(False))


_SUFFIXES = sorted({*cat.SUFFIXES, *cat.FREE_HOSTING})


def _suffix_size(parts: Column) -> Column:
    out = F.lit(1)
    for n in (2, 3, 4):
        out = F.when((F.size(parts) > n) & listed(last(parts, n), [s for s in _SUFFIXES if s.count(".") == n - 1]), n).otherwise(out)
    return out


def suffix_size(host: Column) -> Column:
    """How many labels the public suffix has: the longest listed one of four to two labels, else one."""
    return let(labels(host), _suffix_size)


def public_suffix(host: Column) -> Column:
    return let(labels(F.lower(host)), lambda p: F.when(F.size(p) < 2, F.array_join(p, ".")).otherwise(last(p, _suffix_size(p))))


def registrable(host: Column) -> Column:
    """The suffix and the label before it; an address as it is."""
    own = lambda h: let(labels(h), lambda p: F.when(F.size(p) < 2, h).otherwise(last(p, _suffix_size(p) + 1)))
    return let(normal_host(host), lambda h: F.when(is_ip(h), h).otherwise(own(h)))


def depth(host: Column) -> Column:
    """Labels before the registrable domain."""
    below = lambda p: F.greatest(F.lit(0), F.size(p) - F.least(F.size(p), _suffix_size(p) + 1))
    return let(normal_host(host), lambda h: F.when(is_ip(h), 0).otherwise(let(labels(h), below)))


def is_punycode(host: Column) -> Column:
    h = F.lower(host)
    return h.rlike(r"(?:^|\.)xn--") | h.rlike(r"[^\x00-\x7F]")


def in_set(host: Column, names, own: Column | None = None) -> Column:
    """The host or its registrable domain, which may be given, is listed."""
    if own is not None:
        return listed(normal_host(host), names) | listed(own, names)
    return let(normal_host(host), lambda h: listed(h, names) | listed(registrable(h), names))


def is_free_mail(domain: Column, own: Column | None = None) -> Column:
    return in_set(domain, cat.FREE_MAIL, own)


def is_shortener(host: Column, own: Column | None = None) -> Column:
    return in_set(host, cat.SHORTENERS, own)


def has_suspicious_tld(host: Column) -> Column:
    return let(normal_host(host), lambda h: ~is_ip(h) & listed(F.substring_index(h, ".", -1), cat.SUSPICIOUS_TLDS))


def is_free_hosting(host: Column) -> Column:
    def test(h: Column) -> Column:
        hosted = let(labels(h), lambda p: (F.size(p) >= 3) & (listed(last(p, 2), cat.FREE_HOSTING) | listed(last(p, 3), cat.FREE_HOSTING)))
        return hosted | (h == "sites.google.com") | h.endswith(".sites.google.com")

    return let(normal_host(host), test)


def path_and_query(href: Column) -> Column:
    """Lower-case path, a question mark and the query, without fragment."""
    t = F.regexp_replace(href, r"^\s+|\s+$", "")
    rest = F.regexp_extract(t, r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.lower(F.concat(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.lit("?"), F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)))


def has_userinfo(href: Column) -> Column:
    return F.regexp_extract(href, r"(?s)^.*?://([^/?#]*)", 1).contains("@")


def contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def has_credential_token(host: Column) -> Column:
    """A label part, outside the public suffix, that names a sign-in."""
    own = lambda p: F.slice(p, 1, F.greatest(F.size(p) - _suffix_size(p), F.lit(0)))
    tokens = F.flatten(F.transform(let(labels(host), own), lambda x: F.split(x, "-")))
    return F.exists(tokens, lambda t: listed(t, cat.CREDENTIAL_HOSTS))


def homoglyphs(text: Column) -> Column:
    """Look-alike characters and pairs folded to the letters that they imitate."""
    t = F.lower(text)
    for pair, letter in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        t = F.replace(t, F.lit(pair), F.lit(letter))
    return F.translate(t, *cat.HOMOGLYPHS)


#: Longest text in which links are looked for, and most links of a message.
LINK_CHARS = 1_000_000
MOST_LINKS = 50
# fixed value: a scheme or www., then anything but white space and delimiters
TEXT_URL = r"""(?i)(?:https?://|www\.)[^\s<>"'`\[\]{}|\\^]+"""


def _trimmed_url(found: Column) -> Column:
    """Without the punctuation of the sentence, and without the closing brackets that none opens."""
    bare = F.regexp_replace(found, r"""[.,;:!?'"]+$""", "")
    closing = F.length(bare) - F.length(F.regexp_replace(bare, r"\)+$", ""))
    extra = F.length(F.regexp_replace(bare, r"[^)]", "")) - F.length(F.regexp_replace(bare, r"[^(]", ""))
    return F.substring(bare, F.lit(1), F.length(bare) - F.greatest(F.least(closing, extra), F.lit(0)))


def text_urls(text: Column) -> Column:
    """The bare http(s) and www. addresses of a plain text in order, twice ``MOST_LINKS`` at most."""
    found = F.regexp_extract_all(F.substring(text, 1, LINK_CHARS), F.lit(TEXT_URL), F.lit(0))
    return F.slice(F.filter(F.transform(found, _trimmed_url), lambda u: u != ""), 1, 2 * MOST_LINKS)


def addresses(text: str) -> list[str]:
    """``text_urls`` for one text, inside a task."""
    out = []
    for m in re.finditer(TEXT_URL, text[:LINK_CHARS], re.ASCII):
        bare = m[0].rstrip(".,;:!?'\"")
        unopened = min(len(bare) - len(bare.rstrip(")")), bare.count(")") - bare.count("("))
        out.append(bare[: len(bare) - max(unopened, 0)])
    return list(filter(None, out))[: 2 * MOST_LINKS]


def message_links(anchors: Column, text: Column) -> Column:
    """A message's links (href, anchor): those of its HTML, then those of its text; the first of equal targets counts, ``MOST_LINKS`` at most.

    anchors: array of (href, anchor), null for none.  Targets are equal when they are so in lower case, without blanks around them.
    """
    kind = "array<struct<href:string,anchor:string>>"
    bare = F.transform(F.coalesce(text_urls(text), F.array().cast("array<string>")), lambda u: F.struct(u.alias("href"), F.lit(None).cast("string").alias("anchor")))
    both = F.transform(F.concat(F.coalesce(anchors, F.array().cast(kind)), bare), lambda x: F.struct(F.trim(x["href"]).alias("href"), x["anchor"].alias("anchor")))

    def first(every: Column) -> Column:
        keys = F.transform(every, lambda x: F.lower(x["href"]))
        return F.filter(every, lambda x, i: (x["href"] != "") & (F.array_position(keys, F.lower(x["href"])) == i + 1))

    return F.slice(let(both, first), 1, MOST_LINKS)

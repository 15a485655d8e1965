"""Which brand a host belongs to, imitates or names; computed once per distinct host."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import catalogs as cat
from larkspur.functions import urls
from larkspur.functions.per_text import per_text

_OWNER: dict[str, str] = {}
for _key, _, _domains in cat.BRANDS:
    for _d in _domains:
        _OWNER.setdefault(_d, _key)
_SUFFIX_DOMAINS = sorted({d for d in _OWNER if d in cat.SUFFIXES})
_REGIONAL = [k for k, _, _ in cat.BRANDS if k not in cat.DICTIONARY_BRANDS and k not in cat.DOMESTIC_BRANDS]
_NAMES: dict[str, str] = {}
for _key, _names, _ in cat.BRANDS:
    for _n in _names:
        if " " not in _n and "." not in _n and len(_n) >= 3:
            _NAMES.setdefault(_n, _key)


def _map(entries: dict[str, str]) -> Column:
    """Entries without commas and colons, from one literal."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in entries.items())), F.lit(","), F.lit(":"))


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _under(host: Column, entry: str) -> Column:
    return (host == entry) | host.endswith("." + entry)


def regional_brand(domain: Column) -> Column:
    """A brand's key directly under a country suffix."""

    def test(d: Column, suffix: Column) -> Column:
        label, tld = F.regexp_extract(d, r"^([^.]+)\.", 1), F.substring_index(suffix, ".", -1)
        fits = (F.concat(label, F.lit("."), suffix) == d) & ~urls.listed(suffix, cat.FREE_HOSTING) & (F.length(tld) == 2) & ~urls.listed(tld, cat.SUSPICIOUS_TLDS)
        return F.when(fits & urls.listed(label, _REGIONAL), label)

    return urls.let(domain, lambda d: urls.let(urls.public_suffix(d), lambda s: test(d, s)))


def owner(domain: Column) -> Column:
    """The brand that a registrable domain belongs to; null for none."""
    return urls.let(urls.normal_host(domain), lambda d: F.coalesce(F.try_element_at(_map(_OWNER), d), regional_brand(d)))


def _public(host: Column) -> Column:
    """Under a public suffix that is a brand's own."""
    out = F.lit(False)
    for d in _SUFFIX_DOMAINS:
        out = out | _under(host, d)
    return out


def _with_registrable(host: Column, registrable: Column | None, body) -> Column:
    """``body`` of the normal host and its registrable domain, which is taken as given where it is known."""
    if registrable is not None:
        return urls.let(urls.normal_host(host), lambda h: body(h, registrable))
    return urls.let(urls.normal_host(host), lambda h: urls.let(urls.registrable(h), lambda r: body(h, r)))


def legitimate_for(host: Column, registrable: Column | None = None) -> Column:
    """Keys of the brands, one or more, to whose domains the host belongs; an empty array for none."""
    listed: dict[str, list[str]] = {}
    for key, _, domains in cat.BRANDS:
        for d in domains:
            listed.setdefault(d, []).append(key)
    public = {d: listed[d] for d in _SUFFIX_DOMAINS}
    joined = _map({d: ";".join(k) for d, k in listed.items()})

    def keys(h: Column, r: Column) -> Column:
        own = F.concat_ws(";", F.try_element_at(joined, r), regional_brand(r))
        return F.split(F.concat_ws(";", own, *[F.when(_under(h, d), ";".join(k)) for d, k in public.items()]), ";")

    return _with_registrable(host, registrable, keys)


def is_brand_host(host: Column, registrable: Column | None = None) -> Column:
    """On a domain of any brand, tenants of shared hosting excluded."""

    def test(h: Column, r: Column) -> Column:
        return F.when(owner(r).isNotNull(), ~(urls.listed(r, cat.MULTI_TENANT) & (h != r))).otherwise(_public(h))

    return _with_registrable(host, registrable, test)


def catalogue(spark: SparkSession) -> DataFrame:
    """The brands as a table: ord, key, names, domains, dictionary, domestic, embedded."""
    rows = [(i, k, list(n), list(d), k in cat.DICTIONARY_BRANDS, k in cat.DOMESTIC_BRANDS, k in cat.EMBEDDED_BRANDS) for i, (k, n, d) in enumerate(cat.BRANDS)]
    return spark.createDataFrame(rows, "ord int, key string, names array<string>, domains array<string>, dictionary boolean, domestic boolean, embedded boolean")


_REMAINDER = "^(?:" + "|".join(sorted({w for w in cat.COMPANIONS if not w.isdigit()}, key=lambda w: (-len(w), w))) + "|[0-9]+)*$"


def lookalikes(hosts: DataFrame) -> DataFrame:
    """hosts (host, distinct) that imitate a brand: host, brand, kind, label.

    Every host meets every brand of the fixed catalogue once, and the best
    match by kind, then catalogue order, then label, stays.  A host of a brand
    imitates none, save for the tenant's labels on shared hosting.
    """
    h = F.col("host")
    parts = urls.labels(h)
    r = urls.registrable(h)
    base = hosts.filter((h != "") & (F.length(h) <= 253) & ~urls.is_ip(h)).select("host", parts.alias("parts"), r.alias("r"), owner(r).alias("own"), urls.suffix_size(h).alias("s"))
    tenant = F.col("own").isNotNull()
    keep = F.when(tenant, F.size("parts") - F.size(urls.labels(F.col("r")))).otherwise(F.size("parts") - F.least(F.col("s"), F.greatest(F.size("parts") - 1, F.lit(0))))
    base = base.filter(F.col("own").isNull() | urls.listed(F.col("r"), cat.MULTI_TENANT)).select("host", tenant.alias("tenant"), F.slice("parts", 1, F.greatest(keep, F.lit(0))).alias("labels")).filter(F.size("labels") > 0)
    tokens = F.filter(F.flatten(F.transform("labels", lambda x: F.split(x, "[-_]"))), lambda x: x != "")
    own = F.element_at("labels", -1)
    base = base.withColumns({
        "tokens": tokens,
        "companion": F.exists(tokens, lambda t: urls.listed(t, cat.COMPANIONS) | t.rlike("^[0-9]+$")),
        "typed": F.array_sort(F.array_distinct(F.concat(F.array(own), F.split(own, "-")))),
    })
    brand = F.broadcast(catalogue(hosts.sparkSession).select("ord", "key", "dictionary", "embedded"))  # a fixed table
    pairs = base.crossJoin(brand)
    key, n = F.col("key"), F.length("key")
    needs = F.col("tenant") | F.col("dictionary")
    exact = F.array_contains("tokens", key) & (~needs | F.col("companion"))
    glued = _first(F.filter("tokens", lambda t: (F.length(t) > n) & (F.regexp_replace(t, "^[0-9]+|[0-9]+$", "") == key)))
    alike = _first(F.filter("tokens", lambda t: (F.length(t) >= 4) & (urls.homoglyphs(t) != t) & (urls.homoglyphs(t) == key)))
    limit = F.when(n >= 8, 2).otherwise(1)
    near = _first(F.filter("typed", lambda t: (F.length(t) >= 5) & (t != key) & (F.abs(F.length(t) - n) <= limit) & (F.levenshtein(t, key) <= limit)))

    def squashed(x: Column) -> Column:
        return urls.homoglyphs(F.replace(x, F.lit("-"), F.lit("")))

    def inside(x: Column) -> Column:
        s = squashed(x)
        at = F.position(key, s)
        return (F.length(x) >= 7) & (F.length(s) > n) & (at > 0) & F.substr(s, F.lit(1), at - 1).rlike(_REMAINDER) & F.substr(s, at + n).rlike(_REMAINDER)

    within = _first(F.filter("labels", inside))
    found = F.coalesce(
        F.when(exact, F.struct(F.lit(1).alias("rank"), F.lit("brand_token").alias("kind"), key.alias("label"))),
        F.when((n >= 4) & ~needs & glued.isNotNull(), F.struct(F.lit(1).alias("rank"), F.lit("brand_token").alias("kind"), glued.alias("label"))),
        F.when(alike.isNotNull(), F.struct(F.lit(2).alias("rank"), F.lit("homoglyph").alias("kind"), alike.alias("label"))),
        F.when((n >= 6) & ~F.col("dictionary") & near.isNotNull(), F.struct(F.lit(3).alias("rank"), F.lit("typosquat").alias("kind"), near.alias("label"))),
        F.when(F.col("embedded") & within.isNotNull(), F.struct(F.lit(4).alias("rank"), F.lit("embedded").alias("kind"), within.alias("label"))),
    )
    ranked = pairs.withColumn("m", found).filter("m is not null").groupBy("host").agg(F.min(F.struct("m.rank", "ord", "m.label", "m.kind", "key")).alias("b"))
    return ranked.select("host", F.col("b.key").alias("brand"), F.col("b.kind").alias("kind"), F.col("b.label").alias("label"))


def subdomain_brand(host: Column, registrable: Column | None = None) -> Column:
    """The first label below a foreign registrable domain that is a brand's key or one-word name."""
    known = {**_NAMES, **{k: k for k, _, _ in cat.BRANDS}}
    names = sorted(n for n in known if len(n) >= 3 and n not in cat.GENERIC_BRAND_LABELS)

    def test(h: Column, r: Column) -> Column:
        foreign = owner(r).isNull() & ~urls.is_ip(h) & ~urls.is_shortener(h) & ~urls.listed(r, cat.MULTI_TENANT) & ~_public(h)
        below = urls.let(urls.labels(h), lambda p: F.slice(p, 1, F.greatest(F.size(p) - F.size(urls.labels(r)), F.lit(0))))
        return F.when(foreign, F.try_element_at(_map(known), F.try_element_at(F.filter(below, lambda x: urls.listed(x, names)), F.lit(1))))

    return _with_registrable(host, registrable, test)


@lru_cache(maxsize=1)
def _mention_automaton():
    """Names and qualifying phrases of all brands in one automaton; one for each worker."""
    import ahocorasick

    found: dict[str, list[tuple[int, bool]]] = {}
    for i, (key, names, _) in enumerate(cat.BRANDS):
        for n in names:
            found.setdefault(n, []).append((i, False))
        for q in cat.QUALIFIED_MENTIONS.get(key, ()):
            found.setdefault(q, []).append((i, True))
    made = ahocorasick.Automaton()
    for word, uses in found.items():
        made.add_word(word, (len(word), uses))
    made.make_automaton()
    return made


def _mentioned(lower: str) -> list[str]:
    named, qualified = set(), set()
    for end, (n, uses) in _mention_automaton().iter(lower):
        start = end + 1 - n
        if (start and lower[start - 1].isalnum()) or (end + 1 < len(lower) and lower[end + 1].isalnum()):
            continue
        for i, qualifies in uses:
            (qualified if qualifies else named).add(i)
    keys = ((i, cat.BRANDS[i][0]) for i in sorted(named))
    return [key for i, key in keys if key not in cat.QUALIFIED_MENTIONS or i in qualified]


_mentions = per_text(_mentioned, T.ArrayType(T.StringType()))


def mentions(text: Column) -> Column:
    """Keys of the brands named in the first 2000 characters, in catalogue order; ordinary words need a qualified phrase."""
    return _mentions(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 2000)))

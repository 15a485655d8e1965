"""Mail rules as a table of conditions over context columns, and the verdict they lead to.

``messages`` has one row per message::

    message_id string, from struct<name,address>, sender struct<name,address>, reply_to array<struct<name,address>>,
    `to` array<struct<name,address>>, subject string, text_body string, html_body string,
    headers array<struct<name,value>>, attachments array<struct<filename,mime_type,size_bytes>>,
    links array<struct<href,anchor>>, auth struct<spf,dkim,dmarc,arc,dkim_domain,spf_domain>

Links are judged as rows of their own: host features are computed once per
distinct host and joined, then rolled up per message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import brands, html, lexicon, scoring, text, urls
from larkspur.functions import catalogs as cat
from larkspur.operators import facts

ADDRESS = "struct<name:string,address:string>"
SCHEMA = (
    f"message_id string, `from` {ADDRESS}, sender {ADDRESS}, reply_to array<{ADDRESS}>, `to` array<{ADDRESS}>, subject string, "
    "text_body string, html_body string, headers array<struct<name:string,value:string>>, "
    "attachments array<struct<filename:string,mime_type:string,size_bytes:bigint>>, links array<struct<href:string,anchor:string>>, "
    "auth struct<spf:string,dkim:string,dmarc:string,arc:string,dkim_domain:string,spf_domain:string>"
)
SIGNAL = "struct<ord:int,id:string,title:string,severity:string,weight:double,credit:double>"
DANGEROUS = "^(?:javascript:|data:|vbscript:)"
BODY_CHARS, MENTION_CHARS, GREETING_CHARS, STRANGER_CHARS = 100_000, 400, 300, 600


@dataclass(frozen=True)
class Rule:
    """A signal: when it fires, how severe and heavy it is then, and what it takes off the score."""

    id: str
    title: str
    severity: str | Column
    weight: float | Column
    when: Column
    credit: float | Column = 0.0


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def signals(rules: list[Rule]) -> Column:
    """The signals that fire, in the rules' order."""
    every = [
        F.when(r.when, F.struct(F.lit(i).alias("ord"), F.lit(r.id).alias("id"), F.lit(r.title).alias("title"), _lit(r.severity).alias("severity"), _lit(r.weight).cast("double").alias("weight"), _lit(r.credit).cast("double").alias("credit")))
        for i, r in enumerate(rules)
    ]
    return F.array_compact(F.array(*every)).cast(f"array<{SIGNAL}>")


def domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1))).otherwise("")


def header(name: str) -> Column:
    """The first value of a header, by case-insensitive name."""
    return F.try_element_at(F.filter(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def host_features(hosts: DataFrame) -> DataFrame:
    """hosts (host, distinct): what the link rules ask of a host, whoever links to it."""
    h = F.col("host")
    reg = F.col("h_registrable")
    out = hosts.select("host", urls.registrable(h).alias("h_registrable")).select(
        "host", reg, urls.is_ip(h).alias("h_ip"), urls.is_punycode(h).alias("h_punycode"), urls.is_shortener(h, reg).alias("h_shortener"),
        urls.has_suspicious_tld(h).alias("h_tld"), urls.is_free_hosting(h).alias("h_free"), urls.depth(h).alias("h_depth"), urls.has_credential_token(h).alias("h_credential"),
        brands.is_brand_host(h, reg).alias("h_brand"), brands.subdomain_brand(h, reg).alias("h_below"), brands.legitimate_for(h, reg).alias("h_legit"),
    )
    alike = brands.lookalikes(hosts).select("host", F.col("brand").alias("h_lookalike"))
    return out.join(alike, "host", "left")


def domain_facts(domains: DataFrame) -> DataFrame:
    """domains (domain, distinct): what the rules ask of a mail domain, whoever sends from it."""
    out = domains.withColumn("registrable", urls.registrable(F.col("domain")))
    out = out.select("domain", "registrable", urls.is_free_mail(F.col("domain"), F.col("registrable")).alias("free"), brands.owner(F.col("registrable")).alias("brand"), brands.legitimate_for(F.col("domain"), F.col("registrable")).alias("legit"))
    alike = brands.lookalikes(domains.select(F.col("domain").alias("host")))
    return out.join(alike.select(F.col("host").alias("domain"), F.col("brand").alias("lookalike")), "domain", "left")


def context(messages: DataFrame, organisation: tuple[str, ...] = (), linked: bool = True) -> DataFrame:
    """Messages with the context columns that the rules use; where ``links`` is null, they are found in both bodies.

    Only link and content rules ask what the links show; without ``linked`` that is left out.
    Facts of domains and hosts come first, while rows are as narrow as they arrive; texts are searched behind the last join.
    """
    found = urls.message_links(html.links_of(F.when(F.col("links").isNull(), F.coalesce("html_body", F.lit("")))), F.when(F.col("links").isNull(), F.col("text_body")))
    messages = messages.withColumn("links", F.coalesce("links", found))
    none, no = F.array().cast("array<string>"), F.lit(False)
    replies = F.filter(F.transform(F.coalesce("reply_to", F.array().cast(f"array<{ADDRESS}>")), lambda a: domain_of(a["address"])), lambda d: d != "")
    senders = F.coalesce(domain_of(F.col("from.address")), F.lit(""))
    domains = facts.distinct(messages.select(F.explode(F.concat(replies, F.array(senders))).alias("domain")).filter("domain <> ''"), "domain")
    known = facts.staged(domain_facts(domains.select("domain")).join(domains, "domain"))
    own = known.select(F.col("domain").alias("from_domain"), "n", "registrable", "free", "brand", F.col("legit").alias("from_legit"), F.col("lookalike").alias("from_lookalike"))
    sent = facts.with_facts(messages.withColumn("from_domain", senders), own, "from_domain", "message_id").withColumn("registrable", F.coalesce("registrable", F.lit("")))
    base = sent.withColumns({
        "free": F.coalesce("free", F.lit(False)),
        "from_legit": F.coalesce("from_legit", F.array(F.lit(""))),
        "recipients": F.array_distinct(F.filter(F.transform(F.coalesce("to", F.array().cast(f"array<{ADDRESS}>")), lambda a: urls.registrable(domain_of(a["address"]))), lambda d: d != "")),
    })
    strange = lambda r: (r != F.col("registrable")) & ~F.array_contains("recipients", r)
    odd = F.filter(F.slice(replies, 1, 3), lambda d: urls.let(urls.registrable(d), strange))
    theirs = known.select(F.col("domain").alias("odd_reply"), "n", F.col("lookalike").alias("reply_lookalike"), F.col("free").alias("reply_free"))
    base = facts.with_facts(base.withColumn("odd_reply", F.try_element_at(odd, F.lit(1))), theirs, "odd_reply", "message_id")
    if linked:
        base = base.join(_links(messages, sent), "message_id", "left")
    body = F.coalesce(F.when(F.trim("text_body") != "", F.trim("text_body")), F.when(F.length("html_body") > 0, html.plain_text(F.col("html_body"))), F.lit(""))
    scan = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.substring(body, 1, BODY_CHARS))
    base = base.withColumns({
        "none": none, "body": body, "scan": scan, "name": F.coalesce("from.name", F.lit("")),
        "hits": lexicon.matches(scan), "name_hits": lexicon.matches(F.coalesce("from.name", F.lit(""))), "hidden": html.hidden_text(F.coalesce("html_body", F.lit(""))), "subject_hits": lexicon.matches(F.coalesce("subject", F.lit(""))),
        "greeting_hits": lexicon.matches(F.substring(body, 1, GREETING_CHARS)),
        "spf": F.col("auth.spf"), "dkim": F.col("auth.dkim"), "dmarc": F.col("auth.dmarc"), "arc": F.col("auth.arc"),
    })
    base = base.withColumns({
        "list_headers": header("List-Unsubscribe").isNotNull() | header("List-Id").isNotNull(),
        "mentioned": brands.mentions(F.concat_ws("\n", "name", "subject", F.substring("body", 1, MENTION_CHARS))),
        "name_brands": brands.mentions(F.col("name")),
    })
    reg = F.col("registrable")
    base = base.withColumns({
        "dkim_aligned": F.coalesce((F.col("dkim") == "pass") & (reg != "") & (urls.registrable(F.col("auth.dkim_domain")) == reg), no),
        "auth_failed": F.coalesce(F.col("spf").isin("fail", "softfail"), no) | F.coalesce(F.col("dkim") == "fail", no) | F.coalesce(F.col("dmarc") == "fail", no),
        "n_links": F.size(F.coalesce("links", F.array().cast("array<struct<href:string,anchor:string>>"))),
        "files": F.coalesce("attachments", F.array().cast("array<struct<filename:string,mime_type:string,size_bytes:bigint>>")),
    })
    proven = ~F.col("auth_failed") & (F.coalesce(F.col("dmarc") == "pass", no) | F.col("dkim_aligned"))
    base = base.withColumns({
        "internal": (reg != "") & ~F.col("free") & proven & reg.isin(list(organisation)) if organisation else no,
        "authenticated": F.col("dkim_aligned") & F.coalesce(F.col("dmarc") == "pass", no) & ~F.col("free"),
        "has_auth": F.coalesce("spf", "dkim", "dmarc").isNotNull(),
        "acts": (F.col("n_links") > 0) | (F.size("files") > 0) | (F.size(lexicon.found(F.col("hits"), "action_request")) > 0) | (F.size(lexicon.found(F.col("hits"), "attachment_request")) > 0),
    })
    if not linked:
        return base
    stray = F.exists("l_strays", lambda legit: ~F.arrays_overlap("mentioned", legit["keys"]))
    return base.withColumn("l_stray", F.when((F.size("mentioned") > 0) & F.coalesce(stray, no), 1).otherwise(0))


def _links(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Counts of what a message's links show, one row per message with links; sent: the messages with the facts of their sender's domain."""
    rows = sent.select("message_id", "registrable", "brand", F.posexplode("links").alias("pos", "link")).select(
        "message_id", "registrable", "brand", "pos", "link.href", F.trim(F.coalesce("link.anchor", F.lit(""))).alias("anchor")
    )
    lower = F.lower("anchor")
    url_like = lower.rlike(r"^(?:https?://|www\.)") | (~lower.contains(" ") & (F.length(lower) >= 5) & lower.rlike(r"^[^.]*\.\p{L}{2,}") & lower.contains("/"))
    bare = F.regexp_replace(lower, r"[.,]+$", "")
    tld = F.substring_index(bare, ".", -1)
    is_bare = bare.rlike(r"^[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+$") & (F.length(lower) <= 100) & urls.listed(tld, cat.ANCHOR_TLDS)
    rows = rows.withColumns({
        "dangerous": F.lower("href").rlike(DANGEROUS), "host": urls.host_of(F.col("href")), "pq": urls.path_and_query(F.col("href")), "userinfo": urls.has_userinfo(F.col("href")),
        "bare_host": F.when(is_bare, bare), "bare_reg": urls.registrable(F.when(is_bare, bare)),
    })
    shows = ~F.col("anchor").contains("@") & (F.length("anchor") <= 200) & (url_like | (F.col("bare_host").isNotNull() & brands.is_brand_host(F.col("bare_host"), F.col("bare_reg"))))
    rows = rows.withColumn("anchor_host", F.when(shows, urls.host_of(F.col("anchor")))).withColumn("anchor_reg", urls.registrable(F.col("anchor_host")))
    linked = messages.select(F.explode("links.href").alias("href")).filter(~F.lower("href").rlike(DANGEROUS)).select(urls.host_of(F.col("href")).alias("host"))
    hosts = facts.distinct(linked.filter("host is not null"), "host")
    rows = facts.with_facts(rows, facts.staged(host_features(hosts.select("host")).join(hosts, "host")), "host", "message_id")
    reg, no = F.col("h_registrable"), F.lit(False)
    on = F.col("host").isNotNull() & ~F.col("dangerous")
    aligned = F.coalesce((F.col("registrable") != "") & (reg == F.col("registrable")), no)
    tracker = F.coalesce(urls.listed(reg, cat.TRACKERS), no)
    brand_host = F.coalesce(F.col("h_brand"), no)
    rows = rows.withColumn("anchor_brand", F.coalesce(brands.is_brand_host(F.col("anchor_host"), F.col("anchor_reg")), no))
    anchor_brand = F.col("anchor_brand")
    shows_other = F.coalesce(F.col("anchor_reg") != reg, no)
    mismatch = on & shows_other & (anchor_brand | ~(aligned | tracker))
    bare_mismatch = on & ~shows_other & F.coalesce(F.col("bare_reg") != reg, no) & ~aligned & ~tracker
    alike = on & F.col("h_lookalike").isNotNull()
    below = on & ~alike & ~aligned & F.col("h_below").isNotNull()
    stray = on & ~alike & ~below & ~aligned & ~brand_host & ~F.col("h_shortener") & ~F.col("h_ip")
    keyword = urls.contains_any(F.col("pq"), cat.CREDENTIAL_PATHS)
    outside = on & ~aligned & ~brand_host
    stays = F.coalesce((reg == F.col("registrable")) | (F.col("brand").isNotNull() & F.array_contains("h_legit", F.col("brand"))), F.col("host").isNull())
    free = on & ~aligned & F.col("h_free")
    flags = {
        "l_anchor": mismatch, "l_anchor_signin": mismatch & anchor_brand & urls.contains_any(urls.path_and_query(F.col("anchor")), cat.CREDENTIAL_PATHS), "l_bare": bare_mismatch,
        "l_alike": alike, "l_below": below, "l_ip": on & F.col("h_ip"), "l_punycode": on & F.col("h_punycode"), "l_dangerous": F.col("dangerous"),
        "l_short": on & F.col("h_shortener"), "l_tld": on & F.col("h_tld"), "l_deep": outside & (F.col("h_depth") >= 3), "l_path": outside & keyword,
        "l_host": outside & ~keyword & F.col("h_credential"), "l_free": free, "l_free_signin": free & keyword, "l_userinfo": on & F.col("userinfo"),
        "l_http": on & F.lower("href").startswith("http://") & ~aligned & ~F.col("h_ip") & (F.length("pq") > 1),
    }
    legit = F.struct(F.coalesce("h_legit", F.array().cast("array<string>")).alias("keys"))  # of the few links of a message, judged beside what it mentions
    return rows.groupBy("message_id").agg(
        F.collect_set(F.when(F.coalesce(stray, no), legit)).alias("l_strays"), *[F.count_if(F.coalesce(c, no)).alias(n) for n, c in flags.items()], F.size(F.collect_set(F.when(on & ~aligned, reg))).cast("long").alias("l_sites"), F.count_if(~aligned).alias("l_unaligned"), F.bool_and(stays).alias("links_stay")
    )


def auth_rules() -> list[Rule]:
    spf, dkim, dmarc, no = F.col("spf"), F.col("dkim"), F.col("dmarc"), F.lit(False)
    brand = F.col("brand").isNotNull()
    relay = F.coalesce(F.col("arc") == "pass", no) & (~brand | F.col("free")) & (F.col("list_headers") | F.col("sender").isNotNull())
    any_ = F.col("has_auth")

    def is_(c: Column, *values: str) -> Column:
        return F.coalesce(c.isin(*values), no)

    unaligned = any_ & is_(dkim, "pass") & F.col("auth.dkim_domain").isNotNull() & (F.col("registrable") != "") & ~F.col("dkim_aligned") & ~is_(dmarc, "pass") & ~relay
    unsigned = any_ & (dkim.isNull() | is_(dkim, "none")) & brand & ~is_(dmarc, "pass")
    return [
        Rule("auth.missing", "No authentication results", "info", 0.0, ~any_),
        Rule("auth.brand_unauthenticated", "Unverified brand sender", "high", 0.45, (~any_ & brand) | unsigned),
        Rule("auth.spf_fail", "SPF failed", "medium", 0.3, is_(spf, "fail")),
        Rule("auth.spf_softfail", "SPF soft-fail", "low", 0.2, is_(spf, "softfail")),
        Rule("auth.spf_error", "SPF could not be evaluated", "info", 0.05, is_(spf, "permerror", "temperror")),
        Rule("auth.dkim_fail", "DKIM signature failed", "medium", F.when(brand, 0.45).otherwise(0.35), is_(dkim, "fail") & ~relay),
        Rule("auth.dkim_unaligned", "DKIM domain does not match sender", F.when(brand, "high").otherwise("low"), F.when(brand, 0.4).otherwise(0.15), unaligned),
        Rule("auth.list_relay_dmarc_fail", "Authentication broken by a mailing list", "low", 0.15, is_(dmarc, "fail") & relay),
        Rule("auth.dmarc_fail", "DMARC failed", "high", F.when(brand, 0.55).otherwise(0.45), is_(dmarc, "fail") & ~relay),
    ]


def sender_rules() -> list[Rule]:
    no = F.lit(False)
    has, free = F.coalesce(F.col("from.address") != "", no), F.col("free")
    shown = F.lower(F.regexp_substr(F.substring("name", 1, 200), F.lit(text.ADDRESS)))
    hides = shown.isNotNull() & F.coalesce(urls.registrable(domain_of(shown)) != F.col("registrable"), no)
    claims = F.filter("name_brands", lambda b: ~F.array_contains("from_legit", b))
    claimed = F.try_element_at(claims, F.lit(1))
    about = F.exists("mentioned", lambda b: ~b.eqNullSafe(claimed) & ~F.array_contains("from_legit", b))
    local = F.lower(F.substring_index("from.address", "@", 1))
    pieces = F.filter(F.split(local, "[_+-]"), lambda p: p.rlike(r"[\p{L}\p{N}]{2,}\.(?:" + "|".join(cat.LOCAL_PART_TLDS) + r")\.*$"))
    words = F.filter(F.split(local, r"\P{L}+"), lambda w: F.length(w) >= 4)
    distinctive = {k: v for k, v in {**brands._NAMES, **{k: k for k, _, _ in cat.BRANDS}}.items() if v not in cat.DICTIONARY_BRANDS}
    key_of = brands._map(distinctive)
    spoof = F.exists(words, lambda w: F.coalesce(urls.listed(w, distinctive) & ~F.array_contains("from_legit", F.try_element_at(key_of, w)), no))
    odd, reply_free = F.col("odd_reply"), F.col("reply_free")
    sends = domain_of(F.col("sender.address"))
    other = F.coalesce((sends != "") & (urls.registrable(sends) != F.col("registrable")), no)
    bounce = domain_of(F.regexp_replace(F.coalesce(header("Return-Path"), F.lit("")), "[<>\\s]", ""))
    strays = (bounce != "") & (urls.registrable(bounce) != F.col("registrable")) & ~F.coalesce(F.col("dmarc") == "pass", no)
    by_brand = F.col("brand").isNotNull() & ~free
    webmail = free & reply_free
    plain = odd.isNotNull() & F.col("reply_lookalike").isNull()
    self_sent = F.exists(F.coalesce("to", F.array().cast(f"array<{ADDRESS}>")), lambda a: F.lower(a["address"]) == F.lower("from.address"))
    return [
        Rule("sender.missing_from", "No sender address", "low", 0.1, ~has),
        Rule("sender.display_name_address_mismatch", "Display name shows a different address", "high", 0.5, has & hides),
        Rule("sender.localpart_contains_domain", "Sender address hides another name", "medium", 0.3, has & F.length(local).between(4, 128) & ((F.size(pieces) > 0) | spoof)),
        Rule("sender.free_mail_brand_claim", "Brand name from a personal mailbox", "high", 0.45, has & claimed.isNotNull() & free),
        Rule("sender.brand_display_name_mismatch", "Display name impersonates a brand", "high", 0.45, has & claimed.isNotNull() & ~free),
        Rule("sender.free_mail_company_claim", "Company name from a personal mailbox", "medium", 0.3, has & claimed.isNull() & free & (F.size(lexicon.found(F.col("name_hits"), "company_words")) > 0)),
        Rule("sender.brand_pretext_from_webmail", "Brand pretext from a personal mailbox", "high", 0.5, has & free & F.col("acts") & about),
        Rule("sender.lookalike_domain", "Sender domain imitates a brand", "high", 0.55, has & F.col("from_lookalike").isNotNull()),
        Rule("sender.reply_to_lookalike", "Reply-To imitates a brand", "high", 0.5, has & F.col("reply_lookalike").isNotNull()),
        Rule("sender.reply_to_freemail", "Replies go to a personal mailbox", "medium", 0.4, has & plain & ~free & reply_free),
        Rule("sender.reply_to_mismatch", "Reply-To differs from sender", F.when(webmail, "medium").otherwise("low"), F.when(webmail, 0.3).when(F.col("dmarc") == "pass", 0.2).otherwise(0.25), has & plain & (webmail | ~reply_free)),
        Rule("sender.sender_header_list", "Sent via a mailing list", "info", 0.0, has & other & F.col("list_headers")),
        Rule("sender.sender_header_mismatch", "Sent on behalf of a different domain", "medium", 0.25, has & other & ~F.col("list_headers")),
        Rule("sender.return_path_mismatch", "Bounce address does not match sender", F.when(by_brand, "medium").otherwise("low"), F.when(by_brand, 0.3).otherwise(0.1), has & strays & (by_brand | ~F.col("list_headers"))),
        Rule("sender.from_equals_recipient", "Appears to be sent from your own address", "high", 0.45, has & self_sent & ~F.coalesce(F.col("dkim") == "pass", no)),
    ]


def link_rules() -> list[Rule]:
    def some(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False))

    tracked = ~some("l_anchor_signin") & F.col("authenticated")
    signin = some("l_free_signin")
    return [
        Rule("link.anchor_host_mismatch", "Link text hides its real destination", F.when(tracked, "medium").otherwise("high"), F.when(tracked, 0.3).otherwise(0.55), some("l_anchor")),
        Rule("link.lookalike_domain", "Link imitates a well-known brand", "high", 0.55, some("l_alike")),
        Rule("link.brand_subdomain_mismatch", "Link only looks like a brand", "high", 0.5, some("l_below")),
        Rule("link.anchor_is_bare_domain_mismatch", "Link text names a different site", "medium", 0.35, some("l_bare")),
        Rule("link.brand_domain_mismatch", "Links do not go to the brand", "medium", 0.25, some("l_stray")),
        Rule("link.userinfo_url", "Link hides its host behind an @ sign", "high", 0.5, some("l_userinfo")),
        Rule("link.ip_literal_host", "Link goes to a raw IP address", "high", 0.5, some("l_ip")),
        Rule("link.punycode_host", "Link uses an internationalized (punycode) domain", "medium", 0.35, some("l_punycode")),
        Rule("link.dangerous_scheme", "Link runs script or embeds a page", "medium", 0.4, some("l_dangerous")),
        Rule("link.url_shortener", "Shortened link hides its destination", "low", 0.2, some("l_short")),
        Rule("link.suspicious_tld", "Link uses a high-risk domain ending", "medium", 0.3, some("l_tld")),
        Rule("link.credential_path", "Link looks like a sign-in or verification page", "medium", 0.3, some("l_path")),
        Rule("link.credential_host", "Link domain is named like a sign-in page", "medium", 0.25, some("l_host")),
        Rule("link.free_hosting", "Link goes to a free hosting page", F.when(signin, "medium").otherwise("low"), F.when(signin, 0.35).otherwise(0.2), some("l_free")),
        Rule("link.deep_subdomain", "Link has an unusually long domain chain", "low", 0.15, some("l_deep")),
        Rule("link.many_hosts", "Links go to many different sites", "low", 0.1, F.coalesce(F.col("l_sites") > 10, F.lit(False))),
        Rule("link.plain_http", "Unencrypted (http) link", "low", 0.1, some("l_http")),
    ]


def content_rules() -> list[Rule]:
    no = F.lit(False)

    def hit(name: str, most: int = 3, less: tuple[str, ...] = ()) -> Column:
        out = lexicon.found(F.col("hits"), name, most)
        return F.filter(out, lambda p: ~p.isin(list(less))) if less else out

    def some(x: Column) -> Column:
        return F.size(x) > 0

    scanned = F.substring("scan", 1, text.SCAN_CHARS)
    credentials = hit("credential", 4)
    code = (
        some(credentials) & F.forall(credentials, lambda p: urls.listed(p, cat.CODE_DELIVERY)) & (F.size("files") == 0) & ~F.col("auth_failed")
        & (F.coalesce(F.col("dmarc") == "pass", no) | F.col("dkim_aligned")) & F.coalesce(F.col("l_unaligned") == 0, F.lit(True)) & scanned.rlike(text.ONE_TIME_CODE)
    )
    bulk = F.col("list_headers") & F.col("authenticated")
    notice = F.col("authenticated") & F.col("brand").isNotNull() & (F.size("files") == 0) & F.coalesce("links_stay", F.lit(True))
    asks = some(credentials) & ~code
    gifts = hit("gift_card", 4)
    promo = bulk & ~F.exists(gifts, lambda p: urls.listed(p, cat.GIFT_CARD_REQUESTS))
    words, wallet = hit("crypto"), scanned.rlike(text.WALLET)
    cues, titles = hit("executive_cue", 4), hit("executive_title", 2)
    unverified = F.col("free") | F.col("odd_reply").isNotNull() | F.col("auth_failed") | ~F.col("has_auth")
    corporate = (F.size("recipients") > 0) & ~F.exists("recipients", lambda r: urls.listed(r, cat.FREE_MAIL))
    lures = F.when(bulk, hit("lure", 4, cat.PROMOTIONAL_LURES)).otherwise(hit("lure", 4))
    weak = F.try_element_at(lures, F.lit(1)).isin("award", "bonus", "reward", "grant", "usd", "million", "winner", "congratulations")
    blackmail = hit("sextortion", 4)
    organised = F.col("internal") | (F.col("authenticated") & F.col("from_lookalike").isNull())
    greeted = F.exists(
        F.slice(F.coalesce("to", F.array().cast(f"array<{ADDRESS}>")), 1, 3),
        lambda a: F.exists(
            F.filter(F.split(F.lower(F.concat_ws(" ", a["name"], F.substring_index(a["address"], "@", 1))), r"\P{L}+"), lambda t: F.length(t) >= 3),
            lambda t: F.array_contains(F.split(F.lower(F.substring("body", 1, 240)), r"[^\p{L}\p{N}]+"), t),
        ),
    )
    has_html = F.coalesce(F.length("html_body") > 0, no)
    image = has_html & (F.length("body") < 60) & F.coalesce(F.lower("html_body").contains("<img"), no) & (F.col("n_links") == 1)
    single = has_html & ~image & F.coalesce(F.trim("text_body") == "", F.lit(True)) & (F.col("n_links") == 1) & (F.length("body") < 400) & F.coalesce(F.try_element_at("links", F.lit(1))["anchor"] != "", no)
    much = (F.aggregate("hidden", F.lit(0), lambda n, t: n + F.length(t)) >= 200) | (F.size("hidden") >= 3)
    urgency = F.when(code, hit("urgency", 3, cat.CODE_URGENCY)).otherwise(hit("urgency"))
    secrecy = F.when(code, hit("secrecy", 3, cat.CODE_SECRECY)).otherwise(hit("secrecy"))
    return [
        Rule("content.urgency", "Pressure to act quickly", "medium", 0.25, some(urgency)),
        Rule("content.threat", "Threatens consequences", "medium", 0.3, some(hit("threat"))),
        Rule("content.credential_request", "Asks you to verify or sign in", F.when(notice, "medium").otherwise("high"), F.when(notice, 0.25).otherwise(0.4), asks),
        Rule("content.payment_request", "Asks for a payment or fee", "medium", 0.35, some(hit("payment"))),
        Rule("content.payroll_payment_lure", "Payroll or salary pretext from an outside sender", "high", 0.45, some(hit("payroll")) & ~organised & F.col("acts")),
        Rule("content.gift_card_request", "Asks for gift cards", F.when(promo, "low").otherwise("high"), F.when(promo, 0.15).otherwise(0.5), some(gifts)),
        Rule("content.wire_transfer_request", "Asks for a bank transfer or bank details", "high", 0.45, some(hit("wire"))),
        Rule("content.crypto_payment_request", "Involves cryptocurrency payment", "high", 0.45, wallet | (F.size(words) >= 2) | ((F.size(words) == 1) & ~F.try_element_at(words, F.lit(1)).isin("crypto", "airdrop", "tether"))),
        Rule("content.generic_greeting", "Generic greeting", "low", 0.15, some(lexicon.found(F.col("greeting_hits"), "generic_greeting", 1))),
        Rule("content.secrecy_request", "Asks for secrecy", "medium", 0.35, some(secrecy)),
        Rule("content.executive_impersonation", "Looks like an executive impersonation", "medium", F.when(F.col("free") & corporate, 0.4).otherwise(0.35), (F.size(cues) >= 2) | ((F.size(cues) == 1) & some(titles) & unverified)),
        Rule("content.advance_fee_payment_lure", "Too good to be true", F.when(F.size(lures) >= 2, "high").otherwise("low"), F.when(F.size(lures) >= 2, 0.4).otherwise(0.2), (F.size(lures) >= 2) | ((F.size(lures) == 1) & ~weak)),
        Rule("content.sextortion_crypto_threat", "Extortion attempt", "high", 0.6, (F.size(blackmail) >= 2) | ((F.size(blackmail) == 1) & (wallet | some(words)))),
        Rule("content.support_callback_payment_scam", "Asks you to call about a charge", "high", 0.45, scanned.rlike(text.PHONE) & some(hit("renewal")) & some(hit("callback")) & (F.col("n_links") <= 3)),
        Rule("content.subject_body_mismatch_login", "Subject and request do not match", "medium", 0.3, some(lexicon.found(F.col("subject_hits"), "invoice_subject", 1)) & asks),
        Rule("content.excessive_caps_or_exclamation", "Shouting subject line", "low", 0.15, F.coalesce(text.shouts(F.col("subject")), no)),
        Rule("content.qr_code_lure", "Asks you to scan a QR code", "medium", 0.3, some(hit("qr", 2))),
        Rule("content.action_request_from_stranger", "Short request with a link from an unknown sender", "medium", 0.25, some(hit("action_request", 2)) & F.col("free") & ~F.col("list_headers") & ~F.col("internal") & ~greeted & (F.length("body") < STRANGER_CHARS) & F.col("n_links").between(1, 2)),
        Rule("content.hidden_text", "Hidden text in the message", F.when(much, "medium").otherwise("low"), F.when(much, 0.3).otherwise(0.12), F.coalesce(F.size("hidden") > 0, no)),
        Rule("content.image_only_link_body", "Image-only message with a single link", "medium", 0.35, image),
        Rule("content.html_only_single_link", "Short HTML-only message with one call to action", "low", 0.2, single),
    ]


def attachment_rules() -> list[Rule]:
    def ext(a: Column) -> Column:
        return F.when(a["filename"].contains("."), F.lower(F.trim(F.substring_index(a["filename"], ".", -1)))).otherwise("")

    def kind(a: Column) -> Column:
        mime = F.trim(F.substring_index(F.lower(F.coalesce(a["mime_type"], F.lit(""))), ";", 1))
        e = ext(a)
        return (
            F.when(urls.listed(e, cat.EXECUTABLE_EXTENSIONS) | urls.listed(mime, cat.EXECUTABLE_TYPES), "executable")
            .when(urls.listed(e, cat.HTML_EXTENSIONS) | mime.isin("text/html", "application/xhtml+xml"), "html")
            .when(urls.listed(e, cat.MACRO_EXTENSIONS) | mime.contains("macroenabled"), "macro")
            .when(urls.listed(e, cat.ARCHIVE_EXTENSIONS) | mime.isin("application/zip", "application/x-rar-compressed", "application/x-7z-compressed"), "archive")
            .otherwise("other")
        )

    def double(a: Column) -> Column:
        name = F.lower(F.trim(a["filename"]))
        parts = F.filter(F.split(name, r"\."), lambda p: p != "")
        before = F.coalesce(F.trim(F.try_element_at(F.slice(F.reverse(parts), 2, 1), F.lit(1))), F.lit(""))
        risky = urls.listed(ext(a), [*cat.EXECUTABLE_EXTENSIONS, *cat.HTML_EXTENSIONS, *cat.ARCHIVE_EXTENSIONS, *cat.MACRO_EXTENSIONS])
        spaced = name.contains("  ")
        return ((F.size(parts) >= 3) | ((F.size(parts) == 2) & spaced)) & risky & (spaced | urls.listed(before, cat.DOCUMENT_EXTENSIONS))

    files = F.slice("files", 1, 50)

    def some(name: str) -> Column:
        return F.exists(files, lambda a: kind(a) == name)

    hint = F.size(lexicon.found(F.col("hits"), "archive_password", 1)) > 0
    money = F.exists(files, lambda a: urls.contains_any(F.lower(a["filename"]), cat.FINANCIAL_WORDS))
    asked = (F.size(lexicon.found(F.col("hits"), "attachment_request", 2)) > 0) | (F.size(lexicon.found(F.col("hits"), "payment", 1)) > 0)
    known = F.coalesce((F.col("dkim") == "pass") & (F.col("dmarc") == "pass"), F.lit(False)) & F.col("brand").isNotNull() & ~F.col("free")
    return [
        Rule("attachment.malware_extension", "Executable or script attachment", "high", 0.55, some("executable")),
        Rule("attachment.html_credential_lure", "HTML attachment", "high", 0.5, some("html")),
        Rule("attachment.double_extension_malware", "Attachment disguises its file type", "high", 0.5, F.exists(files, double)),
        Rule("attachment.macro_document_malware_risk", "Macro-enabled Office attachment", "medium", 0.4, some("macro")),
        Rule("attachment.archive_malware_risk", "Archive attachment", F.when(hint, "high").otherwise("medium"), F.when(hint, 0.5).otherwise(0.3), some("archive")),
        Rule("attachment.invoice_lure", "Unexpected financial document", "medium", 0.35, money & asked & ~known),
    ]


def mitigation_rules() -> list[Rule]:
    no = F.lit(False)
    passed = F.coalesce(F.col("dkim") == "pass", no)
    return [
        Rule("mitigation.brand_authenticated", "Authenticated brand sender", "info", 0.0, F.col("dkim_aligned") & F.col("brand").isNotNull() & ~F.col("free"), 0.25),
        Rule("mitigation.dmarc_pass", "DMARC passed", "info", 0.0, F.coalesce(F.col("dmarc") == "pass", no), F.when(F.col("free"), 0.0).otherwise(0.08)),
        Rule("mitigation.newsletter_headers", "Standard mailing-list headers", "info", 0.0, F.col("list_headers") & passed, 0.1),
        Rule("mitigation.internal_sender", "Sent from your own organization", "info", 0.0, F.col("internal"), 0.3),
    ]


FAMILIES = {"auth": auth_rules, "sender": sender_rules, "link": link_rules, "content": content_rules, "attachment": attachment_rules, "mitigation": mitigation_rules}


def analyse(messages: DataFrame, organisation: tuple[str, ...] = ()) -> DataFrame:
    """message_id, signals (severest and heaviest first, mitigations last) and score of each message."""
    ctx = context(messages, organisation)
    parts = ctx.select("message_id", *[signals(make()).alias(name) for name, make in FAMILIES.items()])
    ordered = F.array_sort(
        F.concat(*[n for n in FAMILIES if n != "mitigation"]),
        lambda a, b: F.when(scoring.rank(a["severity"]) != scoring.rank(b["severity"]), scoring.rank(b["severity"]) - scoring.rank(a["severity"])).otherwise(F.signum(b["weight"] - a["weight"]).cast("int")),
    )
    both = parts.select("message_id", F.concat(ordered, "mitigation").alias("signals"))
    # nine places first, so that the noise of binary fractions does not decide ties
    return both.withColumn("score", F.round(F.round(scoring.heuristic_score(F.col("signals")), 9), 6))


def verdicts(analysed: DataFrame, answers: DataFrame) -> DataFrame:
    """Fuses ``analysed`` with model answers (message_id, is_suspicious, category, risk_score, reasons, summary), where there is one."""
    joined = analysed.join(answers, "message_id", "left")
    conf = F.round(scoring.fuse(F.col("signals"), F.col("score"), F.col("risk_score"), F.coalesce("is_suspicious", F.lit(False))), 6)
    out = joined.withColumn("confidence", conf).withColumns({"level": scoring.level(F.col("confidence")), "verdict_category": scoring.category(F.col("signals"), F.col("confidence"), F.col("category"))})
    why = scoring.reasons(F.col("signals"), F.col("reasons"), F.col("risk_score"))
    titles = F.transform(F.slice(why, 1, 2), lambda r: r["title"])
    generated = F.when(F.col("level") == "safe", "No signs of phishing or scam were found.").otherwise(F.concat(F.lit("This message looks like "), F.col("verdict_category"), F.lit(": "), F.array_join(titles, "; "), F.lit(".")))
    return out.select("message_id", F.col("verdict_category").alias("category"), "confidence", "level", why.alias("reasons"), F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), generated).alias("summary"), F.col("score").alias("heuristic_score"), F.col("risk_score").alias("model_risk_score"))

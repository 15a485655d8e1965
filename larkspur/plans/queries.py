"""Queries over the driver's tables, each with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import answers, brands, lexicon, payloads, prompts, scoring, tables, text, urls
from larkspur.functions import catalogs as cat
from larkspur.functions.html import links_of as html_links_of
from larkspur.functions.html import plain_text
from larkspur.operators import calls, debounce, evaluation, mail, scans, sessions, state, transcripts
from larkspur.plans import synthetic as syn
from larkspur.plans.sql import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("host"))


def url_host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("host")
    return _page_hosts(spark, sf_dir).select(
        "page_id", "host", urls.public_suffix(h).alias("suffix"), urls.registrable(h).alias("registrable"), urls.depth(h).alias("depth"), urls.is_ip(h).alias("is_ip"),
        urls.is_punycode(h).alias("is_punycode"), urls.has_userinfo(F.col("url")).alias("has_userinfo"), urls.path_and_query(F.col("url")).alias("path_query"),
    )


def _page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, pq = F.col("host"), urls.path_and_query(F.col("url"))
    return _page_hosts(spark, sf_dir).select(
        "page_id", "host", urls.registrable(h).alias("registrable"),
        (F.lower("url").startswith("http://") & ~urls.is_ip(h) & (F.length(pq) > 1)).alias("plain_http"), urls.has_suspicious_tld(h).alias("suspicious_tld"),
        urls.is_ip(h).alias("ip_literal"), (urls.depth(h) >= 3).alias("deep_subdomain"), urls.contains_any(pq, cat.CREDENTIAL_PATHS).alias("credential_path"),
    )


_FLAG_WEIGHTS = {"plain_http": 0.1, "suspicious_tld": 0.3, "ip_literal": 0.5, "deep_subdomain": 0.15, "credential_path": 0.3}


def link_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _page_flags(spark, sf_dir)
    score = F.round(scoring.noisy_or(F.array(*[F.when(F.col(c), w).otherwise(0.0) for c, w in _FLAG_WEIGHTS.items()])), 6)
    return flags.select("page_id", "host", "registrable", *_FLAG_WEIGHTS, score.alias("score")).withColumn("level", scoring.level(F.col("score")))


def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link_risk_score(spark, sf_dir)
    return rows.groupBy("registrable").agg(
        F.count("*").alias("n_links"), F.count_distinct("host").alias("n_hosts"), F.count_if("plain_http").alias("n_plain_http"), F.max("score").alias("max_score"), F.bool_or("credential_path").alias("any_credential")
    )


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))
    first = rows.groupBy("page_id", F.lower(F.trim("href")).alias("target")).agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n"))
    return first


def page_links_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over pages as messages whose plain body names their own address."""
    tables.register(spark)
    sql = "SELECT page_id, l.pos, l.href, l.anchor FROM {pages}, LATERAL extract_links(html, concat('see (', url, ').')) l"
    return spark.sql(sql, pages=table(spark, sf_dir, "pages"))


def payload_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of parts made of the pages, as messages; every eleventh is cut off and gives none."""
    m = payloads.tree_messages(syn.tree_payloads(spark, sf_dir))
    file = F.try_element_at("attachments", F.lit(1))
    return m.select("message_id", "subject", F.col("from.name").alias("name"), F.col("from.address").alias("address"), F.unix_millis("received_at").alias("received_ms"), "text_body", F.sha2("html_body", 256).alias("html_sha256"), file["filename"].alias("filename"), file["size_bytes"].alias("size_bytes"))


def auth_results_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over the dealt headers of each customer."""
    tables.register(spark)
    sql = "SELECT c_custkey, a.method, a.result, a.domain FROM {rows}, LATERAL parse_auth_results(names, header_values, 'shop.example') a"
    return spark.sql(sql, rows=syn.auth_headers(spark, sf_dir))


def raw_link_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link_signals`` of the same messages, whose links now stand in their HTML only."""
    link = F.element_at("links", 1)
    anchor = F.concat(F.lit('<a href="'), link["href"], F.lit('">'), F.coalesce(link["anchor"], F.lit("")), F.lit("</a>"))
    bodies = F.concat(F.lit("<html><body><p>See "), F.when(F.size("links") > 0, anchor).otherwise(""), F.lit("</p></body></html>"))
    raw = syn.messages(spark, sf_dir).withColumn("html_body", bodies).withColumn("links", F.lit(None).cast("array<struct<href:string,anchor:string>>"))
    rows = mail.context(raw).select("message_id", F.explode(mail.signals(mail.FAMILIES["link"]())).alias("s"))
    return rows.select("message_id", F.col("s.id").alias("signal"), F.col("s.severity").alias("severity"), F.col("s.weight").alias("weight"))


def text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.text_urls(F.col("html"))).alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def clear_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_mktsegment").alias("apns_token"), F.col("c_nationkey").alias("nation"))
    refused = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("device_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("apns_token"))
    return state.clear_tokens(devices, refused)


def kept_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    levels = F.array(*[F.lit(x) for x in scoring.LEVELS])
    status = F.when(k % 7 < 3, "completed").when(k % 7 == 3, "no_answer").when(k % 7 == 4, "ringing").when(k % 7 == 5, "in_progress")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("call_id"), (k * 1000 + k % 977).alias("a"), F.when(k % 5 != 0, k * 1000 + (k * 7919) % 600_000 - 100_000).alias("b"), status.alias("status"), (k % 6 == 0).alias("alerted"),
        F.get(levels, (k % len(scoring.LEVELS)).cast("int")).alias("level"),
    )
    kept = rows.filter(state.worth_keeping(F.col("alerted"), F.col("level"), "medium"))
    return kept.select("call_id", "level", "status", state.duration_seconds(F.col("a"), F.col("b"), F.col("a") + 61_500, F.col("status")).alias("seconds"))


def calls_in_progress_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixtieth of the calls are in progress, old ones too; a third of the stored calls have an older row beside their last."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").cast("date").alias("started_at"), F.col("o_orderstatus").alias("status"))
    older = rows.filter("call_id % 3 = 0").withColumn("started_at", F.date_sub("started_at", 10))
    return state.active_then_stored(rows.filter("call_id % 60 = 0").withColumn("status", F.lit("live")), rows.unionByName(older), 500)


def late_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    speaker = F.when(k % 3 == 0, "user").otherwise("caller")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("call_id"), speaker.alias("speaker"), k.alias("arrival"), F.col("o_orderpriority").alias("text"), (k % 4 == 0).alias("final"), F.when(k % 13 != 0, k * 7 % 50).alias("sequence"))
    return transcripts.utterances(rows)


def uid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


def loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    phone = (c * 2 + 1).cast("string")
    caller = F.when(k % 4 == 0, phone).when(k % 4 == 1, c.cast("string")).otherwise(F.concat(F.lit("n"), k.cast("string")))
    incoming = table(spark, sf_dir, "orders").select(k.alias("call_id"), caller.alias("from_number"), F.when(k % 11 != 0, c.cast("string")).alias("to_number"), F.when(k % 7 == 0, phone).alias("forwarded_from"))
    c = F.col("c_custkey")
    lines = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(c.alias("line_id"), c.cast("string").alias("guard_number"), (c * 2 + 1).cast("string").alias("phone_number"))
    return calls.admitted(incoming, lines)


def model_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "answered").when(F.col("event_type") != "error", "failed")
    return state.breaker(table(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome")), "user_id", "event_id")


def safety_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.safety_id(F.col("c_name"), line).alias("safety_id"))


def max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.scored(spark, sf_dir).select("message_id", scoring.max_severity(F.col("signals")).alias("severity"))


def html_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html_links_of(F.col("html"))).alias("l"))
    return rows.select("page_id", F.col("l.href").alias("href"), F.col("l.anchor").alias("anchor"))


def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("body"))
    return out.select("page_id", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("text_sha256"))


def phone_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = text.first_match(F.col("text"), text.PHONE)
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("phone")).filter("phone is not null")


def digit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_digits(F.col("text"))
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\d{4}")).select("doc_id", F.length(masked).alias("n_chars"), F.sha2(masked, 256).alias("masked_sha256"))


def caps_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    letters, upper = text.count_of(t, "A-Za-z"), text.count_of(t, "A-Z")
    return table(spark, sf_dir, "documents").select("doc_id", letters.alias("n_letters"), upper.alias("n_upper"), text.shouts(t).alias("shouts"))


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the bodies of mails, in prompts for a window of 1500 tokens of which 300 are instructions."""
    people = "array<struct<name:string,address:string>>"
    none = F.lit(None).cast("struct<name:string,address:string>")
    t, auth = F.coalesce("text", F.lit("")), F.struct(F.when(F.col("doc_id") % 2 == 0, "pass").alias("spf"), F.lit(None).cast("string").alias("dkim"), F.lit(None).cast("string").alias("dmarc"), F.lit(None).cast("string").alias("dkim_domain"))
    signals = F.when(F.col("doc_id") % 3 == 0, F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(s).alias("severity"), F.lit(x).alias("title"), t.alias("detail")) for w, s, x in ((0.1, "low", "Low"), (0.0, "info", "None"), (0.5, "high", "High"))])).otherwise(F.array().cast("array<struct<weight:double,severity:string,title:string,detail:string>>"))
    head = prompts.mail_head(
        F.struct(F.col("lang").alias("name"), F.concat("source", F.lit("@site.example")).alias("address")), none, F.array().cast(people), F.array().cast(people), t, F.lit("2024-05-01T00:00:00Z"), auth, F.lit("site.example"),
        F.array().cast("array<struct<filename:string,mime_type:string>>"), signals, F.array().cast("array<struct<href:string,anchor:string>>"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), t.alias("body")).withColumn("n_body", prompts.fitted_body(F.col("head"), F.col("body"), 1500 - prompts.HEADROOM_TOKENS - 300))
    out = prompts.with_body(F.col("head"), F.col("body"), F.col("n_body"))
    return rows.select("doc_id", "n_body", F.length(out).alias("n_chars"), F.sha2(out, 256).alias("prompt_sha256"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def email_domain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit("(" + text.ADDRESS + ")"), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("found")).select("doc_id", F.lower("found").alias("address"))
    d = mail.domain_of(F.col("address"))
    return rows.select("doc_id", "address", d.alias("domain"), urls.registrable(d).alias("registrable"), urls.is_free_mail(d).alias("is_free"))


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = syn.messages(spark, sf_dir).select("message_id", F.explode(lexicon.matches(F.concat("subject", F.lit("\n"), "text_body"))).alias("set_name", "phrases"))
    return m.select("message_id", "set_name", F.size("phrases").cast("long").alias("n"))


def auth_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "auth")


def sender_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "sender")


def attachment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "attachment")


def link_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "link")


def content_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "content")


def _family(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ctx = mail.context(syn.messages(spark, sf_dir), linked=name in ("link", "content"))
    rows = ctx.select("message_id", F.explode(mail.signals(mail.FAMILIES[name]())).alias("s"))
    return rows.select("message_id", F.col("s.id").alias("signal"), F.col("s.severity").alias("severity"), F.col("s.weight").alias("weight"))


def mail_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mail.analyse(syn.messages(spark, sf_dir))
    return out.select("message_id", "score", scoring.level(F.col("score")).alias("level"), F.size("signals").cast("long").alias("n_signals"))


def fused_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syn.scored(spark, sf_dir)
    conf = F.round(scoring.fuse(F.col("signals"), F.col("score"), F.col("risk_score"), F.col("suspicious")), 6)
    out = rows.withColumn("confidence", conf)
    return out.select("message_id", "score", "confidence", scoring.level(F.col("confidence")).alias("level"), scoring.category(F.col("signals"), F.col("confidence"), F.col("model_category")).alias("category"))


def reason_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syn.scored(spark, sf_dir)
    why = scoring.reasons(F.col("signals"), F.array(F.lit("asks for a code")), F.col("risk_score"))
    return rows.select("message_id", F.array_join(F.transform(why, lambda r: r["id"]), ",").alias("reason_ids"))


def ensemble_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syn.members(spark, sf_dir)
    won = scoring.ensemble(F.col("members"), F.col("heuristic"))
    return rows.select("message_id", won["identifier"].alias("winner"), won["risk_score"].cast("long").alias("risk_score"))


def model_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syn.answers(spark, sf_dir).select("message_id", answers.assessment(F.col("raw")).alias("a"))
    return rows.select("message_id", F.col("a.risk_score").cast("long").alias("risk_score"), "a.category", "a.is_suspicious", F.array_join("a.reasons", "|").alias("reasons"))


def homoglyph_typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = syn.hosts(spark, sf_dir).select("host").distinct()
    return brands.lookalikes(hosts)


def call_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.signals(syn.lines(spark, sf_dir)).select("call_id", "rule", "severity", F.round("weight", 4).alias("weight"), "speaker", "ord")


def call_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.verdicts(syn.lines(spark, sf_dir)).withColumn("score", F.round("score", 4))


def call_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.evidence(syn.lines(spark, sf_dir))


def call_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.summaries(calls.evidence(syn.lines(spark, sf_dir)))


def call_running_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calls.running_verdicts(syn.lines(spark, sf_dir))
    return out.select("call_id", "ord", F.round(F.col("score") + 1e-9, 6).alias("score"), "level", "sequence")  # ties go up


def call_alert_on_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.alerts(calls.running_verdicts(syn.lines(spark, sf_dir)))


def call_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a hundred events; a window of four segments makes verdicts fall."""
    out = sessions.session_log(syn.session_events(spark, sf_dir), window=4, retain_ms=60_000)
    return out.withColumn("score", F.round(F.col("score") + 1e-9, 6))


def segment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty segments of each session, each with the verdict that stood when it came."""
    log = sessions.session_log(syn.session_events(spark, sf_dir), window=4, retain_ms=60_000)
    newest = transcripts.newest(log.filter("kind = 'segment'").select("call_id", "n", "id"), "call_id", "n", 20)
    return transcripts.with_latest(newest, log.filter("kind = 'verdict'").select("call_id", "n", "level", "sequence"), "call_id", "n", ["level", "sequence"])


def follow_up_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    accounts = F.when(e % 41 == 0, F.lit(None)).when(e % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(u.cast("bigint"), (e % 7).cast("bigint")))
    out = scans.merged_scopes(table(spark, sf_dir, "events").select((u % 89).alias("scan_id"), accounts.alias("accounts")), "scan_id")
    return out.select("scan_id", "every", F.array_join(F.transform("accounts", lambda a: a.cast("string")), ",").alias("accounts"))


def cursor_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account fetches five messages behind its cursor; a thirteenth of the messages fail."""
    from larkspur.sources.mailboxes import uid_scan

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("uid"))
    fetched = uid_scan(rows, F.lit(100), 5).select("account_id", F.col("uid").alias("message_id"), F.col("next_uid").alias("next_cursor"))
    cursors = rows.filter("uid % 3 <> 0").select("account_id", F.lit(100).cast("long").alias("cursor")).distinct()
    return scans.advanced_cursors(cursors, fetched, rows.filter("uid % 13 <> 0").select("account_id", F.col("uid").alias("message_id")))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return rows.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "user").otherwise("caller").alias("speaker"), "text")


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transcripts.render(_segments(spark, sf_dir), 600)
    return out.select("call_id", F.length("transcript").alias("n_chars"), F.sha2("transcript", 256).alias("transcript_sha256"))


def last_n_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.newest(_segments(spark, sf_dir), "call_id", "ord", 3).select("call_id", "ord", "speaker")


def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.newest(table(spark, sf_dir, "events"), "user_id", "event_id", 50).select("user_id", "event_id", "event_type")


def dedupe_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    done = ev.filter("event_type = 'view'").select("user_id").distinct().filter("user_id % 3 = 0")
    return state.unseen(ev, done, "user_id").select("event_id", "user_id")


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    now = ev.agg(F.max("ts").alias("now"))
    return state.retain(ev.crossJoin(F.broadcast(now)), "ts", F.col("now"), 7 * 86_400).select("event_id", "user_id")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of users holds after all events are written over it in order."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(e % 4 != 0, F.col("event_type")).alias("first_type"), F.when(e % 3 == 0, F.col("event_type")).alias("last_known"), (F.col("event_type") == "error").alias("failed"), F.when(e % 5 != 0, F.col("value")).alias("value"))
    return state.folded(rows, ["user_id"], ["event_id"], keep_old=("first_type",), sticky=("failed",), fill=("last_known",))


def push_targets_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("account_key"), F.col("o_custkey").alias("device_id"), F.col("o_orderpriority").alias("provider"))
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("apns_token"), F.col("c_mktsegment").alias("environment"))
    return state.push_targets(accounts, devices)


def account_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.com "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.account_key(email, "salt").alias("account_key"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account_key"), at.alias("at_ms"))


def debounce_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.sends(_requests(spark, sf_dir), wait=6 * 3_600_000)


def last_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce_sends(spark, sf_dir).groupBy("account_key").agg(F.max("sent_at").alias("last_sent_at"), F.count("*").alias("n_sends"))


def _risk_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score of contact data and shouting; bad or toxic ones are the positive class."""
    t = F.coalesce("text", F.lit(""))
    letters, upper = text.count_of(t, "A-Za-z"), text.count_of(t, "A-Z")
    parts = ((text.phone_anywhere(t), 0.4), (text.has_address(t), 0.2), (text.shouts(t), 0.25), (upper * 10 > letters, 0.1))
    score = F.round(sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0)), 6)
    docs = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("positive")).join(docs, "doc_id")


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bounds(_risk_of_documents(spark, sf_dir), 0.3)


def eval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sweep(_risk_of_documents(spark, sf_dir))


def day_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts")
    rows = table(spark, sf_dir, "events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max("event_id").alias("newest"))


def unread_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("n_unread"))


def org_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mail.domain_of(F.col("from.address"))
    rows = syn.messages(spark, sf_dir).select(urls.registrable(d).alias("domain"), urls.is_free_mail(d).alias("free"))
    return rows.filter("not free and domain <> ''").select("domain").distinct()


def calls_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


def size_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.mailboxes import within_budget

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return within_budget(rows, "l_orderkey", ["l_linenumber", "size"], "size", 60)


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.mailboxes import uid_scan

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("uid"))
    return uid_scan(rows, F.lit(100), 5)


QUERIES = {
    f.__name__: f
    for f in (
        url_host_features, link_risk_score, host_rollup, html_links, html_link_table, html_plain_text, phone_probe, digit_mask, caps_ratio, token_estimate, email_domain_class,
        lexicon_hits, auth_signals, sender_signals, attachment_signals, link_signals, content_signals, mail_score, fused_verdict, reason_rank, ensemble_combine, model_json_parse,
        homoglyph_typosquat, call_signals, call_verdicts, call_running_verdict, call_alert_on_rise, call_sessions, call_evidence, call_summaries, segment_verdicts, follow_up_scopes, cursor_commit, eval_sweep, transcript_render, last_n_segments, catch_up, dedupe_processed,
        retention_prune, upsert_latest, upsert_fold, push_targets_join, account_key, debounce_sends, last_push, eval_confusion, day_sections, unread_count, org_domains, calls_page,
        size_budget, incremental_scan, text_urls, document_prompts, payload_messages, page_links_sql, auth_results_sql, raw_link_signals, clear_tokens, kept_calls, calls_in_progress_first,
        late_partials, uid_chunks, loop_guard, model_breaker, safety_ids, max_severity,
    )
}

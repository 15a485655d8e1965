"""The queries of ``plans.queries`` stated in SQL for DuckDB.

Where the rules judge synthetic values, the facts about those values (which
domain is whose, which phrases a text holds) are stated here by hand, so the
SQL checks the functions that find them.
"""

from __future__ import annotations

import re

from larkspur.functions import catalogs as cat
from larkspur.functions import prompts
from larkspur.functions.call_patterns import CALL_RULES
from larkspur.plans import synthetic as syn

_HOST = r"lower(regexp_extract(url, '^[^:]*://([^/?#@]*@)?([^/?#:]*)', 2))"
_PQ = r"lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) || '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1))"
_REG = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_CREDENTIAL = " OR ".join(f"contains(pq, '{w}')" for w in cat.CREDENTIAL_PATHS)
_LEVEL = "CASE WHEN {0} >= 0.75 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' WHEN {0} >= 0.3 THEN 'low' ELSE 'safe' END"
_PAGES = f"SELECT page_id, url, {_HOST} AS host, {_PQ} AS pq FROM pages"
_FLAGS = f"""
    SELECT page_id, host, {_REG} AS registrable, starts_with(lower(url), 'http://') AND length(pq) > 1 AS plain_http,
           list_contains([{', '.join(map(repr, cat.SUSPICIOUS_TLDS))}], list_extract(string_split(host, '.'), -1)) AS suspicious_tld,
           regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}') AS ip_literal, len(string_split(host, '.')) >= 5 AS deep_subdomain, ({_CREDENTIAL}) AS credential_path
    FROM ({_PAGES})"""
_SCORED = f"""
    SELECT *, round(1 - (1 - CASE WHEN plain_http THEN 0.1 ELSE 0 END) * (1 - CASE WHEN suspicious_tld THEN 0.3 ELSE 0 END) * (1 - CASE WHEN ip_literal THEN 0.5 ELSE 0 END)
                    * (1 - CASE WHEN deep_subdomain THEN 0.15 ELSE 0 END) * (1 - CASE WHEN credential_path THEN 0.3 ELSE 0 END), 6)::DOUBLE AS score FROM ({_FLAGS})"""


def _quoted(x) -> str:
    return "NULL" if x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + ")"


# what is known of the synthetic senders: domain, registrable domain, webmail, brand, imitates a brand, mailbox name imitates
_SENDERS = _table("senders", "from_address, from_domain, registrable, free, brand, lookalike, spoof", (
    ("alerts@paypal.com", "paypal.com", "paypal.com", False, "paypal", False, False),
    ("billing@paypa1-secure.com", "paypa1-secure.com", "paypa1-secure.com", False, None, True, False),
    ("john.smith@gmail.com", "gmail.com", "gmail.com", True, "google", False, False),
    ("news@example.org", "example.org", "example.org", False, None, False, False),
    ("ceo.office@outlook.com", "outlook.com", "outlook.com", True, "microsoft", False, False),
    ("support@micros0ft.com", "micros0ft.com", "micros0ft.com", False, None, True, False),
    ("amazon-refund@yahoo.com", "yahoo.com", "yahoo.com", True, "yahoo", False, True),
    ("service@amazom.com", "amazom.com", "amazom.com", False, None, True, False),
    ("info@example.co.uk", "example.co.uk", "example.co.uk", False, None, False, False),
    ("security@mypaypal.net", "mypaypal.net", "mypaypal.net", False, None, True, False),
))
_NAMES = _table("names", "from_name, name_brand, company, shown", (
    ("PayPal", "paypal", False, None), ("John Smith", None, False, None), ("Billing Department", None, True, None), ("service@bank.example", None, True, "bank.example"),
    ("Amazon", "amazon", False, None), ("Newsletter", None, False, None), ("Microsoft Support", "microsoft", True, None), ("Jane", None, False, None),
))
_REPLIES = _table("replies", "reply_address, reply_reg, reply_free, reply_alike", (
    ("help@gmail.com", "gmail.com", True, False), ("desk@example.org", "example.org", False, False), ("pay@paypai-login.com", "paypai-login.com", False, True), ("me@corp.example", "corp.example", False, False),
))
_LINKS = _table("hrefs", "href, host, link_reg, scheme, path_query, link_brand, alike, below, ip, short, tld, free_host, deep, cred_host, at_sign", (
    ("https://www.paypal.com/login", "www.paypal.com", "paypal.com", "https", "/login?", "paypal", False, None, False, False, False, False, False, False, False),
    ("http://paypa1-secure.com/verify?id=1", "paypa1-secure.com", "paypa1-secure.com", "http", "/verify?id=1", None, True, None, False, False, False, False, False, True, False),
    ("https://bit.ly/abc", "bit.ly", "bit.ly", "https", "/abc?", None, False, None, False, True, False, False, False, False, False),
    ("http://192.168.10.9/index.html", "192.168.10.9", "192.168.10.9", "http", "/index.html?", None, False, None, True, False, False, False, False, False, False),
    ("https://shop.example.top/a", "shop.example.top", "example.top", "https", "/a?", None, False, None, False, False, True, False, False, False, False),
    ("https://user@evil.example/x", "evil.example", "evil.example", "https", "/x?", None, False, None, False, False, False, False, False, False, True),
    ("https://a.b.c.d.example.org/", "a.b.c.d.example.org", "example.org", "https", "/?", None, False, None, False, False, False, False, True, False, False),
    ("https://login.example.net/", "login.example.net", "example.net", "https", "/?", None, False, None, False, False, False, False, False, True, False),
    ("https://paypal.evil.example/pay", "paypal.evil.example", "evil.example", "https", "/pay?", None, True, "paypal", False, False, False, False, False, False, False),
    ("https://site.github.io/account", "site.github.io", "site.github.io", "https", "/account?", None, False, None, False, False, False, True, False, False, False),
))
_MSG = f"m AS ({syn.messages_sql(spark=False)})"
_JOINED = f"""{_MSG}, {_SENDERS}, {_NAMES}, {_REPLIES}, {_LINKS},
    j AS (SELECT m.* EXCLUDE (from_name), coalesce(m.from_name, '') AS from_name, s.* EXCLUDE (from_address), n.* EXCLUDE (from_name), r.* EXCLUDE (reply_address), l.* EXCLUDE (href),
                 CASE WHEN self_sent THEN coalesce(s.registrable, '') ELSE 'corp.example' END AS to_reg, spf IS NOT NULL OR dkim IS NOT NULL OR dmarc IS NOT NULL AS has_auth,
                 coalesce(dkim = 'pass' AND dkim_domain = s.registrable, false) AS aligned
          FROM m LEFT JOIN senders s ON m.from_address = s.from_address LEFT JOIN names n ON m.from_name = n.from_name
               LEFT JOIN replies r ON m.reply_address = r.reply_address LEFT JOIN hrefs l ON m.href = l.href)"""


def _signals(family: str, rules, extra: str = "") -> str:
    """rules: (id, severity SQL, weight SQL, condition SQL)."""
    arms = " UNION ALL ".join(f"SELECT message_id, '{family}.{i}' AS signal, {s} AS severity, CAST({w} AS DOUBLE) AS weight FROM x WHERE {c}" for i, s, w, c in rules)
    return f"WITH {_JOINED}{extra} {arms}"


_RELAY = "coalesce(arc = 'pass', false) AND (brand IS NULL OR coalesce(free, false)) AND (is_list OR has_sender)"
_BRAND = "brand IS NOT NULL"


def _case(a: str, b: str, c: str = _BRAND) -> str:
    return f"CASE WHEN {c} THEN {a} ELSE {b} END"


_AUTH = _signals("auth", (
    ("missing", "'info'", "0", "NOT has_auth"),
    ("brand_unauthenticated", "'high'", "0.45", f"{_BRAND} AND (NOT has_auth OR ((dkim IS NULL OR dkim = 'none') AND coalesce(dmarc <> 'pass', true)))"),
    ("spf_fail", "'medium'", "0.3", "spf = 'fail'"), ("spf_softfail", "'low'", "0.2", "spf = 'softfail'"), ("spf_error", "'info'", "0.05", "spf IN ('permerror', 'temperror')"),
    ("dkim_fail", "'medium'", _case("0.45", "0.35"), "dkim = 'fail' AND NOT relay"),
    ("dkim_unaligned", _case("'high'", "'low'"), _case("0.4", "0.15"), "dkim = 'pass' AND registrable IS NOT NULL AND NOT aligned AND coalesce(dmarc <> 'pass', true) AND NOT relay"),
    ("list_relay_dmarc_fail", "'low'", "0.15", "dmarc = 'fail' AND relay"), ("dmarc_fail", "'high'", _case("0.55", "0.45"), "dmarc = 'fail' AND NOT relay"),
), f", x AS (SELECT *, {_RELAY} AS relay FROM j)")

_PHRASES = _table("phrases", "set_name, phrase, pattern", ((n, p, ("(^|[^a-z0-9])" if p[0].isalnum() else "") + re.sub(r"([.*+?^$()\[\]{}|\\/])", r"\\\1", p) + ("([^a-z0-9]|$)" if p[-1].isalnum() else "")) for n, ps in cat.LEXICONS.items() for p in ps))
_HITS = f"""{_PHRASES}, pairs AS (SELECT DISTINCT subject, body FROM m),
    hits AS (SELECT subject, body, set_name, least(count(*), 4) AS n, list(phrase) AS found FROM pairs, phrases WHERE regexp_matches(lower(subject || ' ' || body), pattern) GROUP BY ALL)"""
_TRUTH = """h AS (SELECT subject, body, map(list(set_name), list(n)) AS n, map(list(set_name), list(found)) AS f FROM hits GROUP BY ALL)"""


def _n(name: str) -> str:
    return f"coalesce(n['{name}'], 0)"


_CODE = f"""(coalesce(f['credential'], []) = ['security code'] AND filename IS NULL AND NOT failed AND (coalesce(dmarc = 'pass', false) OR aligned)
            AND (host IS NULL OR coalesce(link_reg = registrable, false)) AND contains(body, 'security code is 482913'))"""
_MENTIONED = "list_distinct(list_filter([CASE WHEN contains(j.subject || j.body, 'PayPal') THEN 'paypal' END, CASE WHEN from_address IS NOT NULL THEN name_brand END], lambda b: b IS NOT NULL))"
_CLAIMED = "CASE WHEN name_brand IS NOT NULL AND coalesce(name_brand <> brand, true) THEN name_brand END"
_ACTS = f"(href IS NOT NULL OR filename IS NOT NULL OR {_n('action_request')} > 0 OR {_n('attachment_request')} > 0)"
_X = f""", {_HITS}, {_TRUTH},
    x AS (SELECT j.*, h.n, h.f, coalesce(spf IN ('fail', 'softfail'), false) OR coalesce(dkim = 'fail', false) OR coalesce(dmarc = 'fail', false) AS failed,
                 aligned AND coalesce(dmarc = 'pass', false) AND NOT coalesce(free, false) AS authenticated, {_CLAIMED} AS claimed, {_MENTIONED} AS mentioned,
                 reply_reg IS NOT NULL AND coalesce(reply_reg <> registrable, true) AND reply_reg <> to_reg AS odd
          FROM j LEFT JOIN h ON j.subject = h.subject AND j.body = h.body)"""
_HAS = "from_address IS NOT NULL"
_SENDER = _signals("sender", (
    ("missing_from", "'low'", "0.1", f"NOT ({_HAS})"),
    ("display_name_address_mismatch", "'high'", "0.5", f"{_HAS} AND shown IS NOT NULL"),
    ("localpart_contains_domain", "'medium'", "0.3", f"{_HAS} AND spoof"),
    ("free_mail_brand_claim", "'high'", "0.45", f"{_HAS} AND claimed IS NOT NULL AND free"),
    ("brand_display_name_mismatch", "'high'", "0.45", f"{_HAS} AND claimed IS NOT NULL AND NOT free"),
    ("free_mail_company_claim", "'medium'", "0.3", f"{_HAS} AND claimed IS NULL AND free AND company"),
    ("brand_pretext_from_webmail", "'high'", "0.5", f"{_HAS} AND free AND {_ACTS} AND len(list_filter(mentioned, lambda b: b IS DISTINCT FROM claimed AND b IS DISTINCT FROM brand)) > 0"),
    ("lookalike_domain", "'high'", "0.55", f"{_HAS} AND lookalike"),
    ("reply_to_lookalike", "'high'", "0.5", f"{_HAS} AND odd AND reply_alike"),
    ("reply_to_freemail", "'medium'", "0.4", f"{_HAS} AND odd AND NOT reply_alike AND NOT free AND reply_free"),
    ("reply_to_mismatch", _case("'medium'", "'low'", "free AND reply_free"), "CASE WHEN free AND reply_free THEN 0.3 WHEN dmarc = 'pass' THEN 0.2 ELSE 0.25 END", f"{_HAS} AND odd AND NOT reply_alike AND (NOT reply_free OR free)"),
    ("sender_header_list", "'info'", "0", f"{_HAS} AND has_sender AND is_list"), ("sender_header_mismatch", "'medium'", "0.25", f"{_HAS} AND has_sender AND NOT is_list"),
    ("from_equals_recipient", "'high'", "0.45", f"{_HAS} AND self_sent AND coalesce(dkim <> 'pass', true)"),
), _X)

_OUT = "(host IS NOT NULL AND coalesce(link_reg <> registrable, true))"
_KEY = "(" + " OR ".join(f"contains(path_query, '{w}')" for w in cat.CREDENTIAL_PATHS) + ")"
_AWAY = f"({_OUT} AND link_brand IS NULL)"
_SHOWS = "anchor = 'https://www.paypal.com/signin' AND host IS NOT NULL AND link_reg <> 'paypal.com'"
_LINK = _signals("link", (
    ("anchor_host_mismatch", "'high'", "0.55", _SHOWS),
    ("lookalike_domain", "'high'", "0.55", "alike"), ("brand_subdomain_mismatch", "'high'", "0.5", f"below IS NOT NULL AND NOT alike AND {_OUT}"),
    ("anchor_is_bare_domain_mismatch", "'medium'", "0.35", f"anchor = 'example.org' AND link_reg <> 'example.org' AND {_OUT}"),
    ("brand_domain_mismatch", "'medium'", "0.25", f"{_AWAY} AND NOT alike AND len(mentioned) > 0 AND NOT short AND NOT ip"),
    ("userinfo_url", "'high'", "0.5", "at_sign"), ("ip_literal_host", "'high'", "0.5", "ip"), ("dangerous_scheme", "'medium'", "0.4", "href LIKE 'javascript:%'"),
    ("url_shortener", "'low'", "0.2", "short"), ("suspicious_tld", "'medium'", "0.3", "tld"), ("credential_path", "'medium'", "0.3", f"{_AWAY} AND {_KEY}"),
    ("credential_host", "'medium'", "0.25", f"{_AWAY} AND NOT {_KEY} AND cred_host"), ("free_hosting", _case("'medium'", "'low'", _KEY), _case("0.35", "0.2", _KEY), f"free_host AND {_OUT}"),
    ("deep_subdomain", "'low'", "0.15", f"deep AND {_AWAY}"), ("plain_http", "'low'", "0.1", f"scheme = 'http' AND {_OUT} AND NOT ip"),
), _X)

_LURES = f"CASE WHEN is_list AND authenticated THEN least(len(list_filter(coalesce(f['lure'], []), lambda p: NOT list_contains([{', '.join(map(_quoted, cat.PROMOTIONAL_LURES))}], p))), 4) ELSE {_n('lure')} END"
_WEAK = "('award', 'bonus', 'reward', 'grant', 'usd', 'million', 'winner', 'congratulations')"
_ASKS = f"({_n('credential')} > 0 AND NOT {_CODE})"
_NOTICE = f"(authenticated AND {_BRAND} AND filename IS NULL AND (host IS NULL OR link_reg = registrable OR coalesce(link_brand = brand, false)))"
_ORGANISED = "(authenticated AND NOT coalesce(lookalike, false))"
_CONTENT = _signals("content", (
    ("urgency", "'medium'", "0.25", f"{_n('urgency')} > 0 AND NOT ({_CODE} AND f['urgency'] = ['expires in'])"), ("threat", "'medium'", "0.3", f"{_n('threat')} > 0"),
    ("credential_request", _case("'medium'", "'high'", _NOTICE), _case("0.25", "0.4", _NOTICE), _ASKS), ("payment_request", "'medium'", "0.35", f"{_n('payment')} > 0"),
    ("payroll_payment_lure", "'high'", "0.45", f"{_n('payroll')} > 0 AND NOT {_ORGANISED} AND {_ACTS}"),
    ("gift_card_request", "'high'", "0.5", f"{_n('gift_card')} > 0"), ("wire_transfer_request", "'high'", "0.45", f"{_n('wire')} > 0"),
    ("crypto_payment_request", "'high'", "0.45", f"{_n('crypto')} >= 2"), ("generic_greeting", "'low'", "0.15", "starts_with(body, 'Dear customer')"),
    ("secrecy_request", "'medium'", "0.35", f"{_n('secrecy')} > 0"),
    ("executive_impersonation", "'medium'", "CASE WHEN free AND to_reg = 'corp.example' THEN 0.4 ELSE 0.35 END", f"{_n('executive_cue')} >= 2 OR ({_n('executive_cue')} = 1 AND {_n('executive_title')} > 0 AND (coalesce(free, false) OR odd OR failed OR NOT has_auth))"),
    ("advance_fee_payment_lure", f"CASE WHEN {_LURES} >= 2 THEN 'high' ELSE 'low' END", f"CASE WHEN {_LURES} >= 2 THEN 0.4 ELSE 0.2 END", f"{_LURES} >= 2 OR ({_LURES} = 1 AND NOT list_any_value(f['lure']) IN {_WEAK})"),
    ("sextortion_crypto_threat", "'high'", "0.6", f"{_n('sextortion')} >= 2 OR ({_n('sextortion')} = 1 AND {_n('crypto')} > 0)"),
    ("support_callback_payment_scam", "'high'", "0.45", f"contains(body, '123-4567') AND {_n('renewal')} > 0 AND {_n('callback')} > 0"),
    ("subject_body_mismatch_login", "'medium'", "0.3", f"subject IN ('URGENT INVOICE NOTICE', 'Payment receipt', 'Purchase order 7') AND {_ASKS}"),
    ("excessive_caps_or_exclamation", "'low'", "0.15", "subject IN ('URGENT INVOICE NOTICE', 'Win now!!')"), ("qr_code_lure", "'medium'", "0.3", f"{_n('qr')} > 0"),
    ("action_request_from_stranger", "'medium'", "0.25", f"{_n('action_request')} > 0 AND free AND NOT is_list AND href IS NOT NULL"),
), _X)

_FILES = (
    ("malware_extension", "'high'", "0.55", "filename = 'invoice.pdf.exe'"), ("html_credential_lure", "'high'", "0.5", "filename = 'payment.html'"),
    ("double_extension_malware", "'high'", "0.5", "filename = 'invoice.pdf.exe'"), ("macro_document_malware_risk", "'medium'", "0.4", "filename = 'macro.docm'"),
    ("archive_malware_risk", "'medium'", "0.3", "filename = 'archive.zip'"),
    ("invoice_lure", "'medium'", "0.35", f"filename IN ('invoice.pdf.exe', 'payment.html', 'invoice.pdf') AND ({_n('attachment_request')} > 0 OR {_n('payment')} > 0) AND NOT (coalesce(dkim = 'pass' AND dmarc = 'pass', false) AND {_BRAND} AND NOT coalesce(free, false))"),
)

_S = f"s AS ({syn.scored_sql(spark=False)})"
_LIST = "list_filter([" + ", ".join(f"CASE WHEN s{i} THEN {{'id': '{i_}', 'severity': '{sev}', 'weight': {w}, 'credit': {c}}} END" for i, (i_, sev, w, c, _) in enumerate(syn.CANDIDATES)) + "], lambda x: x IS NOT NULL)"
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_BASE = f"""{_S}, b AS (SELECT message_id, risk_score, suspicious, model_category, {_LIST} AS signals,
    round(greatest(0, 1 - {' * '.join(f'(1 - CASE WHEN s{i} THEN {w} ELSE 0 END)' for i, (_, _, w, _, _) in enumerate(syn.CANDIDATES))} - {' - '.join(f'CASE WHEN s{i} THEN {c} ELSE 0 END' for i, (_, _, _, c, _) in enumerate(syn.CANDIDATES))}), 6)::DOUBLE AS score,
    s0 AS structural, s0::INT + s1::INT + s2::INT + s3::INT + s5::INT AS weighted, s4 AND NOT (s0 OR s1) AS capped, s0 OR s1 AS phishing, s2 AS scam FROM s)"""
_CONF = """CASE WHEN risk_score IS NULL THEN score ELSE greatest(
        least(1, greatest(score, risk_score / 100.0) + CASE WHEN suspicious AND risk_score >= 50 AND structural THEN 0.1 ELSE 0 END),
        CASE WHEN score >= 0.6 AND structural AND weighted >= 2 THEN 0.5 ELSE 0 END) END"""
_FUSED = f"{_BASE}, c AS (SELECT *, round(CASE WHEN capped THEN least({_CONF}, 0.45) ELSE {_CONF} END, 6)::DOUBLE AS confidence FROM b)"

# which rules each synthetic call line fires, by hand
_LINE_RULES = _table("line_rules", "k, rule, severity, full_weight, guarded", (
    (1, "call.gift_cards", "high", 0.7, True), (2, "call.government_threat", "high", 0.65, False), (3, "call.secrecy", "high", 0.55, False),
    (4, "call.secrecy", "high", 0.55, False), (6, "call.safe_account", "high", 0.75, True), (6, "call.urgency", "medium", 0.25, False),
    (7, "call.otp_or_credentials", "high", 0.65, True), (8, "call.user_sharing_sensitive", "high", 0.8, False),
    (10, "call.remote_access", "high", 0.7, True), (10, "call.tech_support", "high", 0.5, False), (11, "call.gift_card_errand", "low", 0.15, True),
))
_CALLS = f"""l AS ({syn.lines_sql(spark=False)}), {_LINE_RULES},
    fired AS (SELECT l.call_id, l.ord, l.speaker, r.rule, r.severity, r.full_weight FROM l JOIN line_rules r ON l.k = r.k
              WHERE final AND (r.rule <> 'call.user_sharing_sensitive' OR speaker = 'user')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id, rule ORDER BY speaker = 'user', ord) AS k FROM fired),
    best AS (SELECT call_id, rule, severity, CASE WHEN speaker = 'user' AND rule <> 'call.user_sharing_sensitive' THEN round(full_weight * 0.5, 4) ELSE full_weight END::DOUBLE AS weight, speaker, ord FROM ranked WHERE k = 1)"""
_RUNNING = f"""{_CALLS}, f AS (SELECT call_id, ord FROM l WHERE final),
    sofar AS (SELECT f.call_id, f.ord, x.rule, max(CASE WHEN x.speaker = 'caller' OR x.rule = 'call.user_sharing_sensitive' THEN full_weight ELSE round(full_weight * 0.5, 4) END) AS w
              FROM f JOIN fired x ON f.call_id = x.call_id AND x.ord <= f.ord GROUP BY ALL),
    st AS (SELECT f.call_id, f.ord, coalesce(1 - product(1 - w), 0) AS s, coalesce(string_agg(rule || w::VARCHAR, ',' ORDER BY rule), '') AS rules FROM f LEFT JOIN sofar USING (call_id, ord) GROUP BY ALL),
    lv AS (SELECT *, {_LEVEL.format('round(s, 9)')} AS level FROM st),
    ch AS (SELECT *, (level, round(s, 2), rules) IS DISTINCT FROM lag((level, round(s, 2), rules)) OVER (PARTITION BY call_id ORDER BY ord) AS changed FROM lv)"""
# where the first match of a rule begins in a synthetic line, and its length, by hand
_SPOTS = _table("spots", "k, rule, title, severity, full_weight, place, off, len", [(k, rule, *next((r[1], r[2], r[3], i) for i, r in enumerate(CALL_RULES) if r[0] == rule), off, n) for k, rule, off, n in (
    (1, "call.gift_cards", 4, 64), (2, "call.government_threat", 9, 9), (3, "call.secrecy", 0, 18), (4, "call.secrecy", 7, 16), (6, "call.safe_account", 0, 15), (6, "call.urgency", 34, 9),
    (7, "call.otp_or_credentials", 4, 17), (8, "call.user_sharing_sensitive", 0, 14), (10, "call.remote_access", 61, 7), (10, "call.tech_support", 0, 31), (11, "call.gift_card_errand", 0, 19),
)])
_EVIDENCE = f"""l AS ({syn.lines_sql(spark=False)}), {_SPOTS}, says AS (SELECT k0, said0 FROM (VALUES {', '.join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(syn.LINES))}) t(k0, said0)),
    f0 AS (SELECT l.call_id, l.ord, l.speaker, s.*, said0, trim(regexp_replace(regexp_replace(translate(l.text, '‘’ʼ“”–—', '""--'), '\\p{{Cc}}', ' ', 'g'), '\\s+', ' ', 'g')) AS line
           FROM l JOIN spots s ON l.k = s.k JOIN says ON k0 = l.k WHERE final AND (s.rule <> 'call.user_sharing_sensitive' OR l.speaker = 'user')),
    f1 AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY call_id, rule ORDER BY speaker = 'user', ord) = 1),
    f2 AS (SELECT *, strpos(line, said0) - 1 + off AS first, length(line) AS n FROM f1),
    f3 AS (SELECT *, greatest(0, first - (120 - len) // 2) AS s0 FROM f2),
    f4 AS (SELECT *, least(n, s0 + 120) AS e0 FROM f3),
    f5 AS (SELECT *, CASE WHEN e0 - s0 < 120 THEN greatest(0, e0 - 120) ELSE s0 END AS s1 FROM f4),
    f6 AS (SELECT *, strpos(substr(line, s1 + 1), ' ') - 1 + s1 AS gap, CASE WHEN strpos(reverse(substr(line, 1, e0 + 1)), ' ') > 0 THEN least(n, e0 + 1) - strpos(reverse(substr(line, 1, e0 + 1)), ' ') ELSE -1 END AS back FROM f5),
    f7 AS (SELECT *, CASE WHEN s1 > 0 AND gap >= s1 AND gap < first THEN gap + 1 ELSE s1 END AS s2, CASE WHEN e0 < n AND back > first + len THEN back ELSE e0 END AS e2 FROM f6),
    f8 AS (SELECT *, CASE WHEN n <= 120 THEN line ELSE CASE WHEN s2 > 0 THEN '…' ELSE '' END || trim(substr(line, s2 + 1, e2 - s2)) || CASE WHEN e2 < n THEN '…' ELSE '' END END AS quote FROM f7),
    ev AS (SELECT call_id, rule, title, severity, CASE WHEN speaker = 'user' AND rule <> 'call.user_sharing_sensitive' THEN round(full_weight * 0.5, 4) ELSE full_weight END::DOUBLE AS weight, speaker, ord, place,
                  CASE WHEN rule = 'call.user_sharing_sensitive' THEN 'You said: something that sounds like a card number, a code or a password was read out.'
                       ELSE CASE WHEN speaker = 'caller' THEN 'Caller said: “' ELSE 'You said: “' END || quote || '”' END AS detail FROM f8)"""
_SEG = "seg AS (SELECT conv_id AS call_id, turn AS ord, CASE WHEN role = 'user' THEN 'user' ELSE 'caller' END AS speaker, text FROM conversations WHERE role <> 'system')"

_RISK = r"""t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    q AS (SELECT doc_id, regexp_matches(substr(t, 1, 30000), '(?:^|[^0-9])((?:\+?[0-9]{1,2}[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})(?:$|[^0-9])') AS phone,
                 regexp_matches(t, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+') AS address,
                 length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
                 length(regexp_replace(t, '\P{L}', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS upper, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs FROM t),
    risk AS (SELECT doc_id, quality = 0 OR toxic = 1 AS positive, round(CASE WHEN phone THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN address THEN 0.2 ELSE 0 END + CASE WHEN (letters >= 10 AND upper >= 0.6 * letters) OR bangs >= 2 THEN 0.25 ELSE 0 END
                    + CASE WHEN n_upper * 10 > n_letters THEN 0.1 ELSE 0 END, 6) AS score FROM labels JOIN q USING (doc_id))"""

ORACLE_SQL: dict[str, str] = {
    "url_host_features": f"""
        SELECT page_id, host, list_extract(string_split(host, '.'), -1) AS suffix, {_REG} AS registrable, CAST(len(string_split(host, '.')) - 2 AS INT) AS depth, false AS is_ip,
               NOT regexp_full_match(host, '[ -~]*') OR regexp_matches(host, '(^|\\.)xn--') AS is_punycode, regexp_matches(url, '://[^/?#]*@') AS has_userinfo, pq AS path_query
        FROM ({_PAGES})""",
    "link_risk_score": f"SELECT page_id, host, registrable, plain_http, suspicious_tld, ip_literal, deep_subdomain, credential_path, score, {_LEVEL.format('score')} AS level FROM ({_SCORED})",
    "host_rollup": f"""
        SELECT registrable, count(*) AS n_links, count(DISTINCT host) AS n_hosts, count(*) FILTER (WHERE plain_http) AS n_plain_http, max(score) AS max_score, bool_or(credential_path) AS any_credential
        FROM ({_SCORED}) GROUP BY registrable""",
    "html_links": """
        WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
        SELECT page_id, lower(trim(href)) AS target, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n FROM l GROUP BY ALL""",
    "phone_probe": r"""
        WITH p AS (SELECT doc_id, regexp_extract(substr(coalesce(text, ''), 1, 30000), '(?:^|[^0-9])((?:\+?[0-9]{1,2}[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})(?:$|[^0-9])', 1) AS phone FROM documents)
        SELECT doc_id, phone FROM p WHERE phone <> ''""",
    "digit_mask": r"""
        WITH d AS (SELECT doc_id, string_split_regex(text, '[0-9](?:[\s-]?[0-9]){3,}') AS rest, regexp_extract_all(text, '[0-9](?:[\s-]?[0-9]){3,}') AS runs FROM documents WHERE regexp_matches(text, '[0-9]{4}')),
        p AS (SELECT doc_id, unnest(rest) AS part, generate_subscripts(rest, 1) AS i, runs FROM d),
        m AS (SELECT doc_id, string_agg(part || coalesce(regexp_replace(runs[i], '[0-9]', '•', 'g'), ''), '' ORDER BY i) AS masked FROM p GROUP BY doc_id)
        SELECT doc_id, CAST(length(masked) AS INT) AS n_chars, sha256(masked) AS masked_sha256 FROM m""",
    "caps_ratio": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        c AS (SELECT doc_id, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS INT) AS n_letters, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS INT) AS n_upper,
              length(regexp_replace(t, '\P{L}', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS upper, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs FROM t)
        SELECT doc_id, n_letters, n_upper, (letters >= 10 AND upper >= 0.6 * letters) OR bangs >= 2 AS shouts FROM c""",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 3.5) AS BIGINT) AS n_tokens FROM documents",
    "email_domain_class": f"""
        WITH a AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\\.[A-Za-z0-9-]{{1,63}})+'))) AS address FROM documents),
        d AS (SELECT doc_id, address, list_extract(string_split(address, '@'), -1) AS host FROM a)
        SELECT doc_id, address, host AS domain, {_REG} AS registrable, list_contains([{', '.join(map(repr, cat.FREE_MAIL))}], {_REG}) AS is_free FROM d""",
    "lexicon_hits": f"WITH {_MSG}, {_HITS} SELECT message_id, set_name, CAST(n AS BIGINT) AS n FROM m JOIN hits USING (subject, body)",
    "auth_signals": _AUTH,
    "sender_signals": _SENDER,
    "link_signals": _LINK,
    "content_signals": _CONTENT,
    "attachment_signals": _signals("attachment", _FILES, _X),
    "fused_verdict": f"""
        WITH {_FUSED} SELECT message_id, score, confidence, {_LEVEL.format('confidence')} AS level,
            CASE WHEN risk_score IS NOT NULL AND model_category <> 'safe' AND confidence >= 0.5 THEN model_category WHEN model_category <> 'safe' AND confidence >= 0.5 THEN model_category
                 WHEN confidence < 0.3 THEN 'safe' WHEN phishing THEN 'phishing' WHEN scam THEN 'scam' ELSE 'phishing' END AS category FROM c""",
    "reason_rank": f"""
        WITH {_BASE}, u AS (SELECT message_id, risk_score, unnest(signals) AS x, generate_subscripts(signals, 1) AS pos FROM b),
        r AS (SELECT message_id, x.id AS id, pos, CASE x.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS k FROM u
              UNION ALL SELECT message_id, 'model.reason.0', 1000, CASE WHEN risk_score >= 75 THEN 3 WHEN risk_score >= 50 THEN 2 WHEN risk_score >= 30 THEN 1 ELSE 0 END FROM b)
        SELECT message_id, string_agg(id, ',' ORDER BY k DESC, pos) AS reason_ids FROM r GROUP BY message_id""",
    "ensemble_combine": """
        WITH m AS (SELECT o_orderkey AS message_id, (o_orderkey % 10) / 10.0 AS h, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 71 END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 89 END AS b, o_orderkey % 97 AS c FROM orders),
        s AS (SELECT *, coalesce(a >= 40, false) OR h >= 0.3 AS ok FROM m),
        one AS (SELECT *, CASE WHEN b IS NOT NULL AND ok AND (a IS NULL OR b > a) THEN 'second' WHEN a IS NOT NULL THEN 'local' END AS w1, CASE WHEN b IS NOT NULL AND ok AND (a IS NULL OR b > a) THEN b ELSE a END AS v1 FROM s)
        SELECT message_id, CASE WHEN ok AND (v1 IS NULL OR c > v1) THEN 'third' ELSE w1 END AS winner, CAST(CASE WHEN ok AND (v1 IS NULL OR c > v1) THEN c ELSE v1 END AS BIGINT) AS risk_score FROM one""",
    "model_json_parse": """
        WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN greatest(0, least(100, o_orderkey * 7 % 160 - 20)) END AS score,
                          ['phishing', 'scam', 'safe', 'spam', NULL, 'safe'][o_orderkey % 6 + 1] AS said, o_orderkey // 6 % 6 = 5 AS none FROM orders),
        c AS (SELECT *, coalesce(said, CASE WHEN score >= 50 THEN 'scam' WHEN score < 50 THEN 'safe' END) AS category FROM o),
        f AS (SELECT *, CASE WHEN score IS NOT NULL THEN score >= 50 ELSE category <> 'safe' END AS flag FROM c),
        r AS (SELECT *, coalesce(score, CASE category WHEN 'spam' THEN 60 WHEN 'safe' THEN 5 ELSE 80 END) AS risk, none OR category IS NULL AS void FROM f)
        SELECT k AS message_id, CASE WHEN NOT void THEN CAST(risk AS BIGINT) END AS risk_score, CASE WHEN NOT void THEN category END AS category,
               CASE WHEN NOT void THEN flag END AS is_suspicious, CASE WHEN NOT void THEN 'reason ' || k || '|second' END AS reasons FROM r""",
    "homoglyph_typosquat": """
        WITH t(host, brand, kind, label) AS (VALUES ('paypa1.com', 'paypal', 'homoglyph', 'paypa1'), ('rnicrosoft.com', 'microsoft', 'homoglyph', 'rnicrosoft'), ('amazom.com', 'amazon', 'typosquat', 'amazom'),
            ('mypaypal.net', 'paypal', 'embedded', 'mypaypal'), ('apple-id-verify.com', 'apple', 'brand_token', 'apple'), ('netflix.account-update.co.uk', 'netflix', 'brand_token', 'netflix'),
            ('paypal-secure.myshopify.com', 'paypal', 'brand_token', 'paypal'), ('gooogle.com', 'google', 'typosquat', 'gooogle'), ('facebook2.com', 'facebook', 'brand_token', 'facebook2'),
            ('secure-docusign.net', 'docusign', 'brand_token', 'docusign'), ('xn--pypal-4ve.com', 'paypal', 'typosquat', 'pypal'))
        SELECT * FROM t""",
    "call_signals": f"WITH {_CALLS} SELECT call_id, rule, severity, weight, speaker, ord FROM best",
    "call_verdicts": f"""
        WITH {_CALLS}, v AS (SELECT call_id, round(1 - product(1 - weight), 9) AS score, bool_and(rule IN ('call.otp_or_credentials', 'call.user_sharing_sensitive')) AS codes, count(*) AS n_signals FROM best GROUP BY call_id)
        SELECT call_id, round(score, 4) AS score, {_LEVEL.format('score')} AS level, CASE WHEN score < 0.3 THEN 'safe' WHEN codes THEN 'phishing' ELSE 'scam' END AS category, n_signals FROM v""",
    "call_running_verdict": f"""
        WITH {_RUNNING} SELECT call_id, ord, round(s + 1e-9, 6) AS score, level, CAST(sum(changed::INT) OVER (PARTITION BY call_id ORDER BY ord) AS BIGINT) AS sequence FROM ch""",
    "call_alert_on_rise": f"""
        WITH {_RUNNING}, k AS (SELECT call_id, ord, level, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END AS r FROM lv),
        p AS (SELECT *, coalesce(max(r) OVER (PARTITION BY call_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
        SELECT call_id, ord, level FROM p WHERE r > before""",
    "call_sessions": f"""
        WITH e AS ({syn.session_events_sql(spark=False)}), {_LINE_RULES},
        m AS (SELECT *, coalesce(bool_or(kind = 'created') OVER (PARTITION BY call_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS made FROM e),
        a AS (SELECT *, min(CASE WHEN status = 'completed' THEN n END) OVER (PARTITION BY call_id) AS last FROM m WHERE (kind = 'created') <> made),
        b AS (SELECT a.*, max(CASE WHEN n = last THEN a."at" END) OVER (PARTITION BY call_id) AS ended_at FROM a),
        life AS (SELECT * FROM b WHERE last IS NULL OR n <= last OR (kind = 'verdict' AND b."at" <= ended_at + INTERVAL 60 SECOND)),
        sp AS (SELECT *, max(sequence) OVER (PARTITION BY call_id, speaker ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM life WHERE kind = 'segment' AND trim(text) <> ''),
        st AS (SELECT *, count(*) FILTER (WHERE final) OVER w - final::INT + 1 AS number, coalesce(lag(final) OVER w, true) AS fresh FROM sp
               WHERE final OR sequence IS NULL OR seen IS NULL OR sequence >= seen WINDOW w AS (PARTITION BY call_id, speaker ORDER BY n)),
        rk AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY call_id ORDER BY n) AS newest FROM st),
        seg AS (SELECT * FROM (SELECT *, max(newest) FILTER (WHERE fresh) OVER (PARTITION BY call_id, speaker ORDER BY n) AS rank FROM rk) WHERE rank > newest - 4),
        hit AS (SELECT s.call_id, s.n, s.rank, s.speaker, r.rule, r.severity, r.full_weight, rule = 'call.user_sharing_sensitive' AS users FROM seg s JOIN line_rules r ON s.k = r.k
                WHERE final AND (r.rule <> 'call.user_sharing_sensitive' OR speaker = 'user')),
        now AS (SELECT f.call_id, f.n, h.rule, any_value(h.severity) AS severity, max(CASE WHEN h.speaker = 'caller' OR users THEN full_weight ELSE round(full_weight * 0.5, 4) END)::DOUBLE AS w
                FROM seg f JOIN hit h ON f.call_id = h.call_id AND h.n <= f.n AND h.rank > f.newest - 4 WHERE f.final GROUP BY f.call_id, f.n, h.rule),
        sums AS (SELECT f.call_id, f.n, round(coalesce(1 - product(1 - w), 0), 9) AS score,
                        coalesce(string_agg(rule, ',' ORDER BY list_position(['high', 'medium', 'low'], severity), w DESC, list_position([{', '.join(f"'{r[0]}'" for r in CALL_RULES)}], rule)), '') AS rules
                 FROM seg f LEFT JOIN now USING (call_id, n) WHERE f.final GROUP BY f.call_id, f.n),
        lv AS (SELECT *, {_LEVEL.format('score')} AS level FROM sums),
        ch AS (SELECT *, (level, round(score + 1e-9, 2), rules) IS DISTINCT FROM lag((level, round(score + 1e-9, 2), rules)) OVER (PARTITION BY call_id ORDER BY n) AS changed FROM lv),
        v0 AS (SELECT call_id, n, score, level, rules, false AS over FROM ch WHERE changed
               UNION ALL SELECT call_id, n, score, {_LEVEL.format('score')}, NULL, coalesce(n > last, false) FROM life WHERE kind = 'verdict'),
        v1 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n) AS sequence, CASE WHEN over OR level NOT IN ('medium', 'high') THEN 0 WHEN level = 'high' THEN 3 ELSE 2 END AS due FROM v0),
        v AS (SELECT *, coalesce(max(due) OVER (PARTITION BY call_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v1),
        tu AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY call_id ORDER BY n), 'ringing') AS was FROM life WHERE kind = 'status')
        SELECT call_id, n, 'created' AS kind, NULL::VARCHAR AS id, 'ringing' AS status, NULL::DOUBLE AS score, NULL::VARCHAR AS level, NULL::VARCHAR AS rules, NULL::BIGINT AS sequence FROM life WHERE kind = 'created'
        UNION ALL SELECT call_id, n, 'segment', speaker || '-tw-' || number, NULL, NULL, NULL, NULL, NULL FROM seg
        UNION ALL SELECT call_id, n, 'verdict', NULL, NULL, round(score + 1e-9, 6), level, rules, sequence FROM v
        UNION ALL SELECT call_id, n, 'alert', NULL, NULL, round(score + 1e-9, 6), level, NULL, sequence FROM v WHERE due > before
        UNION ALL SELECT call_id, n, CASE WHEN status = 'completed' THEN 'ended' ELSE 'status' END, NULL, status, NULL, NULL, NULL, NULL FROM tu WHERE status = 'completed' OR status <> was""",
    "transcript_render": f"""
        WITH {_SEG}, t AS (SELECT call_id, ord, CASE WHEN speaker = 'caller' THEN 'Caller' ELSE 'You' END AS label, trim(text) AS text FROM seg WHERE trim(text) <> ''),
        g AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY call_id ORDER BY ord) THEN 0 ELSE 1 END AS new FROM t),
        i AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY ord) AS line FROM g),
        m AS (SELECT call_id, line, label || ': ' || string_agg(text, ' ' ORDER BY ord) AS s FROM i GROUP BY call_id, line, label),
        w AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY call_id ORDER BY line DESC) AS total, row_number() OVER (PARTITION BY call_id ORDER BY line DESC) AS k FROM m),
        o AS (SELECT call_id, right(string_agg(s, chr(10) ORDER BY line), 600) AS transcript FROM w WHERE total <= 600 OR k = 1 GROUP BY call_id)
        SELECT call_id, CAST(length(transcript) AS INT) AS n_chars, sha256(transcript) AS transcript_sha256 FROM o""",
    "last_n_segments": f"WITH {_SEG} SELECT call_id, ord, speaker FROM seg QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ord DESC) <= 3",
    "catch_up": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50",
    "dedupe_processed": "SELECT event_id, user_id FROM events WHERE NOT (user_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'view'))",
    "retention_prune": "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "upsert_fold": """
        SELECT user_id, max(event_id) AS event_id, first(event_type ORDER BY event_id) FILTER (WHERE event_id % 4 <> 0 AND event_type IS NOT NULL) AS first_type,
               last(event_type ORDER BY event_id) FILTER (WHERE event_id % 3 = 0 AND event_type IS NOT NULL) AS last_known, bool_or(coalesce(event_type = 'error', false)) AS failed,
               last(CASE WHEN event_id % 5 <> 0 THEN value END ORDER BY event_id) AS value FROM events GROUP BY user_id""",
    "push_targets_join": """
        SELECT o_custkey AS device_id, o_orderkey AS account_key, o_orderpriority AS provider, c_name AS apns_token, c_mktsegment AS environment
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""",
    "account_key": "SELECT c_custkey, sha256(lower(c_name || '@example.com') || ':salt') AS account_key FROM customer",
    "debounce_sends": """
        WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS account_key, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
        s AS (SELECT account_key, i, tm, tm AS last, NULL::BIGINT AS pending, [{'sent_at': tm, 'request_at': tm, 'kind': 'sent'}] AS sends FROM e WHERE i = 1
              UNION ALL
              SELECT account_key, i, tm,
                     CASE WHEN open AND due > tm THEN last WHEN open AND tm - due < 21600000 THEN due WHEN open THEN tm WHEN tm - last < 21600000 THEN last ELSE tm END,
                     CASE WHEN open AND due > tm THEN tm WHEN open AND tm - due < 21600000 THEN tm WHEN open THEN NULL WHEN tm - last < 21600000 THEN tm ELSE NULL END,
                     list_concat(sends, list_concat(CASE WHEN open AND due <= tm THEN [{'sent_at': due, 'request_at': pending, 'kind': 'trailing'}] ELSE [] END,
                         CASE WHEN (open AND due <= tm AND tm - due >= 21600000) OR (NOT open AND tm - last >= 21600000) THEN [{'sent_at': tm, 'request_at': tm, 'kind': 'sent'}] ELSE [] END))
              FROM (SELECT e.account_key, e.i, e.tm, s.last, s.pending, s.sends, s.pending IS NOT NULL AS open, s.last + 21600000 AS due FROM s JOIN e ON e.account_key = s.account_key AND e.i = s.i + 1)),
        z AS (SELECT account_key, list_concat(sends, CASE WHEN pending IS NOT NULL THEN [{'sent_at': last + 21600000, 'request_at': pending, 'kind': 'trailing'}] ELSE [] END) AS sends FROM s QUALIFY row_number() OVER (PARTITION BY account_key ORDER BY i DESC) = 1)
        SELECT account_key, u.sent_at AS sent_at, u.request_at AS request_at, u.kind AS kind FROM (SELECT account_key, unnest(sends) AS u FROM z)""",
    "eval_confusion": f"""
        WITH {_RISK} SELECT positive, count(*) AS n, min(score) AS floor, max(score) AS ceiling, count(*) FILTER (WHERE positive = (score >= 0.3)) AS n_right FROM risk GROUP BY positive""",
    "eval_sweep": f"""
        WITH {_RISK}, th AS (SELECT DISTINCT score AS threshold FROM risk),
        c AS (SELECT threshold, count(*) FILTER (WHERE positive AND score = threshold) AS n_positive, count(*) FILTER (WHERE NOT positive AND score = threshold) AS n_negative,
                     count(*) FILTER (WHERE positive AND score >= threshold) AS tp, count(*) FILTER (WHERE NOT positive AND score >= threshold) AS fp,
                     count(*) FILTER (WHERE positive AND score < threshold) AS fn, count(*) FILTER (WHERE NOT positive AND score < threshold) AS tn FROM th, risk GROUP BY threshold)
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c""",
    "call_evidence": f"WITH {_EVIDENCE} SELECT call_id, rule, title, severity, weight, speaker, ord, detail FROM ev",
    "call_summaries": f"""
        WITH {_EVIDENCE}, o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY list_position(['high', 'medium', 'low'], severity), weight DESC, place) AS k FROM ev),
        v AS (SELECT call_id, round(1 - product(1 - weight), 9) AS score, bool_and(rule IN ('call.otp_or_credentials', 'call.user_sharing_sensitive')) AS codes, string_agg(title, '; ' ORDER BY k) FILTER (WHERE k <= 2) AS titles FROM o GROUP BY call_id)
        SELECT call_id, {_LEVEL.format('score')} AS level, CASE WHEN score < 0.3 THEN 'No signs of a scam so far.'
               ELSE 'This call looks ' || CASE WHEN codes THEN 'like an attempt to get your codes or passwords' ELSE 'like a scam' END || ': ' || titles || '.' END AS summary FROM v""",
    "follow_up_scopes": """
        WITH r AS (SELECT user_id % 89 AS scan_id, event_id % 41 = 0 AS everything, CASE WHEN event_id % 5 = 0 THEN []::BIGINT[] ELSE [CAST(user_id AS BIGINT), CAST(event_id % 7 AS BIGINT)] END AS accounts FROM events),
        e AS (SELECT scan_id, bool_or(everything) AS every FROM r GROUP BY scan_id),
        u AS (SELECT DISTINCT scan_id, unnest(accounts) AS a FROM r WHERE NOT everything)
        SELECT e.scan_id, every, CASE WHEN NOT every THEN coalesce(string_agg(CAST(a AS VARCHAR), ',' ORDER BY a), '') END AS accounts FROM e LEFT JOIN u USING (scan_id) GROUP BY e.scan_id, every""",
    "cursor_commit": """
        WITH f AS (SELECT user_id AS account_id, event_id AS id FROM events WHERE event_id > 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5),
        a AS (SELECT account_id, max(id) AS next, bool_or(id % 13 = 0) AS failed FROM f GROUP BY account_id),
        c AS (SELECT DISTINCT user_id AS account_id, CAST(100 AS BIGINT) AS cursor FROM events WHERE event_id % 3 <> 0),
        m AS (SELECT * FROM a WHERE NOT failed)
        SELECT account_id, coalesce(next, cursor) AS cursor, next IS NOT NULL AS advanced FROM c FULL JOIN m USING (account_id)""",
    "day_sections": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, max(event_id) AS newest FROM events GROUP BY 1",
    "unread_count": "SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS n_unread FROM events GROUP BY user_id",
    "org_domains": f"WITH {_JOINED} SELECT DISTINCT registrable AS domain FROM j WHERE NOT free",
    "calls_page": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "size_budget": """
        WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, sum(CAST(l_quantity AS BIGINT)) OVER w AS total, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING))
        SELECT l_orderkey, l_linenumber, size, CAST(total AS BIGINT) AS total FROM t WHERE total <= 60 OR k = 1""",
    "incremental_scan": """
        WITH t AS (SELECT user_id AS account_id, event_id AS uid FROM events WHERE event_id > 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5)
        SELECT account_id, uid, max(uid) OVER (PARTITION BY account_id) AS next_uid FROM t""",
    "text_urls": r"""
        WITH f AS (SELECT page_id, regexp_extract_all(substr(coalesce(html, ''), 1, 1000000), '(?i)(?:https?://|www\.)[^\s<>"''`\[\]{}|\\^]+') AS u FROM pages),
        e AS (SELECT page_id, unnest(u) AS raw, generate_subscripts(u, 1) AS i FROM f),
        b AS (SELECT page_id, i, regexp_replace(raw, '[.,;:!?''"]+$', '') AS x FROM e),
        c AS (SELECT *, length(x) - length(rtrim(x, ')')) AS closing, length(regexp_replace(x, '[^)]', '', 'g')) - length(regexp_replace(x, '[^(]', '', 'g')) AS extra FROM b),
        d AS (SELECT page_id, i, substr(x, 1, length(x) - greatest(least(closing, extra), 0)) AS href FROM c)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, href FROM d WHERE href <> '' QUALIFY pos < 100""",
    "clear_tokens": """
        WITH r AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS token FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT c_custkey AS device_id, CASE WHEN id IS NULL THEN c_mktsegment END AS apns_token, c_nationkey AS nation FROM customer LEFT JOIN r ON id = c_custkey AND token = c_mktsegment""",
    "kept_calls": """
        WITH c AS (SELECT o_orderkey AS k, k * 1000 + k % 977 AS a, CASE WHEN k % 5 <> 0 THEN k * 1000 + (k * 7919) % 600000 - 100000 END AS b,
                          CASE WHEN k % 7 < 3 THEN 'completed' WHEN k % 7 = 3 THEN 'no_answer' WHEN k % 7 = 4 THEN 'ringing' WHEN k % 7 = 5 THEN 'in_progress' END AS status FROM orders)
        SELECT k AS call_id, ['safe', 'low', 'medium', 'high'][k % 4 + 1] AS level, status,
               CASE WHEN b IS NOT NULL THEN greatest(0, CAST(floor((b - a) / 1000.0 + 0.5) AS BIGINT)) WHEN k % 7 >= 4 THEN 62 END AS seconds
        FROM c WHERE k % 6 = 0 OR k % 4 >= 2""",
    "late_partials": """
        WITH t AS (SELECT o_custkey AS call_id, CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'caller' END AS speaker, o_orderkey AS arrival, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey * 7 % 50 END AS sequence, o_orderkey % 4 = 0 AS final, trim(o_orderpriority) AS text FROM orders),
        m AS (SELECT *, max(sequence) OVER (PARTITION BY call_id, speaker ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
        k AS (SELECT * FROM m WHERE final OR sequence IS NULL OR seen IS NULL OR sequence >= seen)
        SELECT call_id, speaker, arrival, speaker || '-tw-' || CAST(1 + count(*) FILTER (WHERE final) OVER (PARTITION BY call_id, speaker ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS id, text, final FROM k""",
    "uid_chunks": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS chunk FROM events",
    "loop_guard": """
        WITH l AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0)
        SELECT o_orderkey AS call_id, id AS line_id, CASE WHEN id IS NULL THEN 'no_line' WHEN o_orderkey % 4 < 2 OR o_orderkey % 7 = 0 THEN 'loop' ELSE 'accept' END AS decision
        FROM orders LEFT JOIN l ON id = o_custkey AND o_orderkey % 11 <> 0""",
    "model_breaker": """
        WITH o AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'answered' WHEN event_type <> 'error' THEN 'failed' END AS outcome FROM events),
        i AS (SELECT *, count(*) FILTER (WHERE outcome = 'answered') OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM o),
        f AS (SELECT *, count(*) FILTER (WHERE outcome = 'failed') OVER (PARTITION BY user_id, island ORDER BY event_id) AS fails FROM i),
        b AS (SELECT user_id, min(event_id) AS broken FROM f WHERE fails >= 3 GROUP BY user_id)
        SELECT user_id, event_id, outcome, coalesce(event_id <= broken, true) AS allowed FROM o LEFT JOIN b USING (user_id)""",
    "safety_ids": "SELECT c_custkey, sha256(c_name || '|' || CASE WHEN c_custkey % 5 <> 0 THEN coalesce(c_mktsegment, '') ELSE '' END) AS safety_id FROM customer",
    "max_severity": "SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'high' WHEN o_orderkey % 2 = 0 THEN 'medium' WHEN o_orderkey % 7 = 0 THEN 'info' END AS severity FROM orders",
    "calls_in_progress_first": """
        WITH live AS (SELECT o_orderkey AS call_id, CAST(o_orderdate AS DATE) AS started_at, 'live' AS status FROM orders WHERE o_orderkey % 60 = 0),
        rest AS (SELECT o_orderkey AS call_id, CAST(o_orderdate AS DATE) AS started_at, o_orderstatus AS status FROM orders WHERE o_orderkey % 60 <> 0),
        listed AS (SELECT 1 AS part, * FROM live UNION ALL SELECT 2, * FROM rest)
        SELECT call_id, started_at, status FROM listed ORDER BY part, started_at DESC, call_id LIMIT 500""",
}
ORACLE_SQL["last_push"] = f"WITH x AS ({ORACLE_SQL['debounce_sends']}) SELECT account_key, max(sent_at) AS last_sent_at, count(*) AS n_sends FROM x GROUP BY account_key".replace("WITH x AS (\n        WITH RECURSIVE", "WITH RECURSIVE x AS (\n        WITH RECURSIVE")
_MITIGATION = _signals("mitigation", (
    ("brand_authenticated", "'info'", "0", "aligned AND brand IS NOT NULL AND NOT coalesce(free, false)"), ("dmarc_pass", "'info'", "0", "dmarc = 'pass'"), ("newsletter_headers", "'info'", "0", "is_list AND dkim = 'pass'"),
), ", x AS (SELECT * FROM j)")
_EVERY = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (_AUTH, _SENDER, _LINK, _CONTENT, ORACLE_SQL["attachment_signals"], _MITIGATION))
ORACLE_SQL["mail_score"] = f"""
    WITH {_JOINED}, every_signal AS ({_EVERY}),
    ranked AS (SELECT *, list_position(['info', 'low', 'medium', 'high'], severity) AS r FROM every_signal),
    rolled AS (SELECT message_id, count(*) AS n_signals, list(1 - weight ORDER BY r DESC, weight DESC) FILTER (WHERE weight > 0) AS spared, count(*) FILTER (WHERE signal = 'mitigation.brand_authenticated') AS known,
                      count(*) FILTER (WHERE signal = 'mitigation.dmarc_pass') AS passed, count(*) FILTER (WHERE signal = 'mitigation.newsletter_headers') AS listed FROM ranked GROUP BY message_id),
    scored AS (SELECT j.message_id, coalesce(n_signals, 0) AS n_signals, round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - list_reduce(list_prepend(1.0::DOUBLE, coalesce(spared, [])), lambda a, b: a * b)
                      - (coalesce(known, 0) * 0.25::DOUBLE + CASE WHEN coalesce(free, false) THEN 0 ELSE coalesce(passed, 0) * 0.08::DOUBLE END + coalesce(listed, 0) * 0.1::DOUBLE))), 9), 6) AS score
               FROM j LEFT JOIN rolled USING (message_id))
    SELECT message_id, score, {_LEVEL.format('score')} AS level, n_signals FROM scored"""
ORACLE_SQL["segment_verdicts"] = f"""
    WITH x AS ({ORACLE_SQL['call_sessions']}), s AS (SELECT call_id, n, id FROM x WHERE kind = 'segment' QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n DESC) <= 20),
    v AS (SELECT call_id, n, level, sequence FROM x WHERE kind = 'verdict')
    SELECT s.call_id, s.n, s.id, v.level, v.sequence FROM s ASOF LEFT JOIN v ON s.call_id = v.call_id AND s.n >= v.n"""
ORACLE_SQL["raw_link_signals"] = ORACLE_SQL["link_signals"]
_PLAIN = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ORACLE_SQL["page_links_sql"] = f"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS tags FROM pages),
    a AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM t),
    h AS (SELECT page_id, i, trim({_PLAIN.format("regexp_extract(tag, '<a href=\"([^\"]*)\"', 1)")}) AS href, trim(regexp_replace({_PLAIN.format("regexp_extract(tag, '>([^<]*)<', 1)")}, '\\s+', ' ', 'g')) AS anchor FROM a
          UNION ALL SELECT page_id, 1000000, url, NULL FROM pages WHERE regexp_matches(url, '^(?i)https?://')),
    f AS (SELECT * FROM h WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY i) = 1)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, href, anchor FROM f"""
ORACLE_SQL["auth_results_sql"] = """
    WITH c AS (SELECT c_custkey, c_custkey % 5 AS part, c_custkey % 6 AS s, c_custkey % 4 AS d, c_custkey % 3 = 0 AS m FROM customer)
    SELECT c_custkey, 'spf' AS method, CASE WHEN part = 0 THEN 'pass' WHEN part = 1 THEN 'softfail' ELSE ['pass', 'fail', 'softfail', 'none', 'temperror', 'unknown'][s + 1] END AS result,
           CASE WHEN part = 0 THEN 'relay.example' WHEN part > 1 THEN 'mail.example' END AS domain FROM c
    UNION ALL SELECT c_custkey, 'dkim', 'pass', 'shop.example' FROM c WHERE part > 1
    UNION ALL SELECT c_custkey, 'dmarc', CASE WHEN part > 1 AND m THEN 'fail' ELSE 'pass' END, NULL FROM c WHERE part <> 1"""
_LINE = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 1) || '…' ELSE {0} END"
_ONE = r"replace(replace(substr(trim(regexp_replace({0}, '[\p{{Cc}}\p{{Z}}\x{{200B}}\x{{FEFF}}\x{{00AD}}]+', ' ', 'g')), 1, {1} + 1), '<<<', '‹‹‹'), '>>>', '›››')"
ORACLE_SQL["document_prompts"] = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body, {_ONE.format("coalesce(text, '')", 200)} AS subject, {_ONE.format("coalesce(text, '')", 140)} AS detail, lang, source FROM documents),
    h AS (SELECT doc_id, body, concat_ws(chr(10), {', '.join("'" + x.replace("'", "''") + "'" for x in (*prompts.TASK, "", prompts.START))}, 'From: ' || source || '@site.example',
                 CASE WHEN lang <> '' THEN 'From display name: "' || lang || '"' END, 'Subject: ' || {_LINE.format("subject", 200)}, 'Received: 2024-05-01T00:00:00Z',
                 'Authentication: ' || CASE WHEN doc_id % 2 = 0 THEN 'spf=pass dkim=missing dmarc=missing' ELSE 'no authentication results reported' END, 'Attachments: none',
                 CASE WHEN doc_id % 3 = 0 THEN 'Heuristic findings (2 of 2, computed on device):' || chr(10) || '- [high] High: ' || {_LINE.format("detail", 140)} || chr(10) || '- [low] Low: ' || {_LINE.format("detail", 140)}
                      ELSE 'Heuristic findings: none' END, 'Links: none') AS head FROM d),
    s(n_body) AS (VALUES (2500), (1875), (1407), (1056), (792), (594), (446), (335), (235), (200)),
    p AS (SELECT doc_id, n_body, concat_ws(chr(10), head, 'Body (plain text, ' || least(length(body), n_body) || ' of ' || length(body) || ' characters):', '{prompts.FENCE}',
                 replace(replace(replace(regexp_replace(substr(body, 1, n_body), '[\x00-\x09\x0B-\x1F\x7F-\x{{9F}}\x{{200B}}\x{{FEFF}}]', '', 'g'), '<<<', '‹‹‹'), '>>>', '›››'), '{prompts.FENCE}', '" " "'),
                 CASE WHEN length(body) > n_body THEN '[truncated]' END, '{prompts.FENCE}', '{prompts.END}', '', '{prompts.LAST}') AS prompt FROM h, s),
    f AS (SELECT *, ceil(length(prompt) / 3.5) <= 500 AS fits FROM p)
    SELECT doc_id, n_body, CAST(length(prompt) AS INT) AS n_chars, sha256(prompt) AS prompt_sha256 FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT fits, CASE WHEN fits THEN -n_body ELSE n_body END) = 1"""
ORACLE_SQL["payload_messages"] = """
    SELECT 'm' || page_id AS message_id, 'Page ' || page_id AS subject, 'Shop, ' || page_id AS name, 's' || page_id || '@shop.example' AS address, CAST(page_id * 1000 AS BIGINT) AS received_ms, url AS text_body,
           sha256(html) AS html_sha256, CASE WHEN page_id % 3 = 0 THEN 'bill ' || page_id || '.pdf' END AS filename, CASE WHEN page_id % 3 = 0 THEN CAST(page_id * 10 AS BIGINT) END AS size_bytes
    FROM pages WHERE page_id % 11 <> 10"""
ORACLE_SQL["html_link_table"] = f"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS tags FROM pages),
    a AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM t),
    h AS (SELECT page_id, i, trim({_PLAIN.format("regexp_extract(tag, '<a href=\"([^\"]*)\"', 1)")}) AS href, trim(regexp_replace({_PLAIN.format("regexp_extract(tag, '>([^<]*)<', 1)")}, '\\s+', ' ', 'g')) AS anchor FROM a)
    SELECT page_id, href, anchor FROM h WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY i) = 1"""

"""Functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import answers, auth, brands, html, lexicon, mime, scoring, text, urls


def values(spark, inputs, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["out"] for r in frame.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_hosts(spark):
    given = ["https://A.Example.com:8080/x", "http://user@evil.example\\@paypal.com/", "mailto:a@b.c", "www.example.com/p", "#top", None, "", "http://[::1]/x", "https://evil.example/\\x", "plain"]
    assert values(spark, given, urls.host_of) == ["a.example.com", "evil.example", None, "www.example.com", None, None, None, "[::1]", "evil.example", None]


@pytest.mark.parametrize(
    ("host", "ip"),
    [("10.0.0.1", True), ("0x7f.1", True), ("2130706433", True), ("0177.0.0.1", True), ("256.1.1.1", False), ("1.2.3.4.5", False), ("[::ffff:1.2.3.4]", True), ("fe80::1%eth0", True), ("1::2::3", False), ("example.com", False), ("", False)],
)
def test_addresses(spark, host, ip):
    assert values(spark, [host], urls.is_ip) == [ip]


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "example.co.uk", "site.github.io", "x.y.com", "localhost", "10.1.1.1"]
    assert values(spark, hosts, urls.registrable) == ["example.co.uk", "example.co.uk", "site.github.io", "y.com", "localhost", "10.1.1.1"]
    assert values(spark, hosts, urls.depth) == [2, 0, 0, 1, 0, 0]
    # no suffixes: they keep two labels
    assert values(spark, ["login.shop.ac.de", "a.b.gob.uk", "x.shop.com.jp", "b.or.fr", "c.d.com.de"], urls.registrable) == ["ac.de", "gob.uk", "com.jp", "or.fr", "d.com.de"]


def test_brands(spark):
    assert values(spark, ["paypal.com", "paypal.at", "apple.at", "example.com"], brands.owner) == ["paypal", "paypal", None, None]
    assert values(spark, ["shop.myshopify.com", "www.gov.uk", "amazon.de", "example.org"], brands.is_brand_host) == [False, True, True, False]
    assert values(spark, ["paypal.evil.example", "www.paypal.com", "prime.evil.example"], brands.subdomain_brand) == ["paypal", None, None]
    assert values(spark, ["Your Apple ID and PayPal", "an apple a day", None], brands.mentions) == [["paypal", "apple"], [], []]


def test_text(spark):
    assert values(spark, ["code 123456, 12 34 and 1-2-3-4", "no 123"], text.mask_digits) == ["code ••••••, •• •• and •-•-•-•", "no 123"]
    assert values(spark, ["FREE MONEY NOW", "hello there friend", "Wow!!"], text.shouts) == [True, False, True]
    assert values(spark, ["“Don’t”  wait –\tnow "], text.normal_line) == ["\"Don't\" wait - now"]
    assert values(spark, ["(555) 123-4567", "+44 20 7946 0958", "12"], text.e164) == ["+15551234567", "+442079460958", None]
    assert values(spark, ["a" * 9, "漢字"], text.wide_token_estimate) == [3, 2]


def test_html():
    page = '<head><title>x</title></head><p>Hello&nbsp;<b>wo</b>rld<br>two<!-- c --><script>var a="<p>"</script><a href="/x" title="a>b">go <img alt="there"></a>'
    assert html.strip(page) == "Hello world\ntwogo"
    assert html.links(page) == [("/x", "go there")]
    assert html.links('<a href="MAILTO:x">m</a><a href="http://A/">1</a><a href="http://a/">2</a>') == [("http://A/", "1")]
    assert html.hidden('<div style="display:none">a <div>b</div></div><span style="color:#fff;background:#FFFFFF">c</span><p>d</p>') == ["a b", "c"]
    assert html.strip("<p" * 20_000) is not None


@pytest.mark.parametrize(("style", "hides"), [("opacity:0.01", True), ("font-size:12px", False), ("font-size:1px", True), ("left:-2000px;position:absolute", True), ("mso-hide:all", True), ("max-height:0", True), ("color:red", False), ("", False)])
def test_hidden_styles(style, hides):
    assert html.hidden_style(style) is hides


def test_lexicon():
    assert lexicon.scan("URGENT:  verify your\naccount — don’t tell") == {"urgency": ["urgent"], "credential": ["verify your account"], "company_words": ["account"], "secrecy": ["don't tell"]}
    assert lexicon.scan("urgently urgencyx") == {"urgency": ["urgently"]}
    assert lexicon.scan("") == {}


def test_scores(spark):
    row = spark.range(1).select(
        F.round(scoring.noisy_or(F.array(F.lit(0.5), F.lit(0.5))), 6).alias("a"), scoring.level(F.lit(0.5)).alias("b"), scoring.noisy_or(F.array().cast("array<double>")).alias("c"), scoring.risk_severity(F.lit(74)).alias("d")
    ).first()
    assert tuple(row) == (0.75, "medium", 0.0, "medium")


def test_auth():
    headers = [
        ("Authentication-Results", "mx.example; spf=pass (ok; fine) smtp.mailfrom=a@bounce.example; dkim=fail header.d=x.com; dkim=pass header.d=example.com; dmarc=pass"),
        ("Authentication-Results", "forged.example; dkim=pass header.d=paypal.com"),
        ("ARC-Authentication-Results", "i=1; mx.example; arc=none; spf=fail"),
    ]
    found = auth.extract(headers, "example.com")
    assert found == {"spf": "pass", "dkim": "pass", "dmarc": "pass", "arc": None, "dkim_domain": "example.com", "spf_domain": "bounce.example"}
    assert auth.extract([("Received-SPF", "SoftFail (x)")])["spf"] == "softfail"
    assert auth.extract([("Authentication-Results", "mx; spf=odd;" * 5000)])["spf"] == "unknown"
    assert auth.strip_comments('a (b (c) d) "e (f)"') == 'a  "e (f)"'


def test_mime():
    raw = (
        b"From: =?utf-8?q?J=C3=B6rg?= <J@Example.COM>\r\nTo: a@b.c, \"D, E\" <d@e.f>\r\nSubject: =?utf-8?b?SGVsbG8=?= =?utf-8?b?IHdvcmxk?=\r\nDate: Mon, 2 Jan 2023 10:00:00 +0200\r\n"
        b"References: <1@x> <2@x>\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=windows-1252\r\n\r\ncaf\xe9\r\n--q\r\n"
        b"Content-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"../a/b.pdf\"\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--q--\r\n"
    )
    m = mime.parse("p", raw)
    assert m["from"] == {"name": "Jörg", "address": "j@example.com"} and [a["address"] for a in m["to"]] == ["a@b.c", "d@e.f"]
    assert m["subject"] == "Hello world" and m["thread_id"] == "<1@x>" and m["text_body"].strip() == "café"
    assert m["attachments"] == [{"filename": "b.pdf", "mime_type": "application/pdf", "size_bytes": 3}] and str(m["received_at"]) == "2023-01-02 08:00:00"
    for junk in (b"", b"\0\xff" * 99, b"Content-Type: multipart/mixed; boundary=\r\n\r\n--\r\n", b"=?utf-8?b?" * 2000):
        mime.parse("p", junk)


def test_mime_rows(spark):
    files = spark.createDataFrame([("a.eml", b"From: a@b.c\r\nSubject: x\r\n\r\nhi")], "path string, content binary")
    assert mime.messages(files).select("from.address", "subject", "text_body").first() == ("a@b.c", "x", "hi")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('<think>{"risk_score": 1}</think>```json\n{"risk_score": 90, "category": "Phishing", "reasons": ["• a", "b"]}\n```', (True, "phishing", 90)),
        ("{'is_scam': True, 'Risk-Score': 0.8,}", (True, "scam", 80)), ('{"category": "not phishing"}', (False, "safe", 5)), ('{"riskScore": 1}', (False, "safe", 1)), ('{"riskScore": 1.0}', (True, "scam", 100)),
        ('text {"risk_score": 70, "category": "scam", "reasons": ["one", "tw', (True, "scam", 70)), ("no object", None), ("{" * 1000, None),
    ],
)
def test_answers(raw, want):
    got = answers.parse_answer(raw)
    assert (got and (got["is_suspicious"], got["category"], got["risk_score"])) == want


def test_answer_column(spark):
    assert values(spark, ['{"risk_score": 70, "category": "scam"}', None], answers.assessment)[0]["risk_score"] == 70


def test_plain_text_urls(spark):
    texts = ["see https://a.example/x, or (http://b.example/y_(z)) and www.c.example/q?d=1!", "no link; ftp://x.example", "HTTPS://UP.example/A).", "", None, " ".join(f"http://h{i}.example" for i in range(150))]
    got = values(spark, texts, urls.text_urls)
    assert got[0] == ["https://a.example/x", "http://b.example/y_(z)", "www.c.example/q?d=1"] and got[1] == [] == got[3] and got[2] == ["HTTPS://UP.example/A)."[:-2]]
    assert got[4] is None and len(got[5]) == 100


def test_links_of_both_bodies(spark):
    rows = [([("http://a.example/", "A"), (" HTTP://A.example/ ", "B"), ("javascript:x", "c")], "http://a.example/ http://b.example"), (None, None), (None, " ".join(f"http://h{i}.example" for i in range(80)))]
    frame = spark.createDataFrame(rows, "anchors array<struct<href:string,anchor:string>>, body string")
    got = [[tuple(x) for x in r[0]] for r in frame.select(urls.message_links(F.col("anchors"), F.col("body"))).collect()]
    assert got[0] == [("http://a.example/", "A"), ("javascript:x", "c"), ("http://b.example", None)] and got[1] == [] and len(got[2]) == 50


def test_brand_mentions_equal_one_pattern_for_each_brand():
    import random
    import re

    from larkspur.functions import brands
    from larkspur.functions import catalogs as cat

    def named(words, t):
        return re.search(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])", t) is not None

    words = [n for _, names, _ in cat.BRANDS for n in names] + [q for qs in cat.QUALIFIED_MENTIONS.values() for q in qs] + ["x", "_", "7", "é"]
    draw = random.Random(5)
    for _ in range(200):
        t = "".join(draw.choice(words) + draw.choice([" ", "", ".", "_", "-", "é"]) for _ in range(6)).lower()
        want = [k for k, names, _ in cat.BRANDS if named(names, t) and (k not in cat.QUALIFIED_MENTIONS or named(cat.QUALIFIED_MENTIONS[k], t))]
        assert brands._mentioned(t) == want, t

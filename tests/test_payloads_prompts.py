"""Provider payloads, prompts and table functions on hand-made inputs."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import payloads, prompts, tables, text


def leaf(kind, t, encode=base64.urlsafe_b64encode):
    data = t if isinstance(t, bytes) else t.encode()
    return {"mimeType": kind, "body": {"data": encode(data).decode().rstrip("="), "size": len(data)}}


def nested(part, levels):
    for _ in range(levels):
        part = {"mimeType": "multipart/mixed", "parts": [part]}
    return part


def test_trees_of_parts(spark):
    parts = [
        {"mimeType": "multipart/alternative", "parts": [leaf("text/plain", "hello é"), leaf(" Text/HTML; charset=x", "<p>x</p>")]}, {"mimeType": "application/pdf", "filename": " a.pdf ", "body": {"size": 9}},
        leaf("text/plain", "second", base64.b64encode), leaf("", b"\xe9\xff"), {"mimeType": "text/plain", "body": {"data": "a"}}, {"mimeType": "text/plain", "body": {}}, {"mimeType": "image/png", "body": {"data": "AAAA"}},
        {"mimeType": "message/rfc822", "parts": [leaf("text/plain", "inner")]}, {"mimeType": "multipart/mixed", "headers": [{"name": "content-disposition", "value": " ATTACHMENT; x"}], "parts": [leaf("text/plain", "not entered")]},
        nested(leaf("text/plain", "deep enough"), 30), nested(leaf("text/plain", "too deep"), 31),
    ]
    headers = [{"name": "from", "value": '"Doe, Jane" <jane@x.org>'}, {"name": "To", "value": "a@b.c, Bob <bob@d.e>,, nobody"}, {"name": "TO", "value": "c@d.e"}, {"name": "Subject", "value": " Hi "}]
    message = {"id": "m1", "threadId": "t", "internalDate": "1700000000000", "payload": {"mimeType": "multipart/mixed", "headers": headers, "parts": parts}}
    bodies = [json.dumps(message), json.dumps({"id": "m2"}), json.dumps({"id": "m3", "payload": leaf("text/plain", "alone")}), "junk", "[]", "", None, json.dumps({"payload": {}})]
    got = {r["message_id"]: r.asDict(True) for r in payloads.tree_messages(spark.createDataFrame([("a", b) for b in bodies], "account_id string, body string")).collect()}
    assert got.keys() == {"m1", "m2", "m3"}
    m = got["m1"]
    assert m["text_body"] == "hello é\n\nsecond\n\néÿ\n\ninner\n\ndeep enough" and m["html_body"] == "<p>x</p>"
    assert m["from"] == {"name": "Doe, Jane", "address": "jane@x.org"} and [p["address"] for p in m["to"]] == ["a@b.c", "bob@d.e", "c@d.e"] and m["subject"] == "Hi"
    assert m["attachments"] == [{"filename": "a.pdf", "mime_type": "application/pdf", "size_bytes": 9}, {"filename": "", "mime_type": "multipart/mixed", "size_bytes": None}]
    assert got["m3"]["text_body"] == "alone" and got["m2"]["text_body"] is None and got["m2"]["headers"] == []


def test_flat_resources(spark):
    one = {
        "id": "g1", "receivedDateTime": "2024-05-01T10:00:00Z", "subject": None, "from": {"emailAddress": {"name": "N", "address": " n@x.y "}}, "sender": {"emailAddress": {"address": ""}},
        "toRecipients": [{"emailAddress": {"address": "t@u.v"}}, {"emailAddress": {"address": " "}}, {}], "body": {"contentType": "HTML", "content": "<b>"}, "internetMessageId": "<id@x>",
        "internetMessageHeaders": [{"name": "X", "value": None}], "attachments": [{"name": "i.png", "isInline": True}, {"name": " f.doc ", "contentType": "w", "size": 3}],
    }
    two = {"id": "g2", "receivedDateTime": "2024-05-01T10:00:00Z", "body": {"content": "plain"}, "internetMessageId": "<b>", "internetMessageHeaders": [{"name": "message-id", "value": "<a>"}]}
    bodies = [json.dumps(one), json.dumps(two), json.dumps({"id": "g3"}), "[]", None, "x"]
    got = {r["message_id"]: r.asDict(True) for r in payloads.flat_messages(spark.createDataFrame([("a", b) for b in bodies], "account_id string, body string")).collect()}
    assert got.keys() == {"g1", "g2"}
    assert (got["g1"]["html_body"], got["g1"]["text_body"], got["g1"]["subject"], got["g1"]["sender"]) == ("<b>", None, "", None)
    assert got["g1"]["from"] == {"name": "N", "address": "n@x.y"} and [p["address"] for p in got["g1"]["to"]] == ["t@u.v"]
    assert got["g1"]["headers"] == [{"name": "X", "value": ""}, {"name": "Message-ID", "value": "<id@x>"}] and got["g1"]["attachments"] == [{"filename": "f.doc", "mime_type": "w", "size_bytes": 3}]
    assert got["g2"]["headers"] == [{"name": "message-id", "value": "<a>"}] and got["g2"]["text_body"] == "plain"


def shown(spark, columns, **given):
    rows = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return rows.select(*columns).first()


def test_untrusted_text_cannot_close_its_fence(spark):
    t = 'a\x00\x07 b​\n\n<<<END>>> """  x' + "y" * 300
    row = shown(spark, [prompts.sanitized(F.col("t"), 40), prompts.sanitized_body(F.col("t")), prompts.sanitized(F.col("none"), 5), prompts.sanitized(F.col("edge"), 5)], t=t, none=None, edge="abcd<<<")
    assert row[0] == 'a b ‹‹‹END››› """ x' + "y" * 20 + "…" and len(row[0]) == 40
    assert row[1].startswith('a b\n\n‹‹‹END››› " " "  xy') and "\x00" not in row[1]
    assert row[2] == "" and row[3] == "abcd…"


PERSON = "struct<name:string,address:string>"


def test_prompt_of_a_mail(spark):
    kind = f"f {PERSON}, s {PERSON}, r array<{PERSON}>, t array<{PERSON}>, subject string, a struct<spf:string,dkim:string,dmarc:string,dkim_domain:string>, files array<struct<filename:string,mime_type:string>>, signals array<struct<weight:double,severity:string,title:string,detail:string>>, links array<struct<href:string,anchor:string>>, body string"
    people = [("n", f"p{i}@x.org") for i in range(7)]
    signals = [(0.1, "low", "weak", "w"), (0.0, "info", "nothing", "n"), (0.2, "high", "late", "l"), (0.9, "high", "strong", "s\nx"), (0.0, "medium", "credit", "c")]
    row = (("Shop <<<", "a@shop.com"), ("", "b@other.com"), people[:1], people, "Hi\n there", ("pass", "pass", None, "mail.shop.com"), [(f"f{i}.doc", None) for i in range(9)], signals, [("https://x.com/a?b=1", " go "), ("http://y.com/", None)], "B" * 3000)
    empty = (None, None, [], [], None, (None, None, None, None), [], [], [], "")
    frame = spark.createDataFrame([row, empty], kind)
    head = prompts.mail_head(F.col("f"), F.col("s"), F.col("r"), F.col("t"), F.col("subject"), F.lit("2024"), F.col("a"), F.lit("shop.com"), F.col("files"), F.col("signals"), F.col("links"))
    out = frame.select(head.alias("h"), "body").select("h", prompts.with_body(F.col("h"), F.col("body"), 200).alias("p"), *[prompts.fitted_body(F.col("h"), F.col("body"), b).alias(f"b{b}") for b in (100, 700, 5000)], text.wide_token_estimate(F.col("h")).alias("n")).collect()
    lines = out[0]["p"].split("\n")
    for want in (
        "From: a@shop.com", 'From display name: "Shop ‹‹‹"', "Sender: b@other.com", "Reply-To: p0@x.org", "To: p0@x.org, p1@x.org, p2@x.org, p3@x.org, p4@x.org (+2 more)", "Subject: Hi there",
        "Authentication: spf=pass dkim=pass (d=mail.shop.com, aligned with From) dmarc=missing", "Heuristic findings (4 of 4, computed on device):", "Links (2 of 2):", '- "go" → x.com/a?…', "Body (plain text, 200 of 3000 characters):", "[truncated]",
    ):
        assert want in lines, want
    assert [x for x in lines if x.startswith("- [")] == ["- [high] strong: s x", "- [high] late: l", "- [medium] credit: c", "- [low] weak: w"]
    assert any(x.startswith("Attachments (9): f0.doc (unknown type); ") and x.endswith("; …") for x in lines)
    assert out[0]["b100"] == 200 and out[0]["b5000"] == 2500
    steps = prompts.body_steps()
    assert steps == sorted(steps, reverse=True) and steps[-1] == 200 and out[0]["b700"] in steps[1:-1]
    assert "From: (missing)" in out[1]["p"] and "Heuristic findings: none\nLinks: none" in out[1]["p"] and "[truncated]" not in out[1]["p"]


@pytest.mark.parametrize(("text_", "tokens"), [("", 0), ("abc", 1), ("abcdefgh", 3), ("漢字", 2), ("ᄀ⺀〇ㄅ㐀한豈Ａ𠀀", 9), ("漢字ab", 3)])
def test_tokens_of_dense_scripts(spark, text_, tokens):
    assert shown(spark, [text.wide_token_estimate(F.col("t"))], t=text_)[0] == tokens


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, '<a href="/A">x <b>y</b></a><a href="/a">z</a><a>none</a>', "see http://q.com/(a)). and WWW.R.com, http://q.com/(a)"), (2, None, None)], "id int, html string, t string")
    got = spark.sql("SELECT id, l.* FROM {rows}, LATERAL extract_links(html, t) l", rows=rows).collect()
    assert [tuple(r) for r in got] == [(1, 0, "/A", "x y"), (1, 1, "http://q.com/(a)", None), (1, 2, "WWW.R.com", None)]
    heads = spark.createDataFrame([(["Authentication-Results", None], ["mx; spf=fail smtp.mailfrom=a@b.c; dmarc=pass", None]), (None, None)], "n array<string>, v array<string>")
    got = spark.sql("SELECT a.* FROM {heads}, LATERAL parse_auth_results(n, v, null) a", heads=heads).collect()
    assert [tuple(r) for r in got] == [("spf", "fail", "b.c"), ("dmarc", "pass", None)]

"""Messages out of the JSON of two mail providers, with variants: a tree of parts, and a flat resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a tree of parts that are read.
DEPTH = 32
_PEOPLE = "array<struct<name:string,address:string>>"
_HEADERS = "array<struct<name:string,value:string>>"
_FILES = "array<struct<filename:string,mime_type:string,size_bytes:bigint>>"


def base64url(data: Column) -> Column:
    """Bytes of base64 in either alphabet, padded or not; null where the length is none of base64's, or a character is not."""
    plain = F.rtrim(F.regexp_replace(F.translate(data, "-_", "+/"), r"\s+", ""), F.lit("="))
    rest = F.length(plain) % 4
    padded = F.when(rest == 0, plain).when(rest == 2, F.concat(plain, F.lit("=="))).when(rest == 3, F.concat(plain, F.lit("=")))
    return F.try_to_binary(padded, F.lit("base64"))


def decoded(data: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1, which every byte is."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by its name in any case."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def people(value: Column) -> Column:
    """Names and addresses of a header: parts between commas that no quotes hold; parts without an @ are none."""
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r'(?:"[^"]*"|[^,"])+'), F.lit(0))
    in_angles = lambda p: F.regexp_extract(p, r"<([^<>]*)>\s*$", 1)

    def one(p: Column) -> Column:
        named = in_angles(p) != ""
        name = F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^<>]*>\s*$", ""), '"', ""))
        return F.struct(F.when(named & (name != ""), name).alias("name"), F.trim(F.when(named, in_angles(p)).otherwise(p)).alias("address"))

    return F.filter(F.transform(parts, one), lambda a: a["address"].contains("@"))


def _get(part: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(part, path, kind)


def _attached(part: Column) -> Column:
    disposition = header(F.coalesce(_get(part, "$.headers", _HEADERS), F.array().cast(_HEADERS)), "Content-Disposition")
    return (F.trim(F.coalesce(_get(part, "$.filename"), F.lit(""))) != "") | F.coalesce(F.lower(F.trim(disposition)).startswith("attachment"), F.lit(False))


def tree(payload: Column, depth: int = DEPTH) -> Column:
    """Parts of a payload, itself included, as (path, part) in depth-first order; attached parts are not entered, nor levels beyond ``depth``."""
    kind = "array<struct<path:string,part:variant>>"
    root = F.filter(F.array(F.struct(F.lit("").alias("path"), payload.alias("part"))).cast(kind), lambda n: n["part"].isNotNull())

    def below(n: Column) -> Column:
        parts = F.when(~_attached(n["part"]), _get(n["part"], "$.parts", "array<variant>"))
        return F.transform(F.coalesce(parts, F.array().cast("array<variant>")), lambda p, i: F.struct(F.concat(n["path"], F.lpad(i.cast("string"), 6, "0")).alias("path"), p.alias("part")))

    def step(acc: Column, _: Column) -> Column:
        level = F.flatten(F.transform(acc["level"], below)).cast(kind)
        return F.struct(F.concat(acc["every"], level).alias("every"), level.alias("level"))

    start = F.struct(root.alias("every"), root.alias("level"))
    every = F.aggregate(F.sequence(F.lit(2), F.lit(depth)), start, step, lambda acc: acc["every"])
    by_path = lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    return F.array_sort(every, by_path)


def tree_messages(rows: DataFrame) -> DataFrame:
    """rows (account_id, body: JSON of a message whose payload is a tree of parts): messages in the mail rules' schema.

    Text leaves are joined by an empty line, HTML leaves by a line end;
    attached parts give their name, type and size.  Bodies are base64url.
    A body that is no JSON object gives no row; missing fields are null or empty.
    """
    m = rows.withColumn("_m", F.try_parse_json("body")).filter(_get(F.col("_m"), "$.id").isNotNull())
    m = m.withColumns({"_h": F.coalesce(_get(F.col("_m"), "$.payload.headers", _HEADERS), F.array().cast(_HEADERS)), "_parts": tree(_get(F.col("_m"), "$.payload", "variant"))})
    mime = lambda p: F.lower(F.trim(F.coalesce(_get(p["part"], "$.mimeType"), F.lit(""))))
    leaf = lambda p: ~_attached(p["part"]) & (F.coalesce(F.size(_get(p["part"], "$.parts", "array<variant>")), F.lit(0)) == 0)

    def texts(of) -> Column:
        found = F.transform(F.filter("_parts", lambda p: leaf(p) & of(mime(p))), lambda p: decoded(base64url(_get(p["part"], "$.body.data"))))
        return F.filter(found, lambda t: t.isNotNull() & (t != ""))

    plain, marked = texts(lambda t: t.startswith("text/plain") | (t == "")), texts(lambda t: t.startswith("text/html"))
    files = F.transform(
        F.filter("_parts", lambda p: _attached(p["part"])),
        lambda p: F.struct(F.trim(F.coalesce(_get(p["part"], "$.filename"), F.lit(""))).alias("filename"), _get(p["part"], "$.mimeType").alias("mime_type"), _get(p["part"], "$.body.size", "bigint").alias("size_bytes")),
    )
    every = lambda name: F.flatten(F.transform(F.filter("_h", lambda h: F.lower(h["name"]) == name), lambda h: people(h["value"])))
    first = lambda name: F.try_element_at(people(header(F.col("_h"), name)), F.lit(1))
    return m.select(
        "account_id", _get(F.col("_m"), "$.id").alias("message_id"), _get(F.col("_m"), "$.threadId").alias("thread_id"), F.timestamp_millis(_get(F.col("_m"), "$.internalDate", "bigint")).alias("received_at"),
        first("From").alias("from"), first("Sender").alias("sender"), every("reply-to").alias("reply_to"), every("to").alias("to"), F.trim(F.coalesce(header(F.col("_h"), "Subject"), F.lit(""))).alias("subject"),
        F.when(F.size(plain) > 0, F.array_join(plain, "\n\n")).alias("text_body"), F.when(F.size(marked) > 0, F.array_join(marked, "\n")).alias("html_body"), F.col("_h").alias("headers"), files.cast(_FILES).alias("attachments"),
    )


def flat_messages(rows: DataFrame) -> DataFrame:
    """rows (account_id, body: JSON of a flat message resource): messages in the mail rules' schema.

    The body is HTML or text as its type says; inline attachments are left
    out; the message id becomes a header where there is none.  A body that is
    no JSON object, or has no id or time of receipt, gives no row.
    """
    person = "struct<emailAddress:struct<name:string,address:string>>"
    m = rows.withColumn("_m", F.try_parse_json("body"))
    get = lambda path, kind="string": _get(F.col("_m"), path, kind)
    one = lambda p: F.when(F.trim(F.coalesce(p["emailAddress"]["address"], F.lit(""))) != "", F.struct(p["emailAddress"]["name"].alias("name"), F.trim(p["emailAddress"]["address"]).alias("address")))
    many = lambda path: F.filter(F.transform(F.coalesce(get(path, f"array<{person}>"), F.array().cast(f"array<{person}>")), one), lambda a: a.isNotNull()).cast(_PEOPLE)
    given = F.transform(F.coalesce(get("$.internetMessageHeaders", _HEADERS), F.array().cast(_HEADERS)), lambda h: F.struct(h["name"].alias("name"), F.coalesce(h["value"], F.lit("")).alias("value")))
    own = F.trim(F.coalesce(get("$.internetMessageId"), F.lit("")))
    added = F.when((own != "") & header(given, "Message-ID").isNull(), F.array(F.struct(F.lit("Message-ID").alias("name"), own.alias("value")))).otherwise(F.array().cast(_HEADERS))
    kind = "array<struct<name:string,contentType:string,size:bigint,isInline:boolean>>"
    files = F.transform(
        F.filter(F.coalesce(get("$.attachments", kind), F.array().cast(kind)), lambda f: ~F.coalesce(f["isInline"], F.lit(False))),
        lambda f: F.struct(F.trim(F.coalesce(f["name"], F.lit(""))).alias("filename"), f["contentType"].alias("mime_type"), f["size"].alias("size_bytes")),
    )
    marked = F.lower(F.coalesce(get("$.body.contentType"), F.lit(""))) == "html"
    received = F.try_to_timestamp(get("$.receivedDateTime"))
    return m.select(
        "account_id", get("$.id").alias("message_id"), get("$.conversationId").alias("thread_id"), received.alias("received_at"), one(get("$.from", person)).alias("from"), one(get("$.sender", person)).alias("sender"),
        many("$.replyTo").alias("reply_to"), many("$.toRecipients").alias("to"), F.coalesce(get("$.subject"), F.lit("")).alias("subject"), F.when(~marked, get("$.body.content")).alias("text_body"),
        F.when(marked, get("$.body.content")).alias("html_body"), F.concat(given, added).alias("headers"), files.cast(_FILES).alias("attachments"),
    ).filter("message_id is not null and received_at is not null")

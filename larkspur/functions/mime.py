"""RFC 822 messages to rows, best effort: whatever the bytes, a message comes out."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from email.header import decode_header
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES, MOST_PARTS, MOST_HEADERS, HEADER_CHARS = 8 << 20, 500, 1000, 16_000
ADDRESS = "struct<name:string,address:string>"
SCHEMA = (
    f"path string, message_id string, thread_id string, received_at timestamp, `from` {ADDRESS}, sender {ADDRESS}, reply_to array<{ADDRESS}>, `to` array<{ADDRESS}>, "
    "subject string, text_body string, html_body string, headers array<struct<name:string,value:string>>, attachments array<struct<filename:string,mime_type:string,size_bytes:bigint>>"
)


def decode_bytes(data: bytes, charset: str | None) -> str:
    """UTF-8, then the declared charset, then Windows-1252, then Latin-1; stateful 7-bit charsets come first."""
    if charset and charset.lower().startswith(("iso-2022", "utf-7", "hz")):
        order = [charset, "utf-8", "cp1252"]
    else:
        order = ["utf-8", charset, "cp1252"]
    for c in order:
        try:
            if c:
                return data.decode(c)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1")


def decode_words(raw: str) -> str:
    """Encoded words decoded; those of one charset that follow one another are joined as bytes first."""
    try:
        parts = decode_header(re.sub(r"\r?\n[ \t]+", " ", raw))
    except Exception:  # noqa: BLE001  a broken word stays as it is
        return raw
    return "".join(p if isinstance(p, str) else decode_bytes(p, c) for p, c in parts).strip()


def addresses(raw: str) -> list[dict]:
    """Addresses are read before their names are decoded."""
    found = getaddresses([re.sub(r"\r?\n[ \t]+", " ", raw).replace(";", ",").replace("mailto:", "")], strict=False)
    return [{"name": decode_words(n) or None, "address": a.strip().lower()} for n, a in found if "@" in a]


def filename(raw: str | None) -> str:
    """Without path, control and direction characters."""
    name = re.sub(r"[\x00-\x1f\x7f‪-‮⁦-⁩]", "", decode_words(raw or "").replace("\\", "/").rpartition("/")[2]).strip()
    return name or "attachment"


def date(raw: str | None):
    try:
        at = parsedate_to_datetime(re.sub(r"\([^)]*\)", "", raw or ""))
    except (TypeError, ValueError, IndexError):
        return None
    return at.replace(tzinfo=None) - (at.utcoffset() or pd.Timedelta(0)) if 1900 <= at.year <= 2200 else None


def parse(path: str, content: bytes) -> dict:
    """One message's columns."""
    message = email.message_from_bytes(content[:MOST_BYTES], policy=email.policy.compat32)
    headers = [{"name": n, "value": re.sub(r"\r?\n[ \t]+", " ", str(v))[:HEADER_CHARS]} for n, v in message.items()[:MOST_HEADERS]]
    get = lambda n: next((h["value"] for h in headers if h["name"].lower() == n), None)
    text, html, files = [], [], []
    for k, part in enumerate(message.walk()):
        if k >= MOST_PARTS or part.is_multipart():
            continue
        kind, named = part.get_content_type(), part.get_filename()
        try:
            data = part.get_payload(decode=True) or b""
        except Exception:  # noqa: BLE001
            data = b""
        if named or part.get_content_disposition() == "attachment":
            files.append({"filename": filename(named), "mime_type": kind, "size_bytes": len(data)})
        elif kind == "text/html":
            html.append(decode_bytes(data, part.get_content_charset()))
        elif kind.startswith("text/") and kind != "text/calendar":
            text.append(decode_bytes(data, part.get_content_charset()))
    ids = re.findall(r"<[^>]+>", get("references") or "") or re.findall(r"<[^>]+>", get("in-reply-to") or "")
    own = (get("message-id") or "").strip() or None
    one = lambda n: (addresses(get(n) or "") or [None])[0]
    return {
        "path": path, "message_id": own, "thread_id": ids[0] if ids else own, "received_at": date(get("date")), "from": one("from"), "sender": one("sender"),
        "reply_to": addresses(get("reply-to") or ""), "to": addresses(get("to") or ""), "subject": decode_words(get("subject") or ""), "text_body": "\n".join(text) or None,
        "html_body": "\n".join(html) or None, "headers": headers, "attachments": files,
    }


def messages(files: DataFrame) -> DataFrame:
    """files (path, content), as the binaryFile source reads them: one message row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [re.sub(r"[` ].*", "", c.strip().lstrip("`")) for c in re.split(r", (?=`?\w+`? (?:string|timestamp|struct|array))", SCHEMA)]
        for batch in batches:
            yield pd.DataFrame([parse(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def decoded_size(body: Column) -> Column:
    """Bytes of a base64 body, without decoding it."""
    return F.floor(F.length(F.regexp_replace(body, "[^A-Za-z0-9+/]", "")) * 3 / 4)

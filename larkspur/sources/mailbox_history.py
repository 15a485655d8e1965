"""A data source over mailbox histories, whose offsets are each account's cursor.

``path`` is a folder with a file of JSON lines for each account, named by the
account in URL quoting: ``{"id": 17, "messages": [{"id": "m", "labels": ["INBOX"]}]}``
by increasing id, the oldest perhaps gone.  Any store that Arrow opens by URI will do.

    spark.dataSource.register(MailboxHistory)
    spark.readStream.format("mailbox_history").option("path", folder).option("cap", 100).load()
    spark.read.format("mailbox_history").option("path", folder).option("cursors", '{"a@b.c": 17}').load()

A scan of an account goes from its cursor to the record that reaches the cap,
and its cursor is that record's id.  A cursor older than the history is stale:
the account is scanned again from its oldest record, once, and its rows say so.
A stream commits cursors with its checkpoint, so they advance only when a batch
has been processed, and a batch that failed is read again, the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larkspur.sources.mailboxes import SCAN_CAP

SCHEMA = "account_id string, record_id long, message_id string, next_cursor long, cursor_was_reset boolean"


@dataclass
class Span(InputPartition):
    """Records of an account after ``start`` up to ``end``."""

    account: str
    start: int
    end: int


class History:
    """What lies in the folder."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.cap = int(options.get("cap", SCAN_CAP))

    def _file_system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def accounts(self) -> list[str]:
        from pyarrow import fs

        system, folder = self._file_system()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(unquote(f.base_name.removesuffix(".jsonl")) for f in found if f.is_file and f.base_name.endswith(".jsonl"))

    def records(self, account: str) -> Iterator[tuple[int, list[str]]]:
        """Id and new inbox messages of each record; drafts and sent mail are none."""
        import io

        system, folder = self._file_system()
        with system.open_input_stream(f"{folder}/{quote(account, safe='@')}.jsonl") as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                if line.strip():
                    record = json.loads(line)
                    labels = ((m["id"], set(m.get("labels") or ())) for m in record.get("messages") or ())
                    yield record["id"], [i for i, own in labels if "INBOX" in own and not own & {"DRAFT", "SENT"}]

    def stale(self, account: str, cursor: int) -> bool:
        """Whether records after the cursor are gone; 0 is the cursor of an account that was never scanned."""
        oldest = next(self.records(account), (0, []))[0]
        return 0 < cursor < oldest - 1

    def end(self, account: str, cursor: int) -> int:
        """The cursor after the next scan."""
        seen: set[str] = set()
        start = 0 if self.stale(account, cursor) else cursor
        for record, messages in self.records(account):
            if record > start:
                seen.update(messages)
                cursor = max(cursor, record)
                if len(seen) >= self.cap:
                    break
        return cursor

    def rows(self, span: Span) -> Iterator[tuple]:
        """Each message of a span once, at its first record."""
        reset = self.stale(span.account, span.start)
        start, seen = 0 if reset else span.start, set()
        for record, messages in self.records(span.account):
            if record > span.end:
                return
            for m in messages if record > start else ():
                if m not in seen:
                    seen.add(m)
                    yield span.account, record, m, span.end, reset

    def spans(self, start: dict, end: dict) -> list[Span]:
        return [Span(a, int(start.get(a, 0)), int(e)) for a, e in sorted(end.items()) if int(e) > int(start.get(a, 0))]


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.history, self.cursors = History(options), json.loads(options.get("cursors", "{}"))

    def partitions(self) -> list[Span]:
        return self.history.spans(self.cursors, {a: self.history.end(a, int(self.cursors.get(a, 0))) for a in self.history.accounts()})

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.history.rows(partition)


class HistoryStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.history, self.planned = History(options), None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.planned = self.planned or {}
        return self.planned | {a: self.history.end(a, self.planned.get(a, 0)) for a in self.history.accounts()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.planned = dict(end)  # at a restart the last batch is planned again first
        return self.history.spans(start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.history.rows(partition)


class MailboxHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> HistoryStreamReader:
        return HistoryStreamReader(self.options)

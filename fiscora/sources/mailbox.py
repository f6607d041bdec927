"""A mailbox as a data source, in batch (newest first, the limit before anything is skipped) and as a
stream with the last number seen as its offset. The server is a folder of <number>.eml files on any file
system that pyarrow knows; another server is another Server.

    spark.dataSource.register(Mailbox)
    spark.read.format("mailbox").option("folder", uri).option("limit", "10").load()
    spark.readStream.format("mailbox").option("folder", uri).load()

Headers that are missing have defaults. A message that cannot be read or has gone is a row with its error
and a key by its number, and stops nothing else."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source_key string, sequence long, subject string, sender string, message_date string, content binary, error string"
#: Messages that one task reads.
EACH = 100


class Server:
    """The messages of a folder by their numbers."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        store, base = self._open()
        names = [posixpath.splitext(f.base_name) for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File]
        return sorted(int(n) for n, ext in names if ext == ".eml" and n.isdigit())

    def fetch(self, number: int) -> bytes:
        store, base = self._open()
        with store.open_input_stream(posixpath.join(base, f"{number}.eml")) as f:
            return f.read()


def row(number: int, fetch) -> tuple:
    """A message's row; its key is its id by the server or by its sender, or its number."""
    from email import message_from_bytes, policy

    try:
        content = fetch(number)
        m = message_from_bytes(content, policy=policy.default)
        header = lambda name: str(m[name] or "").strip()
        key = f"gmail:{header('X-GM-MSGID')}" if header("X-GM-MSGID") else f"message-id:{header('Message-ID')}" if header("Message-ID") else f"imap-sequence:{number}"
        return key, number, header("Subject") or "(sin asunto)", header("From"), header("Date"), content, None
    except Exception as e:
        return f"imap-sequence:{number}", number, "Identidad no disponible", "", "", None, f"{type(e).__name__}: {e}"


def shares(numbers: Sequence[int], each: int = EACH) -> list[InputPartition]:
    return [InputPartition(list(numbers[i : i + each])) for i in range(0, len(numbers), each)]


class _Read:
    def __init__(self, options: dict):
        self.server, self.each = Server(options["folder"]), int(options.get("each", EACH))
        self.limit = int(options["limit"]) if options.get("limit") else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number in partition.value:
            yield row(number, self.server.fetch)


class _Batch(_Read, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        newest = self.server.numbers()[::-1]
        return shares(newest[: self.limit] if self.limit else newest, self.each) or [InputPartition([])]


class _Stream(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": max([0, *self.server.numbers()])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return shares([n for n in self.server.numbers() if start["number"] < n <= end["number"]][::-1], self.each) or [InputPartition([])]


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)

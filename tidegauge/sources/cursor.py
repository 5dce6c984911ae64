"""A data source of answers that are paged by a cursor: each answer's last id asks for the next one.

``spark.read.format("cursor_pages")`` and ``readStream`` follow the chains of the
channels below ``path``: the answer to ``{path}/{channel}/{cursor}.json`` is a JSON
list of items, the cursor of the first answer is ``first``, and the next one is
the id of the last item that has one. A chain ends where no answer is saved, where
an answer is empty or has no id, or, with ``since``, after an answer whose last item is
older. Paths are opened by pyarrow's file systems (``file``, ``s3``, ``gs``, ``hdfs``).

Channels are read in parallel, a chain in order. Filters on ``channel`` leave out
chains, and those on ``moment`` (at least) end them early. A schema that names
fewer columns makes only those.

Options: ``path``, ``channels`` (names with commas; all below ``path`` if not given),
``since`` (as moments are written), ``pages`` (answers of a chain at most).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "channel string, id long, title string, moment string, body string"
FIRST = "first"
# The names under which answers give an item's fields.
NAMES = {"id": ("Id", "id"), "title": ("FriendlyTitle", "friendly_title"), "moment": ("Date", "date"), "body": ("Body", "body")}


def _field(item: dict, name: str):
    return next((item[n] for n in NAMES[name] if item.get(n) not in (None, "")), None)


def _id(item) -> int | None:
    value = _field(item, "id") if isinstance(item, dict) else None
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


class Chain:
    """One channel's answers in the order of their cursors."""

    def __init__(self, path: str, channel: str) -> None:
        self.files, base = fs.FileSystem.from_uri(path)
        self.base, self.channel = f"{base}/{channel}", channel

    def answer(self, cursor: str) -> list | None:
        """The items behind a cursor; None where nothing is saved (yet) or what is saved isn't a list."""
        try:
            with self.files.open_input_stream(f"{self.base}/{cursor}.json") as file:
                found = json.loads(file.read())
        except (FileNotFoundError, ValueError):
            return None
        return found if isinstance(found, list) else None

    def pages(self, cursor: str, until: str | None = None, since: str | None = None, most: int | None = None) -> Iterator[tuple[list[tuple[int, dict]], str]]:
        """(items with ids, next cursor) of each answer from ``cursor`` on, up to the cursor ``until``."""
        read = 0
        while cursor != until and (most is None or read < most):
            answer = self.answer(cursor)
            items = [(i, x) for x in answer or () if (i := _id(x)) is not None]
            if not items or str(items[-1][0]) == cursor:
                return
            cursor, read = str(items[-1][0]), read + 1
            yield items, cursor
            last = _field(items[-1][1], "moment")
            if since and last and str(last) < since:
                return


class Part(InputPartition):
    def __init__(self, channel: str, start: str, end: str | None) -> None:
        self.channel, self.start, self.end = channel, start, end


class _Reader:
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.since = options["path"], options.get("since")
        self.most = int(options["pages"]) if options.get("pages") else None
        self.names = schema.fieldNames()
        self.listed = [c.strip() for c in options["channels"].split(",")] if options.get("channels") else None

    def channels(self) -> list[str]:
        if self.listed is not None:
            return sorted(set(self.listed))
        files, base = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # where there are no channels
            return
        for items, _ in Chain(self.path, partition.channel).pages(partition.start, partition.end, self.since, self.most):
            for i, item in items:
                known = {"channel": partition.channel, "id": i}
                yield tuple(known[n] if n in known else None if (v := _field(item, n)) is None else str(v) for n in self.names)


class Reader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("channel",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.listed = [c for c in self.channels() if c in wanted]
            else:
                if isinstance(f, GreaterThanOrEqual) and f.attribute == ("moment",):
                    self.since = max(filter(None, (self.since, f.value)))  # answers go back in time; the last one has older items too
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Part(c, FIRST, None) for c in self.channels()]


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the cursors of the channels: what is behind them hasn't been read."""

    def __init__(self, options: dict, schema: StructType) -> None:
        super().__init__(options, schema)
        self.at: dict[str, str] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Follows the chains from where they ended last time; after a restart once from their start, for the cursors alone."""
        for channel in self.channels():
            for _, cursor in Chain(self.path, channel).pages(self.at.get(channel, FIRST), most=self.most):
                self.at[channel] = cursor
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(c, start.get(c, FIRST), e) for c, e in sorted(end.items()) if start.get(c, FIRST) != e]


class CursorPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source, and with filters handed to sources written in Python."""
    spark.dataSource.register(CursorPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark

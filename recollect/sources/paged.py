"""Paged sources as Spark data sources: anything that lists numbered pages can be read, and followed from a cursor.

A source is a class of two functions: ``latest`` tells the number of pages there are now, ``fetch`` gives a page's items. Each page is a
partition, fetched by the task that reads it; a stream's offset is the number of pages it has read, kept in its checkpoint. A page
must not change once a later one exists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page int, place int, source_id string, content string, content_type string, timestamp string"
# Keys of a reply that may hold its items, and of an item that may hold its text (fixed values).
LISTS, TEXTS = ["conversations", "data", "messages", "results"], ["content", "text", "message"]


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Pages:
    """A folder of replies, one JSON file a page, named by its number; any file system that Arrow knows."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")

    def latest(self) -> int:
        from pyarrow import fs

        system, folder = self._folder()
        names = [f.base_name.removesuffix(".json") for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".json")]
        numbers = sorted(int(n) for n in names if n.isdigit())
        return next((i for i, n in enumerate(numbers) if n != i), len(numbers))

    def fetch(self, page: int) -> list:
        system, folder = self._folder()
        with system.open_input_stream(f"{folder}/{page}.json") as f:
            return items(json.loads(f.read()))


def items(reply) -> list[tuple[str | None, str, str, str | None]]:
    """(source_id, content, content_type, timestamp) of a reply's items that have a text: a list, or an object that holds one."""
    listed = reply if isinstance(reply, list) else next((reply[k] for k in LISTS if reply.get(k)), []) if isinstance(reply, dict) else []
    out = []
    for item in listed:
        if isinstance(item, str):
            out.append((None, item, "conversation", None))
        elif isinstance(item, dict) and (text := next((item[k] for k in TEXTS if item.get(k)), "")):
            out.append((item.get("source_id"), str(text), item.get("content_type") or "conversation", item.get("timestamp")))
    return [x for x in out if x[1]]


def _read(pages, prefix: str, page: int) -> Iterator[tuple]:
    for i, (source, content, kind, at) in enumerate(pages.fetch(page)):
        yield page, i, source or f"{prefix}:{page}:{i}", content, kind, at


def write(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (page, source_id, content, content_type) as replies, a JSON file for each page, from the tasks that hold them."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        number, held = None, []

        def out() -> int:
            system.create_dir(place, recursive=True)
            with system.open_output_stream(f"{place}/{number}.json") as f:
                f.write(json.dumps({"conversations": held}).encode())
            return len(held)

        for batch in batches:
            for row in batch.to_pylist():
                if row["page"] != number:
                    if number is not None:
                        yield pa.RecordBatch.from_pydict({"items": pa.array([out()], pa.int64())})
                    number, held = row["page"], []
                held.append({k: row[k] for k in ("source_id", "content", "content_type")})
        if number is not None:
            yield pa.RecordBatch.from_pydict({"items": pa.array([out()], pa.int64())})

    rows.select("page", "source_id", "content", "content_type").repartition("page").sortWithinPartitions("page").mapInArrow(put, "items long").agg({"items": "sum"}).collect()


class Reader(DataSourceReader):
    def __init__(self, pages, prefix: str):
        self.pages, self.prefix = pages, prefix

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.pages.latest())]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.pages, self.prefix, partition.number) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, pages, prefix: str):
        self.pages, self.prefix = pages, prefix

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.pages.latest()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(i) for i in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.pages, self.prefix, partition.number)


class Replies(DataSource):
    """``spark.read.format("replies").option("path", folder)`` and the same with ``readStream``.

    A subclass with other ``pages`` (a REST client that turns a cursor into a request, say) and ``name`` reads other systems.
    """

    pages = Pages

    @classmethod
    def name(cls) -> str:
        return "replies"

    def schema(self) -> str:
        return SCHEMA

    def _parts(self):
        return type(self).pages(dict(self.options)), self.options.get("prefix", "api")

    def reader(self, schema) -> Reader:
        return Reader(*self._parts())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._parts())

"""A paged search source: pages of results for each query, read until a short page or a limit.

Pages lie as `<path>/query=<name>/page=<n>/*.json`, n from 0, one JSON object a line, as a writer partitioned by query and
page leaves them; a page that isn't there ends its query. `spark.read.format("paged")` and `spark.readStream` give
(query, page, position, value): position counts from 1 within the query, value is the line. A query is one input
partition of a batch, so its pages are asked for in order and what stands behind its end is never opened. A stream's
offset is the number of pages seen of each query, so a stopped read goes on at the next page.

Options: path; schema by `.schema(...)` isn't taken; `size`, entries of a full page; `limit`, entries of each query (none);
`queries`, names by commas (all that lie there).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "query string, page long, position long, value string"
NULL = "__HIVE_DEFAULT_PARTITION__"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Span(InputPartition):
    """Pages from `first` up to `last` (None: to the end) of the query in `folder`."""

    folder: str
    first: int = 0
    last: int | None = None


class Pages:
    """What batch and stream share: folders of queries, pages, the stop rule."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("size", "100"))
        self.limit = int(options["limit"]) if options.get("limit") else None
        named = options.get("queries")
        self.names = {q.strip() for q in named.split(",")} if named else None
        if self.size < 1:
            raise ValueError("size: a page holds at least one entry")

    def folders(self) -> list[str]:
        files, root = opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("query="))
        return [n for n in names if self.names is None or unquote(n[6:]) in self.names]

    def count(self, folder: str) -> int:
        """Pages without a gap from page 0."""
        files, root = opened(f"{self.path}/{folder}")
        have, n = {f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))}, 0
        while f"page={n}" in have:
            n += 1
        return n

    def page(self, folder: str, n: int) -> list[str] | None:
        files, root = opened(f"{self.path}/{folder}/page={n}")
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        if not found:
            return None
        lines: list[str] = []
        for at in sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
            with files.open_input_stream(at) as data:
                lines += [x for x in data.read().decode("utf-8").split("\n") if x.strip()]
        for i, line in enumerate(lines, 1):
            if not isinstance(json.loads(line), dict):
                raise ValueError(f"{folder}/page={n}:{i} is not a JSON object")
        if len(lines) > self.size:
            raise ValueError(f"{folder}/page={n}: {len(lines)} entries, a page has at most {self.size}")
        return lines

    def read(self, span: Span) -> Iterator[tuple]:
        """Entries of the span. All pages before a page that counts are full, so places and the limit need no other page."""
        name = unquote(span.folder[6:])
        query, n = None if name == NULL else name, span.first
        if n and (before := self.page(span.folder, n - 1)) is not None and len(before) < self.size:
            return  # the query had ended before this span
        while span.last is None or n < span.last:
            at = n * self.size
            if self.limit is not None and at >= self.limit:
                return
            lines = self.page(span.folder, n)
            if lines is None:
                return
            for i, line in enumerate(lines[: None if self.limit is None else self.limit - at], 1):
                yield query, n, at + i, line
            if len(lines) < self.size:
                return
            n += 1


class Reader(Pages, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [Span(f) for f in self.folders()]

    def read(self, partition: Span | None) -> Iterator[tuple]:
        return Pages.read(self, partition) if partition else iter(())  # None where no query lies there


class StreamReader(Pages, DataSourceStreamReader):
    """Offsets are small: a number for each query."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: self.count(f) for f in self.folders()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(f, start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return Pages.read(self, partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Executors need this package installed, or shipped with `addPyFile`."""
    spark.dataSource.register(PagedSource)

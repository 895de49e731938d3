"""Pages and glyphs of documents as a data source: one partition per file, decoded by a reader that the caller names.

No library that decodes page formats is at hand, so the source reads pages of JSON lines by itself, and any other format by
a function named in the option `reader` as 'module:function', which yields the dictionaries of a file's pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "path string, page_no int, text string, title string, author string, subject string, keywords string"
GLYPHS = "path string, page_no int, line_no int, seq int, font string, ch string, size double, origin_y double, bbox_x0 double, bbox_x1 double"


def json_pages(path: str) -> Iterator[dict]:
    """The pages of a file of JSON lines: {"text", "meta": {...}, "glyphs": [[line, seq, font, ch, size, y, x0, x1], ...]}."""
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip():
                yield json.loads(line)


def _reader(name: str | None) -> Callable[[str], Iterator[dict]]:
    if not name:
        return json_pages
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PageSource(DataSource):
    """spark.read.format("pages").option("path", folder).option("kind", "glyphs" or "pages").load()

    A file that its reader cannot decode gives one row with its path and nulls, so that a corpus is never stopped by it.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return GLYPHS if self.options.get("kind") == "glyphs" else PAGES

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glyphs, self.decoder, self.glob = options["path"], options.get("kind") == "glyphs", options.get("reader"), options.get("glob", "*.jsonl")

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path)
        return [_File(str(p)) for p in ([root] if root.is_file() else sorted(root.rglob(self.glob)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 9 if self.glyphs else 6
        try:
            for no, page in enumerate(_reader(self.decoder)(partition.path)):
                if self.glyphs:
                    for g in page.get("glyphs") or []:
                        yield (partition.path, no, int(g[0]), int(g[1]), g[2], g[3], *map(float, g[4:8]))
                else:
                    meta = page.get("meta") or {}
                    yield (partition.path, no, page.get("text"), *[str(meta.get(k) or "").strip() for k in ("title", "author", "subject", "keywords")])
        except Exception:
            yield (partition.path, *[None] * n)


def map_pages(pages: DataFrame, make: Callable[[], Callable[[bytes | None], str | None]], id_col: str, image_col: str) -> DataFrame:
    """(id, text) of page images by a recogniser that `make` builds once a task; an image it fails on has null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()

        def one(x: bytes | None) -> str | None:
            try:
                return read(x)
            except Exception:
                return None

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    src = pages.selectExpr(f"cast(`{id_col}` as string) as id", f"cast(`{image_col}` as binary) as image")
    return src.mapInArrow(run, "id string, text string")

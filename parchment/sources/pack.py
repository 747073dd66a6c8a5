"""Captured packs as a Spark data source: one JSON object of named row arrays a file, read as a stream of rows."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StringType, StructType

#: Characters read at a time.
CHUNK = 1 << 16


class _Text:
    """A JSON text of any length, of which only the value at hand is kept."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk, self.decoder, self.json = stream, chunk, codecs.getincrementaldecoder("utf-8-sig")("replace"), json.JSONDecoder()
        self.text, self.at, self.ended = "", 0, False

    def more(self, size: int = 0) -> bool:
        if self.ended:
            return False
        data = self.stream.read(max(self.chunk, size))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decoder.decode(data, self.ended), 0
        return True

    def next(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while True:
            while self.at < len(self.text):
                if not self.text[self.at].isspace():
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, mark: str) -> None:
        if self.next() != mark:
            raise ValueError(f"not a captured pack: {mark!r} expected")
        self.at += 1

    def value(self) -> Any:
        """The next value, read on until it is whole."""
        self.next()
        while True:
            try:
                found, end = self.json.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more(len(self.text) - self.at)

    def items(self) -> Iterator[Any]:
        """The elements of an array, one after another."""
        self.take("[")
        while self.next() != "]":
            yield self.value()
            if self.next() == ",":
                self.at += 1
        self.at += 1


def pack_rows(stream: BinaryIO, relation: str, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of one relation of a pack; elements that aren't objects are left out, other relations are passed over."""
    text = _Text(stream, chunk)
    text.take("{")
    while text.next() != "}":
        name = text.value()
        text.take(":")
        if text.next() == "[":
            for row in text.items():
                if name == relation and isinstance(row, dict):
                    yield row
        else:
            text.value()
        if text.next() == ",":
            text.at += 1


def _as(value: Any, kind: DataType) -> Any:
    """A JSON value as one of a declared type, null where it can't be."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, IntegralType):
            return None if isinstance(value, bool) or int(value) != float(value) else int(value)
        if isinstance(kind, FractionalType):
            return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return value


class PackPartition(InputPartition):
    """One file of one relation."""


class PackReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, relation: str):
        self.schema, self.path, self.relation = schema, path, relation

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [PackPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as stream:
            for row in pack_rows(stream, self.relation):
                yield tuple(_as(row.get(f.name), f.dataType) for f in self.schema.fields)


class PackSource(DataSource):
    """``spark.read.format("captured_pack").schema(...).option("relation", name).load(uri)``."""

    @classmethod
    def name(cls) -> str:
        return "captured_pack"

    def schema(self) -> str:
        raise ValueError("a captured pack has no schema of its own: declare one")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackReader(schema, self.options["path"], self.options["relation"])


def scan_pack(spark: SparkSession, path: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """A2. Captured packs, one JSON object of named row arrays a file; an absent name is an empty relation of its schema.

    ``path``: a file or folder, as an address (file:, s3:, hdfs:, gs:) or a local path.  Each file is a task for each
    relation and is read as a stream, so neither a relation nor a file need fit in memory; only one row must.
    """
    spark.dataSource.register(PackSource)
    uri = path if ":/" in path else f"file://{path}"
    return {n: spark.read.format("captured_pack").schema(s).option("relation", n).load(uri) for n, s in schemas.items()}

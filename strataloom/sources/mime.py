"""The text parts of web archives (MHTML) as a Spark data source: a row for each part, read part by part.

    register(spark)
    spark.read.format("mime_parts").load(folder)

Files are dealt out over partitions by size. A file is read line by line up to its bounds, so one with a thousand images
costs no more memory than its longest text part; a filter on content_type is applied before anything is decoded."""

from __future__ import annotations

import base64
import binascii
import itertools
import quopri
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# Parts of an archive and bytes of its decoded texts at most.
MAX_PARTS, MAX_DECODED = 128, 50 * 1024 * 1024
#: Bytes of files that make up one partition.
PARTITION_BYTES = 64 << 20
SCHEMA = "path string, part int, content_type string, text string, error_code string"
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^;\s]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*(?:"([^"]+)"|([^;\s]+))', re.I)


def _parameter(pattern: re.Pattern, value: str) -> str:
    found = pattern.search(value)
    return (found[1] or found[2]) if found else ""


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    """Header fields up to the blank line; a folded field goes on in lines that begin with white space."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("latin-1").rstrip("\r\n")
        if not text.strip():
            break
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _decoded(body: bytes, encoding: str) -> bytes:
    if encoding == "base64":
        clean = re.sub(rb"[^A-Za-z0-9+/]", b"", body)
        try:
            return base64.b64decode(clean + b"=" * (-len(clean) % 4))
        except binascii.Error:
            return base64.b64decode(clean[: len(clean) // 4 * 4])
    return quopri.decodestring(body) if encoding == "quoted-printable" else body


def parts(lines: Iterator[bytes], wanted: str | None = None) -> Iterator[tuple[int, str, str]]:
    """(number, content type, text) of the text parts of an archive given by its lines; ValueError beyond the limits or without a boundary.

    ``wanted``: the only content type that is asked for; other parts are skipped undecoded, but counted."""
    top = _headers(lines)
    boundary = _parameter(_BOUNDARY, top.get("content-type", ""))
    if not boundary:
        raise ValueError("no boundary")
    mark, end = b"--" + boundary.encode("latin-1"), b"--" + boundary.encode("latin-1") + b"--"
    total, number, closed = 0, 0, False
    at_mark = lambda line: line.rstrip() in (mark, end) and line.startswith(b"--")
    for line in lines:
        if line.rstrip() == mark:
            break
    else:
        return
    while not closed:
        def until_mark() -> Iterator[bytes]:
            nonlocal closed
            for line in lines:
                if at_mark(line):
                    closed = line.rstrip() == end
                    return
                yield line
            closed = True

        inner = until_mark()
        seen = [line for line in [next((x for x in inner if x.strip()), None)] if line is not None]
        if not seen:
            continue
        head = _headers(itertools.chain(seen, inner))
        if number >= MAX_PARTS:
            raise ValueError("too many parts")
        number += 1
        kind = head.get("content-type", "text/plain")
        base = kind.split(";")[0].strip().lower()
        if not base.startswith(("text/html", "text/plain")) or (wanted and base != wanted):
            for _ in inner:
                pass
            continue
        body, size = [], 0
        for line in inner:
            size += len(line)
            if size > 2 * MAX_DECODED:
                raise ValueError("text too large")
            body.append(line)
        raw = _decoded(b"".join(body), head.get("content-transfer-encoding", "").strip().lower())
        total += len(raw)
        if total > MAX_DECODED:
            raise ValueError("text too large")
        try:
            text = raw.decode(_parameter(_CHARSET, kind) or "utf-8", "replace")
        except LookupError:
            text = raw.decode("utf-8", "replace")
        yield number - 1, base, text


@dataclass
class _Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted, self.only = path, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("content_type",) and isinstance(f.value, str):
                self.wanted = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                self.only = f.value
            yield f  # Spark applies all of them again

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        out: list[_Files] = []
        size = PARTITION_BYTES
        for info in sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path):
            if self.only is not None and info.path != self.only:
                continue
            if size >= PARTITION_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for path in partition.paths if partition is not None else []:
            try:
                with system.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for number, kind, text in parts(_lines(stream), self.wanted):
                        yield path, number, kind, text, None
            except ValueError:
                yield path, None, None, None, "DOCUMENT_PARSE_FAILED"


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 16):
        lines = (rest + block).splitlines(keepends=True)
        rest = lines.pop() if lines and not lines[-1].endswith((b"\n", b"\r")) else b""
        yield from lines
    if rest:
        yield rest


class MimeParts(DataSource):
    """``mime_parts``: path, part (from 0), content_type, text, and error_code for archives that cannot be read or exceed the limits."""

    @classmethod
    def name(cls) -> str:
        return "mime_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``mime_parts`` known to a session, filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MimeParts)

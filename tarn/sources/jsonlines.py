"""JSON lines as a data source: byte ranges of files, each line decoded strictly where it is read, with its file and place.

spark.read.format("tarn_jsonl") gives (value, path, offset, line): the text of each line that is an object, its file, the byte at which it begins, and its number in
the part of the file that was read together (the file's own number where the file is one part). Lines in order of (path, offset) are the log in its
order. Options: path (a file, a folder, a comma-separated list, globs of the last name), mode (strict: a line that isn't an object fails the read and
is named by path:line; tolerant: it is dropped; marked: it comes with an error), part_bytes, head (no more records of a part than so many are read). path may be a JSON array of paths, too. readStream gives what was appended since, by
file and offset; a line without its end waits for it.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, offset long, line long, error string"
PART = 64 << 20
_BUFFER = 4 << 20


def file_system(path: str):
    """(pyarrow's file system, the path there, what stands before it in a name)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    files, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return files, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def listed(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(name, bytes) of the files that the paths mean, by name; names that begin with _ or . aren't data."""
    from pyarrow import fs

    out = {}
    for path in paths:
        files, inner, before = file_system(path)
        folder, _, name = inner.rstrip("/").rpartition("/")
        if any(c in name for c in "*?["):
            found = [f for f in files.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True)) if fnmatch.fnmatch(f.base_name, name)]
        else:
            found = [files.get_file_info(inner)]
            if found[0].type == fs.FileType.Directory:
                found = files.get_file_info(fs.FileSelector(inner, recursive=True))
            elif found[0].type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
        out |= {before + f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."}
    return sorted(out.items())


def lines(path: str, start: int, stop: int | None, ended: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(offset, number, line) of the lines that begin in [start, stop); a line that begins before start is another part's. ended: the last line
    counts only if it has its end."""
    files, inner, _ = file_system(path)
    with files.open_input_file(inner) as f:
        at = start
        if start:  # unless a line ends just before start, the rest of one is skipped
            f.seek(start - 1)
            at = start - 1
        rest, number, skipping = [], 0, start > 0
        while True:
            chunk = f.read(_BUFFER)
            if not chunk:
                last = b"".join(rest)
                if last and not skipping and not ended and (stop is None or at < stop):
                    yield at, number + 1, last
                return
            rest.append(chunk)
            if b"\n" not in chunk:
                continue
            *whole, last = b"".join(rest).split(b"\n")
            rest = [last]
            for line in whole:
                if skipping:
                    skipping = False
                else:
                    if stop is not None and at >= stop:
                        return
                    number += 1
                    yield at, number, line
                at += len(line) + 1
            if stop is not None and at >= stop:
                return


def decoded(line: bytes) -> tuple[str | None, str | None]:
    """(the text of an object, what is wrong with it): both None for a blank line."""
    text = line.decode("utf-8", "replace").strip()
    if not text:
        return None, None
    try:
        value = json.loads(text)
    except ValueError as e:
        return text, f"invalid JSON: {e}"
    except RecursionError:
        return text, "invalid JSON: nested too deeply"
    return text, None if isinstance(value, dict) else f"expected an object, found {type(value).__name__}"


def _paths(option: str) -> list[str]:
    return json.loads(option) if option.startswith("[") else [p for p in option.split(",") if p]


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, ended: bool = False):
        self.path, self.start, self.stop, self.ended = path, start, stop, ended


def records(part: Part, mode: str) -> Iterator[tuple]:
    for offset, number, line in lines(part.path, part.start, part.stop, part.ended):
        text, error = decoded(line)
        if text is None or error and mode == "tolerant":
            continue
        if error and mode == "strict":
            before = sum(1 for _ in lines(part.path, 0, part.start)) if part.start else 0
            raise ValueError(f"{part.path}:{before + number}: not a JSON object: {error}: {text[:100]}")
        yield text, part.path, offset, number, error


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarn_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = _paths(options["path"])
        self.mode, self.size, self.head = options.get("mode", "strict"), int(options.get("part_bytes", PART)), int(options.get("head", 0))

    def partitions(self) -> list[Part]:
        parts = [Part(p, at, min(at + self.size, n)) for p, n in listed(self.paths) for at in range(0, n, self.size)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        found = records(partition, self.mode) if partition.path else iter(())
        return islice(found, self.head) if self.head else found


class _StreamReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file."""

    def __init__(self, options):
        self.paths = _paths(options["path"])
        self.mode, self.size = options.get("mode", "tolerant"), int(options.get("part_bytes", PART))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """As far as the last line that has its end."""
        out = {}
        for path, size in listed(self.paths):
            files, inner, _ = file_system(path)
            with files.open_input_file(inner) as f:
                end = size
                while end:
                    start = max(0, end - _BUFFER)
                    f.seek(start)
                    last = f.read(end - start).rfind(b"\n")
                    if last >= 0:
                        out[path] = start + last + 1
                        break
                    end = start
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        was = start["files"]
        return [Part(p, at, min(at + self.size, n), True) for p, n in sorted(end["files"].items()) for at in range(was.get(p, 0), n, self.size)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return records(partition, self.mode)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)

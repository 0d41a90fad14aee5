"""Wordlists as a Spark data source: spark.read.format("wordlist") and df.write.format("wordlist").

    from lexispark.sources.datasource import WordlistSource
    spark.dataSource.register(WordlistSource)
    words = spark.read.format("wordlist").option("path", "words.tsv").load()

Files are tab-separated with a header and without quoting. Columns are typed by their lower-case names as in sources.wordlists.
Paths go through pyarrow.fs, so anything it reaches can be read where its URI is given (file, hdfs, s3, gs); a plain path is a
file that all machines share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexispark.sources.wordlists import ID_COLUMNS, NUMBER_COLUMNS, SOUND_COLUMNS

#: Bytes of a file that one task reads, unless the option part says otherwise.
PART = 32 << 20
BROKEN = "broken"


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at a path: itself, or those in a folder that aren't hidden."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


def _header(path: str) -> list[str]:
    files = _files(path)
    if not files:
        raise FileNotFoundError(f"no files in {path}")
    with _open(path)[0].open_input_file(files[0][0]) as f:
        for line in _lines(f, 0, files[0][1]):
            if not line.startswith("#"):
                return line.split("\t")
    raise ValueError(f"{files[0][0]} has no header")


def _lines(file, start: int, end: int) -> Iterator[str]:
    """The lines of a file that begin in a range of bytes; one that begins before it belongs to the range before."""
    file.seek(max(start - 1, 0))
    held, at = b"", max(start - 1, 0)
    skip = start > 0
    while True:
        read = file.read(1 << 20)
        held += read
        *whole, held = held.split(b"\n")
        if not read and held:
            whole, held = [*whole, held], b""
        for line in whole:
            begin, at = at, at + len(line) + 1
            if skip:
                skip = False  # the rest of a line that began earlier, or nothing but its end
                continue
            if begin >= end:
                return
            if line.strip(b"\r"):
                yield line.decode("utf-8").rstrip("\r")
        if not read or at >= end and not skip:
            return


def _kind(name: str) -> T.DataType:
    if name in SOUND_COLUMNS:
        return T.ArrayType(T.StringType())
    if name in ID_COLUMNS:
        return T.ArrayType(T.LongType())
    return T.LongType() if name in NUMBER_COLUMNS else T.StringType()


def _value(cell: str, kind: T.DataType):
    cell = cell.strip()
    if not cell:
        return None
    if isinstance(kind, T.ArrayType):
        return [int(x) if isinstance(kind.elementType, T.LongType) else x for x in cell.split()]
    return int(cell) if isinstance(kind, T.LongType) else cell


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, mode: str, part: int) -> None:
        self.path, self.fields, self.mode, self.part = path, [(f.name, f.dataType) for f in schema.fields], mode, part

    def partitions(self) -> list[Range]:
        return [Range(p, low, min(low + self.part, size)) for p, size in _files(self.path) for low in range(0, size, self.part)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        system = _open(self.path)[0]
        with system.open_input_file(partition.path) as f:
            size = f.size()
            first = next((line for line in _lines(f, 0, size) if not line.startswith("#")), "")
            names = [n.strip().lower() for n in first.split("\t")]
            headed = partition.start == 0
            for line in _lines(f, partition.start, partition.end):
                if line.startswith("#"):
                    continue
                if headed:  # the header of this file
                    headed = False
                    continue
                cells, why = dict(zip(names, line.split("\t"))), None
                try:
                    if line.count("\t") + 1 != len(names):
                        raise ValueError(f"{line.count(chr(9)) + 1} cells under {len(names)} names")
                    row = tuple(_value(cells.get(n, ""), k) for n, k in self.fields if n != BROKEN)
                except ValueError as e:
                    if self.mode == "failfast":
                        raise ValueError(f"{partition.path}: {line!r}: {e}") from e
                    if self.mode == "dropmalformed":
                        continue
                    row, why = tuple(None for n, _ in self.fields if n != BROKEN), f"{e}: {line}"
                yield (*row, why) if self.fields[-1][0] == BROKEN else row


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """Parts are written aside and moved into the folder when all are there; a part that is written again replaces nothing."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.run = path.rstrip("/"), [f.name for f in schema.fields], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, inner = _open(self.path)
        aside = f"{inner}/_written-{self.run}"
        system.create_dir(aside, recursive=True)
        path = f"{aside}/{uuid.uuid4().hex}.tsv"
        text = lambda x: "" if x is None else " ".join(map(str, x)) if isinstance(x, (list, tuple)) else json.dumps(x) if isinstance(x, dict) else str(x)
        with system.open_output_stream(path) as out:
            out.write(("\t".join(n.upper() for n in self.names) + "\n").encode())
            for row in rows:
                out.write(("\t".join(text(x).replace("\t", " ").replace("\n", " ") for x in row) + "\n").encode())
        return Written(path)

    def commit(self, messages: list) -> None:
        system, inner = _open(self.path)
        old = [p for p, _ in _files(self.path)] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            system.move(m.path, f"{inner}/part-{self.run}-{k:05d}.tsv")
        for p in old:
            system.delete_file(p)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = _open(self.path)
        if system.get_file_info(f"{inner}/_written-{self.run}").is_file is False:
            try:
                system.delete_dir(f"{inner}/_written-{self.run}")
            except FileNotFoundError:
                pass


class WordlistSource(DataSource):
    """Options: path; part, the bytes a task reads; mode: permissive (a row with too few or too many cells, or a word where a number
    should be, is null but for the column broken, which says why), dropmalformed, or failfast."""

    @classmethod
    def name(cls) -> str:
        return "wordlist"

    def schema(self) -> T.StructType:
        names = [n.strip().lower() for n in _header(self.options["path"])]
        fields = [T.StructField(n, _kind(n)) for n in names]
        return T.StructType([*fields, T.StructField(BROKEN, T.StringType())] if self._mode() == "permissive" else fields)

    def _mode(self) -> str:
        mode = self.options.get("mode", "permissive").lower()
        if mode not in ("permissive", "dropmalformed", "failfast"):
            raise ValueError("mode must be permissive, dropmalformed or failfast")
        return mode

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, self._mode(), int(self.options.get("part", PART)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)

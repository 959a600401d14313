"""FASTQ as a Python data source: files are cut into ranges that find their first record."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, at long, id string, header string, sequence string, scores string, _corrupt string"
_OPENERS = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def first_record(lines: list[bytes]) -> int | None:
    """Number of the first line that begins a record, or None: a title, three lines before the next one, a plus line between.

    A quality line may begin with @ or +, so one line does not tell; its length must equal the sequence's.
    """
    for i in range(min(4, len(lines))):
        if lines[i].startswith(b"@") and i + 3 < len(lines) and lines[i + 2].startswith(b"+") and len(lines[i + 1]) == len(lines[i + 3]):
            return i
    return None


def four_lines(title: bytes, sequence: bytes, plus: bytes, scores: bytes) -> tuple:
    text = [x.decode("utf-8", "replace") for x in (title, sequence, plus, scores)]
    fine = text[0].startswith("@") and text[2].startswith("+") and len(sequence) == len(scores)
    name, _, header = text[0][1:].partition(" ")
    return name, header if " " in text[0] else None, text[1], text[3], None if fine else "\n".join(text)


class FastqReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _files(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.Directory:
            return store, sorted((i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file), key=lambda i: i.path)
        return store, [info]

    def partitions(self):
        out = []
        for info in self._files()[1]:
            if info.path.rsplit(".", 1)[-1] in _OPENERS:
                out.append(Range(info.path, 0, None))
            else:
                out += [Range(info.path, at, min(at + self.size, info.size)) for at in range(0, max(1, info.size), self.size)]
        return out

    def read(self, partition):
        store, _ = self._files()
        with store.open_input_file(partition.path) as raw:
            kind = partition.path.rsplit(".", 1)[-1]
            stream = _OPENERS[kind](raw, "rb") if kind in _OPENERS else io.BufferedReader(raw, 1 << 20)
            at = partition.start
            if at:
                stream.seek(at - 1)
                at += len(stream.readline()) - 1
            held: list[tuple[int, bytes]] = []

            def line() -> bool:
                nonlocal at
                data = stream.readline()
                if data:
                    held.append((at, data.rstrip(b"\r\n")))
                    at += len(data)
                return bool(data)

            if partition.start:
                begin = None
                while begin is None:
                    while len(held) < 8 and line():
                        pass
                    begin = first_record([x for _, x in held])
                    if begin is None and len(held) < 8:
                        return  # what is left belongs to a record of the range before
                    del held[: 4 if begin is None else begin]
            while True:
                while len(held) < 4 and line():
                    pass
                while held and not held[0][1] and len(held) < 4:
                    held.pop(0)
                if not held or (partition.end is not None and held[0][0] >= partition.end):
                    return
                part = held[:4] + [(at, b"")] * (4 - len(held[:4]))
                yield (partition.path, part[0][0], *four_lines(*[x for _, x in part]))
                del held[:4]


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(file, at, id, header, sequence, scores, _corrupt); ``at`` orders the records of a file."""
    from strandline.session import ship_package

    ship_package(spark)
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", split_bytes).load(path)

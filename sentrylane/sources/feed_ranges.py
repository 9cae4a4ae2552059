"""Vulnerability feeds read by byte ranges: one feed file of any size is many tasks.

A feed is one JSON document, usually on one line, so neither lines nor documents split it.
Its records do: each is the object under a key ``cve``. From any byte on, the next
``"cve": {`` whose first quote has no backslash before it begins a record, as quotes within
strings are escaped. A record belongs to the range that its key begins in, wherever it ends.
"""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sentrylane import schemas

#: Bytes of a range, unless the option ``rangeBytes`` names another number.
RANGE = 64 << 20
#: Bytes of a read.
BLOCK = 1 << 20

_KEY = re.compile(rb'(?<!\\)"cve"\s*:\s*(?=\{)')
#: A key whose rest may follow in the next block.
_KEY_CUT = re.compile(rb'"cve"\s*:?\s*\Z')
#: Strings and braces; a lone quote is a string whose end has not been read yet.
_PART = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["{}]', re.S)


def records(read: Callable[[int], bytes], start: int, end: int | None, block: int = BLOCK) -> Iterator[bytes]:
    """Records whose key begins in ``start <= offset < end``, from the key's object on.

    ``read`` gives the next bytes and begins one byte before ``start`` (at 0 if that is 0).
    A record that the file cuts off is given as far as it goes.
    """
    base = max(start - 1, 0)
    text = read(block)
    at = start - base
    while True:
        key = _KEY.search(text, at)
        if key is None:
            # Keep what may be the beginning of a key, and the byte before it.
            cut = text.rfind(b'"cve"', at)
            keep = cut if cut >= 0 and _KEY_CUT.match(text, cut) else max(at, len(text) - 4)
            if end is not None and base + keep >= end:
                return
            more = read(block)
            if not more:
                return
            drop = max(keep - 1, 0)
            base, at, text = base + drop, keep - drop, text[drop:] + more
            continue
        if end is not None and base + key.start() >= end:
            return
        # Only the record's own text is held, read in steps that grow with it.
        base, text = base + key.end(), text[key.end():]
        depth = at = 0
        closed = False
        while not closed:
            for part in _PART.finditer(text, at):
                token = part.group()
                if token == b'"':
                    at = part.start()
                    break
                at = part.end()
                depth += (token == b"{") - (token == b"}")
                if depth == 0:
                    closed = True
                    break
            if not closed:
                more = read(max(block, len(text)))
                if not more:
                    yield text
                    return
                text += more
        yield text[:at]


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files below ``path``, a URI or a local path; names of hidden files are left out."""
    system, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    (info,) = system.get_file_info([root])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangeBytes", RANGE))
        self.block = int(options.get("blockBytes", BLOCK))

    def partitions(self):
        """A range each; a compressed file has no ranges and is one."""
        ranges = []
        for f in _files(self.path)[1]:
            if f.extension == "gz":
                ranges.append((f.path, 0, None))
            else:
                ranges += [(f.path, at, min(at + self.range, f.size)) for at in range(0, f.size, self.range)]
        # Without any file there is still one, empty, range to read.
        return [InputPartition(r) for r in ranges] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        path, start, end = partition.value
        system = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
        with system.open_input_stream(path) if end is None else system.open_input_file(path) as file:
            if end is not None:
                file.seek(max(start - 1, 0))
            batch, size = [], 0
            for record in records(file.read, start, end, self.block):
                batch.append(record.decode("utf-8", "replace"))
                size += len(record)
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["record"])
                    batch, size = [], 0
            if batch:
                yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["record"])


class FeedRanges(DataSource):
    @classmethod
    def name(cls):
        return "cve_feed"

    def schema(self):
        return "record string"

    def reader(self, schema):
        return FeedReader(self.options)


def read_nvd_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """One row per ``cve`` object of the feed files under ``path``, as ``read_nvd`` gives them.

    The files are cut into ranges of ``range_bytes``, a task each; records at their ends are
    read once, by the range that they begin in. Records are parsed by Spark; one that is no
    JSON, or that its file cuts off, gives no row and costs no other record.
    """
    spark.dataSource.register(FeedRanges)
    rows = spark.read.format("cve_feed").option("rangeBytes", range_bytes).load(path)
    cve = F.from_json("record", schemas.NVD_CVE, {"mode": "PERMISSIVE"})
    return rows.select(cve.alias("cve")).filter("cve IS NOT NULL")

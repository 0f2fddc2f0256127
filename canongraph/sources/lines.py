"""A Spark data source for the lines of GFA files by ranges of bytes, each with the byte it starts at.

    spark.dataSource.register(GfaLines)
    spark.read.format("gfa_lines").option("blockSize", 1 << 24).load("folder or file or pattern")

A row is (graph_id, offset, value): the file's path, the line's first byte, its bytes without the line feed. A line belongs to
the range in which it starts, so ranges are read apart, in any order and again after a failure, and lines need no numbers: offsets
order them, and a line's number is only worked out where a message asks for it (gfa.line_numbers). Lines end at a line feed
alone; a last line without one counts, an empty rest does not. A line may be longer than many ranges (2 GB at most).

Files are opened by Arrow's file systems: local paths, file:, hdfs:, s3: and gs: where Arrow has them. Other paths that only
Spark knows are read by gfa.read_lines().
"""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and bytes that are read at once.
BLOCK, PIECE = 16 << 20, 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Files of a path, folder or pattern (patterns: local only) and their sizes; hidden ones are left out."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        found = sorted(glob.glob(path)) or [path]
    else:
        found = [path]
    out = []
    for one in found:
        system, inner = _system(one)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        head = one[: len(one) - len(inner)] if one.endswith(inner) else ""
        inside = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
        out += [(head + x.path, x.size) for x in inside if x.type == fs.FileType.File and not os.path.basename(x.path).startswith(("_", "."))]
    return sorted(out)


def lines_of(stream, start: int, stop: int, piece: int = PIECE):
    """Pieces of (offsets, ends, bytes) of the lines that start from ``start`` up to before ``stop`` in a seekable stream."""
    stream.seek(max(start - 1, 0))
    at, rest, fresh = max(start - 1, 0), bytearray(), start > 0  # fresh: the line under way began before the range
    while True:
        data = stream.read(piece)
        last = data.rfind(b"\n")
        if data and last < 0:
            rest += data
            continue
        if not data and (fresh or not rest):
            return
        block = bytes(rest) + (data[: last + 1] if data else b"\n")  # a last line may have no line feed
        rest = bytearray(data[last + 1 :])
        raw = np.frombuffer(block, np.uint8)
        feeds = np.flatnonzero(raw == 10)
        begin = np.r_[0, feeds[:-1] + 1]
        first, fresh = int(fresh), False
        keep = np.flatnonzero(begin[first:] + at < stop) + first
        if len(keep):
            a, b = begin[keep[0]], feeds[keep[-1]] + 1
            yield at + begin[keep], feeds[keep] - a - np.arange(len(keep)), raw[a:b][raw[a:b] != 10]
        at += len(block)
        if not data or at >= stop:
            return


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self):
        return [Range(p, a, min(a + self.block, size)) for p, size in files(self.path) for a in range(0, size, self.block)] or [Range("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        system, inner = _system(part.path)
        with system.open_input_file(inner) as stream:
            for offsets, ends, data in lines_of(stream, part.start, part.stop):
                if len(data) >= 1 << 31:
                    raise ValueError(f"a line of {part.path} is longer than 2 GB")
                edges = np.r_[0, ends].astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(ends)), pa.array(offsets.astype(np.int64)), values], names=["graph_id", "offset", "value"])


class GfaLines(DataSource):
    @classmethod
    def name(cls):
        return "gfa_lines"

    def schema(self):
        return "graph_id string, offset long, value binary"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("blockSize", BLOCK)))

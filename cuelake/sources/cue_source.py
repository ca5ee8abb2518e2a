"""Cue files as a data source, spark.read.format("cuefiles"), for batches and streams.

A row is a file: path, name, modified, bytes, content and error. Files are packed into partitions by their bytes, so
many small files make few tasks; a file that can't be read is a row with an error and doesn't fail the job. The stream's
offset is the newest (modified, path) that was read, so a file moved in with an older time than that isn't seen. Options:
pattern (of names, "*.srt"), splitBytes. Both kinds read the same rows, which to_cues() parses.

With the option shares the driver lists nothing, however many files there are: each of so many tasks lists the folder's top and
walks the entries that are its own by their names' hash. The stream's offset is then the driver's time, which has to agree with
the store's. Without content (content=false) files are only listed.
"""

from __future__ import annotations

import fnmatch
import re
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cuelake.sources.cues import to_cues

SPLIT_BYTES = 64 << 20
#: Bytes and rows of files that a share hands on at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096


class _Part(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(files)


class _Share(InputPartition):
    """A share of the folder, and the times (in ns) after and up to which files count; None for no limit."""

    def __init__(self, share: int, after: int | None = None, upto: int | None = None):
        super().__init__((share, after, upto))


def matches(pattern: str):
    """Whether a name fits a pattern with * ? [] and alternatives in braces."""
    patterns, whole = [pattern], []
    while patterns:
        p = patterns.pop()
        if m := re.search(r"\{([^{}]*)\}", p):
            patterns += [p[: m.start()] + x + p[m.end() :] for x in m[1].split(",")]
        else:
            whole.append(re.compile(fnmatch.translate(p)).match)
    return lambda name: any(x(name) for x in whole)


def walked(folder: str, share: int = 0, shares: int = 1, pattern: str = "*") -> Iterator:
    """The files of a share of a folder, in the store's terms, one directory at a time; hidden and unfinished ones don't count."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    fits, at = matches(pattern), [root]
    while at:
        where = at.pop()
        for x in store.get_file_info(fs.FileSelector(where, allow_not_found=True)):
            if x.base_name[:1] == "." or (x.base_name[:1] == "_" and "=" not in x.base_name):
                continue
            if where == root and zlib.crc32(x.base_name.encode()) % shares != share:
                continue
            if x.type == fs.FileType.Directory:
                at.append(x.path)
            elif fits(x.base_name):
                yield x


class _Files:
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.shares = int(options.get("shares", 0))
        self.content = str(options.get("content", "true")).lower() != "false"

    def listed(self) -> list[tuple[int, str, int]]:
        """(modified in ns, path, bytes) of the folder's files, oldest first; hidden and unfinished ones aren't listed."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = (x for x in found if x.type != fs.FileType.Directory and fnmatch.fnmatch(x.base_name, self.pattern))
        shown = (x for x in names if not any(part[:1] in "._" for part in x.path[len(root) :].split("/") if part))
        return sorted((x.mtime_ns or 0, x.path, max(x.size or 0, 0)) for x in shown)

    def packed(self, files: list[tuple[int, str, int]]) -> list[_Part]:
        parts: list[list] = []
        held = self.split
        for f in files:
            if held + f[2] > self.split:
                parts.append([])
                held = 0
            parts[-1].append(f)
            held += f[2]
        return [_Part(p) for p in parts]

    def rows(self, part: InputPartition) -> Iterator[tuple]:
        if isinstance(part, _Share):
            yield from self.batches(part)
        else:
            yield from self.read_each(part.value)

    def read_each(self, files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        for modified, path, size in files:
            content, error = None, None
            try:
                if self.content:
                    with store.open_input_stream(path) as f:
                        content = f.read()
            except OSError as e:
                error = f"{type(e).__name__}: {str(e)[:200]}"
            yield path, path.rsplit("/", 1)[-1], datetime.fromtimestamp(modified // 1000 / 1e6, timezone.utc), size, content, error

    def batches(self, part: _Share) -> Iterator[pa.RecordBatch]:
        """The share's rows, few bytes at a time."""
        share, after, upto = part.value
        found = ((x.mtime_ns or 0, x.path, max(x.size or 0, 0)) for x in walked(self.folder, share, self.shares, self.pattern))
        one = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ARROW.types)], schema=ARROW)
        held, size = [], 0
        for row in self.read_each(x for x in found if (after is None or x[0] > after) and (upto is None or x[0] <= upto)):
            held.append(row)
            size += len(row[4] or b"")
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield one(held)
                held, size = [], 0
        yield one(held)


#: The rows of a share.
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if self.shares:
            return [_Share(k) for k in range(self.shares)]
        return self.packed(self.listed()) or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition)


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        if self.shares:
            return {"modified": time.time_ns(), "path": ""}
        files = self.listed()
        return {"modified": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = ((x["modified"], x["path"]) for x in (start, end))
        if self.shares:
            return [_Share(k, after[0], upto[0]) for k in range(self.shares)]
        return self.packed([f for f in self.listed() if after < (f[0], f[1]) <= upto])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition)


class CueFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cuefiles"

    def schema(self) -> str:
        return "path string, name string, modified timestamp, bytes long, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def shares_of(spark: SparkSession) -> int:
    """How many shares keep the executors busy; less than a folder that is spread has entries."""
    return min(4 * spark.sparkContext.defaultParallelism, 512)


def cue_files(spark: SparkSession, folder: str, stream: bool = False, **options) -> DataFrame:
    """The files of a folder, as a batch or a stream."""
    spark.dataSource.register(CueFiles)
    return (spark.readStream if stream else spark.read).format("cuefiles").options(**options).load(folder)


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues of a batch of files, file_id being the path, and the rejects (file_id, line, warning), unreadable files among them."""
    rows = files.select(F.col("path").alias("file_id"), "name", "content", "error")
    cues, warnings = to_cues(rows.filter("error is null").drop("error"))
    return cues, warnings.unionByName(rows.filter("error is not null").select("file_id", F.lit(None).cast("int").alias("line"), F.col("error").alias("warning")))

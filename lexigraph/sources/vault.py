"""A folder of markdown files as a data source: ``spark.read.format("vault")``.

Reading is split by folders: the driver lists folders until there are SPLITS of them,
and each task lists and reads its own. The files beside those folders are dealt by name,
or beyond HELD of them by a checksum of their names: tasks list them for themselves, and
no list of files is held (by stores other than folders one folder's is, in a task). Filters on path (equal, one of, begins with)
skip folders and files; others Spark applies itself.
As a stream the source gives files as they are written or changed, by their times.

Writing takes (path, contents); a row without contents removes its file. A task
writes to a folder of its attempt, and there a list of what it did; when all tasks are
done these lists are read in pieces and files moved into place, and if the job fails
none is. A file is there whole or not at all.

Paths and URIs are pyarrow's (local and shared folders, and the stores it knows), as
workers read them without Spark. Call ``register(spark)`` first.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from ..errors import BadRequest
from .files import IGNORED

SCHEMA = "path string, contents string, modified timestamp"
SPLITS, FILES, MOVERS, HELD = 64, 500, 16, 20_000
MARKDOWN = re.compile(r"\.(md|markdown)$", re.I)
STAGING = ".vault-"


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand filters down, which a source
    that takes any must have."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def _open(uri: str) -> tuple[afs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return afs.FileSystem.from_uri(uri)
    return afs.LocalFileSystem(), uri


def _hidden(path: str) -> bool:
    return any(p in IGNORED or p.startswith(STAGING) for p in path.split("/"))


@dataclass
class Part(InputPartition):
    """A folder to list with all below it, files to read, or a share (which, of how
    many) of the files that lie in a folder itself."""

    folder: str | None = None
    files: tuple[str, ...] = ()
    share: tuple[int, int] | None = None


class Wanted:
    """What filters say of paths: only these, all beginning so."""

    def __init__(self) -> None:
        self.only: set[str] | None = None
        self.prefix: list[str] = []

    def take(self, f: Filter) -> bool:
        if getattr(f, "attribute", None) != ("path",):
            return False
        if isinstance(f, StringStartsWith):
            self.prefix.append(f.value)
            return True
        if not isinstance(f, (EqualTo, In)):
            return False
        values = set(f.value) if isinstance(f, In) else {f.value}
        self.only = values if self.only is None else self.only & values
        return True

    def file(self, path: str) -> bool:
        return (self.only is None or path in self.only) and all(path.startswith(p) for p in self.prefix)

    def folder(self, path: str) -> bool:
        """Whether a file below a folder may be wanted."""
        inside = lambda p: p.startswith(path + "/")
        return (self.only is None or any(map(inside, self.only))) and all(inside(p) or (path + "/").startswith(p) for p in self.prefix)


class _Reading:
    def __init__(self, options: dict):
        self.uri = options.get("path")
        if not self.uri:
            raise BadRequest("a vault has a path")
        self.wanted = Wanted()

    def _list(self, folder: str, recursive: bool) -> Iterator[tuple[str, afs.FileInfo]]:
        fs, root = _open(self.uri)
        at = posixpath.join(root, folder) if folder else root
        for info in fs.get_file_info(afs.FileSelector(at, recursive=recursive, allow_not_found=True)):
            path = posixpath.relpath(info.path, root)
            if not _hidden(path):
                yield path, info

    def _walk(self, folder: str, recursive: bool) -> Iterator[tuple[str, bool]]:
        """Paths in a folder, and whether they are folders; without a list of all."""
        fs, root = _open(self.uri)
        if not isinstance(fs, afs.LocalFileSystem):
            yield from ((p, i.type == afs.FileType.Directory) for p, i in self._list(folder, recursive))
            return
        left = [folder]
        while left:
            at = left.pop()
            try:
                entries = os.scandir(posixpath.join(root, at) if at else root)
            except FileNotFoundError:
                continue
            with entries:
                for e in entries:
                    path = posixpath.join(at, e.name)
                    if not _hidden(path) and (e.is_dir() or e.is_file()):
                        yield path, e.is_dir()
                        if recursive and e.is_dir():
                            left.append(path)

    def _names(self, part: Part) -> Iterator[str]:
        if part.folder is None:
            yield from part.files
            return
        which, of = part.share or (0, 1)
        for path, is_folder in self._walk(part.folder, part.share is None):
            if not is_folder and MARKDOWN.search(path) and self.wanted.file(path) and zlib.crc32(path.encode("utf-8", "surrogateescape")) % of == which:
                yield path

    def _matching(self, folder: str) -> list[tuple[str, afs.FileInfo]]:
        return [(p, i) for p, i in self._list(folder, True) if i.type == afs.FileType.File and MARKDOWN.search(p) and self.wanted.file(p)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.uri)
        names = self._names(part)
        while some := list(islice(names, FILES)):
            infos = fs.get_file_info([posixpath.join(root, n) for n in some])
            there = [(n, i) for n, i in zip(some, infos, strict=True) if i.type == afs.FileType.File]
            texts = []
            for _, info in there:
                with fs.open_input_stream(info.path) as f:
                    texts.append(f.read().decode("utf-8", errors="replace"))
            times = pa.array([i.mtime_ns // 1000 for _, i in there], pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in there], pa.string()), pa.array(texts, pa.string()), times], ["path", "contents", "modified"])


class VaultReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> Sequence[Part]:
        """Folders are opened, nearest first, while there are few."""
        folders, loose, shares = [""], [], []
        while folders and len(folders) < SPLITS:
            folder, files = folders.pop(0), 0
            for path, is_folder in self._walk(folder, False):
                if is_folder:
                    if self.wanted.folder(path):
                        folders.append(path)
                elif MARKDOWN.search(path) and self.wanted.file(path):
                    files += 1
                    if len(loose) + files <= HELD:
                        loose.append(path)
            if len(loose) + files > HELD and files:
                loose = [p for p in loose if posixpath.dirname(p) != folder]
                of = min(SPLITS, -(-files // FILES))
                shares += [Part(folder=folder, share=(i, of)) for i in range(of)]
        return [Part(folder=f) for f in folders] + shares + [Part(files=tuple(loose[i : i + FILES])) for i in range(0, len(loose), FILES)] or [Part()]


class VaultStream(_Reading, DataSourceStreamReader):
    """Offsets are times of files' last changes, in nanoseconds."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": max((i.mtime_ns for _, i in self._matching("")), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        names = sorted(p for p, i in self._matching("") if start["at"] < i.mtime_ns <= end["at"])
        return [Part(files=tuple(names[i : i + FILES])) for i in range(0, len(names), FILES)] or [Part()]


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of the attempt: files by number, and NAMES, the path of each; GONE, paths to remove
    staged: int = 0
    removed: int = 0


NAMES, GONE = "names", "gone"


class VaultWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, STAGING + uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, root = _open(self.uri)
        mine = posixpath.join(root, self.job, uuid.uuid4().hex)
        fs.create_dir(mine, recursive=True)
        staged = removed = 0
        with fs.open_output_stream(posixpath.join(mine, NAMES)) as names, fs.open_output_stream(posixpath.join(mine, GONE)) as gone:
            for row in rows:
                name = row["path"]
                if not name or name.startswith("/") or ".." in name.split("/") or _hidden(name):
                    raise BadRequest("no path below a vault", {"path": name})
                line = json.dumps(name).encode() + b"\n"
                if row["contents"] is None:
                    gone.write(line)
                    removed += 1
                    continue
                with fs.open_output_stream(posixpath.join(mine, str(staged))) as f:
                    f.write(row["contents"].encode())
                names.write(line)
                staged += 1
        return Written(mine, staged, removed)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.uri)
        done = [m for m in messages if m is not None]

        def listed(m: Written, name: str) -> Iterator[tuple[int, str]]:
            with fs.open_input_stream(posixpath.join(m.folder, name)) as f:
                yield from enumerate(json.loads(x) for x in io.TextIOWrapper(f, "utf-8"))

        @lru_cache(4096)
        def make(folder: str) -> None:
            fs.create_dir(folder, recursive=True)

        def move(at: str, name: str) -> None:
            to = posixpath.join(root, name)
            make(posixpath.dirname(to))
            fs.move(at, to)

        def remove(name: str) -> None:
            if fs.get_file_info(to := posixpath.join(root, name)).type == afs.FileType.File:
                fs.delete_file(to)

        def each(pool: ThreadPoolExecutor, f: Callable, args: Iterator[tuple]) -> None:
            while some := list(islice(args, FILES)):
                list(pool.map(lambda x: f(*x), some))

        before = _Reading({"path": self.uri})
        with ThreadPoolExecutor(MOVERS) as pool:  # names alone pass here, FILES at once, no contents
            # What is written stays, though it be removed too or lie there already.
            if self.overwrite:
                each(pool, remove, ((p,) for p, is_folder in before._walk("", True) if not is_folder and MARKDOWN.search(p)))
            for m in done:
                each(pool, remove, ((name,) for _, name in (listed(m, GONE) if m.removed else ())))
            for m in done:
                each(pool, move, ((posixpath.join(m.folder, str(i)), name) for i, name in (listed(m, NAMES) if m.staged else ())))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _open(self.uri)
        at = posixpath.join(root, self.job)
        if fs.get_file_info(at).type != afs.FileType.NotFound:
            fs.delete_dir(at)


def export(actions: DataFrame, folder: str) -> dict[str, int]:
    """Carries out export actions (filename, contents, action) in parallel: files
    created, updated and removed, and how many of each action there were."""
    spark = actions.sparkSession
    register(spark)
    contents = F.when(F.col("action") != "removed", F.col("contents"))
    actions.where("action in ('created', 'updated', 'removed')").select(F.col("filename").alias("path"), contents.alias("contents")).write.format("vault").mode("append").save(folder)
    return {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options)

    def streamReader(self, schema) -> VaultStream:  # noqa: N802
        return VaultStream(self.options)

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        if not {"path", "contents"} <= set(schema.names):
            raise BadRequest("a vault takes path and contents", {"columns": schema.names})
        return VaultWriter(self.options, overwrite)

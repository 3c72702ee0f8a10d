"""The store: one folder of versioned Parquet tables for each project.

A write makes a new version beside the old one and then moves a pointer, so a
reader sees one whole version, and a writer that is lost leaves no half of one.
One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import BadRequest, Conflict, NotFound
from ..functions import text as T

PREFIX = re.compile(r"^[A-Z][A-Z0-9]{1,3}$")


class Files:
    """Small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        out = self._fs(path).create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []


@dataclass
class Project:
    """The tables of one project below root."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.files = Files(self.spark)

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/CURRENT"

    def load(self, table: str) -> DataFrame:
        """The current version; an empty table where none was written."""
        if not self.files.exists(self._pointer(table)):
            return schemas.empty(self.spark, table)
        return self.spark.read.schema(schemas.TABLES[table]).parquet(f"{self.root}/{table}/{self.files.read(self._pointer(table)).strip()}")

    def save(self, table: str, df: DataFrame, partition_by: str | None = None) -> str:
        """Writes df as the next version and points to it."""
        version = f"v-{uuid.uuid4().hex}"
        names = [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", schemas.TABLES[table])]
        writer = schemas.checked(df.select(*names), table).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{version}")
        self.files.write(self._pointer(table), version)
        return version

    def versions(self, table: str) -> list[str]:
        return [x for x in self.files.names(f"{self.root}/{table}") if x.startswith("v-")]

    def vacuum(self, table: str) -> int:
        """Deletes the versions that aren't current."""
        now = self.files.read(self._pointer(table)).strip() if self.files.exists(self._pointer(table)) else ""
        old = [v for v in self.versions(table) if v != now]
        for v in old:
            self.files.delete(f"{self.root}/{table}/{v}")
        return len(old)

    # ---- meta ----

    def meta(self) -> dict[str, str]:
        path = f"{self.root}/meta.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {}

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        return self.meta().get(key, default)

    def meta_number(self, key: str, default: float = 0) -> float:
        try:
            return float(self.meta().get(key, default))
        except ValueError:
            return default

    def set_meta(self, key: str, value: str) -> None:
        self.files.write(f"{self.root}/meta.json", json.dumps(self.meta() | {key: value}, sort_keys=True))

    # ---- snapshots of the search index ----

    def fingerprint(self, space: str) -> str:
        return fingerprint_row(*(self.load(t) for t in ("notes", "chunks", "embeddings", "note_terms", "aliases", "tags", "links")), space).first()["hash"]

    def _snapshot(self, space: str, kind: str) -> str:
        return f"{self.root}/snapshots/{space}/{kind}"

    def save_snapshot(self, space: str, kind: str, version: str, mark: str, df: DataFrame) -> None:
        """One snapshot of each kind in a space: of which version of the engine's
        index, and of which data (their fingerprint)."""
        here, part = self._snapshot(space, kind), f"s-{uuid.uuid4().hex}"
        df.write.parquet(f"{here}/{part}")
        self.files.write(f"{here}/ABOUT", json.dumps({"version": version, "mark": mark, "part": part}))
        for old in self.files.names(here):
            if old.startswith("s-") and old != part:
                self.files.delete(f"{here}/{old}")

    def load_snapshot(self, space: str, kind: str, version: str, mark: str) -> DataFrame | None:
        """The snapshot, if this version made it from these data."""
        here = self._snapshot(space, kind)
        about = json.loads(self.files.read(f"{here}/ABOUT")) if self.files.exists(f"{here}/ABOUT") else {}
        return self.spark.read.parquet(f"{here}/{about['part']}") if (about.get("version"), about.get("mark")) == (version, mark) else None

    def snapshots(self) -> list[tuple[str, str, str]]:
        """(space, kind, version), in order."""
        top = f"{self.root}/snapshots"
        found = [(s, k, f"{top}/{s}/{k}/ABOUT") for s in self.files.names(top) for k in self.files.names(f"{top}/{s}")]
        return [(s, k, json.loads(self.files.read(p))["version"]) for s, k, p in found if self.files.exists(p)]

    def clear_snapshots(self, space: str | None = None) -> None:
        self.files.delete(f"{self.root}/snapshots" + (f"/{space}" if space else ""))


def fingerprint_row(notes: DataFrame, chunks: DataFrame, embeddings: DataFrame, note_terms: DataFrame, aliases: DataFrame, tags: DataFrame, links: DataFrame, space: str) -> DataFrame:
    """One row: counts and latest changes of all that a space's index is made
    from, and their hash: active notes, the space's passages and vectors, terms,
    aliases, tags and links. Each part is one partial aggregate."""
    active, mine = notes.where("status = 'active'"), F.col("space_id") == space
    parts = [active.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.max("updated_at").cast("string"), F.lit("")).alias("updated"), F.coalesce(F.sum("rev"), F.lit(0)).alias("revs"))]
    rest = (("chunks", chunks.where(mine)), ("embeddings", embeddings.where(mine)), ("note_terms", note_terms), ("aliases", aliases), ("tags", tags), ("links", links))
    parts += [df.agg(F.count(F.lit(1)).alias(name)) for name, df in rest]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    out = out.drop("one")
    return out.withColumn("hash", F.sha2(F.to_json(F.struct(*out.columns)), 256))


# ---- projects ----


def prefix_for(spark: SparkSession, name: str) -> str:
    found = spark.range(1).select(T.derive_prefix(F.lit(name))).first()[0]
    if found is None:
        raise BadRequest(f'no id prefix in "{name}"', {"name": name}, "give one of 2 to 4 capital letters or digits")
    return found


class Registry:
    """The projects below a folder: name, id prefix, place."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.files = spark, home.rstrip("/"), Files(spark)

    def _read(self) -> dict[str, dict]:
        path = f"{self.home}/projects.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {}

    def _write(self, entries: dict[str, dict]) -> None:
        self.files.write(f"{self.home}/projects.json", json.dumps(entries, sort_keys=True, indent=1))

    def names(self) -> list[str]:
        return sorted(self._read())

    def create(self, name: str, prefix: str | None = None, root: str | None = None) -> Project:
        entries = self._read()
        if name in entries:
            raise Conflict(f'a project "{name}" exists', {"name": name})
        prefix = prefix or prefix_for(self.spark, name)
        if not PREFIX.match(prefix):
            raise BadRequest(f'"{prefix}" is no id prefix', {"prefix": prefix})
        entries[name] = {"prefix": prefix, "root": root or f"{self.home}/{name}"}
        self._write(entries)
        project = Project(self.spark, entries[name]["root"])
        project.set_meta("id_prefix", prefix)
        project.set_meta("schema_version", str(schemas.SCHEMA_VERSION))
        return project

    def open(self, name: str) -> Project:
        entry = self._read().get(name)
        if entry is None:
            raise NotFound(f'no project "{name}"', {"name": name}, f"known: {', '.join(self.names()) or 'none'}")
        project = Project(self.spark, entry["root"])
        if project.meta_number("schema_version", 0) > schemas.SCHEMA_VERSION:
            raise BadRequest("the project is of a later version than this engine", {"name": name})
        return project

    def remove(self, name: str, delete: bool = False) -> None:
        entries = self._read()
        if name not in entries:
            raise NotFound(f'no project "{name}"', {"name": name})
        root = entries.pop(name)["root"]
        self._write(entries)
        if delete:
            self.files.delete(root)

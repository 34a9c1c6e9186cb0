"""A folder with an index in versions, the JSON root that names the current one, and settings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import Settings
from ..operators.settings import SCHEMA_VERSION, error_of
from . import sidecar

SCHEMA = "id string, embedding array<double>, content_hash string, updated_at string, position long"


class Store:
    """Reads and writes of one folder, by one writer.

    A write makes a new version beside the old one and then replaces the root, which is a rename: readers take the version that the
    root names, so they see the old index or the new one. Without a root they take the highest version that is complete.
    rewrite() keeps an index until flush(), or until tick() finds that the first rewrite since the last flush is every_ms
    old; later rewrites replace it and don't put the flush off. read() and is_empty() see what is kept.
    """

    def __init__(self, spark: SparkSession, folder: str, every_ms: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.every_ms, self.clock = spark, folder, every_ms, clock
        self.pending: DataFrame | None = None
        self.since = 0.0

    # --- the root ---
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def root(self) -> dict:
        """The root, {} if there is none; what is missing or wrong in it gets its default."""
        path = f"{self.folder}/data.json"
        fs, p = self._fs(path)
        held = json.loads(self.spark.sparkContext.wholeTextFiles(path).first()[1] or "{}") if fs.exists(p) else {}
        return normalized(held or {})

    def update(self, updater: Callable[[dict], dict]) -> dict:
        """Reads the root, changes it and writes it."""
        new = updater(self.root())
        sidecar._put(self.spark, f"{self.folder}/data.json", [json.dumps(new).encode()])
        return new

    def settings(self) -> Settings:
        return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in self.root()["settings"].items()})

    def update_settings(self, **patch) -> Settings:
        """Some settings replaced by checked ones, the others as they are."""
        new = replace(self.settings(), **patch)
        error = error_of(new)
        if error:
            raise ValueError(error)
        self.update(lambda root: root | {"settings": asdict(new)})
        return new

    # --- the index ---
    def version(self) -> int:
        """The version that readers take; 0 without any."""
        named = self.root()["version"]
        return named or max(self.versions(), default=0)

    def versions(self) -> list[int]:
        """The complete versions in the folder."""
        fs, p = self._fs(self.folder)
        found = fs.listStatus(p) if fs.exists(p) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(self._fs(f"{self.folder}/{n}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        if self.pending is not None:
            return self.pending
        at = self.version()
        return sidecar.read_version(self.spark, self.folder, at) if at else self.spark.createDataFrame([], SCHEMA)

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def needs_rebuild(self) -> bool:
        """Whether the root names a version that isn't there whole."""
        named = self.root()["version"]
        return bool(named) and named not in self.versions()

    def rewrite(self, index: DataFrame) -> None:
        if self.pending is None:
            self.since = self.clock()
        self.pending = index

    def tick(self) -> bool:
        """Flushes if it is time; whether it did."""
        due = self.pending is not None and (self.clock() - self.since) * 1000 >= self.every_ms
        if due:
            self.flush()
        return due

    def flush(self) -> None:
        """Writes what is kept, if anything is."""
        if self.pending is None:
            return
        new = max([self.version(), *self.versions()]) + 1
        sidecar.write_version(self.pending, self.folder, new)
        self.update(lambda root: root | {"version": new, "schemaVersion": SCHEMA_VERSION})
        self.pending = None


def normalized(root: dict) -> dict:
    """A root with all of its parts: settings field by field, version numbers from 0."""
    held, base = root.get("settings") or {}, asdict(Settings())
    settings = {f.name: held[f.name] if _fits(f.name, held.get(f.name), base[f.name]) else base[f.name] for f in fields(Settings)}
    version = root.get("version")
    return root | {"settings": settings, "version": version if isinstance(version, int) and version > 0 else 0, "schemaVersion": min(root.get("schemaVersion") or 1, SCHEMA_VERSION)}


def _fits(name: str, value, default) -> bool:
    if isinstance(default, bool):
        return isinstance(value, bool)
    if isinstance(default, int):
        return isinstance(value, int) and not isinstance(value, bool) and value >= (0 if name == "title_weight" else 1)
    return isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)

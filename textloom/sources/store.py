"""Snapshot store of an index: versioned table folders and a pointer file that is replaced atomically.

Readers use the snapshot that the pointer names, so a writer never disturbs them: the one before stays until the
next commit, older ones go. One writer at a time: a lock file, retried with growing pauses, that its holder touches now and
then; one that nobody has touched for ``STALE_S`` is left from a crash and is taken over. The pointer, the state
(``state.json``) and the lock are small files on the Hadoop file system of the root.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import schemas as S

RETRY_FIRST_MS, RETRY_MOST_MS, RETRY_BUDGET_S = 200, 5_000, 900
TOUCH_S, STALE_S = 30, 300


def retry_delay_ms(attempt: int) -> int:
    return min(RETRY_FIRST_MS * 2 ** min(attempt, 5), RETRY_MOST_MS)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self) -> bool:
        return self.fs.exists(self._at("CURRENT"))

    def pointer(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no index at {self.root}")
        return json.loads(self._bytes("CURRENT"))

    def _bytes(self, name: str) -> bytes:
        s = self.fs.open(self._at(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(s))
        finally:
            s.close()

    def _replace(self, name: str, body: bytes) -> None:
        """Writes a small file beside the old one and renames it over that in one step."""
        jvm = self.spark.sparkContext._jvm
        out = self.fs.create(self._at(f"{name}.new"), True)
        out.write(bytearray(body))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(self._at(f"{name}.new")), self.fs.makeQualified(self._at(name)), options)

    def state(self) -> dict:
        """dirty, dirty_reason and last_sync_unix_ms of the index; clean if never told otherwise."""
        return {"dirty": False, "dirty_reason": None, "last_sync_unix_ms": None} | (json.loads(self._bytes("state.json")) if self.fs.exists(self._at("state.json")) else {})

    def set_state(self, dirty: bool, reason: str | None = None, synced: int | None = None) -> dict:
        """A missing sync time keeps the last one."""
        state = {"dirty": dirty, "dirty_reason": reason if dirty else None, "last_sync_unix_ms": synced if synced is not None else self.state()["last_sync_unix_ms"]}
        self._replace("state.json", json.dumps(state).encode())
        return state

    def missing_tables(self) -> list[str]:
        """Tables that the index must have and has not."""
        found = self.pointer()
        needed = S.REQUIRED_TABLES + ("vectors",) * (found["settings"].get("index_level") == "fts+vector")
        return [t for t in needed if not self.fs.exists(self._at(f"{found['snapshot']}/{t}"))]

    def settings(self) -> dict[str, str]:
        found = self.pointer()["settings"]
        if found.get("schema_version") != str(S.SCHEMA_VERSION):
            raise ValueError("the index has another schema version; rebuild it")
        return found

    def read(self, name: str) -> DataFrame:
        self.settings()
        return self.spark.read.parquet(f"{self.root}/{self.pointer()['snapshot']}/{name}")

    def commit(self, tables: dict[str, DataFrame], settings: dict[str, str], finish: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]] | None = None) -> str:
        """Writes the tables to a new snapshot, then those that ``finish`` makes of a reader of them, and swaps the pointer."""
        name = f"snapshot={time.time_ns()}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{table}")
        for table, df in (finish(lambda t: self.spark.read.parquet(f"{self.root}/{name}/{t}")) if finish else {}).items():
            df.write.parquet(f"{self.root}/{name}/{table}")
        old = self.pointer()["snapshot"] if self.exists() else None
        self._replace("CURRENT", json.dumps({"snapshot": name, "settings": settings | {"schema_version": str(S.SCHEMA_VERSION)}}).encode())
        for found in self.fs.listStatus(self._path(self.root)):
            folder = found.getPath().getName()
            if folder.startswith("snapshot=") and folder not in (name, old):
                self.fs.delete(found.getPath(), True)
        return name

    def locked(self):
        return _Lock(self)

    def delete(self) -> bool:
        if not self.fs.exists(self._path(self.root)):
            return False
        if not self.fs.getFileStatus(self._path(self.root)).isDirectory():
            raise NotADirectoryError(self.root)
        return bool(self.fs.delete(self._path(self.root), True))


class _Lock:
    def __init__(self, store: Store):
        self.store, self._done = store, threading.Event()

    def _touch(self) -> None:
        while not self._done.wait(TOUCH_S):
            self.store.fs.setTimes(self.store._at("LOCK"), int(time.time() * 1000), -1)

    def __enter__(self) -> Store:
        began, attempt = time.monotonic(), 0
        lock = self.store._at("LOCK")
        while True:
            try:
                self.store.fs.create(lock, False).close()
                threading.Thread(target=self._touch, daemon=True).start()
                return self.store
            except Exception:
                if time.monotonic() - began > RETRY_BUDGET_S:
                    raise
            with contextlib.suppress(Exception):  # the holder may have let go in between
                if time.time() - self.store.fs.getFileStatus(lock).getModificationTime() / 1000 > STALE_S:
                    self.store.fs.delete(lock, False)
                    continue
            time.sleep(retry_delay_ms(attempt) / 1000)
            attempt += 1

    def __exit__(self, *_) -> None:
        self._done.set()
        self.store.fs.delete(self.store._at("LOCK"), False)

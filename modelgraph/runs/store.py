"""Where runs live. Any file system that Spark reaches will do.

    <root>/live.json                     model -> run whose snapshot is current
    <root>/history.jsonl                 one entry for each published run
    <root>/pending.json                  a publication that isn't finished
    <root>/runs/<id>/models/<model>      snapshots, never changed once written
    <root>/runs/<id>/inputs/<source>     the rows that the run read
    <root>/branches/<branch>/<model>     staged, not published
"""

from __future__ import annotations

import contextlib
import functools
import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ModelError

#: Version of the files' layout.
LAYOUT = 1
_LOCKS: dict[str, threading.RLock] = {}
#: Before the names of columns that only name folders.
_FOLDER = "__folder_"
#: The file that names the folders behind a table's own.
_PARTS = "_behind.json"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # -- files
    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def names(self, *parts: str) -> list[str]:
        p = self._path(self.path(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.path(*parts)), True)

    def move(self, old: str, new: str) -> None:
        """Rename a folder; the new name mustn't be taken."""
        target = self._path(self.path(new))
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(self.path(old)), target):
            raise ModelError("E082", f"can't move {old} to {new}")

    def text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        with contextlib.closing(self._fs.open(self._path(self.path(name)))) as f:
            return bytes(f.readAllBytes()).decode()

    def put(self, name: str, text: str) -> None:
        """Write a file in one step: readers see the old or the new text."""
        new = f"{name}.{uuid.uuid4().hex[:8]}"
        with contextlib.closing(self._fs.create(self._path(self.path(new)), True)) as f:
            f.write(bytearray(text.encode()))
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        context.rename(self._path(self.path(new)), self._path(self.path(name)), kinds)

    @contextlib.contextmanager
    def locked(self, wait: float = 60.0, stale: float = 120.0) -> Iterator[None]:
        """One writer at a time: a lock for threads, and a file that only one
        process can create.  The holder renews the file's time as long as it lives,
        so only a file whose holder is gone gets older than ``stale`` seconds; it is
        taken over.  Nobody deletes a file with another one's token."""
        with _LOCKS.setdefault(self.root, threading.RLock()):
            token, end = uuid.uuid4().hex, time.time() + wait
            while not self._take(token):
                with contextlib.suppress(Exception):  # it may go in between
                    age = time.time() - self._fs.getFileStatus(self._path(self.path("_lock"))).getModificationTime() / 1000
                    if age > stale:
                        # renamed first: of several that find it stale, one wins
                        gone = self._path(self.path(f"_lock.{token}"))
                        if self._fs.rename(self._path(self.path("_lock")), gone):
                            self._fs.delete(gone, False)
                        continue
                if time.time() > end:
                    raise ModelError("E083", f"{self.root} is locked by another run")
                time.sleep(0.1)
            done = threading.Event()
            beat = threading.Thread(target=self._renew, args=(token, done, stale / 6), daemon=True)
            beat.start()
            try:
                yield
            finally:
                done.set()
                beat.join()
                if self.text("_lock") == token:
                    self.delete("_lock")

    def _take(self, token: str) -> bool:
        try:
            with contextlib.closing(self._fs.create(self._path(self.path("_lock")), False)) as f:
                f.write(bytearray(token.encode()))
        except Exception:  # it exists: the lock is another one's
            return False
        return self.text("_lock") == token

    def _renew(self, token: str, done: threading.Event, every: float) -> None:
        while not done.wait(every):
            with contextlib.suppress(Exception):  # a missed beat is made up by the next
                if self.text("_lock") == token:
                    self._fs.setTimes(self._path(self.path("_lock")), int(time.time() * 1000), -1)

    # -- records
    def live(self) -> dict[str, str]:
        return json.loads(self.text("live.json") or '{"models": {}}')["models"]

    def set_live(self, models: dict[str, str]) -> None:
        self.put("live.json", json.dumps({"layout": LAYOUT, "models": models}, sort_keys=True))

    def history(self) -> list[dict]:
        entries = [json.loads(x) for x in (self.text("history.jsonl") or "").splitlines() if x]
        for e in entries:
            if e.get("layout", 0) > LAYOUT:
                raise ModelError("E097", f"run {e.get('run')} was written by a later version")
        return [e if "layout" in e else e | {"layout": 0} for e in entries]

    def add_history(self, entry: dict) -> None:
        entries = self.history()
        if not any(e["run"] == entry["run"] and e.get("at") == entry.get("at") for e in entries):
            self.put("history.jsonl", "".join(json.dumps(e, sort_keys=True) + "\n" for e in [*entries, entry]))

    def migrate(self) -> int:
        """Bring older entries to this layout; run ids stay. Returns how many."""
        entries = self.history()
        old = [e for e in entries if e["layout"] < LAYOUT]
        if old:
            self.put("history.jsonl", "".join(json.dumps(e | {"layout": LAYOUT}, sort_keys=True) + "\n" for e in entries))
        return len(old)

    def entry(self, run: str) -> dict:
        for e in reversed(self.history()):
            if e["run"] == run:
                return e
        raise ModelError("E080", f"unknown run {run!r}")

    # -- tables
    def write(self, df: DataFrame, *parts: str, partition_by: list[str] | None = None, sums: list[Column] | None = None, behind: tuple[str, ...] | None = None) -> tuple[DataFrame, list]:
        """Write a table and read it back, with the schema it came with.  ``sums``
        are aggregates that are computed as the rows pass.  ``behind`` names a table
        whose rows belong to this one too; they stay where they are.

        Folders are named by copies of the partition columns, whose own values
        stay in the files: a folder's name can't tell '' from null."""
        path, seen = self.path(*parts), Observation()
        copies = {f"{_FOLDER}{c}": F.col(f"`{c}`").cast("string") for c in partition_by or ()}
        writer = (df.observe(seen, *sums) if sums else df).withColumns(copies).write.mode("overwrite")
        (writer.partitionBy(*copies) if copies else writer).parquet(path)
        if behind:
            self.put("/".join([*parts, _PARTS]), json.dumps(["/".join(behind), *self._behind(*behind)]))
        found = seen.get if sums else {}
        return self._frame(df.schema, *parts), list(found.values())

    def _behind(self, *parts: str) -> list[str]:
        """Folders, besides its own, that hold rows of a table."""
        return json.loads(self.text("/".join([*parts, _PARTS])) or "[]")

    def behind(self, run: str) -> set[str]:
        """Runs that hold rows of a run's snapshots."""
        return {p.split("/")[1] for m in self.names("runs", run, "models") for p in self._behind("runs", run, "models", m)}

    def _frame(self, schema: T.StructType | None, *parts: str) -> DataFrame:
        places = [self.path(*parts), *[self.path(p) for p in self._behind(*parts)]]
        if schema is None:
            first = self.spark.read.parquet(places[0]).schema
            schema = T.StructType([f for f in first.fields if not f.name.startswith(_FOLDER)])
        # one folder at a time: their partition folders have roots of their own
        frames = [self.spark.read.schema(schema).parquet(p).select(*[f"`{f.name}`" for f in schema.fields]) for p in places]
        return functools.reduce(DataFrame.unionByName, frames)

    def read(self, *parts: str) -> DataFrame:
        if not self.exists(*parts):
            raise ModelError("E085", f"{self.path(*parts)} is gone")
        return self._frame(None, *parts)

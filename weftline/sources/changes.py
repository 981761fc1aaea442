"""A streaming source of changes below a folder: files added, changed and deleted, by the Python Data Source API."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, op string, text string, ts timestamp"
SKIPPED = ("node_modules", "dist", "build", ".next", "coverage", ".git")
SETTLE = 0.2  # seconds that a file must have rested
PART = 256  # files that a task reads


class Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str, float]]):
        self.rows = rows


class Reader(DataSourceStreamReader):
    """An offset is the number of a listing kept in the folder `state`; a batch is the difference of two listings.

    Listings are made on the driver and hold a path, size and time for each file of the tree; texts are read by the tasks.
    A file that disappears before it is read counts as deleted.
    """

    def __init__(self, options):
        self.root, self.state = options["path"].rstrip("/"), options["state"]
        self.ends = tuple("." + e.strip() for e in options.get("extensions", "ts,tsx").split(","))
        self.settle = float(options.get("settle", SETTLE))

    def _listing(self, n: int) -> dict:
        if n == 0:
            return {}
        with open(f"{self.state}/{n:012d}.json") as f:
            return json.load(f)

    def _newest(self) -> int:
        if not os.path.isdir(self.state):
            return 0
        return max((int(f[:12]) for f in os.listdir(self.state) if f.endswith(".json")), default=0)

    def _look(self, before: dict) -> dict:
        now, out = time.time(), {}
        for folder, folders, names in os.walk(self.root):
            folders[:] = [d for d in folders if d not in SKIPPED]
            for name in names:
                if not name.endswith(self.ends):
                    continue
                path = f"{folder}/{name}"
                try:
                    s = os.stat(path)
                except FileNotFoundError:
                    continue
                if now - s.st_mtime >= self.settle:
                    out[path] = [s.st_mtime_ns, s.st_size]
                elif path in before:
                    out[path] = before[path]  # still being written: as it was
        return out

    def initialOffset(self):
        return {"listing": 0}

    def latestOffset(self):
        n = self._newest()
        before = self._listing(n)
        found = self._look(before)
        if found == before:
            return {"listing": n}
        os.makedirs(self.state, exist_ok=True)
        with open(f"{self.state}/{n + 1:012d}.tmp", "w") as f:
            json.dump(found, f)
        os.replace(f.name, f"{self.state}/{n + 1:012d}.json")
        return {"listing": n + 1}

    def partitions(self, start, end):
        a, b = self._listing(start["listing"]), self._listing(end["listing"])
        rows = [(p, "add" if p not in a else "change", b[p][0] / 1e9) for p in sorted(b) if a.get(p) != b[p]]
        rows += [(p, "unlink", time.time()) for p in sorted(a) if p not in b]
        return [Changes(rows[k : k + PART]) for k in range(0, len(rows), PART)] or [Changes([])]

    def read(self, partition):
        from datetime import datetime, timezone

        for path, op, ts in partition.rows:
            text = None
            if op != "unlink":
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                except FileNotFoundError:
                    op = "unlink"
            yield path, op, text, datetime.fromtimestamp(ts, timezone.utc)

    def commit(self, end):
        """Listings before the last committed one are not asked for again."""
        for f in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if f.endswith(".json") and int(f[:12]) < end["listing"]:
                os.remove(f"{self.state}/{f}")


class TreeChanges(DataSource):
    """format("tree_changes") with options path, state (a folder for listings), extensions and settle (seconds)."""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return Reader(self.options)


def stream_changes(spark, root: str, state: str, extensions: tuple[str, ...] = ("ts", "tsx"), settle: float = SETTLE):
    """Changes below root as a stream (path, op, text, ts); deletions are rows with op unlink and no text."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("state", state).option("extensions", ",".join(extensions)).option("settle", str(settle)).load()

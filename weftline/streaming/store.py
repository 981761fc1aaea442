"""A store of tables that change together: each batch adds a delta, and one pointer written last makes it visible.

A table is a base and deltas; a delta holds the keys it touches and their rows. Readers see the tables of one epoch, whole:
what they read is never overwritten. After FOLD deltas a table is written anew, so that reads stay cheap.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from weftline.storage import broadcast_if_small

FOLD = 8
WRITERS = 6  # tables of a batch that are written at once
SMALL = 1 << 18  # keys of a delta that are broadcast when it is read


class Store:
    """Tables below path; keys gives the key column of each."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest pointer: epoch, and for each table the folders of its base and deltas."""
        log = self.fs_path(f"{self.path}/log")
        if not self.fs.exists(log):
            return {"epoch": None, "tables": {}}
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(log) if f.getPath().getName().endswith(".json"))
        if not names:
            return {"epoch": None, "tables": {}}
        stream = self.fs.open(self.fs_path(f"{self.path}/log/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table as of a state, the newest by default; None before its first row."""
        folders = (state or self.state())["tables"].get(name)
        if not folders:
            return None
        key, read = self.keys[name], self.spark.read.parquet
        out = read(f"{folders[0]}/rows")
        for folder in folders[1:]:
            out = out.join(broadcast_if_small(read(f"{folder}/keys"), SMALL), key, "left_anti").select(out.columns).unionByName(read(f"{folder}/rows"))
        return out

    def commit(self, epoch: int, changes: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """changes: for each table the touched keys (one column) and their new rows. An epoch that ran before replaces itself."""
        before = self.state()
        if before["epoch"] is not None and before["epoch"] >= epoch:
            return
        tables = dict(before["tables"])
        folder_of = lambda name: f"{self.path}/data/{epoch}/{name}"
        parts = [(f"{folder_of(n)}/keys", keys.distinct()) for n, (keys, _) in changes.items()] + [(f"{folder_of(n)}/rows", rows) for n, (_, rows) in changes.items()]
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda part: part[1].write.mode("overwrite").parquet(part[0]), parts))
        for name in changes:
            tables[name] = [*tables.get(name, []), folder_of(name)]
            if len(tables[name]) > FOLD:
                whole = f"{self.path}/data/{epoch}/{name}-whole"
                self.read(name, {"tables": tables}).write.mode("overwrite").parquet(f"{whole}/rows")
                tables[name] = [whole]
        temporary, final = (self.fs_path(f"{self.path}/log/{n}") for n in (f".{epoch:012d}.tmp", f"{epoch:012d}.json"))
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps({"epoch": epoch, "tables": tables}).encode()))
        out.close()
        self.fs.rename(temporary, final)

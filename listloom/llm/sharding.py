"""An append-only store of immutable Parquet shards with size-tiered compaction.

`append` writes arrivals as small shards (one for each input task, no shuffle). `compact` sorts shards into tiers of
similar size and merges the shards of a tier with at least `fan_in` of them into files of about the target size; it
repeats until no tier is that full. Each merge is one task that reads its own shards and writes one file, so nothing is
shuffled and no shard is split between tasks. What the store holds is what the newest whole manifest lists. A manifest is
created exclusively under its version's name and counts from its last line on; the writer reads it back, so of two writers
of one version one fails, and a reader sees the store before or after a commit. A compaction is committed only if its files
hold as many rows as those they replace.

Each shard keeps the schema that it was written with; the store has all columns that were ever appended, null where a shard
has none. A column that comes back with another type, or names that differ in case only, are refused before anything is
written. `vacuum` deletes shards that the newest manifest doesn't list, once they are older than a grace period, so that
those of a commit under way stay.

The driver handles names and sizes of shards only. Defined cases: nulls, empty texts and other columns are stored as they are;
an empty append adds its columns and no rows; an empty store can be compacted and read; repeated rows stay; rows have no
order, so there are no ties; texts of any length are whole values of one shard.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS_A_JOB = 64
END = "\nend\n"  # the last line of a whole manifest


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4) -> None:
        self.spark, self.path, self.target_bytes, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[tuple[str, int, int]]:
        """Names, bytes and times of change (ms) in a folder."""
        if not self._fs.exists(self._at(name)):
            return []
        return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in self._fs.listStatus(self._at(name)))

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, *_ in self._listed("manifests") if n.startswith("v") and n.endswith(".json"))

    def _text(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/manifests/v{version:08d}.json", wholetext=True).first()[0]

    def version(self) -> int:
        """The newest version with a whole manifest; 0 for none."""
        return next((v for v in reversed(self._versions()) if self._fs.getFileStatus(self._at(f"manifests/v{v:08d}.json")).getLen() and self._text(v).endswith(END)), 0)

    def manifest(self, version: int | None = None) -> dict:
        """shards: name to bytes; schema of each (a number); schemas; columns: the schema of the store."""
        version = self.version() if version is None else version
        if not version:
            return {"columns": None, "schemas": [], "shards": {}, "schema": {}}
        return json.loads(self._text(version)[: -len(END)])

    def _commit(self, version: int, manifest: dict) -> None:
        name = self._at(f"manifests/v{version:08d}.json")
        text = json.dumps(manifest | {"writer": uuid.uuid4().hex}) + END
        conflict = RuntimeError(f"version {version} was committed by another writer")
        if self._fs.exists(name):
            raise conflict
        try:
            out = self._fs.create(name, False)
        except Exception as e:
            raise conflict from e
        out.write(bytearray(text.encode()))
        out.close()
        if self._text(version) != text:
            raise conflict

    def _next(self) -> tuple[int, int]:
        """The version to build on and the number of the next, beyond manifests that were never finished."""
        return self.version(), 1 + max(self._versions(), default=0)

    def _write(self, df: DataFrame) -> dict[str, int]:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {f"{name}/{n}": size for n, size, _ in self._listed(name) if n.startswith("part-")}

    @staticmethod
    def _with(now: dict, schema: T.StructType) -> tuple[dict, int]:
        """The manifest with a further schema, and its number."""
        columns = [] if now["columns"] is None else T.StructType.fromJson(now["columns"]).fields
        known = {f.name: f.dataType for f in columns}
        for f in schema.fields:
            if known.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {known[f.name].simpleString()} in the store, not {f.dataType.simpleString()}")
        columns = [*columns, *(f for f in schema.fields if f.name not in known)]
        names = [f.name.lower() for f in columns]
        if len(set(names)) < len(names):
            raise ValueError("column names differ in case only, or repeat")
        schemas, own = list(now["schemas"]), schema.jsonValue()
        if own not in schemas:
            schemas.append(own)
        return now | {"columns": T.StructType(columns).jsonValue(), "schemas": schemas}, schemas.index(own)

    def append(self, df: DataFrame) -> int:
        """Commits the rows as new shards; gives the version."""
        last, version = self._next()
        now, number = self._with(self.manifest(last), df.schema)
        new = self._write(df)
        self._commit(version, now | {"shards": now["shards"] | new, "schema": now["schema"] | dict.fromkeys(new, number)})
        return version

    def _open(self, names: list[str], now: dict) -> DataFrame:
        """The rows of shards, with the columns of the store."""
        columns = T.StructType.fromJson(now["columns"])
        by_schema: dict[int, list[str]] = {}
        for n in names:
            by_schema.setdefault(now["schema"][n], []).append(f"{self.path}/{n}")
        parts = [self.spark.read.schema(T.StructType.fromJson(now["schemas"][k])).parquet(*paths) for k, paths in sorted(by_schema.items())]
        if not parts:
            return self.spark.createDataFrame([], columns)
        whole = (p.select(*(F.col(f"`{f.name}`") if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns.fields)) for p in parts)
        return reduce(DataFrame.unionAll, whole)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        return self._open(list(now["shards"]), now)

    def _tier(self, size: int) -> int:
        """The power of fan_in that a size reaches."""
        tier, bound = 0, self.fan_in
        while size >= bound:
            tier, bound = tier + 1, bound * self.fan_in
        return tier

    def runs(self, shards: dict[str, int]) -> list[list[str]]:
        """Shards to merge: of each tier with enough of them, in runs of about the target size."""
        tiers: dict[int, list[str]] = {}
        for name in sorted(shards, key=lambda n: (shards[n], n)):
            if 2 * shards[name] <= self.target_bytes:
                tiers.setdefault(self._tier(shards[name]), []).append(name)
        found = []
        for names in tiers.values():
            if len(names) < self.fan_in:
                continue
            run, total = [], 0
            for n in names:
                if run and total + shards[n] > self.target_bytes:
                    found.append(run)
                    run, total = [], 0
                run.append(n)
                total += shards[n]
            found.append(run)
        return [r for r in found if len(r) > 1]

    def compact(self) -> int:
        """Merges until no tier is full; gives the version. Each step is committed on its own."""
        while True:
            last, version = self._next()
            now = self.manifest(last)
            runs = self.runs(now["shards"])[:RUNS_A_JOB]
            if not runs:
                return last
            old = {n for r in runs for n in r}
            merged = reduce(DataFrame.unionAll, (self._open(r, now).coalesce(1) for r in runs))
            then, number = self._with(now, T.StructType.fromJson(now["columns"]))
            new = self._write(merged)
            then["schema"] = {n: k for n, k in now["schema"].items() if n not in old} | dict.fromkeys(new, number)
            then["shards"] = {n: b for n, b in now["shards"].items() if n not in old} | new
            if self._open(list(new), then).count() != self._open(sorted(old), now).count():
                raise RuntimeError("a compaction lost rows; nothing was committed")
            self._commit(version, then)

    def vacuum(self, grace_seconds: float = 86_400) -> None:
        """Deletes shards that the newest manifest doesn't list and that are older than the grace period, which has to be
        longer than any write takes."""
        kept, before = self.manifest()["shards"], 1000 * (time.time() - grace_seconds)
        for folder, *_ in self._listed(""):
            if not folder.startswith("data-"):
                continue
            files = [(f"{folder}/{n}", at) for n, _, at in self._listed(folder)]
            stale = [n for n, at in files if n not in kept and at <= before]
            if files and len(stale) == len(files):
                self._fs.delete(self._at(folder), True)
            elif any(n in kept for n, _ in files):
                for n in stale:
                    self._fs.delete(self._at(n), False)

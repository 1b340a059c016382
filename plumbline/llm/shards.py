"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and a versioned manifest. Arrivals are appended as small shards, each task writing
its own; compaction merges shards of a similar size, tier by tier, into files of about the target size; a version is committed by
renaming its manifest to a name that must not exist yet, so that readers see a version whole or not at all and of two writers one
wins; an append that lost commits again on the new version. A manifest names its parts, immutable files with at most PART shards each; a
commit writes only those that change. Data are copied by Spark's readers and writers only, without a shuffle; the driver lists files
and their sizes, and reads a folder as one path where all its files are in the version.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 64 << 20
#: Shards in a part of a manifest, at most.
PART = 10_000
#: Seconds for which a file that no manifest names is taken for one that a writer has yet to commit.
GRACE = 24 * 3600.0


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # within the store
    size: int
    of: int = 0  # files of its folder, when it was written


class ShardStore:
    """Shards under a folder in any file system that Spark reaches.

    target: bytes of a full shard. fan_in: a tier of so many similar shards is merged. Tier t holds sizes under target / fan_in**t.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fan_in: int = 4):
        if target < 1 or fan_in < 2:
            raise ValueError("target must be positive and fan_in at least 2")
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target, fan_in
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list[Shard]:
        at = self._at(name)
        if not self.fs.exists(at):
            return []
        found = [f for f in self.fs.listStatus(at) if f.getPath().getName().startswith("part-")]
        return [Shard(f"{name}/{f.getPath().getName()}", f.getLen(), len(found)) for f in found]

    def versions(self) -> list[int]:
        at = self._at("_manifest")
        if not self.fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _get(self, name: str) -> dict:
        stream = self.fs.open(self._at(f"_manifest/{name}"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        out = self.fs.create(self._at(f"_manifest/{name}"), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "parts": names of the files that list the shards}; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        return self._get(f"v{version:08d}.json") if version else {"version": 0, "schema": None, "parts": []}

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the last one if none is named."""
        return self._shards(self.manifest(version))

    def _shards(self, manifest: dict) -> list[Shard]:
        return [Shard(**s) for name in manifest["parts"] for s in self._get(name)["shards"]]

    def _commit(self, base: dict, schema: str | None, shards: list[Shard]) -> int:
        """The next version of base, with these shards. Parts that are as they were are named again; the rest is written anew."""
        version, wanted, parts = base["version"] + 1, set(shards), []
        self.fs.mkdirs(self._at("_manifest"))
        if version in self.versions():  # the base may be expired, and its parts gone
            raise Conflict(f"version {version} exists")
        for name in base["parts"]:
            has = {Shard(**s) for s in self._get(name)["shards"]}
            if has <= wanted and 2 * len(has) >= PART:  # a small part is written together with what is new
                parts.append(name)
                wanted -= has
        rest = sorted(wanted, key=lambda s: s.path)
        for i in range(0, len(rest), PART):
            parts.append(f"p-{uuid.uuid4().hex}.json")
            self._put(parts[-1], {"shards": [vars(s) for s in rest[i : i + PART]]})
        name = f".new-{uuid.uuid4().hex}"
        new, final = self._at(f"_manifest/{name}"), self._at(f"_manifest/v{version:08d}.json")
        self._put(name, {"version": version, "schema": schema, "parts": parts})
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context.rename(new, final, options)  # fails if the name is taken
        except Exception as e:
            self.fs.delete(new, False)
            if version in self.versions():
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame, name: str) -> list[Shard]:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return [s for s in self._list(name) if s.size]

    def append(self, arrivals: DataFrame) -> int:
        """Add the rows of arrivals as small shards, one or more for each task, and commit, again if other writers were first. The first append fixes the columns."""
        have = [(f["name"], f["type"]) for f in json.loads(arrivals.schema.json())["fields"]]
        written: list[Shard] | None = None
        while True:
            now = self.manifest()
            if now["schema"] and [(f["name"], f["type"]) for f in json.loads(now["schema"])["fields"]] != have:
                raise ValueError("the columns of arrivals differ from the store's")
            if written is None:
                written = self._write(arrivals, f"shards/{uuid.uuid4().hex}")
            try:
                return self._commit(now, now["schema"] or arrivals.schema.json(), [*self._shards(now), *written])
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        """0 for a shard of half the target or more, then one for each power of fan_in that it is smaller."""
        return 0 if size * 2 >= self.target else 1 + int(math.log(self.target / (2 * max(1, size)), self.fan_in))

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        out: dict[int, list[Shard]] = {}
        for s in shards:
            out.setdefault(self.tier(s.size), []).append(s)
        return out

    def compact(self) -> int:
        """Merge tiers of fan_in or more similar shards, from the smallest shards up, until none is left, and commit once. Returns the version, the present one if there is nothing to do."""
        from pyspark.sql.types import StructType

        now = self.manifest()
        shards, merged = self._shards(now), False
        before, made = set(shards), set()
        tried: set[frozenset] = set()
        while True:
            run = next((s for t, s in sorted(self.tiers(shards).items(), reverse=True) if t and len(s) >= self.fan_in and frozenset(s) not in tried), None)
            if run is None:
                break
            tried.add(frozenset(run))
            files = max(1, min(len(run) // 2, round(sum(s.size for s in run) / self.target)))
            rows = self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*(f"{self.path}/{s.path}" for s in run))
            new = self._write(rows.coalesce(files), f"shards/{uuid.uuid4().hex}")
            shards, merged, made = [s for s in shards if s not in set(run)] + new, True, made | set(new)
        while merged:
            try:
                version = self._commit(now, now["schema"], shards)
                for s in made - set(shards):  # merged again since
                    self.fs.delete(self._at(s.path), False)
                return version
            except Conflict:  # what others have added stays; what others have merged too can't be taken away twice
                now = self.manifest()
                latest = self._shards(now)
                if not before - set(shards) <= set(latest):
                    raise
                shards = [*shards, *(s for s in latest if s not in before)]
                before |= set(latest)
        return now["version"]

    def read(self, version: int | None = None, *, shard_col: str | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named, as they were appended; with shard_col, their shard as a column of that name, which must not be one of the store's."""
        from pyspark.sql.types import StructType

        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(json.loads(now["schema"]))
        if shard_col and shard_col.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"the store has a column {shard_col}")
        folders: dict[str, list[Shard]] = {}
        for s in self._shards(now):
            folders.setdefault(s.path.rpartition("/")[0], []).append(s)
        paths = [f"{self.path}/{p}" for f, own in folders.items() for p in ([f] if len(own) == own[0].of else [s.path for s in own])]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn(shard_col, F.regexp_extract(F.input_file_name(), r"(shards/[^/]+/[^/]+)$", 1)) if shard_col else rows

    def expire(self, keep: int = 1, *, grace: float = GRACE) -> int:
        """Delete manifests but the last keep versions, and shards that only deleted ones name; how many shards went.

        A file that no manifest names may be one that an append has written and not committed yet: it goes only when it is more than
        grace seconds old. Not for use while older versions are being read."""
        versions = self.versions()
        kept, old = versions[-max(1, keep) :], versions[: -max(1, keep)]
        live = {s.path for v in kept for s in self.shards(v)}
        named = {s.path for v in old for s in self.shards(v)}
        parts = {p for v in kept for p in self.manifest(v)["parts"]}
        spent = {p for v in old for p in self.manifest(v)["parts"]}
        late = (time.time() - grace) * 1000
        gone = 0
        if self.fs.exists(self._at("shards")):
            for folder in self.fs.listStatus(self._at("shards")):
                name, left = f"shards/{folder.getPath().getName()}", 0
                found = {f.getPath().getName(): f.getModificationTime() for f in self.fs.listStatus(folder.getPath())}
                for file, at in found.items():
                    path = f"{name}/{file}"
                    if file.startswith("part-") and path not in live and (path in named or at < late):
                        self.fs.delete(self._at(path), False)
                        gone += 1
                    elif file.startswith("part-") or file == "_temporary":
                        left += 1
                if found and not left:
                    self.fs.delete(folder.getPath(), True)
        for v in old:
            self.fs.delete(self._at(f"_manifest/v{v:08d}.json"), False)
        for p in spent - parts:
            self.fs.delete(self._at(f"_manifest/{p}"), False)
        return gone


def shard_documents(docs: DataFrame, path: str, *, arrivals: int | None = None, target: int = TARGET, fan_in: int = 4) -> ShardStore:
    """Append docs to a new store at path in so many arrivals (by a hash of all the row), after each of which the store is compacted and drops what was merged.

    arrivals: fan_in squared if none are named, so that arrivals of one shard each are merged, and what they were merged into is merged again.

    Any columns and rows are kept as they are: null and repeated rows, long and empty texts; an empty table makes a version without
    rows. Equal rows arrive together.
    """
    store = ShardStore(docs.sparkSession, path, target, fan_in)
    arrivals = fan_in * fan_in if arrivals is None else arrivals
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")] or [F.lit(0)]), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(part == i) if arrivals > 1 else docs)
        store.compact()
        store.expire()
    return store

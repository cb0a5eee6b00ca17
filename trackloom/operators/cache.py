"""A depth cache of Parquet entries with a byte budget, kept as a log, and a read-through over whole tables of keys."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE_ENTRY, CACHE_LOG, DEFAULTS, DEPTH
from .stats import cache_stats, lru_evict

#: Log folders at which they are put together, and microseconds for which an evicted key is remembered.
COMPACT_AT, REMEMBERED = 64, 24 * 3600 * 10**6


def entry_name(key: str) -> str:
    return hashlib.md5(key.encode()).hexdigest()


def cache_state(log: DataFrame) -> DataFrame:
    """Records of puts, touches and evictions to the entries that are there: (key, name, bytes, last_used, data).

    Of a key's puts and evictions the last one says whether it is there; records stand in order of time, then writer, then the writer's own
    number. Its recency is its last put or touch. Every record counts once, however often it was written, so logs can be put together.
    """
    place = F.struct("at", "writer", "seq")
    last = F.max_by(F.struct("op", "bytes", "data"), F.when(F.col("op") != "touch", place)).alias("last")
    used = F.max(F.when(F.col("op") != "evict", F.col("at"))).alias("last_used")
    there = log.groupBy("key").agg(last, used).where("last.op = 'put'")
    return there.select("key", F.md5(F.col("key").cast("binary")).alias("name"), "last.bytes", "last_used", "last.data")


def last_records(log: DataFrame, since: int) -> DataFrame:
    """The records that the state still depends on: each key's last put or eviction and last touch; evictions before ``since`` are forgotten."""
    place = F.struct("at", "writer", "seq")
    each = F.struct(*[F.col(f.name) for f in CACHE_LOG])
    kept = log.groupBy("key", (F.col("op") == "touch").alias("touch")).agg(F.max_by(each, place).alias("r")).select("r.*")
    return kept.where(~((F.col("op") == "evict") & (F.col("at") < since)))


class CacheLog:
    """An append-only log in a folder: sessions add records, any of them reads all, and none rewrites another's.

    Each append is a folder of its own. Compaction writes the last records as a snapshot with the names of the folders that it covers; a snapshot
    counts once it is marked as done. Evictions are remembered for ``remembered`` microseconds, as a put that is older may still come. Covered folders are deleted by the next compaction, so that a reader that has just begun still finds them.
    """

    def __init__(self, spark: SparkSession, path: str, remembered: int = REMEMBERED):
        self.spark, self.path, self.writer, self.seq, self.at, self.remembered = spark, path.rstrip("/"), uuid.uuid4().hex[:12], 0, 0, remembered
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for name in ("log", "snapshots"):
            self.fs.mkdirs(self._path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/{folder}")))

    def now(self) -> int:
        """Microseconds; no two records of this writer have the same."""
        self.at = max(self.at + 1, time.time_ns() // 1000)
        return self.at

    def record(self, op: str, key: str, size: int | None = None, data: str | None = None) -> tuple:
        self.seq += 1
        return (key, op, size, self.now(), self.writer, self.seq, data)

    def append(self, records: list[tuple] | DataFrame) -> None:
        """Rows of CACHE_LOG, one or a table of them."""
        rows = records if isinstance(records, DataFrame) else self.spark.createDataFrame(records, CACHE_LOG).coalesce(1)
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CACHE_LOG]).write.parquet(f"{self.path}/log/{self.now()}-{self.writer}")

    def _snapshot(self) -> tuple[str | None, list[str], list[str]]:
        """The newest snapshot that is done, all snapshots, and the log folders that the newest one doesn't cover."""
        every = self._names("snapshots")
        done = [n for n in every if self.fs.exists(self._path(f"{self.path}/snapshots/{n}/done"))]
        covered = {r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.path}/snapshots/{done[-1]}/covers").collect()} if done else set()
        return (done[-1] if done else None), every, [n for n in self._names("log") if n not in covered]

    def records(self) -> DataFrame:
        newest, _, logs = self._snapshot()
        paths = [f"{self.path}/log/{n}" for n in logs] + ([f"{self.path}/snapshots/{newest}/rows"] if newest else [])
        return self.spark.read.schema(CACHE_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], CACHE_LOG)

    def state(self) -> DataFrame:
        return cache_state(self.records())

    def folders(self) -> int:
        return len(self._snapshot()[2])

    def compact(self) -> None:
        """One snapshot of the last records; records that others add meanwhile stay in their folders."""
        newest, every, logs = self._snapshot()
        name = f"{self.now():020d}-{self.writer}"
        at = f"{self.path}/snapshots/{name}"
        covered = set(self._names("log")) - set(logs)
        last_records(self.records(), self.at - self.remembered).write.parquet(f"{at}/rows")
        self.spark.createDataFrame([(n,) for n in self._whole(logs)], "name string").coalesce(1).write.parquet(f"{at}/covers")
        self.fs.create(self._path(f"{at}/done")).close()
        for old in [f"log/{n}" for n in covered] + [f"snapshots/{n}" for n in every if newest and n < newest]:
            self.fs.delete(self._path(f"{self.path}/{old}"), True)

    def _whole(self, logs: list[str]) -> list[str]:
        """Folders whose write has ended; one that is being written isn't covered."""
        return [n for n in logs if self.fs.exists(self._path(f"{self.path}/log/{n}/_SUCCESS"))]


class DepthCache:
    """Entries are Parquet folders; what is there, and since when it wasn't used, is in a log that sessions share.

    A put writes new data beside the old and then a record, so a reader never sees half an entry. Recency outlives the session.
    """

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = DEFAULTS.cache_bytes):
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), max_bytes
        self.log = CacheLog(spark, self.path)

    def _at(self, data: str):
        return self.log._path(f"{self.path}/data/{data}")

    def _entry(self, key: str):
        return cache_state(self.log.records().where(F.col("key") == key)).first()

    def entries(self) -> DataFrame:
        return self.log.state().select(*[f.name for f in CACHE_ENTRY])

    def exists(self, key: str) -> bool:
        return self._entry(key) is not None

    def get(self, key: str) -> DataFrame | None:
        own = self._entry(key)
        if own is None:
            return None
        self._add([self.log.record("touch", key)])
        return self.spark.read.schema(DEPTH).parquet(f"{self.path}/data/{own['data']}")

    def put(self, key: str, depth: DataFrame) -> None:
        before = self._entry(key)
        data = f"{entry_name(key)}-{uuid.uuid4().hex[:12]}"
        depth.write.parquet(f"{self.path}/data/{data}")
        self._add([self.log.record("put", key, self.log.fs.getContentSummary(self._at(data)).getLength(), data)])
        if before is not None:
            self.log.fs.delete(self._at(before["data"]), True)
        state = self.log.state()
        if (state.agg(F.sum("bytes")).first()[0] or 0) > self.max_bytes:
            one = F.lit(0).alias("cache_id")
            self._drop(lru_evict(state.select(one, "key", "bytes", "last_used"), self.max_bytes).join(state.select("key", "data"), "key"))

    def _add(self, records: list[tuple] | DataFrame) -> None:
        self.log.append(records)
        if self.log.folders() > COMPACT_AT:
            self.log.compact()

    def _drop(self, entries: DataFrame) -> None:
        """Records the eviction of (key, data, ...), then deletes the data, folder by folder."""
        gone = entries.select("key", F.lit("evict").alias("op"), F.lit(None).cast("long").alias("bytes"), F.lit(self.log.now()).alias("at"), F.lit(self.log.writer).alias("writer"), F.monotonically_increasing_id().alias("seq"), "data")
        name = f"{self.path}/log/{self.log.now()}-{self.log.writer}"
        gone.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CACHE_LOG]).write.parquet(name)
        for r in self.spark.read.schema(CACHE_LOG).parquet(name).select("data").toLocalIterator():
            self.log.fs.delete(self._at(r["data"]), True)

    def stats(self) -> dict:
        return cache_stats(self.entries(), self.max_bytes).first().asDict()

    def clear(self) -> None:
        self._drop(self.log.state().select("key", "data"))


def read_through(cached: DataFrame, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "frame_idx", force: bool = False) -> DataFrame:
    """Cached rows of the wanted keys, and computed ones for the rest: an anti-join before the model, never after it."""
    if force:
        return compute(wanted)
    hit = cached.join(wanted.select(key).distinct(), key, "left_semi")
    miss = wanted.join(cached.select(key).distinct(), key, "left_anti")
    return hit.unionByName(compute(miss))

"""Layers: named stores behind a resource.

A :class:`ParquetLayer` is a table that others write. A :class:`SnapshotLayer` is ours: immutable versions, each a base and a few
deltas of changed rows, all written files. A write costs what changes, not what is stored; a DataFrame keeps the version
that it was planned on; after ``MOST_DELTAS`` deltas the next write compacts them.
"""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READ, SELECT, UPSERT, TRANSACT, TENANTS, EXPRESSIONS = "read", "select", "upsert", "transact", "tenants", "expressions"
MOST_DELTAS = 8
#: Rows of a range that one task sorts.
RANGE_ROWS = 250_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this session's own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strata-layers-")
    return _own[app]


def written(df: DataFrame, name: str, one_for_each_key: bool = False) -> DataFrame:
    """``df`` as files in the shared folder, read back: computed once, and safe from lost executors.

    one_for_each_key: its rows are those of a table with a primary key, so a layer may take the files as they are.
    """
    path = f"{shared_dir(df.sparkSession)}/strata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to, out.one_for_each_key = path, one_for_each_key
    return out


def placed(df: DataFrame, column: str, *by: Column, name: str = "placed") -> DataFrame:
    """``df`` with the place of each row in this order, from 0 on without gaps.

    Ranges of about RANGE_ROWS rows are sorted in a task each and written; bounds come from a sample of at most 300 keys for
    a range, and a count of each range is all else that the driver sees. Rows that are equal in ``by`` may lie in several ranges.
    """
    ranges = -(-df.count() // RANGE_ROWS) or 1
    by = (*by, F.col("_tie"))
    cut = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_tie")
    cut = written(cut.withColumn("_at", F.monotonically_increasing_id()), name)  # the range, and 33 bits for the place in it
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["_range"]: r["n"] for r in cut.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, at = [], 0
    for k in sorted(sizes):
        begins.append((k, at))
        at += sizes[k]
    begin = df.sparkSession.createDataFrame(begins, "_range int, _begin long")
    rows = cut.withColumn("_range", part).join(F.broadcast(begin), "_range")
    return rows.select(*df.columns, (F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(column))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class LayerError(Exception):
    """A batch that a layer did not take: which one, and why. The layers before it have it."""

    def __init__(self, layer: str, reason: Exception):
        super().__init__(f"layer {layer!r}: {reason}")
        self.layer, self.reason = layer, reason


def upsert_in_order(layers: Sequence[Layer], rows: DataFrame, fields: Sequence[str] | None = None) -> None:
    """One batch for each layer; the first failure ends it."""
    for x in layers:
        try:
            x.upsert(rows, fields)
        except Exception as e:
            raise LayerError(x.name, e) from e


class Layer:
    """A store. ``catalog``: layers of one catalog can be joined inside it."""

    def __init__(self, name: str, capabilities: Sequence[str], catalog: str | None = None):
        self.name, self.capabilities, self.catalog = name, frozenset(capabilities), catalog

    def scan(self) -> DataFrame:
        raise NotImplementedError

    def check(self) -> None:
        """Raise a FileNotFoundError if what the layer holds is lost."""

    @property
    def identifier(self) -> str:
        return f"{self.catalog}.{self.name}" if self.catalog else self.name


class ParquetLayer(Layer):
    """A read-only table: a Parquet path, or any function of the session that gives a DataFrame."""

    def __init__(self, name: str, spark: SparkSession, source: str | Callable[[SparkSession], DataFrame], catalog: str | None = "files"):
        super().__init__(name, (READ, SELECT, TENANTS, EXPRESSIONS), catalog)
        self.spark, self.source = spark, source

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(self.source) if isinstance(self.source, str) else self.source(self.spark)


@dataclass(frozen=True)
class Delta:
    """Changed rows, or, without rows, keys that are gone."""

    keys: DataFrame
    rows: DataFrame | None


@dataclass(frozen=True)
class Version:
    base: DataFrame | None = None
    deltas: tuple[Delta, ...] = ()


class SnapshotLayer(Layer):
    def __init__(self, name: str, spark: SparkSession, schema: StructType, keys: Sequence[str], catalog: str | None = None, seed: DataFrame | None = None):
        super().__init__(name, (READ, SELECT, UPSERT, TRANSACT, TENANTS, EXPRESSIONS), catalog)
        self.spark, self.schema, self.keys = spark, schema, tuple(keys)
        self.version = Version(seed.select(*schema.names) if seed is not None else None)
        self.lock = threading.RLock()

    @property
    def is_empty(self) -> bool:
        return self.version == Version()

    def _rows(self, v: Version) -> DataFrame:
        """Rows of the base and the deltas that no later delta has touched: one join with the newest place of each changed key."""
        start = v.base if v.base is not None else self.spark.createDataFrame([], self.schema)
        if not v.deltas:
            return start.select(*self.schema.names)
        at, last = "_at", "_last"
        changed = [d.keys.select(*self.keys, F.lit(i).alias(last)) for i, d in enumerate(v.deltas, 1)]
        newest = reduce(DataFrame.unionByName, changed)
        newest = newest if len(changed) == 1 else newest.groupBy(*self.keys).agg(F.max(last).alias(last))
        rows = [start.select(*self.schema.names, F.lit(0).alias(at))]
        rows += [d.rows.select(*self.schema.names, F.lit(i).alias(at)) for i, d in enumerate(v.deltas, 1) if d.rows is not None]
        joined = reduce(DataFrame.unionByName, rows).join(newest, list(self.keys), "left")
        return joined.where(F.col(last).isNull() | (F.col(last) == F.col(at))).select(*self.schema.names)

    def scan(self) -> DataFrame:
        return self._rows(self.version)

    def staged(self, rows: DataFrame, fields: Sequence[str] | None = None) -> Delta:
        """Rows to upsert, whole: fields that are not given keep what is stored (null in new rows)."""
        given = set(self.keys) | (set(rows.columns) if fields is None else set(fields))
        given = [c for c in self.schema.names if c in given]
        rows = rows.select(*given).dropDuplicates(list(self.keys))
        if set(given) != set(self.schema.names):
            rest = [c for c in self.schema.names if c not in given]
            stored = self.scan().select(*self.keys, *rest) if not self.is_empty else self.spark.createDataFrame([], self.schema).select(*self.keys, *rest)
            rows = rows.join(stored, list(self.keys), "left")
        rows = written(rows.select(*[F.col(c).cast(self.schema[c].dataType) for c in self.schema.names]), self.name)
        return Delta(rows.select(*self.keys), rows)

    def check(self) -> None:
        v = self.version
        for x in (v.base, *(d.rows if d.rows is not None else d.keys for d in v.deltas)):
            path = getattr(x, "written_to", None)
            if path is not None and not exists(self.spark, path):
                raise FileNotFoundError(path)

    def restore(self, version: Version = Version()) -> None:
        """Set the layer back to a version that it had (without one: empty)."""
        with self.lock:
            self.version = version

    def gone(self, keys: DataFrame) -> Delta:
        return Delta(written(keys.select(*self.keys).distinct(), self.name), None)  # null keys never match

    def publish(self, *deltas: Delta) -> None:
        """Make staged deltas the current version, in one step."""
        with self.lock:
            v = Version(self.version.base, self.version.deltas + deltas)
            if len(v.deltas) > MOST_DELTAS:
                v = Version(written(self._rows(v), f"{self.name}-base"))
            self.version = v

    def upsert(self, rows: DataFrame, fields: Sequence[str] | None = None) -> None:
        """Whole rows that are written already, one for each key, are taken over as they are."""
        whole = [(f.name, f.dataType) for f in rows.schema.fields] == [(f.name, f.dataType) for f in self.schema.fields]
        self.publish(Delta(rows.select(*self.keys), rows) if whole and getattr(rows, "one_for_each_key", False) else self.staged(rows, fields))

    def delete(self, keys: DataFrame) -> None:
        """Keys that are not there do no harm."""
        if not self.is_empty:
            self.publish(self.gone(keys))


class Manifest:
    """Versions of several snapshot layers, committed together: one small JSON file that is put in place by renaming.

    Files are numbered; the highest one counts. The data files that it names have to be below a folder that outlives the
    process, as ``root`` has. Of two processes that commit the same number the second one fails.
    """

    def __init__(self, spark: SparkSession, root: str, layers: dict[str, SnapshotLayer]):
        self.spark, self.root, self.layers, self.number, self.saved = spark, root.rstrip("/"), layers, 0, None
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _stored(self, df: DataFrame | None) -> str | None:
        """A path for these rows; rows that are not files yet (a seed) are written now."""
        if df is None:
            return None
        if not getattr(df, "written_to", None):
            df.written_to = f"{self.root}/rows-{uuid.uuid4().hex}"
            df.write.parquet(df.written_to)
        return df.written_to

    def save(self) -> None:
        now = {n: x.version for n, x in self.layers.items()}
        if now == self.saved:
            return
        said = {
            n: {"base": self._stored(v.base), "deltas": [{"rows": self._stored(d.rows), "keys": None if d.rows is not None else self._stored(d.keys)} for d in v.deltas]}
            for n, v in now.items()
        }
        self.files.mkdirs(self.path(self.root))
        name = f"{self.root}/version-{self.number + 1:012d}.json"
        temporary = self.path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.files.create(temporary, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if self.files.exists(self.path(name)) or not self.files.rename(temporary, self.path(name)):
            self.files.delete(temporary, False)
            raise RuntimeError(f"{name} is there already: another process writes here")
        self.number, self.saved = self.number + 1, now

    def open(self) -> bool:
        """Set the layers to the last committed versions; False if there are none."""
        found = self.files.globStatus(self.path(f"{self.root}/version-*.json")) or []
        names = sorted(x.getPath().toString() for x in found)
        if not names:
            return False
        text = self.spark.sparkContext.wholeTextFiles(names[-1]).first()[1]
        self.number = int(names[-1].rsplit("-", 1)[1].split(".")[0])
        for n, v in json.loads(text).items():
            layer = self.layers[n]

            def rows(path: str | None, schema: StructType = layer.schema) -> DataFrame | None:
                if path is None:
                    return None
                df = self.spark.read.schema(schema).parquet(path)
                df.written_to = path
                return df

            keys = StructType([layer.schema[k] for k in layer.keys])
            deltas = [(rows(d["rows"]), rows(d["keys"], keys)) for d in v["deltas"]]
            layer.restore(Version(rows(v["base"]), tuple(Delta(k if r is None else r.select(*layer.keys), r) for r, k in deltas)))
        self.saved = {n: x.version for n, x in self.layers.items()}
        return True


class CountingLayer(Layer):
    """Counts scans and writes of another layer: how often a source was asked is what tests are about."""

    def __init__(self, inner: Layer):
        super().__init__(inner.name, tuple(inner.capabilities), inner.catalog)
        self.inner, self.scans, self.writes, self.fail = inner, 0, 0, None

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def _check(self, what: str) -> None:
        if self.fail and what in self.fail:
            raise ConnectionError(f"{self.name} does not answer")

    def scan(self) -> DataFrame:
        self._check("scan")
        self.scans += 1
        return self.inner.scan()

    def upsert(self, rows: DataFrame, fields: Sequence[str] | None = None) -> None:
        self._check("upsert")
        self.writes += 1
        self.inner.upsert(rows, fields)

    def check(self) -> None:
        self._check("scan")
        self.inner.check()

    def delete(self, keys: DataFrame) -> None:
        self._check("delete")
        self.writes += 1
        self.inner.delete(keys)

"""The engine: reads from the first layer that provably holds the answer, writes to the authority first.

Proofs and routing happen here, on the driver, before a plan exists; all rows stay in Spark.
"""

from __future__ import annotations

import logging
import random
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.interval import mask
from strata.functions.normal import EMPTY, UNIVERSE, Normal, normalise
from strata.functions.predicate import Always, Predicate, all_of, references
from strata.operators.aggregates import Aggregate, AggregateNotSupported, grouped, stitched
from strata.operators.query import Query, compile_query, needed_fields, restrict
from strata.plans.ledger import Entry, Ledger
from strata.plans.resource import OUTBOX, ConfigError, Resource, Unsupported
from strata.plans.strategy import Strategy, chosen
from strata.sources.layers import EXPRESSIONS, READ, TENANTS, Layer, written
from strata.telemetry import Telemetry, fingerprint

log = logging.getLogger("strata")
#: A batch of more changed rows than this drops all entries instead of being brought to the driver.
MOST_CHANGED_ROWS = 1_000_000
#: A batch of up to so many rows is looked up entry by entry through the ledger's bounds.
FEW_ROWS = 64


#: What a store that fails raises; anything else is an error of ours.
FAULTS = (OSError, PySparkException, Py4JError)


class NoRollback(Exception):
    """An error that reaches the caller as it is, and undoes nothing of a transaction."""


class Rollback(Exception):
    """Ends a transaction and undoes it; ``reason`` is what it gives back."""

    def __init__(self, reason=None):
        super().__init__(reason)
        self.reason = reason


class Transaction:
    """What a transaction was undone for, if it was."""

    rolled_back, reason = False, None


class Engine:
    def __init__(self, spark: SparkSession, *resources: Resource, cap: int = 10_000, seed: int | None = None):
        self.spark, self.telemetry = spark, Telemetry()
        self.ledger = Ledger(self.telemetry, cap)
        self.resources: dict[str, Resource] = {}
        self.disabled: set[str] = set()
        self.outboxes: dict[str, object] = {}
        self.strategies: dict[str, Strategy] = {}
        self.locks: dict[str, threading.RLock] = {}
        self.local = threading.local()
        self.random = random.Random(seed)
        for r in resources:
            self.register(r)

    def register(self, r: Resource) -> Resource:
        r.validate()
        have = {f.name: f.dataType for f in r.source.scan().schema.fields}
        for f in r.schema.fields:
            if have.get(f.name) != f.dataType:
                raise ConfigError(f"{r.name}: the source has {have.get(f.name)} for {f.name}, not {f.dataType}")
        kind, options = chosen(r)
        self.resources[r.name] = r
        self.locks.setdefault(r.name, threading.RLock())
        self.strategies[r.name] = kind(self, r, **options)
        return r

    def start(self) -> None:
        """What is to happen when the process starts: outbox resources fill their local layer. A failure is logged."""
        for s in self.strategies.values():
            s.start()

    def stop(self) -> None:
        for s in self.strategies.values():
            s.stop()

    def outbox(self, name: str):
        return self.outboxes[name]

    def resolve(self, name: str) -> Resource:
        """The resource that a stored name means; a name is never made into one."""
        if name not in self.resources:
            raise ConfigError(f"no resource {name!r} is registered")
        return self.resources[name]

    def can(self, name: str, feature) -> bool:
        return self.strategies[name].can(feature)

    def disable(self, name: str) -> None:
        """Kill switch: reads go to the source, writes to the authority; invalidation goes on."""
        self.disabled.add(name)

    def enable(self, name: str) -> None:
        self.disabled.discard(name)

    def reset(self, name: str | None = None) -> None:
        self.ledger.reset(name)
        self.disabled.clear() if name is None else self.disabled.discard(name)

    def stats(self) -> dict[str, int]:
        return {f"{g}.{k}": n for (g, k), n in sorted(self.telemetry.counts.items())}

    # ------------------------------------------------------------------------------------------ reading

    def _scoped(self, r: Resource, df: DataFrame, tenant: str | None) -> DataFrame:
        """Rows of one tenant. The tenant is no part of a proof: it is the ledger's partition."""
        return df.where(F.col(r.tenant_attribute) == F.lit(tenant)) if r.tenant_attribute and tenant is not None else df

    def _on(self, q: Query, r: Resource, layer: Layer, skip: frozenset[str] = frozenset()) -> DataFrame:
        """A query on one layer as it is. A step that the layer can't take is an error, never left out."""
        wanted = {READ: True, TENANTS: r.tenant_attribute is not None and q.tenant is not None, EXPRESSIONS: bool(set(q.calculations) - skip)}
        for capability, used in wanted.items():
            if used and capability not in layer.capabilities:
                raise Unsupported(f"{r.name}: layer {layer.name!r} has no {capability}")
        return compile_query(q, self._scoped(r, layer.scan(), q.tenant), r.names, r.primary_key, r.calculations, skip)

    def _event(self, kind: str, q: Query, measurements: dict | None = None, **more) -> None:
        self.telemetry.emit("read", kind, measurements, resource=q.resource, tenant=q.tenant, shape=fingerprint(q.filter), **more)

    def needed(self, q: Query) -> frozenset[str]:
        r = self.resources[q.resource]
        own = {r.relationships[r.aggregates[a].relationship].own for a in q.aggregates}
        return needed_fields(q, r.names, r.primary_key, r.calculations) | own

    def _checked(self, q: Query) -> Query:
        """The query with the resource's own filter; refused if it has no tenant, or filters or sorts by an aggregate."""
        r = self.resources[q.resource]
        self._tenant(r, q.tenant)
        names = set(r.aggregates)
        if names & (references(q.filter, sorted(names)) | {n for n, _ in (*q.sort, *q.distinct_sort)}):
            raise AggregateNotSupported(f"{r.name}: no filter or sort by an aggregate")
        return q if r.base_filter is None else q.where(r.base_filter)

    @staticmethod
    def _tenant(r: Resource, tenant: str | None) -> None:
        if r.tenant_attribute and tenant is None and not r.tenant_global:
            raise Unsupported(f"{r.name}: a tenant is needed")

    def read(self, q: Query) -> DataFrame:
        """The rows of a query, by the resource's strategy."""
        r, q = self.resources[q.resource], self._checked(q)
        if forced := q.context.get("read_from"):
            self._event("forced", q, layer=forced)
            return self.read_layer(q, r, r.layer(forced))
        return self.strategies[q.resource].read(q)

    def read_layer(self, q: Query, r: Resource, layer: Layer) -> DataFrame:
        return self._with_aggregates(q, r, lambda b: self._on(b, r, layer), from_source=True)

    def point(self, name: str, layer: str, key: dict, tenant: str | None = None) -> DataFrame:
        """One row of a named layer by its whole primary key, with all attributes, or none."""
        r = self.resources[name]
        if set(key) != set(r.primary_key):
            raise Unsupported(f"{name}: {sorted(key)} is not the primary key")
        rows = self.all_of_layer(name, layer, tenant)
        for k, v in key.items():
            rows = rows.where(F.col(f"`{k}`") == F.lit(v).cast(r.schema[k].dataType))
        return rows.limit(1)

    def all_of_layer(self, name: str, layer: str, tenant: str | None = None) -> DataFrame:
        """All rows of a named layer, past every proof."""
        r = self.resources[name]
        return self._scoped(r, r.layer(layer).scan(), tenant).select(*r.names)

    def read_proven(self, q: Query, r: Resource) -> DataFrame:
        """From the first layer that is proven to hold all rows; the order of these cases matters."""
        if q.resource in self.disabled:
            self._event("miss", q, reason="disabled")
            return self._with_aggregates(q, r, lambda b: self._on(b, r, r.source), from_source=True)
        if r.cache is None:
            return self._with_aggregates(q, r, lambda b: self._on(b, r, r.source), from_source=True)
        if q.lock:
            self._event("miss", q, reason="not_cacheable")
            return self._with_aggregates(q, r, lambda b: self._on(b, r, r.source), from_source=True)
        ordered = {n for n, _ in (*q.sort, *q.distinct_sort)} | set(q.distinct)
        if any(not self._local(r, c) for c in ordered & set(r.calculations)):
            self._event("miss", q, reason="calc_sort_source_only")
            return self._with_aggregates(q, r, lambda b: self._on(b, r, r.source), from_source=True)
        if q.aggregates:
            self._event("aggregate_read", q)
            return self._with_aggregates(q, r, self._computed, from_source=False)
        return self._computed(q)

    def _local(self, r: Resource, calculation: str) -> bool:
        return r.local_evaluation and EXPRESSIONS in r.cache.capabilities and calculation not in r.overrides and not r.calculations[calculation].source_only

    def _computed(self, q: Query) -> DataFrame:
        """Calculations that the cache can't evaluate come from one narrow query of the source, by primary key."""
        r = self.resources[q.resource]
        remote = tuple(c for c in q.calculations if not self._local(r, c))
        if not remote:
            if q.calculations:
                self._event("local", q)
            return self._covered(q)
        if len(r.primary_key) != 1:
            self._event("miss", q, reason="not_mergeable")
            return self._on(q, r, r.source)
        [pk] = r.primary_key
        shown = q.select if q.select is not None else tuple(r.names)
        base = replace(q, calculations=tuple(c for c in q.calculations if c not in remote), select=tuple(dict.fromkeys((*shown, pk))))
        hit, _ = self.covers(base)
        if hit is None:
            return self._covered(q, split=False)  # one query of the source brings rows and calculations
        rows = self._covered(base)
        wanted = rows.select(F.col(pk).alias("_pk"))
        values = self._scoped(r, r.source.scan(), q.tenant).join(wanted, F.col(pk) == F.col("_pk"), "left_semi")
        values = values.select(F.col(pk).alias("_pk"), *[F.expr(r.calculations[c].sql).alias(c) for c in remote], F.lit(True).alias("_there"))
        merged = written(rows.join(values, rows[pk] == values["_pk"], "left").drop("_pk"), "merged")
        if merged.where("_there is null").limit(1).count():  # the cache holds a row that the source has not
            self._event("miss", q, reason="stale_cache")
            return self._on(q, r, r.source)
        self._event("merged", q)
        out = merged.select(*shown, *[c for c in q.calculations if c not in shown])
        return out.orderBy(*_order(q)) if q.sort else out

    def covers(self, q: Query) -> tuple[Entry | None, str | None]:
        """The ledger's entry that holds all of a query, or why none does."""
        r = self.resources[q.resource]
        return self.ledger.covers(q.resource, q.tenant, normalise(q.filter, r.types), self.needed(q))

    def _covered(self, q: Query, split: bool = True) -> DataFrame:
        r = self.resources[q.resource]
        normal = normalise(q.filter, r.types)
        if not normal.opaque and not normal.disjuncts:  # no row can match: any layer will do, and none is scanned
            self._event("hit", q, unsatisfiable=True)
            return self._on(replace(q, filter=Always(False)), r, r.cache)
        needed = self.needed(q)
        entry, reason = self.ledger.covers(q.resource, q.tenant, normal, needed)
        if entry is not None:
            try:
                r.cache.check()
                out = self._on(q, r, r.cache)
                self._event("hit", q, entry=entry.id)
            except FAULTS as e:  # a cache that fails is a cache that misses
                log.warning("%s: reading the cache failed: %s", r.name, e)
                reason = "cache_failed"
                if isinstance(e, FileNotFoundError):  # what it held is gone for good
                    self.drop_everything(r)
            else:
                self._sample(q, r, out)
                return out
        seen = self.ledger.epoch(q.resource, q.tenant)
        if split and q.recordable and not normal.opaque and not q.sort and len(r.primary_key) == 1 and reason != "cache_failed":
            parts = self.ledger.split(q.resource, q.tenant, needed)
            if parts is not None:
                try:
                    r.cache.check()
                    return self._remainder(q, r, normal, needed, seen, *parts)
                except FileNotFoundError as e:
                    log.warning("%s: reading the cache failed: %s", r.name, e)
                    self.drop_everything(r)
                    seen, reason = self.ledger.epoch(q.resource, q.tenant), "cache_failed"
        return self._miss(q, r, normal, needed, seen, reason)

    def _miss(self, q: Query, r: Resource, normal: Normal, needed: frozenset[str], seen, reason: str | None) -> DataFrame:
        self._event("miss", q, reason=reason)
        if not q.recordable or normal.opaque:
            return self._on(q, r, r.source)
        remote = tuple(c for c in q.calculations if not self._local(r, c))
        names = tuple(c for c in r.names if c in needed)
        wide = Query(q.resource, q.filter, names, tenant=q.tenant, calculations=remote)
        fetched = written(self._on(wide, r, r.source), "fetched", one_for_each_key=True)  # the source is scanned once: files feed cache and caller
        self._fill(q, r, fetched.select(*names) if remote else fetched, q.filter, normal, needed, seen)
        known = {c: replace(r.calculations[c], sql=f"`{c}`") if c in remote else x for c, x in r.calculations.items()}
        return compile_query(q, fetched, r.names, r.primary_key, known)

    def _remainder(self, q: Query, r: Resource, normal: Normal, needed, seen, held, missing) -> DataFrame:
        """What the cache holds of the query, and only the rest from the source."""
        names = tuple(c for c in r.names if c in needed)

        def part(layer: Layer, where) -> DataFrame | None:
            if where == EMPTY:
                return None
            p = q.filter if where == UNIVERSE else all_of((q.filter, where))
            return self._on(Query(q.resource, p, names, tenant=q.tenant), r, layer)

        cached = part(r.cache, held)
        rest = part(r.source, missing)
        if rest is None:
            self._event("hit", q)
            return compile_query(replace(q, filter=None), cached, r.names, r.primary_key, r.calculations)
        rest = written(rest, "rest", one_for_each_key=True)
        self._event("partial", q)
        self._fill(q, r, rest, q.filter if missing == UNIVERSE else all_of((q.filter, missing)), normal, needed, seen)
        [pk] = r.primary_key
        rows = rest if cached is None else rest.unionByName(cached.join(rest.select(pk), pk, "left_anti"))
        return compile_query(replace(q, filter=None), rows, r.names, r.primary_key, r.calculations)

    def _fill(self, q: Query, r: Resource, fetched: DataFrame, fetched_filter: Predicate | None, normal: Normal, needed, seen) -> None:
        """Bring fetched rows into the cache, take out what the source no longer has, then record. A failure is no failure of the read."""
        if self.ledger.moved(q.resource, q.tenant, seen):
            self._event("backfill_aborted", q, reason="epoch_moved")
            return
        try:
            stale = None if getattr(r.cache, "is_empty", False) else restrict(self._scoped(r, r.cache.scan(), q.tenant), fetched_filter)
            r.cache.upsert(fetched, [c for c in r.names if c in needed])
            if stale is not None:  # ghosts of the region just read
                ghosts = written(stale.join(fetched.select(*r.primary_key), list(r.primary_key), "left_anti").select(*r.names), "ghosts")
                if ghosts.limit(1).count():
                    r.cache.delete(ghosts)
                    self._drop_matching(r, q.tenant, [ghosts])
                    seen = (seen[0] + 1, seen[1])  # our own step; any other one still counts
            if self.ledger.record(q.resource, q.tenant, q.filter, normal, needed, seen, r.ledger_cap) == "epoch_moved":
                r.cache.delete(fetched.select(*r.primary_key))
                self._event("backfill_aborted", q, reason="epoch_moved")
            else:
                self._event("backfill", q)
        except FAULTS as e:
            log.warning("%s: filling the cache failed: %s", r.name, e)
            self._event("backfill_aborted", q, reason="cache_failed")

    def _sample(self, q: Query, r: Resource, answered: DataFrame) -> None:
        """Now and then the source is asked as well; differences in primary keys are reported, the answer stays."""
        if r.divergence <= 0 or self.random.random() >= r.divergence or not set(r.primary_key) <= set(answered.columns):
            return
        delta = self.divergence(answered, self._on(q, r, r.source), r.primary_key)
        n = delta.count()
        if n:
            self._event("divergence_detected", q, {"rows": n})

    @staticmethod
    def divergence(ours: DataFrame, theirs: DataFrame, keys: Iterable[str]) -> DataFrame:
        """(keys, side): keys that only one of the two has."""
        keys = list(keys)
        a = ours.select(*keys).withColumn("_a", F.lit(1))
        b = theirs.select(*keys).withColumn("_b", F.lit(1))
        both = a.join(b, keys, "full_outer").where("_a is null or _b is null")
        return both.select(*keys, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))

    # ------------------------------------------------------------------------------------------ aggregates

    def _with_aggregates(self, q: Query, r: Resource, rows_of, from_source: bool) -> DataFrame:
        if not q.aggregates:
            return rows_of(q)
        chosen = [r.aggregates[a] for a in q.aggregates]
        shown = q.select if q.select is not None else tuple(r.names)
        own = tuple(r.relationships[a.relationship].own for a in chosen)
        ordered = tuple(n for n, _ in q.sort)
        base = replace(q, aggregates=(), select=tuple(dict.fromkeys((*shown, *own, *[n for n in ordered if n in r.names]))))
        values = [(a, r.relationships[a.relationship], self._children(r, a, from_source, q.tenant)) for a in chosen]
        rows = rows_of(base)
        for a, link, child in values:
            element = self.resources[link.resource].schema[a.field].dataType if a.field else None
            rows = stitched(rows, link.own, grouped(child, link.foreign, a), a, element)
        if q.sort:
            rows = rows.orderBy(*_order(q))
        return rows.select(*shown, *[c for c in q.calculations if c not in shown], *q.aggregates)

    def _children(self, r: Resource, a: Aggregate, from_source: bool, tenant: str | None) -> DataFrame:
        """Child rows of an aggregate, of the query's tenant and under the child's own filter.

        From the child's cache if it surely has them all, else from the source; else a loud error.
        """
        link = r.relationships[a.relationship]
        child = self.resources.get(link.resource)
        if child is None:
            raise AggregateNotSupported(f"{a.name}: resource {link.resource!r} is not registered")
        if not r.can(("aggregate", a.kind)):
            raise AggregateNotSupported(f"{a.name}: neither folding nor joining is allowed")
        fields = tuple(dict.fromkeys((link.foreign, *([a.field] if a.field else []), *[n for n, _ in a.sort])))
        tenant = tenant if child.tenant_attribute else None
        self._tenant(child, tenant)
        q = Query(link.resource, all_of((a.filter, child.base_filter)), fields, tenant=tenant)
        own = Query(link.resource, child.base_filter, tenant=tenant)
        fold = r.fold_aggregates and a.name not in r.overrides and not from_source
        if fold and child.cache is not None and link.resource not in self.disabled and self.covers(q)[0] is not None:
            self._event("aggregate_fold", q)
            return self._on(own, child, child.cache)
        if r.join_aggregates and r.source.catalog is not None and r.source.catalog == child.source.catalog:
            self._event("aggregate_join", q)
            return self._on(own, child, child.source)
        if fold and child.strategy != OUTBOX:  # cold: the child's source, without a join inside one catalog
            self._event("aggregate_source", q)
            return self._on(own, child, child.source)
        raise AggregateNotSupported(f"{a.name}: its children can neither be folded nor joined")

    def aggregate(self, q: Query, **columns) -> DataFrame:
        """Aggregates of a whole query, always on the read authority."""
        q = self._checked(q)
        return self.strategies[q.resource].aggregate(q, columns)

    def whole(self, q: Query, r: Resource, layer: Layer, columns: dict) -> DataFrame:
        return self._on(replace(q, select=None), r, layer).agg(*[c.alias(n) for n, c in columns.items()])

    def join(self, name: str | None = None, other: DataFrame | None = None, on=None, how: str = "inner", tenant: str | None = None) -> DataFrame:
        """Rows of a local-first resource joined with others; the local layer is all that there is to prove there."""
        if name is None or self.resources[name].strategy != OUTBOX:
            raise Unsupported("joined rows escape the proof; join the DataFrames that read() returns")
        return self.read(Query(name, tenant=tenant)).join(other, on, how)

    def combine(self, *_, **__):
        raise Unsupported("combined rows escape the proof; combine the DataFrames that read() returns")

    bulk = combine

    # ------------------------------------------------------------------------------------------ writing

    def create(self, name: str, rows: DataFrame, tenant: str | None = None) -> DataFrame:
        return self._write(name, "create", rows, tenant)

    def update(self, name: str, changes: DataFrame, tenant: str | None = None) -> DataFrame:
        """``changes``: the primary key and the fields that change."""
        return self._write(name, "update", changes, tenant)

    def destroy(self, name: str, keys: DataFrame, tenant: str | None = None) -> DataFrame:
        return self._write(name, "destroy", keys, tenant)

    def upsert(self, name: str, rows: DataFrame, tenant: str | None = None, condition: str | None = None) -> DataFrame:
        """``condition``: an existing row is overwritten only where this holds of ``old`` and ``new``."""
        return self._write(name, "upsert", rows, tenant, condition)

    def _write(self, name: str, op: str, rows: DataFrame, tenant: str | None, condition: str | None = None) -> DataFrame:
        """Authority, then invalidation, then the other layers; returns the written (destroyed) rows as the authority has them."""
        r = self.resources[name]
        if not self.can(name, op):
            raise Unsupported(f"{name} has no {op}")
        self._tenant(r, tenant)
        with self.locks[name]:  # images are of the version that the write replaces
            return self.strategies[name].write(op, rows, tenant, condition)

    def write_proven(self, r: Resource, op: str, rows: DataFrame, tenant: str | None, condition: str | None = None) -> DataFrame:
        name = r.name
        before, after = images(r, r.authority, op, rows, condition, tenant)
        if op == "destroy":
            r.authority.delete(before)
        else:
            if condition is not None and not after.limit(1).count():
                return after
            r.authority.upsert(after)
        if op == "upsert":
            dropped = self.drop_all(name, tenant)
        else:
            dropped = self.invalidate(name, before, after, tenant)
        self._propagate(r, op, before, after)
        self.telemetry.emit("write", "applied", {"dropped": dropped}, resource=name, op=op)
        return before if after is None else after

    def _propagate(self, r: Resource, op: str, before: DataFrame | None, after: DataFrame | None) -> None:
        if r.name in self.disabled:
            return
        for n in r.write_order[1:]:
            try:
                r.layers[n].delete(before) if op == "destroy" else r.layers[n].upsert(after)
            except NoRollback:
                raise
            except Exception as e:  # best effort: the entries are dropped already, so a stale copy is never read
                log.warning("%s: writing layer %s failed: %s", r.name, n, e)
                self.telemetry.emit("write", "failed_at_layer", resource=r.name, layer=n)

    # ------------------------------------------------------------------------------------------ transactions

    def in_transaction(self, name: str) -> bool:
        return name in getattr(self.local, "open", ())

    def rollback(self, reason=None) -> None:
        raise Rollback(reason)

    @contextmanager
    def transaction(self, *names: str) -> Iterator[Transaction]:
        """Writes to these resources by this thread are undone together when the block raises.

        Every layer they write is set back to the version that it had: versions are immutable, so nothing is copied. Other
        writers of the resources wait. ``rollback`` undoes and ends the block without an error; a NoRollback passes and
        undoes nothing. Inside another transaction of the same resources the outer one decides.
        """
        done, opened = Transaction(), getattr(self.local, "open", frozenset())
        fresh = sorted(set(names) - opened)
        for n in fresh:
            if not self.can(n, "transact"):
                raise Unsupported(f"{n} has no transactions")
        for n in fresh:
            self.locks[n].acquire()
        self.local.open = opened | set(fresh)
        held = [(x, x.version) for n in fresh for x in self._written_layers(n)]
        try:
            yield done
        except NoRollback:
            raise
        except BaseException as e:
            if not fresh:
                raise
            for layer, version in held:
                layer.restore(version)
            for n in fresh:
                self.drop_all(n)
            done.rolled_back = True
            if not isinstance(e, Rollback):
                raise
            done.reason = e.reason
        finally:
            self.local.open = opened
            for n in reversed(fresh):
                self.locks[n].release()

    def _written_layers(self, name: str) -> list[Layer]:
        r = self.resources[name]
        own = [r.layers[n] for n in dict.fromkeys((*r.write_order, *r.read_order[:-1]))]
        return [x for x in own if hasattr(x, "restore")] + ([self.outboxes[name].entries] if name in self.outboxes else [])

    # ------------------------------------------------------------------------------------------ invalidation

    def _swept(self, r: Resource, tenant: str | None) -> list[str | None]:
        """Partitions that a write of this tenant may touch: rows of all tenants are read only where that is allowed."""
        if tenant is None:
            return sorted({*self.ledger.partitions(r.name), None}, key=str)
        return [tenant, None] if r.tenant_global or not r.tenant_attribute else [tenant]

    def invalidate(self, name: str, before: DataFrame | None, after: DataFrame | None, tenant: str | None = None) -> int:
        """Row-aware invalidation: only entries that match an old or a new image of a changed row are dropped."""
        r = self.resources[name]
        if before is not None:
            self._evict(r, before)
        images = [x for x in (before, after) if x is not None]
        return sum(self._drop_matching(r, t, images) for t in self._swept(r, tenant))

    def _evict(self, r: Resource, keys: DataFrame) -> None:
        for n in r.read_order[:-1]:
            try:
                r.layers[n].delete(keys)
            except Exception as e:
                log.warning("%s: evicting from %s failed: %s", r.name, n, e)
                self.telemetry.emit("ledger", "evict_failed", resource=r.name, layer=n)

    def _drop_matching(self, r: Resource, tenant: str | None, images: list[DataFrame]) -> int:
        """The epoch moves first, whatever matches; a column that an image lacks is unknown, and unknown matches."""
        self.ledger.bump(r.name, tenant)
        entries = self.ledger.entries(r.name, tenant)
        if not entries:
            return 0
        used = sorted(set().union(*(e.normal.attributes for e in entries)))
        hit: set[int] = set()
        for image in images:
            cols = [c for c in used if c in image.columns]
            rows = image.select(*[F.col(f"`{c}`") for c in cols], F.lit(1).alias("_one")).limit(MOST_CHANGED_ROWS + 1).toArrow()
            if rows.num_rows > MOST_CHANGED_ROWS:
                return self.ledger.clear(r.name, tenant)
            hit |= matching(self.ledger, r, tenant, rows, cols, entries)
        n = self.ledger.drop(r.name, tenant, hit)
        if n:
            self.telemetry.emit("ledger", "invalidated", {"entries": n}, resource=r.name, tenant=tenant)
        return n

    def drop_all(self, name: str, tenant: str | None = None) -> int:
        r = self.resources[name]
        return sum(self.ledger.clear(name, t) for t in self._swept(r, tenant))

    def drop_everything(self, r: Resource) -> None:
        """The cache lost what it held: no entry stands, and it starts empty."""
        self.drop_all(r.name)
        r.cache.restore()
        self.telemetry.emit("ledger", "cache_lost", resource=r.name)

    def forget(self, name: str, keys: DataFrame, tenant: str | None = None) -> int:
        """Something happened to these keys: all but the key is unknown."""
        r = self.resources[name]
        keys = keys.select(*r.primary_key)
        return self.invalidate(name, keys, None, tenant)

    def on_external_change(self, name: str, keys: DataFrame, tenant: str | None = None) -> int:
        return self.strategies[name].on_external_change(keys, tenant)

    def on_external_gap(self, name: str, tenant: str | None = None) -> int:
        """Changes were lost: nothing is certain any more."""
        return self.strategies[name].on_external_gap(tenant)

    # ------------------------------------------------------------------------------------------ looking in

    def explain_covers(self, q: Query) -> list[dict]:
        """For every entry: does it hold the query, and if not, why."""
        from strata.functions.normal import implies

        r = self.resources[q.resource]
        normal, needed = normalise(q.filter, r.types), self.needed(q)
        return [
            {"id": e.id, "shape": fingerprint(e.filter), "implied": (i := implies(normal, e.normal)), "missing": sorted(needed - e.fields), "covers": i and needed <= e.fields}
            for e in self.ledger.entries(q.resource, q.tenant)
        ]

    def dump_ledger(self, name: str, tenant: str | None = None) -> list[dict]:
        return self.ledger.dump(name, tenant)


def _order(q: Query):
    from strata.operators.query import ordering

    return ordering(q.sort)


class OtherTenant(PermissionError):
    """A write that would touch rows of another tenant."""


def _own_rows(r: Resource, layer: Layer, op: str, rows: DataFrame, tenant: str) -> DataFrame:
    """The rows of a write with their tenant; refused if they name another one, or replace its rows."""
    a = r.tenant_attribute
    if a in rows.columns and rows.where(~F.col(f"`{a}`").eqNullSafe(F.lit(tenant))).limit(1).count():
        raise OtherTenant(f"{r.name}: rows of another tenant than {tenant!r}")
    if op in ("create", "upsert"):
        rows = rows if a in rows.columns else rows.withColumn(a, F.lit(tenant))
        theirs = layer.scan().where(~F.col(f"`{a}`").eqNullSafe(F.lit(tenant))).select(*r.primary_key)
        if theirs.join(rows.select(*r.primary_key), list(r.primary_key), "left_semi").limit(1).count():
            raise OtherTenant(f"{r.name}: keys of another tenant than {tenant!r}")
    return rows


def images(r: Resource, layer: Layer, op: str, rows: DataFrame, condition: str | None = None, tenant: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Old and new images of what a write of this tenant changes on one layer; other tenants' rows are not there for it."""
    keys = list(r.primary_key)
    scoped = r.tenant_attribute is not None and tenant is not None
    if scoped:
        rows = _own_rows(r, layer, op, rows, tenant)
    if op == "create":
        missing = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in r.names if c not in rows.columns]
        return None, written(rows.select("*", *missing).select(*r.names), "created")
    old = layer.scan().where(F.col(f"`{r.tenant_attribute}`") == F.lit(tenant)) if scoped else layer.scan()
    if op == "destroy":
        return written(old.join(rows.select(*keys).distinct(), keys, "left_semi"), "before"), None
    given = [c for c in rows.columns if c in r.names and c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given])
    if op == "update":
        before = written(old.join(rows.select(*keys), keys, "left_semi"), "before")
        after = before.join(new.hint("merge"), keys)  # as many rows on both sides; file sizes would have Spark broadcast far more than it thinks
        return before, written(after.select(*[F.col(f"_new_{c}").alias(c) if c in given else F.col(c) for c in r.names]), "after")
    marked = old.join(rows.select(*keys), keys, "left_semi").withColumn("_old", F.lit(True))
    both = new.join(marked, keys, "left")
    if condition is not None:
        both = both.where(F.col("_old").isNull() | F.coalesce(F.expr(reduce(lambda s, c: s.replace(f"new.{c}", f"_new_{c}").replace(f"old.{c}", c), r.names, condition)), F.lit(False)))
    return None, written(both.select(*[F.col(f"_new_{c}").alias(c) if c in given else F.col(c) for c in r.names]), "upserted")


def matching(ledger: Ledger, r: Resource, tenant: str | None, rows: pa.Table, cols: list[str], entries: list[Entry]) -> set[int]:
    """Ids of entries that match any of the rows, or may match for all that is known."""
    n = rows.num_rows
    if not n:
        return set()
    null = {c: rows[c].is_null().to_numpy() for c in cols}
    values = {c: _plain(rows[c]) for c in cols}
    if n <= FEW_ROWS:
        near: dict[int, Entry] = {}
        plain = {c: rows[c].to_pylist() for c in cols}
        for i in range(n):
            near |= {e.id: e for e in ledger.may_match(r.name, tenant, {c: plain[c][i] for c in cols})}
        entries = list(near.values())
    out, cached = set(), {}
    for e in entries:
        for d in e.normal.disjuncts:
            held = np.ones(n, bool)
            for name, x in d:
                if name in values:
                    if (name, x) not in cached:
                        cached[name, x] = mask(x, values[name], null[name])
                    held &= cached[name, x]
            if held.any():
                out.add(e.id)
                break
    return out


def _plain(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as numbers; all else as Python objects, which the intervals compare."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return pc.fill_null(column, 0).to_numpy()
    return np.array([*column.to_pylist(), None], object)[:-1]

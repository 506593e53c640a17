"""Local-first writes: the local layer and an ordered outbox change together; the outbox is pushed to the targets later.

Entries of one key and target are a chain, pushed in the order of ``seq``. Each round pushes the heads of all chains as
one batch for each target, so a round is a few joins however many chains there are. A parked head blocks its own chain only.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from strata.sources.layers import Manifest, SnapshotLayer, placed, upsert_in_order, written

log = logging.getLogger("strata")

_TEXTS = ("write_ref", "resource", "tenant", "record_pk", "op", "payload", "base_image", "remote_snapshot", "target", "state", "error_class", "last_error")
SCHEMA = StructType(
    [StructField("seq", LongType(), False)]
    + [StructField(n, StringType()) for n in _TEXTS]
    + [StructField("attempts", IntegerType())]
    + [StructField(n, TimestampType()) for n in ("parked_at", "inserted_at", "updated_at")]
)
PENDING, PARKED, SYNCED = "pending", "parked", "synced"
#: Slices of one write's keys that are numbered in parallel.
SLICES = 1024
TRANSIENT, REJECTED, CONFLICT, AUTH = "transient_exhausted", "rejected", "conflict", "auth"


class Rejected(Exception):
    """A target finds the data invalid."""


class Forbidden(PermissionError):
    """A target does not let us."""


class ConflictError(Exception):
    def __init__(self, seqs: list[int]):
        super().__init__(f"{len(seqs)} parked entries stand before this write: {seqs[:20]}")
        self.seqs = seqs


class OutboxError(Exception):
    pass


def classify(e: Exception) -> str:
    """Class of a target's error; what is not known is transient."""
    if isinstance(e, (Rejected, ValueError)) and not isinstance(e, (PySparkException, Py4JError)):
        return REJECTED
    if isinstance(e, PermissionError) or getattr(e, "status", None) in (401, 403):
        return AUTH
    return TRANSIENT


def merged(a: dict, b: dict) -> dict:
    """``b`` over ``a``, dictionaries inside them, too."""
    return {**a, **{k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}


class Outbox:
    def __init__(self, engine, resource):
        self.engine, self.r, self.o = engine, resource, resource.outbox
        self.spark = engine.spark
        self.entries = SnapshotLayer(f"{resource.name}-outbox", self.spark, SCHEMA, ("seq",))
        self.lock = threading.RLock()
        self.next_seq, self.is_paused, self.timer = 1, False, None
        self.last_write_ref = None
        self.manifest = Manifest(self.spark, self.o.store, {"local": self.local, "entries": self.entries}) if self.o.store else None
        if self.manifest and self.manifest.open():
            self.next_seq = (self.entries.scan().agg(F.max("seq")).first()[0] or 0) + 1

    @property
    def local(self) -> SnapshotLayer:
        return self.r.authority

    # ------------------------------------------------------------------------------------------ helpers

    def _pk(self):
        return F.to_json(F.struct(*[F.col(k) for k in self.r.primary_key]))

    def _whole(self):
        return F.to_json(F.struct(*self.r.names), {"ignoreNullFields": "false"})

    def _rows(self, entries: DataFrame, column: str = "payload") -> DataFrame:
        """The rows that entries carry."""
        parsed = entries.select(F.from_json(column, self.r.schema).alias("x")).where("x is not null")
        return parsed.select(*[f"x.{c}" for c in self.r.names])

    def _keys(self, entries: DataFrame) -> DataFrame:
        keys = StructType([self.r.schema[k] for k in self.r.primary_key])
        return entries.select(F.from_json("record_pk", keys).alias("x")).select("x.*")

    def _mark(self, entries: DataFrame, state: str, error_class: str | None = None, error: str | None = None) -> None:
        """Entries get a state; ``entries`` may bring a remote_snapshot of its own."""
        now = F.current_timestamp()
        parked = F.when(F.lit(state == PARKED), now)
        changed = entries.withColumns(
            {"state": F.lit(state), "error_class": F.lit(error_class).cast("string"), "last_error": F.lit(error).cast("string"), "parked_at": parked.cast("timestamp"), "updated_at": now}
        )
        self.entries.upsert(changed)

    def _unsynced(self) -> DataFrame:
        return self.entries.scan().where(F.col("state") != SYNCED)

    def heads(self) -> DataFrame:
        """Entries with their place in the chain: head, racing (a pending one stands before) or blocked (a parked one does)."""
        chain = Window.partitionBy("resource", "record_pk", "target").orderBy("seq")
        before = chain.rowsBetween(Window.unboundedPreceding, -1)
        rows = self._unsynced().withColumn("_n", F.row_number().over(chain))
        blocked = F.coalesce(F.max(F.col("state") == PARKED).over(before), F.lit(False))
        place = F.when(F.col("_n") == 1, "head").when(blocked, "blocked").otherwise("racing")
        return rows.withColumn("position", place).drop("_n")

    # ------------------------------------------------------------------------------------------ writing

    def write(self, op: str, rows: DataFrame, tenant: str | None, condition: str | None = None) -> DataFrame:
        from strata.engine import images

        missing = [k for k in self.r.primary_key if k not in rows.columns]
        if missing or rows.where(" or ".join(f"`{k}` is null" for k in self.r.primary_key)).limit(1).count():
            raise OutboxError("a write needs its whole primary key")
        with self.lock:
            before, after = images(self.r, self.local, op, rows, condition, tenant)
            done = before if op == "destroy" else after
            if not done.limit(1).count():  # a skipped upsert, an update of nothing
                return done
            self.last_write_ref = None
            if self.o.mode == "write_through":
                return self._through(op, before, after, tenant)
            self._commit(op, before, after, tenant)
        return done

    def _new_entries(self, op: str, before, after, tenant) -> DataFrame:
        done = (before if op == "destroy" else after).select(self._pk().alias("record_pk"), (F.lit(None).cast("string") if op == "destroy" else self._whole()).alias("payload"))
        if op in ("update", "destroy"):
            base = before.select(self._pk().alias("record_pk"), self._whole().alias("base_image"))
            done = done.join(base.hint("merge"), "record_pk")  # JSON is far larger than the files that Spark's estimate is made from
        else:
            done = done.withColumn("base_image", F.lit(None).cast("string"))
        done = done.withColumn("target", F.explode(F.array(*[F.lit(t) for t in self.o.targets])))
        now, nothing = F.current_timestamp(), F.lit(None)
        rows = done.withColumns(
            {
                "write_ref": F.lit(uuid.uuid4().hex), "resource": F.lit(self.r.name), "tenant": F.lit(tenant).cast("string"),
                "op": F.lit(op), "remote_snapshot": nothing.cast("string"), "state": F.lit(PENDING), "error_class": nothing.cast("string"),
                "last_error": nothing.cast("string"), "attempts": F.lit(0), "parked_at": nothing.cast("timestamp"), "inserted_at": now, "updated_at": now,
            }
        )
        return written(self._numbered(rows).select(*SCHEMA.names), "entries")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with seq: gapless from next_seq on, by slices of the keys, each ranked in a task of its own."""
        slices = F.pmod(F.xxhash64("record_pk"), F.lit(SLICES)).cast("int")
        rows = written(rows.withColumn("_slice", slices), "unnumbered")
        # One row for each slice: SLICES at most.
        sizes = {r["_slice"]: r["n"] for r in rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
        begins, at = {}, self.next_seq
        for k in sorted(sizes):
            begins[k], at = at, at + sizes[k]
        if not begins:
            return rows.withColumn("seq", F.lit(0).cast("long"))
        begin = self.spark.createDataFrame(list(begins.items()), "_slice int, _begin long")
        nth = F.row_number().over(Window.partitionBy("_slice").orderBy("record_pk", "target"))
        return rows.join(F.broadcast(begin), "_slice").withColumn("seq", F.col("_begin") + nth - 1)

    def _commit(self, op, before, after, tenant, drop: DataFrame | None = None) -> DataFrame:
        """Local rows and entries are staged first; publishing them is two assignments under one lock."""
        rows = self._new_entries(op, before, after, tenant)
        change = self.local.gone(before) if op == "destroy" else self.local.staged(after)
        entry = self.entries.staged(rows)
        top = rows.agg(F.max("seq")).first()[0]
        gone = [self.entries.gone(drop)] if drop is not None else []
        with self.local.lock, self.entries.lock:
            was = self.local.version, self.entries.version
            self.local.publish(change)
            self.entries.publish(entry, *gone)
            try:
                self._save()  # the manifest swap is the commit; before it nothing has happened
            except Exception:
                self.local.restore(was[0])
                self.entries.restore(was[1])
                raise
        self.next_seq = (top or self.next_seq) + 1
        self.last_write_ref = rows.select("write_ref").first()[0]
        self.kick()
        return rows

    def _save(self) -> None:
        if self.manifest:
            self.manifest.save()

    def kick(self) -> None:
        """Ask for a push; ``on_enqueue`` is whatever runs flush() elsewhere. If it fails, entries stay pending for the sweep."""
        if self.o.on_enqueue is not None:
            try:
                self.o.on_enqueue(self)
            except Exception as e:
                log.warning("%s: asking for a push failed: %s", self.r.name, e)

    def _through(self, op, before, after, tenant) -> DataFrame:
        """Older entries of these keys first, then all targets, then the local layer; no entry unless that last step fails."""
        done = before if op == "destroy" else after
        self._drain(done.select(self._pk().alias("record_pk")))
        targets = [self._target(t) for t in self.o.targets]
        if op == "destroy":
            for target in targets:
                target.delete(before)
        else:
            upsert_in_order(targets, after)
        try:
            self.local.delete(before) if op == "destroy" else self.local.upsert(after)
        except Exception as e:
            rows = self._new_entries(op, before, after, tenant)
            self.next_seq = rows.agg(F.max("seq")).first()[0] + 1
            self.entries.upsert(rows)
            self._mark(rows, PARKED, CONFLICT, f"targets have it, the local layer has not: {e}")
            raise
        self._save()
        return done

    def _target(self, name: str):
        """A target, told what the application wants it to know (credentials, a trace)."""
        target, more = self.r.layers[name], self.o.remote_context
        if more is not None and hasattr(target, "configure"):
            target.configure(merged(getattr(target, "context", None) or {}, more(name) if callable(more) else more))
        return target

    def _drain(self, keys: DataFrame) -> None:
        self.flush(only=keys, forget=True)
        stuck = self._unsynced().join(keys, "record_pk", "left_semi").agg(F.collect_list("seq")).first()[0]  # of this write's keys
        if stuck:
            raise ConflictError(sorted(stuck))

    # ------------------------------------------------------------------------------------------ pushing

    def flush(self, only: DataFrame | None = None, forget: bool = False) -> int:
        """Push heads, round by round, until nothing moves; returns how many rounds moved something.

        An entry behind a pending one waits for the next round; that costs it no attempt.
        """
        moved = 0
        while not (self.is_paused and only is None):
            heads = self.heads().where(F.col("position") == "head").where(F.col("state") == PENDING).drop("position")
            if only is not None:
                heads = heads.join(only, "record_pk", "left_semi")
            heads = written(heads, "heads")
            present = [r.target for r in heads.select("target").distinct().collect()]
            if not present:
                break
            pushed = [self._push(t, heads.where(F.col("target") == t), forget) for t in sorted(present)]
            if not any(pushed):
                break
            moved += 1
            self._save()
        self._save()
        return moved

    def _push(self, name: str, heads: DataFrame, forget: bool) -> bool:
        target = self._target(name)
        try:
            heads, conflicts = self._stale(target, heads)
            if conflicts is not None and conflicts.limit(1).count():
                self._mark(conflicts, PARKED, CONFLICT, "the target has changed since")
            # Entries that were resolved meanwhile are gone from the table: nothing of them is pushed.
            heads = written(heads.join(self.entries.scan().where(F.col("state") == PENDING).select("seq"), "seq", "left_semi").select(*SCHEMA.names), "pushing")
        except Exception as e:
            return self._failed(heads, e)
        return self._each(target, heads, heads.count(), forget)

    def _each(self, target, heads: DataFrame, n: int, forget: bool, at: int = 0) -> bool:
        """Push a batch of n. If the target refuses it, its halves, so that a refused row parks itself alone.

        Entries of a batch have different keys, so their order does not matter. k refused rows of n cost about
        k * log2(n) batches; an error that is not about the data is one for the whole batch. Entries get their places
        by seq once, when the whole batch is refused; ``at`` is the first place of a half, so no row is needed to cut it.
        """
        if not n:
            return False
        try:
            self._apply(target, heads)
        except Exception as e:
            if n == 1 or classify(e) == TRANSIENT:
                return self._failed(heads, e)
            if "_place" not in heads.columns:
                heads = written(placed(heads, "_place", F.col("seq")), "refused")  # stored and sorted, so a half reads its own files only
            half = n // 2
            below, above = heads.where(F.col("_place") < at + half), heads.where(F.col("_place") >= at + half)
            return bool(sum([self._each(target, below, half, forget, at), self._each(target, above, n - half, forget, at + half)]))
        self.entries.delete(heads) if forget else self._mark(heads, SYNCED)
        return True

    def _apply(self, target, heads: DataFrame) -> None:
        """Upsert or delete by key; a target that keeps tenants apart is told whose rows they are."""
        if hasattr(target, "for_tenant"):
            for t in [r.tenant for r in heads.select("tenant").distinct().collect()]:
                self._send(target.for_tenant(t), heads.where(F.col("tenant").eqNullSafe(F.lit(t))))
        else:
            self._send(target, heads)

    def _send(self, target, heads: DataFrame) -> None:
        kept, gone = heads.where(F.col("op") != "destroy"), heads.where(F.col("op") == "destroy")
        if kept.limit(1).count():
            target.upsert(self._rows(kept))
        if gone.limit(1).count():
            target.delete(self._keys(gone))

    def _stale(self, target, heads: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Entries that may be pushed, and those whose row at the target is no longer the one they were made from."""
        if self.o.stale_field is None:
            return heads, None
        remote = target.scan().select(self._pk().alias("record_pk"), self._whole().alias("_remote"))
        both = heads.join(remote, "record_pk", "left")
        there, base = (F.get_json_object(c, f"$.{self.o.stale_field}") for c in ("_remote", "base_image"))
        moved = ~there.eqNullSafe(base)
        absent = F.col("_remote").isNull()
        checked = F.col("op").isin("update", "destroy")
        conflict = checked & F.when(absent, (F.col("op") == "update") & F.col("base_image").isNotNull()).otherwise(moved & ~F.col("_remote").eqNullSafe(F.col("payload")))
        both = written(both.withColumn("_conflict", conflict).withColumn("remote_snapshot", F.when(conflict, F.col("_remote")).otherwise(F.col("remote_snapshot"))), "checked")
        return both.where("not _conflict").select(*SCHEMA.names), both.where("_conflict").select(*SCHEMA.names)

    def _failed(self, heads: DataFrame, e: Exception) -> bool:
        kind = classify(e)
        log.warning("%s: pushing failed: %s", self.r.name, e)
        if kind != TRANSIENT:
            self._mark(heads, PARKED, kind, str(e))
            return True
        tried = heads.withColumn("attempts", F.col("attempts") + 1)
        out = tried.where(F.col("attempts") >= self.o.max_attempts)
        if out.limit(1).count():
            self._mark(out, PARKED, TRANSIENT, str(e))
        self.entries.upsert(tried.where(F.col("attempts") < self.o.max_attempts).withColumn("last_error", F.lit(str(e))))
        return False

    def sweep(self) -> int:
        """What a timer calls: old synced entries go, pending heads are pushed again."""
        old = F.current_timestamp() - F.expr(f"interval {self.o.keep_days} days")
        self.entries.delete(self.entries.scan().where((F.col("state") == SYNCED) & (F.col("updated_at") < old)))
        return self.flush()

    def every(self, seconds: float = 60.0) -> None:
        """Sweep now and then until stop(); a sweep that fails is logged, the next one comes all the same."""
        self.stop()
        self.timer = done = threading.Event()

        def run() -> None:
            while not done.wait(seconds):
                try:
                    self.sweep()
                except Exception as e:
                    log.warning("%s: a sweep failed: %s", self.r.name, e)

        threading.Thread(target=run, name=f"strata-sweep-{self.r.name}", daemon=True).start()

    def stop(self) -> None:
        if self.timer is not None:
            self.timer.set()
            self.timer = None

    # ------------------------------------------------------------------------------------------ looking and waiting

    def in_state(self, state: str, tenant: str | None = None, after: int = 0, limit: int | None = None) -> DataFrame:
        """Entries by seq, page by page: those after the last one seen."""
        rows = self.entries.scan().where((F.col("state") == state) & (F.col("seq") > after))
        rows = (rows.where(F.col("tenant") == tenant) if tenant is not None else rows).orderBy("seq")
        return rows if limit is None else rows.limit(limit)

    def pending(self, tenant: str | None = None, after: int = 0, limit: int | None = None) -> DataFrame:
        return self.in_state(PENDING, tenant, after, limit)

    def parked(self, tenant: str | None = None, after: int = 0, limit: int | None = None) -> DataFrame:
        return self.in_state(PARKED, tenant, after, limit)

    def statuses(self) -> DataFrame:
        """(record_pk, status): parked if any entry of the key is, else pending, else synced."""
        rank = F.max(F.when(F.col("state") == PARKED, 2).when(F.col("state") == PENDING, 1).otherwise(0))
        name = F.element_at(F.array(F.lit(SYNCED), F.lit(PENDING), F.lit(PARKED)), F.col("rank") + 1)
        return self.entries.scan().groupBy("record_pk").agg(rank.alias("rank")).select("record_pk", name.alias("status"))

    def status(self, record_pk: str) -> str:
        row = self.statuses().where(F.col("record_pk") == record_pk).first()
        return row.status if row else SYNCED

    def wait(self, record_pk: str, seconds: float = 5.0, pause: float = 0.025) -> str:
        end = time.monotonic() + seconds
        while True:
            self.flush()
            state = self.status(record_pk)
            if state != PENDING or time.monotonic() > end:
                return state if state != PENDING else "timeout"
            time.sleep(pause)

    def pause(self) -> None:
        self.is_paused = True

    def resume(self) -> int:
        self.is_paused = False
        return self.flush()

    # ------------------------------------------------------------------------------------------ resolving

    def _head(self, seq: int):
        """The parked head of a chain; None if it is synced already."""
        row = self.entries.scan().where(F.col("seq") == seq).first()
        if row is None:
            raise OutboxError(f"no entry {seq}")
        if row.state == SYNCED:
            return None
        if row.state != PARKED:
            raise OutboxError(f"entry {seq} is not parked")
        if self._chain(row).agg(F.min("seq")).first()[0] != seq:
            raise OutboxError(f"entry {seq} is not the head of its chain")
        return row

    def _chain(self, row) -> DataFrame:
        return self._unsynced().where((F.col("record_pk") == row.record_pk) & (F.col("target") == row.target))

    def _entry(self, seq: int) -> DataFrame:
        return self.entries.scan().where(F.col("seq") == seq)

    def retry(self, seq: int) -> int:
        with self.lock:
            if self._head(seq) is None:
                return 0
            self._mark(self._entry(seq).withColumn("attempts", F.lit(0)), PENDING)
        return self.flush()

    def discard(self, seq: int) -> int:
        """A create goes with all that was done to the row since; anything else alone."""
        with self.lock:
            row = self._head(seq)
            if row is None:
                return 0
            self.entries.delete(self._chain(row) if row.op == "create" else self._entry(seq))
            self._save()
        return self.flush()

    def discard_local(self, seq: int) -> int:
        """The target is right: its row replaces ours, then the chain as it was before goes."""
        with self.lock:
            row = self._head(seq)
            if row is None:
                return 0
            chain = written(self._chain(row).select("seq"), "chain")
            keys = written(self._keys(self._entry(seq)), "keys")
            theirs = written(self.r.layers[row.target].scan().join(keys, list(self.r.primary_key), "left_semi").select(*self.r.names), "theirs")
            self.local.upsert(theirs) if theirs.limit(1).count() else self.local.delete(keys)
            self.entries.delete(chain)
        return self.flush()

    def force(self, seq: int) -> int:
        """Push it whatever the target has."""
        with self.lock:
            row = self._head(seq)
            if row is None:
                return 0
            self._apply(self._target(row.target), self._entry(seq))
            self.entries.delete(self._entry(seq))
        return self.flush()

    def rebase(self, seq: int, changes: DataFrame, tenant: str | None = None) -> int:
        """A new write, made from what the target has now, takes the place of the chain."""
        from strata.engine import images

        with self.lock:
            row = self._head(seq)
            if row is None:
                return 0
            chain = written(self._chain(row).select("seq"), "chain")
            keys = self._keys(self._entry(seq))
            theirs = self.r.layers[row.target].scan().join(keys, list(self.r.primary_key), "left_semi").select(*self.r.names)
            before, after = images(self.r, self.local, "update", changes, None, tenant)
            theirs = written(theirs, "theirs")
            try:
                self._commit("update", theirs if theirs.limit(1).count() else before, after, tenant, drop=chain)
            except Exception as e:
                raise OutboxError(f"the chain of entry {seq} could not be replaced: {e}") from e
        return self.flush()

    # ------------------------------------------------------------------------------------------ pulling

    def _dirty(self) -> DataFrame:
        return self._keys(self._unsynced()).distinct()

    def refresh(self, keys: DataFrame | None = None, tenant: str | None = None) -> dict[str, int]:
        """Bring rows of the last target into the local layer; keys with unsynced entries stay as they are.

        Without keys everything is pulled, and local rows that the target lacks go; of given keys, those it lacks go.
        """
        pk = list(self.r.primary_key)
        with self.lock:
            theirs, ours = self.r.layers[self.o.targets[-1]].scan().select(*self.r.names), self.local.scan()
            if self.r.tenant_attribute and tenant is not None:
                theirs, ours = (x.where(F.col(self.r.tenant_attribute) == tenant) for x in (theirs, ours))
            if keys is not None:
                keys = keys.select(*pk).distinct()
                theirs, ours = theirs.join(keys, pk, "left_semi"), ours.join(keys, pk, "left_semi")
            dirty = written(self._dirty(), "dirty")
            theirs = written(theirs, "theirs")
            clean = theirs.join(dirty, pk, "left_anti")
            lost = written(ours.select(*pk).join(theirs.select(*pk), pk, "left_anti").join(dirty, pk, "left_anti"), "lost")
            counts = {"refreshed": clean.count(), "deleted": lost.count(), "skipped_dirty": theirs.join(dirty, pk, "left_semi").count()}
            change = [self.local.staged(clean)] + ([self.local.gone(lost)] if counts["deleted"] else [])
            self.local.publish(*change)
            self._save()
        return counts

    def hydrate(self, tenant: str | None = None) -> dict[str, int]:
        if self._unsynced().limit(1).count():
            raise OutboxError("outbox_not_empty")
        return self.refresh(None, tenant)

    def boot(self) -> None:
        if self.o.sweep_seconds:
            self.every(self.o.sweep_seconds)
        if self.o.hydrate == "manual" or (self.o.hydrate == "on_start" and self.manifest and not self.local.is_empty):
            return
        try:
            self.refresh() if self.o.hydrate == "on_start" else self.hydrate()
        except Exception as e:
            log.warning("%s: filling the local layer failed: %s", self.r.name, e)

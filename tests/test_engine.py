"""Scenarios on small tables: how often the source is asked, what is dropped, what fails and what must not."""

import pytest

from strata.engine import Engine, NoRollback, OtherTenant
from strata.functions.predicate import Opaque, attr
from strata.operators.aggregates import Aggregate, AggregateNotSupported, Relationship
from strata.operators.query import Calculation, Query
from strata.plans.outbox import OutboxError, Rejected
from strata.plans.resource import OUTBOX, ConfigError, OutboxOptions, Resource, Unsupported
from strata.plans.strategy import Proven, Strategy
from strata.sources.layers import CountingLayer, ParquetLayer, SnapshotLayer

SCHEMA = "id long, name string, age int"
Q = Query("posts")
age, name = attr("age"), attr("name")


def posts(spark, rows, cache_first=True, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    layers = {
        "cache": CountingLayer(SnapshotLayer("cache", spark, df.schema, ("id",))),
        "source": CountingLayer(SnapshotLayer("source", spark, df.schema, ("id",), "db", df)),
    }
    order = ("cache", "source") if cache_first else ("source",)
    r = Resource("posts", df.schema, ("id",), layers, order, ("source", *(["cache"] if cache_first else [])), **more)
    return Engine(spark, r), r


ROWS = [(1, "low", 3), (2, "mid", 5), (3, "high", 30), (4, "nilage", None)]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_remainder_keeps_null_rows_and_reads_only_the_rest(spark):
    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 5))
    before = r.source.scans
    assert ids(e.read(Q)) == [1, 2, 3, 4] and e.telemetry.kinds()[-2:] == ["partial", "backfill"]
    assert r.source.scans == before + 1
    assert ids(e.read(Q.where(age.is_nil()))) == [4] and r.source.scans == before + 1


def test_a_cache_failure_is_a_miss_and_a_source_failure_is_an_error(spark):
    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 1))
    r.cache.fail = {"scan", "upsert", "delete"}
    assert ids(e.read(Q.where(age > 4))) == [2, 3]
    r.cache.fail = None
    r.source.fail = {"scan"}
    with pytest.raises(ConnectionError):
        e.read(Q.where(name == "low"))


def test_an_authority_failure_changes_nothing(spark):
    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 1))
    r.source.fail = {"upsert"}
    with pytest.raises(ConnectionError):
        e.create("posts", spark.createDataFrame([(9, "new", 9)], SCHEMA))
    assert len(e.ledger.entries("posts", None)) == 1 and e.telemetry.kinds("write") == []


def test_a_write_between_reading_and_recording_wins(spark):
    e, r = posts(spark, ROWS)
    real = r.cache.inner.upsert

    def slow(rows, fields=None):
        r.cache.inner.upsert = real  # once: the write itself reaches the cache, too
        real(rows, fields)
        e.update("posts", spark.createDataFrame([(3, 31)], "id long, age int"))

    r.cache.inner.upsert = slow
    e.read(Q.where(age > 4))
    assert e.ledger.entries("posts", None) == [] and "backfill_aborted" in e.telemetry.kinds()
    assert {x.age for x in e.read(Q.where(age > 4)).collect()} == {5, 31}


def test_row_aware_invalidation(spark):
    e, r = posts(spark, ROWS)
    for p in (age < 4, age > 20, name == "mid", age.is_nil()):
        e.read(Q.where(p))
    e.update("posts", spark.createDataFrame([(1, 25)], "id long, age int"))  # out of the first, into the second
    assert sorted(x.filter.name for x in e.ledger.entries("posts", None)) == ["age", "name"]
    assert ids(e.read(Q.where(age > 20))) == [1, 3]


def test_forget_drops_all_that_may_hold_the_row(spark):
    e, _ = posts(spark, ROWS)
    for p in (age < 4, attr("id") == 2, attr("id") == 3):
        e.read(Q.where(p))
    assert e.forget("posts", spark.createDataFrame([(3,)], "id long")) == 2
    assert [x.filter.value for x in e.ledger.entries("posts", None)] == [2]


def test_narrow_rows_never_answer_wide_queries(spark):
    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 4).fields("id"))
    before = r.source.scans
    assert {x.name for x in e.read(Q.where(age > 4)).collect()} == {"mid", "high"} and r.source.scans == before + 1
    assert e.explain_covers(Q.where(age > 4))[0]["covers"]


def test_limits_are_answered_but_never_recorded(spark):
    e, _ = posts(spark, ROWS)
    e.read(Q.where(age > 1).order("age").take(1))
    assert e.ledger.entries("posts", None) == []
    e.read(Q.where(age > 1))
    got = [x.id for x in e.read(Q.where(age > 1).order(("age", "desc")).take(2)).collect()]
    assert got == [3, 2] and e.telemetry.last().kind == "hit"


def test_a_lazy_hit_keeps_its_version(spark):
    e, _ = posts(spark, ROWS)
    e.read(Q)
    rows = e.read(Q.where(age > 4))
    e.destroy("posts", spark.createDataFrame([(3,)], "id long"))
    assert ids(rows) == [2, 3] and ids(e.read(Q.where(age > 4))) == [2]


def test_snapshots_compact_and_partial_upserts_keep_other_fields(spark):
    layer = SnapshotLayer("x", spark, spark.createDataFrame([], SCHEMA).schema, ("id",))
    layer.upsert(spark.createDataFrame(ROWS, SCHEMA))
    for i in range(10):
        layer.upsert(spark.createDataFrame([(1, 100 + i), (50 + i, None)], "id long, age int"), ["age"])
    layer.delete(spark.createDataFrame([(2,), (777,)], "id long"))
    got = {x.id: (x.name, x.age) for x in layer.scan().collect()}
    assert got[1] == ("low", 109) and 2 not in got and got[59] == (None, None) and len(got) == 13
    assert len(layer.version.deltas) < 11


def test_tenants(spark):
    e, _ = posts(spark, ROWS, tenant_attribute="name")
    assert ids(e.read(Q.for_tenant("mid"))) == [2]
    assert e.covers(Q.for_tenant("low"))[0] is None and e.covers(Q.for_tenant("mid").where(age > 1))[0] is not None


def test_divergence_is_reported_and_changes_nothing(spark):
    e, r = posts(spark, ROWS, divergence=1.0)
    e.read(Q)
    r.source.inner.delete(spark.createDataFrame([(1,)], "id long"))
    assert ids(e.read(Q)) == [1, 2, 3, 4] and e.telemetry.last().kind == "divergence_detected"


def test_kill_switch_still_invalidates(spark):
    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 4))
    e.disable("posts")
    e.create("posts", spark.createDataFrame([(9, "new", 9)], SCHEMA))
    assert e.ledger.entries("posts", None) == []
    e.enable("posts")
    assert ids(e.read(Q.where(age > 4))) == [2, 3, 9]


def test_an_unavailable_ledger_is_a_miss(spark):
    e, _ = posts(spark, ROWS)
    e.ledger.available = False
    assert ids(e.read(Q.where(age > 4))) == [2, 3] and e.telemetry.counts["read", "miss"] == 1
    e.ledger.available = True
    assert e.ledger.entries("posts", None) == []


def test_aggregates_are_never_left_out(spark):
    e, r = posts(spark, ROWS)
    authors = spark.createDataFrame([("low",), ("none",)], "name string")
    a = {"n": Aggregate("n", "count", "posts"), "ages": Aggregate("ages", "list", "posts", "age", sort=(("id", "asc"),))}
    layers = {"source": ParquetLayer("source", spark, lambda _: authors, "elsewhere")}
    link = {"posts": Relationship("posts", "name", "name")}
    parent = Resource("authors", authors.schema, ("name",), layers, ("source",), relationships=link, aggregates=a, fold_aggregates=False)
    e.register(parent)
    with pytest.raises(AggregateNotSupported):
        e.read(Query("authors").with_aggregates("n"))
    e.register(Resource("authors", authors.schema, ("name",), {"source": ParquetLayer("source", spark, lambda _: authors, "db")}, ("source",), relationships=link, aggregates=a))
    got = {x.name: (x.n, x.ages) for x in e.read(Query("authors").with_aggregates("n", "ages")).collect()}
    assert got == {"low": (1, [3]), "none": (0, [])}


def test_config_errors_and_refusals(spark):
    e, r = posts(spark, ROWS)
    from dataclasses import replace

    for bad in (
        {"read_order": ()},
        {"read_order": ("cache", "nowhere")},
        {"write_order": ("cache", "source")},
        {"primary_key": ("nope",)},
        {"overrides": frozenset({"nope"})},
        {"column_masks": ("name",)},
        {"tenant_attribute": "nope"},
        {"strategy": OUTBOX},
        {"aggregates": {"n": Aggregate("n", "count", "nope")}},
    ):
        with pytest.raises(ConfigError):
            replace(r, **bad).validate()
    with pytest.warns(UserWarning):
        replace(r, base_filter=Opaque("length(name) > 1")).validate()
    with pytest.raises(Unsupported):
        e.join()
    assert not r.can("join") and not r.can("bulk") and r.can("upsert") and r.can(("aggregate", "sum")) and not r.can(("aggregate", "custom"))
    single, s = posts(spark, ROWS, cache_first=False, calculations={"old": Calculation("old", "age > 10")})
    assert [x.old for x in single.read(Q.where(age > 4).load("old").order("id")).collect()] == [False, True]


def test_tenants_never_touch_each_other(spark):
    """Aggregates count the tenant's children, writes see the tenant's rows."""
    children = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "b", 7), (4, "b", None)], "id long, who string, post int")
    parents = spark.createDataFrame([(7, "a"), (8, "b")], "id int, who string")
    store = lambda name, df, pk: {"source": CountingLayer(SnapshotLayer("source", spark, df.schema, (pk,), "db", df)), "cache": CountingLayer(SnapshotLayer("cache", spark, df.schema, (pk,)))}
    child = Resource("c", children.schema, ("id",), store("c", children, "id"), ("cache", "source"), ("source", "cache"), tenant_attribute="who")
    n = {"n": Aggregate("n", "count", "c")}
    parent = Resource("p", parents.schema, ("id",), store("p", parents, "id"), ("cache", "source"), relationships={"c": Relationship("c", "id", "post")}, aggregates=n, tenant_attribute="who")
    for how in ({}, {"join_aggregates": False}):
        from dataclasses import replace

        e = Engine(spark, replace(parent, **how), child)
        assert [x.n for x in e.read(Query("p").for_tenant("a").with_aggregates("n")).collect()] == [1]
        e.read(Query("c").for_tenant("a"))
        assert [x.n for x in e.read(Query("p").for_tenant("a").with_aggregates("n")).collect()] == [1]
    with pytest.raises(Unsupported):
        e.read(Query("c"))
    with pytest.raises(AggregateNotSupported):
        e.read(Query("p").for_tenant("a").order("n"))
    one = lambda *rows: spark.createDataFrame(list(rows), "id long, post int")
    e.destroy("c", one((1, 0), (2, 0)), tenant="a")
    e.update("c", one((3, 9), (4, 9)), tenant="a")
    assert sorted((x.id, x.post) for x in child.source.scan().collect()) == [(2, 7), (3, 7), (4, None)]
    with pytest.raises(OtherTenant):
        e.upsert("c", one((3, 1)), tenant="a")
    with pytest.raises(OtherTenant):
        e.create("c", spark.createDataFrame([(9, "b", 1)], children.schema), tenant="a")
    e.create("c", one((9, 1)), tenant="a")
    assert [x.who for x in e.read(Query("c").for_tenant("a")).collect()] == ["a"]


def test_base_filters_hold_everywhere(spark):
    from pyspark.sql import functions as F

    e, r = posts(spark, ROWS, base_filter=age > 4)
    assert e.aggregate(Q, n=F.count(F.lit(1))).first().n == 2 == e.read(Q).count()
    authors = spark.createDataFrame([("low",), ("mid",)], "name string")
    layers = {"source": ParquetLayer("source", spark, lambda _: authors, "db")}
    e.register(Resource("authors", authors.schema, ("name",), layers, ("source",), relationships={"posts": Relationship("posts", "name", "name")}, aggregates={"n": Aggregate("n", "count", "posts")}))
    assert {x.name: x.n for x in e.read(Query("authors").with_aggregates("n")).collect()} == {"low": 0, "mid": 1}


def test_a_cold_calculation_scans_the_source_once(spark):
    e, r = posts(spark, ROWS, calculations={"old": Calculation("old", "age > 10", source_only=True)})
    before = r.source.scans
    assert {x.id: x.old for x in e.read(Q.where(age > 4).load("old")).collect()} == {2: False, 3: True}
    assert r.source.scans == before + 1 and e.telemetry.kinds()[-2:] == ["miss", "backfill"]
    assert {x.id: x.old for x in e.read(Q.where(age > 4).load("old")).collect()} == {2: False, 3: True} and e.telemetry.last().kind == "merged"


def test_lost_cache_files_are_a_miss(spark):
    import shutil

    e, r = posts(spark, ROWS)
    e.read(Q.where(age > 4))
    shutil.rmtree(r.cache.version.deltas[0].rows.written_to.removeprefix("file:"))
    assert ids(e.read(Q.where(age > 4))) == [2, 3] and "cache_lost" in e.telemetry.kinds("ledger")
    assert ids(e.read(Q.where(age > 4))) == [2, 3] and e.telemetry.last().kind == "hit"


def test_transactions(spark):
    e, r = posts(spark, ROWS)
    e.read(Q)
    row = lambda i: spark.createDataFrame([(i, "new", i)], SCHEMA)
    with pytest.raises(ZeroDivisionError), e.transaction("posts"):
        e.create("posts", row(9))
        assert e.in_transaction("posts") and 9 in ids(e.read(Q))
        1 / 0  # noqa: B018
    assert not e.in_transaction("posts") and ids(e.read(Q)) == ids(r.source.scan()) == [1, 2, 3, 4]
    with e.transaction("posts") as t:
        e.create("posts", row(9))
        with e.transaction("posts"):
            e.rollback("enough")
    assert (t.rolled_back, t.reason) == (True, "enough") and ids(e.read(Q)) == [1, 2, 3, 4]
    with pytest.raises(NoRollback), e.transaction("posts"):
        e.create("posts", row(9))
        raise NoRollback("as it is")
    assert ids(e.read(Q)) == [1, 2, 3, 4, 9]


def test_concurrent_writes_and_reads(spark):
    """Whatever the interleaving: no update is lost, and what the engine answers is what the source holds."""
    from concurrent.futures import ThreadPoolExecutor

    e, r = posts(spark, ROWS)
    change = lambda i: e.update("posts", spark.createDataFrame([(1 + i % 3, 100 + i)] if i % 2 else [(1 + i % 3, f"n{i}")], "id long, age int" if i % 2 else "id long, name string"))
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(change, i) for i in range(6)] + [pool.submit(lambda: e.read(Q.where(age > 4)).collect()) for _ in range(4)]
        [j.result() for j in jobs]
    assert {(x.id, x.name, x.age) for x in r.source.scan().collect()} == {(x.id, x.name, x.age) for x in e.read(Q).collect()} == {(1, "n0", 103), (2, "n4", 101), (3, "n2", 105), (4, "nilage", None)}


def test_strategies_of_ones_own(spark):
    from dataclasses import replace

    class Loud(Proven):
        @classmethod
        def validate(cls, resource, volume=0):
            if volume > 9:
                raise ConfigError("too loud")

        def read(self, q):
            self.heard = self.options["volume"]
            return super().read(q)

    class Half(Strategy):
        def read(self, q): ...

    e, r = posts(spark, ROWS)
    e.register(replace(r, strategy=(Loud, {"volume": 3})))
    assert ids(e.read(Q.where(age > 4))) == [2, 3] and e.strategies["posts"].heard == 3
    for bad in (Half, (Loud, {"volume": 10}), "nope", (Proven, {"x": 1})):
        with pytest.raises(ConfigError):
            replace(r, strategy=bad).validate()
    with pytest.raises(ConfigError):
        e.resolve("nobody")


# ------------------------------------------------------------------------------------------------ outbox


def boxed(spark, **options):
    df = spark.createDataFrame(ROWS, SCHEMA)
    layers = {
        "local": SnapshotLayer("local", spark, df.schema, ("id",), "db", df),
        "far": CountingLayer(SnapshotLayer("far", spark, df.schema, ("id",), "far", df)),
    }
    r = Resource("posts", df.schema, ("id",), layers, ("local",), ("local",), OUTBOX, outbox=OutboxOptions(targets=("far",), **options))
    e = Engine(spark, r)
    return e, r, e.outbox("posts")


def test_transient_errors_are_tried_again_and_then_parked(spark):
    e, r, box = boxed(spark, max_attempts=2)
    e.update("posts", spark.createDataFrame([(1, 50)], "id long, age int"))
    r.layers["far"].fail = {"upsert"}
    box.flush()
    assert box.pending().first().attempts == 1
    box.sweep()
    row = box.parked().first()
    assert (row.error_class, row.attempts) == ("transient_exhausted", 2)
    r.layers["far"].fail = None
    box.retry(row.seq)
    assert box.status('{"id":1}') == "synced" and {x.id: x.age for x in r.layers["far"].scan().collect()}[1] == 50


def test_rejected_creates_go_with_their_chain(spark):
    e, r, box = boxed(spark)
    real = r.layers["far"].upsert
    r.layers["far"].upsert = lambda rows, fields=None: (_ for _ in ()).throw(Rejected("no"))
    e.create("posts", spark.createDataFrame([(9, "new", 9)], SCHEMA))
    e.update("posts", spark.createDataFrame([(9, 10)], "id long, age int"))
    box.flush()
    head = box.parked().first()
    assert head.error_class == "rejected" and box.heads().where("position = 'blocked'").count() == 1
    with pytest.raises(OutboxError):
        box.force(box.pending().first().seq)
    r.layers["far"].upsert = real
    box.discard(head.seq)
    assert box.pending().count() == box.parked().count() == 0


def test_pause_dirty_rows_and_hydration(spark):
    e, r, box = boxed(spark)
    box.pause()
    e.update("posts", spark.createDataFrame([(1, 50)], "id long, age int"))
    assert box.flush() == 0 and box.status('{"id":1}') == "pending"
    with pytest.raises(OutboxError):
        box.hydrate()
    r.layers["far"].inner.upsert(spark.createDataFrame([(1, "far", 1), (2, "far", 2)], SCHEMA))
    assert box.refresh(spark.createDataFrame([(1,), (2,), (3,)], "id long")) == {"refreshed": 2, "deleted": 0, "skipped_dirty": 1}
    got = {x.id: (x.name, x.age) for x in e.read(Q).collect()}
    assert got[1] == ("low", 50) and got[2] == ("far", 2)
    box.resume()
    assert box.wait('{"id":1}') == "synced"
    with pytest.raises(OutboxError):
        e.create("posts", spark.createDataFrame([(None, "x", 1)], SCHEMA))


def test_sequence_numbers_have_no_gaps_and_follow_writes(spark):
    e, r, box = boxed(spark)
    for _ in range(2):
        e.update("posts", spark.createDataFrame([(i, 50) for i in (1, 2, 3)], "id long, age int").repartition(3))
    seqs = [(x.seq, x.record_pk) for x in box.pending().collect()]
    assert [s for s, _ in seqs] == [1, 2, 3, 4, 5, 6] and {k for _, k in seqs[:3]} == {k for _, k in seqs[3:]}
    assert box.last_write_ref == box.pending().collect()[-1].write_ref


def test_sweeps_come_by_themselves_and_pushes_are_asked_for(spark):
    import time

    asked = []
    e, r, box = boxed(spark, sweep_seconds=0.2, on_enqueue=lambda b: (asked.append(b), 1 / 0))
    e.update("posts", spark.createDataFrame([(1, 50)], "id long, age int"))
    assert asked == [box] and box.status('{"id":1}') == "pending"
    e.start()
    end = time.monotonic() + 60
    while box.status('{"id":1}') != "synced" and time.monotonic() < end:
        time.sleep(0.5)
    e.stop()
    assert box.status('{"id":1}') == "synced"


def test_two_processes_never_commit_the_same_version(spark, tmp_path):
    a, b = (boxed(spark, store=f"file://{tmp_path}/box") for _ in range(2))
    row = spark.createDataFrame([(1, 50)], "id long, age int")
    a[0].update("posts", row)
    with pytest.raises(RuntimeError):
        b[0].update("posts", row)
    assert b[2].entries.is_empty and {x.age for x in b[0].read(Q.where(attr("id") == 1)).collect()} == {3}


def test_targets_are_told_their_context(spark):
    e, r, box = boxed(spark, remote_context=lambda name: {"auth": {"token": name}})
    far = r.layers["far"].inner
    far.context, far.configure = {"auth": {"user": "u"}, "x": 1}, lambda c: setattr(far, "told", c)
    e.update("posts", spark.createDataFrame([(1, 50)], "id long, age int"))
    box.flush()
    assert far.told == {"auth": {"user": "u", "token": "far"}, "x": 1}
    assert box.last_write_ref and e.join("posts", spark.createDataFrame([(1,)], "id long"), "id").count() == 1
    assert [x.age for x in e.point("posts", "far", {"id": 1}).collect()] == [50]

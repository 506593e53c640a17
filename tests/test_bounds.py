"""What tasks and the driver get must not grow with the tables: figures of Spark's own task metrics."""

from contextlib import contextmanager

import duckdb
import pytest

from strata import suite
from strata.engine import Engine
from strata.operators.query import Query
from strata.plans.outbox import Rejected
from strata.plans.resource import OUTBOX, OutboxOptions, Resource
from strata.sources.layers import CountingLayer, SnapshotLayer


@contextmanager
def stages(spark, group):
    """Fills a list with the finished stages of the block: (tasks, bytes sent to the driver, rows read of shuffles)."""
    sc, out = spark.sparkContext, []
    sc.setJobGroup(group, group)
    try:
        yield out
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    for k in sorted({k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}):
        x = store.lastStageAttempt(k)
        if x.numCompleteTasks():
            out.append((x.numCompleteTasks(), x.resultSize(), x.shuffleReadRecords()))


class Picky(CountingLayer):
    """Refuses a batch with some of these ids, and keeps the sizes and ids of those it took."""

    bad, took = (), ()

    def upsert(self, rows, fields=None):
        ids = [r.id for r in rows.select("id").collect()]
        if set(self.bad) & set(ids):
            raise Rejected("no")
        self.took = (*self.took, sorted(ids))
        super().upsert(rows, fields)


def test_neither_a_write_nor_a_refused_batch_comes_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr("strata.sources.layers.RANGE_ROWS", 300, raising=False)
    n = 1000
    df = spark.range(n).selectExpr("id", "concat_ws('', transform(sequence(1, 16), i -> sha2(concat(id, '-', i), 512))) as name", "0 as age")
    far = Picky(SnapshotLayer("far", spark, df.schema, ("id",), "far", df))
    far.bad = (17,)
    layers = {"local": SnapshotLayer("local", spark, df.schema, ("id",), "db", df), "far": far}
    r = Resource("posts", df.schema, ("id",), layers, ("local",), ("local",), OUTBOX, outbox=OutboxOptions(targets=("far",)))
    e = Engine(spark, r)
    box = e.outbox("posts")
    with stages(spark, "writing") as written:
        e.update("posts", spark.range(n).selectExpr("id", "1 as age"))
    with stages(spark, "halves") as pushed:
        box.flush()
    for seen in (written, pushed):
        assert max(size for _, size, _ in seen) < 500_000  # the entries have about 4 MB
    assert [x.record_pk for x in box.parked().collect()] == ['{"id":17}'] and box.pending().count() == 0
    assert {x.id for x in far.inner.scan().where("age = 1").collect()} == set(range(n)) - {17}
    assert sorted(sum(far.took, [])) == sorted(set(range(n)) - {17})  # each row once
    assert all(len(t) in (500, 250, 125, 62, 63, 31, 32, 15, 16, 7, 8, 3, 4, 2, 1) for t in far.took) and len(far.took) <= 10
    assert e.read(Query("posts")).where("age = 1").count() == n


LINEITEM = """select case when i % 6 < 4 then i // 12 end::bigint as l_orderkey, 1::bigint as l_partkey, 1::bigint as l_suppkey, 1 as l_linenumber,
    if(i % 7 = 6, 1, 50)::double as l_quantity, if(i % 6 = 5, null, 10)::double as l_extendedprice, 0.05::double as l_discount, 0::double as l_tax,
    'N' as l_returnflag, chr((65 + i % 3)::int) as l_linestatus, timestamp '1996-01-01' as l_shipdate from range({rows}) t(i)"""


@pytest.mark.parametrize("rows", [0, 1, 3000])
def test_numbers_of_lineitem_are_those_of_the_sql(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr("strata.sources.layers.RANGE_ROWS", 400, raising=False)
    con = duckdb.connect()
    con.sql(f"copy ({LINEITEM.format(rows=rows)}) to '{tmp_path}/lineitem.parquet' (format parquet)")  # with nulls and copies
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet'")
    sql = f"select l_id, l_linestatus, l_returnflag from ({suite.ORACLE_SQL['read_hit_lineitem']}) order by 1"
    got = suite.QUERIES["read_hit_lineitem"](spark, str(tmp_path)).select("l_id", "l_linestatus", "l_returnflag").orderBy("l_id").collect()
    assert [tuple(r) for r in got] == con.sql(sql).fetchall()


def test_no_task_numbers_all_of_lineitem(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("strata.sources.layers.RANGE_ROWS", 500, raising=False)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    with stages(spark, "lineitem") as seen:
        suite.QUERIES["read_hit_lineitem"](spark, sf_dir).collect()
    assert all(n < rows / 2 for tasks, _, n in seen if tasks == 1) and any(tasks > 6 and n == rows for tasks, _, n in seen)


def test_places_of_equal_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    from strata.sources import layers

    monkeypatch.setattr(layers, "RANGE_ROWS", 500)
    df = spark.range(4000, numPartitions=4).selectExpr("id", "1 as same")
    with stages(spark, "equal") as seen:
        out = layers.placed(df, "place", df["same"])
    assert any(tasks == 8 and n == 4000 for tasks, _, n in seen)
    got = out.collect()
    assert sorted(r.place for r in got) == list(range(4000)) and sorted(r.id for r in got) == list(range(4000))

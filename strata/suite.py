"""One query for each path of the engine, over the test tables, and the same answer as plain SQL.

Every query drives the engine down the path that it is named after and checks by its events that it went there, so an
answer that fell through to the source can't pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.functions.interval import OPAQUE, Interval, conjunction
from strata.functions.normal import complement, implies, normalise, region
from strata.functions.predicate import Opaque, attr, to_column
from strata.operators.aggregates import Aggregate, Relationship
from strata.operators.query import Calculation, Query
from strata.plans.outbox import CONFLICT, PARKED, Outbox, Rejected
from strata.plans.resource import OUTBOX, OutboxOptions, Resource
from strata.sources.layers import CountingLayer, ParquetLayer, SnapshotLayer, placed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
price, status, key, day, priority = (attr(a) for a in ("o_totalprice", "o_orderstatus", "o_orderkey", "o_orderdate", "o_orderpriority"))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def check(ok: bool, what: str) -> None:
    if not ok:
        raise AssertionError(what)


def went(e: Engine, *kinds: str) -> None:
    got = e.telemetry.kinds("read")
    check(set(kinds) <= set(got), f"wanted {kinds}, went {got}")


def table(spark: SparkSession, sf_dir: str, name: str, sql: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if sql is None else df.selectExpr("*", sql)


def cached(spark: SparkSession, name: str, source: DataFrame, pk: tuple[str, ...], writable: bool = False, **more) -> Resource:
    """A resource with a cache before a source; a writable source is a snapshot that starts with the table's rows."""
    if writable:
        inner = SnapshotLayer("source", spark, source.schema, pk, "files", source)
    else:
        inner = ParquetLayer("source", spark, lambda _: source)
    cache = SnapshotLayer("cache", spark, source.schema, pk)
    orders = {"write_order": ("source", "cache")} if writable else {}
    return Resource(name, source.schema, pk, {"cache": CountingLayer(cache), "source": CountingLayer(inner)}, ("cache", "source"), **orders, **more)


def orders(spark: SparkSession, sf_dir: str, writable: bool = False, **more) -> tuple[Engine, Resource]:
    r = cached(spark, "orders", table(spark, sf_dir, "orders"), ("o_orderkey",), writable, **more)
    return Engine(spark, r), r


Q = Query("orders")


def warmed(spark: SparkSession, sf_dir: str, warm, q: Query, *kinds: str, source_scans: int = 0, warm_query: Query = Q, **more) -> DataFrame:
    """Read once to fill the cache, then the query proper; it must take the named path and scan the source so often."""
    e, r = orders(spark, sf_dir, **more)
    e.read(warm_query.where(warm))
    e.telemetry.events.clear()
    before = r.source.scans
    out = e.read(q)
    went(e, *kinds)
    check(r.source.scans - before == source_scans, f"{r.source.scans - before} scans of the source")
    return out


# ------------------------------------------------------------------------------------------------ reads


@query("select * from orders where o_totalprice > 400000")
def read_miss_backfill(spark, sf_dir):
    e, r = orders(spark, sf_dir)
    out = e.read(Q.where(price > 400000.0))
    went(e, "miss", "backfill")
    check(len(e.ledger.entries("orders", None)) == 1, "not recorded")
    return out


@query("select * from orders where o_totalprice > 400000")
def read_hit_repeat(spark, sf_dir):
    return warmed(spark, sf_dir, price > 400000.0, Q.where(price > 400000.0), "hit")


@query("select * from orders where o_totalprice > 300000 and o_orderstatus = 'O'")
def read_hit_narrower_range(spark, sf_dir):
    return warmed(spark, sf_dir, price > 100000.0, Q.where((price > 300000.0) & (status == "O")), "hit")


@query("select * from orders where o_totalprice = (select max(o_totalprice) from orders)")
def read_hit_eq_in_range(spark, sf_dir):
    top = table(spark, sf_dir, "orders").agg(F.max("o_totalprice")).first()[0]
    return warmed(spark, sf_dir, price >= 400000.0, Q.where(price == top), "hit")


@query("select * from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def read_hit_in_subset(spark, sf_dir):
    return warmed(spark, sf_dir, priority.isin("1-URGENT", "2-HIGH", "5-LOW"), Q.where(priority.isin("5-LOW", "1-URGENT")), "hit")


@query("select * from orders where o_orderstatus <> 'F' and o_totalprice < 50000")
def read_hit_not_eq(spark, sf_dir):
    return warmed(spark, sf_dir, status != "F", Q.where((status != "F") & (price < 50000.0)), "hit")


@query("select * from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-06-01'")
def read_hit_date_range(spark, sf_dir):
    warm = (day >= dt.datetime(1996, 1, 1)) & (day < dt.datetime(1997, 1, 1))
    return warmed(spark, sf_dir, warm, Q.where((day >= dt.datetime(1996, 3, 1)) & (day < dt.datetime(1996, 6, 1))), "hit")


@query("select * from orders where o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH'")
def read_hit_or_into_in(spark, sf_dir):
    return warmed(spark, sf_dir, priority.isin("1-URGENT", "2-HIGH"), Q.where((priority == "1-URGENT") | (priority == "2-HIGH")), "hit")


@query("select * from part where p_name like '%ring%'")
def read_opaque_like(spark, sf_dir):
    r = cached(spark, "part", table(spark, sf_dir, "part"), ("p_partkey",))
    e = Engine(spark, r)
    e.read(Query("part"))
    out = e.read(Query("part", Opaque("p_name like '%ring%'")))
    check(e.telemetry.last().metadata["reason"] == "solver_unsupported", "not opaque")
    return out


@query("select * from orders where o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 20")
def read_topk_from_coverage(spark, sf_dir):
    return warmed(spark, sf_dir, price > 100000.0, Q.where(price > 100000.0).order(("o_totalprice", "desc"), "o_orderkey").take(20), "hit")


@query("select * from orders where o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 20 offset 40")
def read_offset_page(spark, sf_dir):
    return warmed(spark, sf_dir, price > 100000.0, Q.where(price > 100000.0).order(("o_totalprice", "desc"), "o_orderkey").take(20, 40), "hit")


@query(
    "select * from orders where o_totalprice > 100000 "
    "qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1"
)
def read_distinct_on(spark, sf_dir):
    q = Q.where(price > 100000.0).distinct_on("o_custkey", by=(("o_totalprice", "desc"),))
    return warmed(spark, sf_dir, price > 100000.0, q, "hit")


@query("select * from orders where o_totalprice > 350000")
def read_field_widening(spark, sf_dir):
    e, r = orders(spark, sf_dir)
    e.read(Q.where(price > 350000.0).fields("o_orderkey", "o_custkey"))
    narrow = e.ledger.entries("orders", None)[0].fields
    check("o_orderstatus" not in narrow, "recorded more than it read")
    e.read(Q.where(price > 350000.0))
    check(len(e.ledger.entries("orders", None)) == 1, "the entry was not widened")
    e.telemetry.events.clear()
    out = e.read(Q.where(price > 350000.0))
    went(e, "hit")
    return out


@query("select * from orders where o_orderdate >= timestamp '2000-01-01'")
def read_remainder(spark, sf_dir):
    return warmed(spark, sf_dir, price > 250000.0, Q.where(day >= dt.datetime(2000, 1, 1)), "partial", source_scans=1)


@query("select o_orderkey, o_totalprice from orders where o_totalprice < 20000 or o_totalprice > 480000")
def read_remainder_or(spark, sf_dir):
    q = Q.where((price < 20000.0) | (price > 480000.0)).fields("o_orderkey", "o_totalprice")
    return warmed(spark, sf_dir, price > 450000.0, q, "partial", source_scans=1)


_NULLABLE = "case when c_acctbal < 0 then null else c_acctbal end as bal"


def customers(spark: SparkSession, sf_dir: str, writable: bool = False, **more) -> Resource:
    return cached(spark, "customer", table(spark, sf_dir, "customer", _NULLABLE), ("c_custkey",), writable, **more)


@query(f"select *, {_NULLABLE} from customer")
def read_remainder_nulls(spark, sf_dir):
    r = customers(spark, sf_dir)
    e = Engine(spark, r)
    e.read(Query("customer", attr("bal") > 5000.0))
    out = e.read(Query("customer"))
    went(e, "partial")
    return out


@query(f"select *, {_NULLABLE} from customer where c_acctbal < 0")
def read_hit_is_nil(spark, sf_dir):
    r = customers(spark, sf_dir)
    e = Engine(spark, r)
    e.read(Query("customer", attr("bal").is_nil() | (attr("bal") < 100.0)))
    out = e.read(Query("customer", attr("bal").is_nil()))
    went(e, "hit")
    return out


@query(
    f"with c as (select *, {_NULLABLE} from customer) select count(*) filter (where bal > 1000 and bal <= 4000 or c_mktsegment in ('BUILDING', 'AUTOMOBILE') "
    "or bal is null and c_nationkey <> 3) as held, count(*) - count(*) filter (where bal > 1000 and bal <= 4000 or c_mktsegment in ('BUILDING', 'AUTOMOBILE') "
    "or bal is null and c_nationkey <> 3) as missed, 0 as twice from c"
)
def read_complement_partition(spark, sf_dir):
    df = table(spark, sf_dir, "customer", _NULLABLE)
    bal, segment, nation = attr("bal"), attr("c_mktsegment"), attr("c_nationkey")
    p = ((bal > 1000.0) & (bal <= 4000.0)) | segment.isin("BUILDING", "AUTOMOBILE") | (bal.is_nil() & (nation != 3))
    n = normalise(p, {f.name: f.dataType.simpleString() for f in df.schema.fields})
    c, rest = to_column(region(n.disjuncts)), to_column(complement(n.disjuncts))
    return df.agg(F.count_if(c).alias("held"), F.count_if(rest).alias("missed"), F.count_if(c & rest).cast("int").alias("twice"))


BIG = Calculation("is_big", "o_totalprice >= 300000")


@query("select *, o_totalprice >= 300000 as is_big from orders where o_totalprice > 200000")
def read_local_calc(spark, sf_dir):
    return warmed(spark, sf_dir, price > 200000.0, Q.where(price > 200000.0).load("is_big"), "local", "hit", calculations={"is_big": BIG})


@query("select *, o_totalprice >= 300000 as is_big from orders where o_totalprice > 200000")
def read_cold_source_calc(spark, sf_dir):
    q = Q.where(price > 200000.0).load("is_big")
    big = Calculation("is_big", BIG.sql, source_only=True)
    return warmed(spark, sf_dir, price > 490000.0, q, "miss", "backfill", source_scans=1, calculations={"is_big": big})


@query("select *, o_totalprice >= 300000 as is_big from orders where o_totalprice > 200000")
def read_merged_calc(spark, sf_dir):
    q = Q.where(price > 200000.0).load("is_big")
    return warmed(spark, sf_dir, price > 200000.0, q, "hit", "merged", source_scans=1, calculations={"is_big": BIG}, local_evaluation=False)


@query("select *, o_totalprice >= 300000 as is_big from orders where o_totalprice > 200000 and o_orderkey % 7 <> 0")
def read_stale_cache_fallthrough(spark, sf_dir):
    e, r = orders(spark, sf_dir, writable=True, calculations={"is_big": BIG}, local_evaluation=False)
    e.read(Q.where(price > 200000.0))
    r.source.delete(r.source.scan().where("o_orderkey % 7 = 0"))  # behind the cache's back
    out = e.read(Q.where(price > 200000.0).load("is_big"))
    check(e.telemetry.last().metadata["reason"] == "stale_cache", "the stale cache went unseen")
    return out


@query("select *, o_totalprice >= 300000 as is_big from orders where o_totalprice > 480000 order by is_big, o_orderkey limit 10")
def read_calc_sort_source(spark, sf_dir):
    q = Q.where(price > 480000.0).load("is_big").order("is_big", "o_orderkey").take(10)
    return warmed(spark, sf_dir, price > 200000.0, q, "miss", source_scans=1, calculations={"is_big": Calculation("is_big", BIG.sql, source_only=True)})


@query("select * from orders where o_totalprice > 300000 and o_orderstatus in ('O', 'P') and o_orderpriority <> '5-LOW'")
def read_sql_front_end(spark, sf_dir):
    from strata.functions.predicate import parse

    text = "300000D < o_totalprice and o_orderstatus in ('O', 'P') and o_orderpriority != '5-LOW'"
    return warmed(spark, sf_dir, price > 100000.0, Q.where(parse(spark, text)), "hit")


@query("select * from orders where o_totalprice > 490000")
def read_forced_source(spark, sf_dir):
    return warmed(spark, sf_dir, price > 100000.0, Q.where(price > 490000.0).read_from("source"), "forced", source_scans=1)


@query("select * from orders where o_totalprice > 490000")
def read_lock_source(spark, sf_dir):
    return warmed(spark, sf_dir, price > 100000.0, Query("orders", price > 490000.0, lock=True), "miss", source_scans=1)


@query("select * from orders where false")
def read_unsatisfiable(spark, sf_dir):
    return warmed(spark, sf_dir, price > 490000.0, Q.where((price > 5.0) & (price < 4.0)), "hit")


@query("select * from orders where o_totalprice > 490000")
def kill_switch_read(spark, sf_dir):
    e, r = orders(spark, sf_dir)
    e.read(Q.where(price > 100000.0))
    e.disable("orders")
    before = r.source.scans
    out = e.read(Q.where(price > 490000.0))
    check(r.source.scans == before + 1, "the cache answered")
    return out


# ------------------------------------------------------------------------------------------------ aggregates


def parents(spark: SparkSession, sf_dir: str, *aggregates: Aggregate, **more) -> Engine:
    links = {"orders": Relationship("orders", "c_custkey", "o_custkey")}
    parent = customers(spark, sf_dir, relationships=links, aggregates={a.name: a for a in aggregates}, **more)
    return Engine(spark, parent, cached(spark, "orders", table(spark, sf_dir, "orders"), ("o_orderkey",)))


def _aggregated(spark, sf_dir, *aggregates: Aggregate, fold: bool = True) -> DataFrame:
    e = parents(spark, sf_dir, *aggregates, join_aggregates=not fold)
    if fold:
        e.read(Q)
    e.read(Query("customer"))
    e.telemetry.events.clear()
    out = e.read(Query("customer").fields("c_custkey").with_aggregates(*[a.name for a in aggregates]))
    went(e, "hit", "aggregate_fold" if fold else "aggregate_join")
    return out


_COUNTS = "select c_custkey, cast(coalesce(n, 0) as bigint) as n_orders from customer left join (select o_custkey, count(*) n from orders {} group by 1) on c_custkey = o_custkey"


@query(_COUNTS.format(""))
def agg_fold_count(spark, sf_dir):
    return _aggregated(spark, sf_dir, Aggregate("n_orders", "count", "orders"))


@query(_COUNTS.format(""))
def agg_join_count(spark, sf_dir):
    return _aggregated(spark, sf_dir, Aggregate("n_orders", "count", "orders"), fold=False)


@query(_COUNTS.format("where o_totalprice > 480000"))
def agg_filtered_count(spark, sf_dir):
    return _aggregated(spark, sf_dir, Aggregate("n_orders", "count", "orders", filter=price > 480000.0))


@query(
    "select c_custkey, n as total_cents, lo, hi, dates from customer left join (select o_custkey, cast(sum(o_orderkey) as bigint) n, min(o_totalprice) lo, "
    "max(o_totalprice) hi, avg(o_orderkey) dates from orders where o_totalprice > 480000 group by 1) on c_custkey = o_custkey"
)
def agg_sum_avg_min_max(spark, sf_dir):
    p = price > 480000.0
    return _aggregated(
        spark,
        sf_dir,
        Aggregate("total_cents", "sum", "orders", "o_orderkey", p),
        Aggregate("lo", "min", "orders", "o_totalprice", p),
        Aggregate("hi", "max", "orders", "o_totalprice", p),
        Aggregate("dates", "avg", "orders", "o_orderkey", p),
    )


@query("select c_custkey, f as first_price from customer left join (select o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) f from orders group by 1) on c_custkey = o_custkey")
def agg_first(spark, sf_dir):
    return _aggregated(spark, sf_dir, Aggregate("first_price", "first", "orders", "o_totalprice", sort=(("o_orderdate", "asc"), ("o_orderkey", "asc"))))


@query("select c_custkey, coalesce(l, '') as statuses from customer left join (select o_custkey, string_agg(o_orderstatus, ',' order by o_orderdate desc, o_orderkey) l from orders where o_totalprice > 450000 group by 1) on c_custkey = o_custkey")
def agg_list(spark, sf_dir):
    a = Aggregate("statuses", "list", "orders", "o_orderstatus", price > 450000.0, (("o_orderdate", "desc"), ("o_orderkey", "asc")))
    return _aggregated(spark, sf_dir, a).withColumn("statuses", F.array_join("statuses", ","))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000) as has_big from customer")
def agg_exists(spark, sf_dir):
    return _aggregated(spark, sf_dir, Aggregate("has_big", "exists", "orders", filter=price > 480000.0))


@query("select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id) as labelled from documents d")
def agg_exists_zero_child(spark, sf_dir):
    links = {"labels": Relationship("labels", "doc_id", "doc_id")}
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    parent = cached(spark, "documents", docs, ("doc_id",), relationships=links, aggregates={"labelled": Aggregate("labelled", "exists", "labels")})
    e = Engine(spark, parent, cached(spark, "labels", table(spark, sf_dir, "labels"), ("doc_id",)))
    return e.read(Query("documents").fields("doc_id").with_aggregates("labelled"))


@query("select count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'O'")
def agg_top_level(spark, sf_dir):
    e, _ = orders(spark, sf_dir)
    return e.aggregate(Q.where(status == "O"), n=F.count(F.lit(1)), top=F.max("o_totalprice"))


@query(_COUNTS.format("where o_orderpriority = '1-URGENT'"))
def agg_tenant_count(spark, sf_dir):
    """Children of the query's tenant alone, from the child's cache and from its source."""
    a = Aggregate("n_orders", "count", "orders")
    links = {"orders": Relationship("orders", "c_custkey", "o_custkey")}
    parent = customers(spark, sf_dir, relationships=links, aggregates={a.name: a}, join_aggregates=False)
    e = Engine(spark, parent, cached(spark, "orders", table(spark, sf_dir, "orders"), ("o_orderkey",), tenant_attribute="o_orderpriority"))
    q = Query("customer", tenant="1-URGENT").fields("c_custkey").with_aggregates("n_orders")
    cold = e.read(q)
    went(e, "aggregate_source")
    e.read(Query("orders", tenant="1-URGENT"))
    warm = e.read(q)
    went(e, "aggregate_fold")
    check(cold.exceptAll(warm).count() == 0, "cache and source differ")
    return warm


@query("select count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'O' and o_totalprice < 300000")
def agg_top_level_base_filter(spark, sf_dir):
    e, _ = orders(spark, sf_dir, base_filter=price < 300000.0)
    return e.aggregate(Q.where(status == "O"), n=F.count(F.lit(1)), top=F.max("o_totalprice"))


# ------------------------------------------------------------------------------------------------ writes


def _written(spark, sf_dir, write, then: Query, warm=price > 300000.0, dropped: bool | None = None, **more) -> DataFrame:
    e, r = orders(spark, sf_dir, writable=True, **more)
    e.read(Q.where(warm))
    write(e, r)
    if dropped is not None:
        check((not e.ledger.entries("orders", None)) == dropped, "the wrong entries were dropped")
    e.read(then)
    e.telemetry.events.clear()
    out = e.read(then)
    went(e, "hit")
    return out


_NEW = "select -1 as o_orderkey, 7 as o_custkey, 'O' as o_orderstatus, 999999.5 as o_totalprice, timestamp '1999-09-09' as o_orderdate, '1-URGENT' as o_orderpriority"


def _new(spark: SparkSession, r: Resource) -> DataFrame:
    return spark.sql(_NEW.replace("timestamp '", "timestamp_ntz '")).select(*[F.col(f.name).cast(f.dataType) for f in r.schema.fields])


@query(f"select * from orders where o_totalprice > 300000 union all {_NEW}")
def write_create_visible(spark, sf_dir):
    return _written(spark, sf_dir, lambda e, r: e.create("orders", _new(spark, r)), Q.where(price > 300000.0), dropped=True)


@query("select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 50 = 1 then 900000.0 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 50 = 1 or o_totalprice > 300000")
def write_update_moves_in(spark, sf_dir):
    def write(e, r):
        e.update("orders", r.source.scan().where("o_orderkey % 50 = 1").select("o_orderkey", F.lit(900000.0).alias("o_totalprice")))

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=True)


@query("select * from orders where o_totalprice > 300000")
def write_update_elsewhere_keeps(spark, sf_dir):
    def write(e, r):
        e.update("orders", r.source.scan().where("o_totalprice < 10000").select("o_orderkey", F.lit("F").alias("o_orderstatus")))

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=False)


@query("select * from orders where o_totalprice > 300000 and o_orderkey % 3 <> 0")
def write_destroy(spark, sf_dir):
    return _written(spark, sf_dir, lambda e, r: e.destroy("orders", r.source.scan().where("o_orderkey % 3 = 0").select("o_orderkey")), Q.where(price > 300000.0), dropped=True)


@query(f"select * from orders where o_totalprice > 300000 union all {_NEW}")
def write_upsert_drops_partition(spark, sf_dir):
    return _written(spark, sf_dir, lambda e, r: e.upsert("orders", _new(spark, r)), Q.where(price > 300000.0), dropped=True)


@query("select * from orders where o_totalprice > 300000")
def write_upsert_skipped(spark, sf_dir):
    def write(e, r):
        same = r.source.scan().where("o_orderkey < 10").withColumn("o_totalprice", F.lit(1.0))
        e.upsert("orders", same, condition="new.o_totalprice > old.o_totalprice")

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=False)


@query(f"select * from orders where o_totalprice > 300000 union all {_NEW}")
def write_propagation_failure(spark, sf_dir):
    def write(e, r):
        r.cache.fail = {"upsert"}
        e.create("orders", _new(spark, r))
        check("failed_at_layer" in e.telemetry.kinds("write"), "no failure was reported")
        r.cache.fail = None

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=True)


@query(
    "with b as (select min(o_totalprice) lo, max(o_totalprice) hi, bool_or(o_orderstatus = 'P') p from orders where o_orderkey <= 40), "
    "x(entry, lower, upper) as (values (0, 0, 50000), (1, 50000, 100000), (2, 100000, 200000), (3, 200000, 400000), (4, 400000, 500001)) "
    "select entry, exists (select 1 from orders where o_orderkey <= 40 and o_totalprice >= lower and o_totalprice < upper) as dropped from x "
    "union all select 5, p from b"
)
def invalidate_row_aware_counts(spark, sf_dir):
    e, r = orders(spark, sf_dir, writable=True)
    bounds = [(0.0, 50000.0), (50000.0, 100000.0), (100000.0, 200000.0), (200000.0, 400000.0), (400000.0, 500001.0)]
    filters = [(price >= lo) & (price < hi) for lo, hi in bounds] + [status == "P"]
    for p in filters:
        e.read(Q.where(p))
    ids = {normalise(p, r.types): i for i, p in enumerate(filters)}
    e.destroy("orders", r.source.scan().where("o_orderkey <= 40").select("o_orderkey"))
    left = {ids[x.normal] for x in e.ledger.entries("orders", None)}
    return spark.createDataFrame([(i, i not in left) for i in range(len(filters))], "entry int, dropped boolean")


@query("select * from orders where o_totalprice > 300000 and o_orderkey % 11 <> 0")
def forget_pk(spark, sf_dir):
    def write(e, r):
        gone = r.source.scan().where("o_orderkey % 11 = 0").select("o_orderkey")
        r.source.inner.delete(gone)
        e.forget("orders", gone)

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=True)


@query("select * from orders where o_totalprice > 300000 and o_orderkey % 13 <> 0")
def external_change(spark, sf_dir):
    def write(e, r):
        gone = r.source.scan().where("o_orderkey % 13 = 0").select("o_orderkey")
        r.source.inner.delete(gone)
        e.on_external_change("orders", gone)

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=True)


@query("select * from orders where o_totalprice > 300000 and o_orderkey % 17 <> 0")
def external_gap(spark, sf_dir):
    def write(e, r):
        r.source.inner.delete(r.source.scan().where("o_orderkey % 17 = 0"))
        e.on_external_gap("orders")

    return _written(spark, sf_dir, write, Q.where(price > 300000.0), dropped=True)


@query("select * from orders where o_totalprice > 300000 and o_orderkey % 19 <> 0")
def reconcile_ghosts(spark, sf_dir):
    e, r = orders(spark, sf_dir, writable=True)
    e.read(Q.where(price > 300000.0).fields("o_orderkey"))
    r.source.inner.delete(r.source.scan().where("o_orderkey % 19 = 0"))
    e.read(Q.where(price > 300000.0))  # more fields: a miss, which finds rows in the cache that the source no longer has
    e.read(Q.where(price > 300000.0))
    e.telemetry.events.clear()
    out = e.read(Q.where(price > 300000.0))
    went(e, "hit")
    return out


@query("select o_orderkey, 'missing' as side from orders where o_orderkey % 10 = 0 and o_orderkey % 15 <> 0 union all select o_orderkey, 'extra' from orders where o_orderkey % 15 = 0 and o_orderkey % 10 <> 0")
def divergence_delta(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return Engine.divergence(df.where("o_orderkey % 15 = 0"), df.where("o_orderkey % 10 = 0"), ["o_orderkey"])


@query("select * from orders where o_orderpriority = '1-URGENT' and o_totalprice > 200000")
def tenant_isolation(spark, sf_dir):
    e, r = orders(spark, sf_dir, tenant_attribute="o_orderpriority")
    q = Q.where(price > 200000.0)
    e.read(q.for_tenant("2-HIGH"))
    check(e.covers(q.for_tenant("1-URGENT"))[0] is None, "one tenant's rows answer another's query")
    e.read(q.for_tenant("1-URGENT"))
    e.telemetry.events.clear()
    out = e.read(q.for_tenant("1-URGENT"))
    went(e, "hit")
    return out


@query("select * from (values ('1-URGENT', 0), ('2-HIGH', 1), ('all', 0)) t(tenant, entries)")
def tenant_global_sweep(spark, sf_dir):
    e, r = orders(spark, sf_dir, writable=True, tenant_attribute="o_orderpriority", tenant_global=True)
    q = Q.where(price > 200000.0)
    for t in ("1-URGENT", "2-HIGH", None):
        e.read(q.for_tenant(t))
    e.destroy("orders", r.source.scan().where("o_orderpriority = '1-URGENT'").select("o_orderkey"), tenant="1-URGENT")
    rows = [(t or "all", len(e.ledger.entries("orders", t))) for t in ("1-URGENT", "2-HIGH", None)]
    return spark.createDataFrame(rows, "tenant string, entries int")


@query("select * from (values ('1-URGENT', 0), ('2-HIGH', 1)) t(tenant, entries)")
def tenant_local_sweep(spark, sf_dir):
    """Where no read spans tenants, a tenant's write sweeps its own partition only."""
    e, r = orders(spark, sf_dir, writable=True, tenant_attribute="o_orderpriority")
    q = Q.where(price > 200000.0)
    for t in ("1-URGENT", "2-HIGH"):
        e.read(q.for_tenant(t))
    e.destroy("orders", r.source.scan().select("o_orderkey"), tenant="1-URGENT")
    return spark.createDataFrame([(t, len(e.ledger.entries("orders", t))) for t in ("1-URGENT", "2-HIGH")], "tenant string, entries int")


@query("select * from orders where not (o_orderkey % 3 = 0 and o_orderpriority = '1-URGENT')")
def write_tenant_scope(spark, sf_dir):
    """Keys of all tenants are given; only the rows of the write's tenant go."""
    e, r = orders(spark, sf_dir, writable=True, tenant_attribute="o_orderpriority")
    e.destroy("orders", r.source.scan().where("o_orderkey % 3 = 0").select("o_orderkey"), tenant="1-URGENT")
    return r.source.scan()


@query("select * from (values ('a', true), ('b', false), ('c', true), ('d', true)) t(name, covered)")
def ledger_lru(spark, sf_dir):
    e, r = orders(spark, sf_dir, ledger_cap=3)
    of = {n: Q.where(key == i) for i, n in enumerate("abcd", 1)}
    for n in ("a", "b", "c", "a", "d"):  # the second a is a hit, so b is the one not used for longest
        e.read(of[n])
    return spark.createDataFrame([(n, e.covers(q)[0] is not None) for n, q in of.items()], "name string, covered boolean")


@query("select l_linestatus, l_returnflag, l_shipdate, l_id from (select row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as l_id, * from lineitem) where l_quantity > 49 and l_discount = 0.05")
def read_hit_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    # A total order over equal-looking rows, for the test tables alone; nulls come last, as in the SQL.
    df = placed(df, "_place", *[F.col(c).asc_nulls_last() for c in df.columns], name="lineitem").select("*", (F.col("_place") + 1).alias("l_id")).drop("_place")
    r = cached(spark, "lineitem", df, ("l_id",))
    e = Engine(spark, r)
    e.read(Query("lineitem", attr("l_quantity") > 40.0))
    out = e.read(Query("lineitem", (attr("l_quantity") > 49.0) & (attr("l_discount") == 0.05)).fields("l_id", "l_returnflag", "l_linestatus", "l_shipdate"))
    went(e, "hit")
    return out


@query("select * from conversations where role = 'user' and turn <= 3")
def read_hit_composite_key(spark, sf_dir):
    r = cached(spark, "conversations", table(spark, sf_dir, "conversations"), ("conv_id", "turn"))
    e = Engine(spark, r)
    e.read(Query("conversations", attr("turn") <= 5))
    out = e.read(Query("conversations", (attr("turn") <= 3) & (attr("role") == "user")))
    went(e, "hit")
    return out


# ------------------------------------------------------------------------------------------------ the outbox


def boxed(spark: SparkSession, sf_dir: str, **options) -> tuple[Engine, Resource, Outbox]:
    """A local layer and a target that start as the same rows of ``orders``."""
    df = table(spark, sf_dir, "orders")
    local = SnapshotLayer("local", spark, df.schema, ("o_orderkey",), "files", df)
    remote = CountingLayer(SnapshotLayer("remote", spark, df.schema, ("o_orderkey",), "files", df))
    o = OutboxOptions(targets=("remote",), **options)
    r = Resource("orders", df.schema, ("o_orderkey",), {"local": local, "remote": remote}, ("local",), ("local",), OUTBOX, outbox=o)
    e = Engine(spark, r)
    return e, r, e.outbox("orders")


def _set(r: Resource, where: str, **values) -> DataFrame:
    return r.layers["local"].scan().where(where).select("o_orderkey", *[F.lit(v).alias(c) for c, v in values.items()])


_ALL = "orders where true"


@query(f"select o_orderkey, op, state from (select o_orderkey, 'update' as op, 'pending' as state from {_ALL} and o_orderkey % 5 = 0 union all select o_orderkey, 'destroy', 'pending' from {_ALL} and o_orderkey % 10 = 0)")
def outbox_pending(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir)
    e.update("orders", _set(r, "o_orderkey % 5 = 0", o_totalprice=1.0))
    e.destroy("orders", _set(r, "o_orderkey % 10 = 0"))
    return box.pending().select(F.get_json_object("record_pk", "$.o_orderkey").cast("long").alias("o_orderkey"), "op", "state")


@query(
    f"select o_orderkey, position from (select o_orderkey, 'head' as position from {_ALL} and o_orderkey % 5 = 0 "
    f"union all select o_orderkey, 'racing' from {_ALL} and o_orderkey % 10 = 0 union all select o_orderkey, 'racing' from {_ALL} and o_orderkey % 20 = 0)"
)
def outbox_chain_heads(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir)
    for n in (5, 10, 20):
        e.update("orders", _set(r, f"o_orderkey % {n} = 0", o_totalprice=float(n)))
    return box.heads().select(F.get_json_object("record_pk", "$.o_orderkey").cast("long").alias("o_orderkey"), "position")


_CONVERGED = (
    "select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 10 = 0 then 10.0 when o_orderkey % 5 = 0 then 5.0 else o_totalprice end as o_totalprice, "
    f"o_orderdate, o_orderpriority from {_ALL} and o_orderkey % 20 <> 0"
)


@query(_CONVERGED)
def outbox_flush_converges(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir)
    for n in (5, 10):
        e.update("orders", _set(r, f"o_orderkey % {n} = 0", o_totalprice=float(n)))
    e.destroy("orders", _set(r, "o_orderkey % 20 = 0"))
    check(box.flush() == 3, "one round for each link of the longest chain")
    check(Engine.divergence(r.layers["local"].scan(), r.layers["remote"].scan(), r.primary_key).count() == 0, "not converged")
    return r.layers["remote"].scan()


@query(f"select o_orderkey, case when o_orderkey % 10 = 0 then 'parked' else 'synced' end as status from {_ALL} and o_orderkey % 5 = 0")
def outbox_parked_blocks(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir, stale_field="o_orderstatus")
    r.layers["remote"].inner.upsert(r.layers["remote"].scan().where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")))
    e.update("orders", _set(r, "o_orderkey % 5 = 0", o_totalprice=5.0))
    e.update("orders", _set(r, "o_orderkey % 10 = 0", o_totalprice=10.0))
    box.flush()
    blocked = box.heads().where("position = 'blocked'").count()
    check(blocked == box.parked().count() > 0, "entries behind a parked one must wait")
    return box.statuses().select(F.get_json_object("record_pk", "$.o_orderkey").cast("long").alias("o_orderkey"), "status")


def _conflict(spark, sf_dir) -> tuple[Engine, Resource, Outbox, int]:
    e, r, box = boxed(spark, sf_dir, stale_field="o_orderstatus")
    r.layers["remote"].inner.upsert(r.layers["remote"].scan().where("o_orderkey = 20").withColumn("o_orderstatus", F.lit("X")))
    e.update("orders", _set(r, "o_orderkey in (20, 30)", o_totalprice=5.0))
    box.flush()
    return e, r, box, box.parked().first().seq


_SET = f"select o_orderkey, o_custkey, {{status}} as o_orderstatus, {{price}} as o_totalprice, o_orderdate, o_orderpriority from {_ALL}"


@query(_SET.format(status="case when o_orderkey = 20 then 'X' else o_orderstatus end", price="case when o_orderkey = 30 then 5.0 else o_totalprice end"))
def outbox_conflict_stale_check(spark, sf_dir):
    e, r, box, seq = _conflict(spark, sf_dir)
    row = box.parked().first()
    check((row.state, row.error_class) == (PARKED, CONFLICT) and '"X"' in row.remote_snapshot, "no conflict was seen")
    return r.layers["remote"].scan()


@query(_SET.format(status="o_orderstatus", price="case when o_orderkey in (20, 30) then 5.0 else o_totalprice end"))
def outbox_force(spark, sf_dir):
    e, r, box, seq = _conflict(spark, sf_dir)
    box.force(seq)
    return r.layers["remote"].scan()


@query(_SET.format(status="case when o_orderkey = 20 then 'X' else o_orderstatus end", price="case when o_orderkey = 30 then 5.0 else o_totalprice end"))
def outbox_discard_local(spark, sf_dir):
    e, r, box, seq = _conflict(spark, sf_dir)
    box.discard_local(seq)
    check(box.parked().count() == 0, "the chain is still there")
    return e.read(Q)


@query(_SET.format(status="o_orderstatus", price="case when o_orderkey = 20 then 77.0 when o_orderkey = 30 then 5.0 else o_totalprice end"))
def outbox_rebase(spark, sf_dir):
    e, r, box, seq = _conflict(spark, sf_dir)
    box.rebase(seq, _set(r, "o_orderkey = 20", o_totalprice=77.0))
    check(box.parked().count() == 0 and box.pending().count() == 0, "the new write did not go through")
    return r.layers["remote"].scan()


@query(_SET.format(status="case when o_orderkey % 4 = 0 and o_orderkey % 20 <> 0 then 'R' else o_orderstatus end", price="case when o_orderkey % 20 = 0 then 5.0 else o_totalprice end") + " and o_orderkey % 7 <> 0")
def outbox_refresh_skip_dirty(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir)
    e.update("orders", _set(r, "o_orderkey % 20 = 0 and o_orderkey % 7 <> 0", o_totalprice=5.0))
    remote = r.layers["remote"].inner
    remote.upsert(remote.scan().where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("R")))
    remote.delete(remote.scan().where("o_orderkey % 7 = 0"))
    counts = box.refresh()
    check(counts["skipped_dirty"] > 0 and counts["deleted"] > 0, f"{counts}")
    return e.read(Q)


@query(f"select * from {_ALL} and o_orderkey % 2 = 0")
def outbox_hydrate(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir, hydrate="on_start")
    r.layers["remote"].inner.delete(r.layers["remote"].scan().where("o_orderkey % 2 = 1"))
    e.start()
    return e.read(Q)


@query(_SET.format(status="o_orderstatus", price="case when o_orderkey % 9 = 0 then 9.0 else o_totalprice end"))
def outbox_write_through(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir, mode="write_through")
    e.update("orders", _set(r, "o_orderkey % 9 = 0", o_totalprice=9.0))
    check(box.entries.is_empty, "a write through leaves no entry")
    return r.layers["remote"].scan()


class Picky(CountingLayer):
    """A target that finds negative prices invalid, and says so of the batch as a whole."""

    def upsert(self, rows: DataFrame, fields=None) -> None:
        if rows.where("o_totalprice < 0").limit(1).count():
            raise Rejected("a price is negative")
        super().upsert(rows, fields)


@query(f"select o_orderkey, case when o_orderkey = 20 then 'parked' else 'synced' end as status from {_ALL} and o_orderkey % 5 = 0")
def outbox_one_rejected_row(spark, sf_dir):
    e, r, box = boxed(spark, sf_dir)
    r.layers["remote"] = Picky(r.layers["remote"].inner)
    e.update("orders", _set(r, "o_orderkey % 5 = 0", o_totalprice=5.0).withColumn("o_totalprice", F.expr("if(o_orderkey = 20, -1.0d, 5.0d)")))
    box.flush()
    check([x.error_class for x in box.parked().collect()] == ["rejected"], "one row is invalid")
    return box.statuses().select(F.get_json_object("record_pk", "$.o_orderkey").cast("long").alias("o_orderkey"), "status")


@query(_SET.format(status="o_orderstatus", price="case when o_orderkey % 10 = 0 then 7.0 when o_orderkey % 5 = 0 then 5.0 else o_totalprice end"))
def outbox_restart_resumes(spark, sf_dir):
    """Local rows and entries are opened again from the manifest by a process that knows nothing else."""
    import uuid

    from strata.sources.layers import shared_dir

    store = f"{shared_dir(spark)}/strata-outbox-{uuid.uuid4().hex}"
    e, r, _ = boxed(spark, sf_dir, store=store)
    e.update("orders", _set(r, "o_orderkey % 5 = 0", o_totalprice=5.0))
    df = r.layers["local"].scan()
    layers = {"local": SnapshotLayer("local", spark, df.schema, ("o_orderkey",), "files"), "remote": r.layers["remote"]}
    again = Resource("orders", df.schema, ("o_orderkey",), layers, ("local",), ("local",), OUTBOX, outbox=OutboxOptions(targets=("remote",), store=store))
    after = Engine(spark, again)
    check(after.outbox("orders").pending().count() > 0, "the entries are lost")
    after.update("orders", _set(again, "o_orderkey % 10 = 0", o_totalprice=7.0))
    check(after.outbox("orders").flush() == 2, "two links of the longest chain")
    check(Engine.divergence(layers["local"].scan(), layers["remote"].scan(), again.primary_key).count() == 0, "not converged")
    return layers["remote"].scan()


# ------------------------------------------------------------------------------------------------ proofs as tables


def _r(lo=None, hi=None, lo_in=False, hi_in=False, tag="int") -> Interval:
    return Interval("range", tag, (), lo, hi, lo_in, hi_in)


_INTERVALS = {
    "nil": Interval("is_nil", "int"),
    "any": Interval("not_nil", "int"),
    "eq3": Interval("eq", "int", (3,)),
    "in135": Interval("in", "int", (1, 3, 5)),
    "ne3": Interval("not_eq", "int", (3,)),
    "gt2": _r(2),
    "le3": _r(None, 3, hi_in=True),
}


@query(
    "select * from (values ('nil', 'eq3', 'unsatisfiable'), ('any', 'gt2', 'range'), ('eq3', 'gt2', 'eq'), ('eq3', 'ne3', 'unsatisfiable'), ('in135', 'gt2', 'in'), "
    "('in135', 'le3', 'in'), ('gt2', 'le3', 'range'), ('ne3', 'gt2', 'opaque'), ('ne3', 'ne3', 'not_eq'), ('nil', 'nil', 'is_nil'), ('in135', 'eq3', 'eq')) t(a, b, result)"
)
def interval_merge_table(spark, sf_dir):
    pairs = ["nil eq3", "any gt2", "eq3 gt2", "eq3 ne3", "in135 gt2", "in135 le3", "gt2 le3", "ne3 gt2", "ne3 ne3", "nil nil", "in135 eq3"]
    rows = []
    for a, b in map(str.split, pairs):
        got, back = conjunction(_INTERVALS[a], _INTERVALS[b]), conjunction(_INTERVALS[b], _INTERVALS[a])
        check(got == back, f"{a} and {b} differ from {b} and {a}")
        rows.append((a, b, got if isinstance(got, str) else got.kind))
    check(conjunction(_r(tag="int"), _r(tag="bigint")) == OPAQUE, "types differ")
    return spark.createDataFrame(rows, "a string, b string, result string")


@query(
    "select * from (values ('x > 5', 'x > 3', true), ('x > 3', 'x > 5', false), ('x = 4', 'x > 3', true), ('x in (1, 3)', 'x = 1 or x = 3', false), "
    "('x = 1 or x = 3', 'x in (1, 3)', true), ('x is null', 'x is not null', false), ('x > 5', 'x is not null', true), ('x > 5', 'x > 5 and s = ''a''', false), "
    "('x > 5 and s = ''a''', 'x > 5', true), ('s > ''a''', 's > ''a''', true), ('s > ''b''', 's > ''a''', false), ('x <> 3', 'x <> 4', false), ('x + 1 > 2', 'x + 1 > 2', false)) t(a, b, implied)"
)
def implication_matrix(spark, sf_dir):
    from strata.functions.predicate import parse

    pairs = [
        ("x > 5", "x > 3"), ("x > 3", "x > 5"), ("x = 4", "x > 3"), ("x in (1, 3)", "x = 1 or x = 3"), ("x = 1 or x = 3", "x in (1, 3)"), ("x is null", "x is not null"),
        ("x > 5", "x is not null"), ("x > 5", "x > 5 and s = 'a'"), ("x > 5 and s = 'a'", "x > 5"), ("s > 'a'", "s > 'a'"), ("s > 'b'", "s > 'a'"), ("x <> 3", "x <> 4"),
        ("x + 1 > 2", "x + 1 > 2"),
    ]
    n = lambda text: normalise(parse(spark, text), {"x": "int", "s": "string"})
    return spark.createDataFrame([(a, b, implies(n(a), n(b))) for a, b in pairs], "a string, b string, implied boolean")


@query("select * from orders where o_totalprice > 300000 and o_orderkey not in (select event_id from events)")
def stream_external_changes(spark, sf_dir):
    """Keys of a change stream (the events) invalidate what is cached; here those orders are gone from the source."""
    import uuid

    from strata.sources.layers import shared_dir
    from strata.streaming.feed import follow

    e, r = orders(spark, sf_dir, writable=True)
    e.read(Q.where(price > 300000.0))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    r.source.inner.delete(events.select(F.col("event_id").alias("o_orderkey")))
    root = f"{shared_dir(spark)}/strata-feed-{uuid.uuid4().hex}"
    events.select(F.col("event_id").alias("o_orderkey"), F.lit("remote").alias("origin")).write.parquet(f"{root}/changes")
    stream = spark.readStream.schema("o_orderkey long, origin string").parquet(f"{root}/changes")
    follow(e, "orders", stream, f"{root}/state").awaitTermination()
    check(not e.ledger.entries("orders", None), "the stream did not invalidate")
    e.read(Q.where(price > 300000.0))
    e.telemetry.events.clear()
    out = e.read(Q.where(price > 300000.0))
    went(e, "hit")
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_hit_narrower_range(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

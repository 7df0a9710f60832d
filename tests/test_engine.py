import datetime as dt
import itertools
import math
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone import catalogue
from siltstone.functions.predicates import QueryError, condition
from siltstone.operators import bloom, zonemap
from siltstone.plans import workload
from siltstone.plans.ast import Feature
from siltstone.plans.parser import parse_filter, parse_query
from siltstone.plans.query import query_parquet, run
from siltstone.sources import footer, layout, scan
from siltstone.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    plain = lambda d: d.apply(lambda c: c.astype("datetime64[us]").astype(str) if str(c.dtype).startswith("datetime") else c.astype(float) if c.dtype.kind in "iuf" else c)
    assert rows(plain(got)) == rows(plain(want))


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, True, "a", 1.0), (None, None, None, None), (3, False, "c", nan), (5, True, "z", inf), (-2, None, "", -inf), (7, False, None, 2.5)]
    return spark.createDataFrame(rows, "i int, b boolean, s string, f double")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("i > 1", {3, 5, 7}), ("i >= 1", {1, 3, 5, 7}), ("i == 3", {3}), ("i < 1", {-2}), ("i <= 1", {1, -2}),
        ("NOT i > 1", {1, -2}),
        ("f > 1.0", {5, 7}), ("f >= 1.0", {1, 5, 7}), ("f < 2.0", {1, -2}), ("NOT f > 1.0", {1, 3, -2}), ("f == 2.5", {7}),
        ("b == true", {1, 5}), ("b < true", {3, 7}), ("b >= false", {1, 3, 5, 7}),
        ("s == a", {1}), ("s > b", {3, 5}), ("s < b", {1, -2}),
        ("b == true OR i > 4", {1, 5, 7}), ("b == true AND i > 4", {5}),
    ],
)
def test_filters(odd, text, ids):
    assert {r.i for r in odd.where(condition(parse_filter(text), odd.schema)).collect()} == ids


def test_strict_null(odd):
    # b is null where i = -2: SQL lets "null OR true" through, the strict mode doesn't
    f = parse_filter("b == true OR i < 0")
    assert {r.i for r in odd.where(condition(f, odd.schema)).collect()} == {1, 5, -2}
    assert {r.i for r in odd.where(condition(f, odd.schema, strict_null=True)).collect()} == {1, 5}
    f = parse_filter("NOT (b == true AND i > 100)")
    assert {r.i for r in odd.where(condition(f, odd.schema)).collect()} == {1, 3, 5, 7, -2}
    assert {r.i for r in odd.where(condition(f, odd.schema, strict_null=True)).collect()} == {1, 3, 5, 7}


@pytest.mark.parametrize("text", ["i > 1.5", "f > 1", "s > 1", "b == 1", "i == x", "missing > 1", "f == true"])
def test_type_errors(odd, text):
    with pytest.raises(QueryError):
        condition(parse_filter(text), odd.schema)


def test_coerce(odd):
    assert odd.where(condition(parse_filter("f > 1 AND i > 1.5"), odd.schema, coerce=True)).count() == 2


def test_types(spark, tmp_path):
    t = pa.table({
        "u8": pa.array([0, 255], pa.uint8()), "u16": pa.array([0, 65535], pa.uint16()), "u32": pa.array([0, 2**32 - 1], pa.uint32()), "u64": pa.array([0, 2**64 - 1], pa.uint64()),
        "i8": pa.array([-1, 1], pa.int8()), "f32": pa.array([0.5, 1.5], pa.float32()), "d": pa.array([dt.date(2020, 1, 1), dt.date(2021, 1, 1)]),
        "ts": pa.array([dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)], pa.timestamp("us")), "dec": pa.array([1, 2], pa.decimal128(10, 2)), "l": pa.array([[1], [2]]),
    })
    pq.write_table(t, tmp_path / "t.parquet")
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    for text in ("u8 > 1", "u16 > 1", "u32 > 2147483648", "u64 > 9223372036854775807", "i8 > 0", "f32 > 1.0", "d > 2020-6-1-0:0:0", "ts > 2020-6-1-0:0:0", "ts > 1590969600000", "NOT u64 <= 5"):
        assert df.where(condition(parse_filter(text), df.schema)).count() == 1, text
        assert zonemap.prune(df, parse_filter(text), F.lit(0)).count() == 2, text
    for text in ("dec > 1", "l > 1", "l == x"):
        with pytest.raises(QueryError):
            condition(parse_filter(text), df.schema)
    got = run(df, parse_query("", "", "SUM(u8),MAX(u64),COUNT(d),MIN(f32),SUM(dec)"), "aggr").aggregates
    assert got.columns == ["SUM(u8)", "MAX(u64)", "MIN(f32)"]
    assert tuple(got.first()) == (255, 2**64 - 1, 0.5)


def test_aggregates(spark, odd):
    got = run(odd, parse_query("", "", "SUM(i),AVG(i),COUNT(i),MIN(i),MAX(i),MIN(f),MAX(f),COUNT(f),SUM(f),COUNT(s),MAX(b),SUM(none)"), "aggr").aggregates
    assert got.columns == ["SUM(i)", "AVG(i)", "COUNT(i)", "MIN(i)", "MAX(i)", "MIN(f)", "MAX(f)", "COUNT(f)", "SUM(f)"]
    r = got.first()
    assert tuple(r)[:8] == (14, 2.8, 5, -2, 7, -math.inf, math.inf, 5) and math.isnan(r[8])
    assert dict(got.dtypes)["MIN(i)"] == "bigint"
    empty = run(odd, parse_query("i > 100", "", "SUM(i),SUM(f),AVG(i),COUNT(i),MIN(f)"), "aggr").aggregates
    assert tuple(empty.first()) == (0, 0.0, None, 0, None)
    nan = spark.createDataFrame([(math.nan,)], "f double")
    assert tuple(run(nan, parse_query("", "", "MIN(f),MAX(f)"), "aggr").aggregates.first()) == (None, None)
    assert run(odd, parse_query("", "", "COUNT(s)"), "aggr").aggregates.columns == []
    assert run(odd, parse_query("", "", "COUNT(s),MAX(s)"), "aggr", extended=True).aggregates.first()[0] == 4


def test_demo(spark, tmp_path):
    rows = [("Alice", 10, False), ("Bob", 60, False), ("Charlie", 30, True), ("Dave", -30, False), ("Eve", 50, True), ("Frank", 0, True)]
    df = spark.createDataFrame(rows, "Name string, Age tinyint, Graduated boolean").coalesce(1)
    layout.write_groups(df, str(tmp_path / "demo"), rows=2)
    path = str(tmp_path / "demo")
    got = query_parquet(spark, path, "", "Age", "AVG(Age),MAX(Age),MIN(Age),COUNT(Age),SUM(Age)")
    assert tuple(got.aggregates.first()) == (20.0, 60, -30, 6, 120) and got.rows.columns == ["Age"]
    assert {r.Name for r in query_parquet(spark, path, "Age < 10", mode="row").rows.collect()} == {"Dave", "Frank"}
    assert query_parquet(spark, path, "Age < 10", "Name", mode="column").rows.columns == ["Name"]
    assert run(spark.read.parquet(path), parse_query("Age < 10"), "group", rows_per_group=2).rows.count() == 4


def test_modes_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    q = parse_query("o_orderkey > 500 AND NOT o_orderstatus == F", "o_orderkey", "COUNT(o_orderkey)")
    keys = {m: {r.o_orderkey for r in run(df, q, m).rows.select("o_orderkey").collect()} for m in ("none", "group", "row", "column", "aggr")}
    assert keys["row"] == keys["column"] == keys["aggr"] <= keys["group"] <= keys["none"]
    assert run(df, q, "aggr").aggregates.first()[0] == len(keys["row"])
    assert {r.o_orderkey for r in run(df, parse_query("o_orderkey == 77"), [Feature.BLOOM], rows_per_group=100).rows.collect()} >= {77}


def test_zones_lose_nothing(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, *range(20)]), rng.choice([None, math.nan, *map(float, range(9))]), rng.choice([None, "a", "b", "c"]), rng.choice([None, True, False])) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, f double, s string, b boolean").cache()
    leaves = [f"i {o} {v}" for o, v in zip(["<", "<=", "==", ">=", ">"], (1, 0, 7, 19, 18), strict=True)] + ["f > 7.0", "f == 8.0", "f < 1.0", "s == a", "s > b", "b == true", "b < true", "k < 30", "k > 390", "k == 77"]
    for a, b in itertools.islice(itertools.product(leaves, rng.sample(leaves, 3)), 0, 45, 3):
        for text in (f"{a} AND NOT {b}", f"NOT ({a} OR {b})"):
            f = parse_filter(text)
            passing = {r.k for r in df.where(condition(f, df.schema)).collect()}
            assert passing <= {r.k for r in zonemap.prune(df, f, F.floor(F.col("k") / 8)).collect()}, text
    assert zonemap.prune(df, parse_filter("k < 30"), F.floor(F.col("k") / 8)).count() == 32
    got = bloom.prune_equal(df, parse_filter("i == 7"), F.floor(F.col("k") / 8), 8)
    assert {r.k for r in df.where("i = 7").collect()} <= {r.k for r in got.collect()} and got.count() < 400


def test_plans_push_down(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = run(df, parse_query("l_quantity > 25.0 AND l_linenumber < 3", "l_extendedprice", "SUM(l_extendedprice)"), "aggr")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = out.aggregates._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(l_quantity,25.0)" in plan and "LessThan(l_linenumber,3)" in plan
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_extendedprice:double>" in plan


def test_layout_and_footers(spark, tmp_path):
    src = str(tmp_path / "many")
    os.makedirs(src)
    for k in range(20):
        pq.write_table(pa.table({"x": list(range(k * 100, k * 100 + 100)), "s": [str(v % 7) for v in range(100)]}), f"{src}/f{k:02d}.parquet")
    pq.write_table(pa.table({"x": pa.array([], pa.int64()), "s": pa.array([], pa.string())}), f"{src}/f20.parquet")
    with open(f"{src}/f21.parquet", "wb") as f:
        f.write(b"not parquet at all")
    packed = layout.compact(spark, src, str(tmp_path / "few"), files=4, rows=150)
    done = packed.outputs
    assert len(done) == 4 and set(packed.left_out) == {f"file:{src}/f20.parquet", f"file:{src}/f21.parquet"}
    assert layout.compact(spark, str(tmp_path / "none"), str(tmp_path / "nothing")).outputs == []
    out = spark.read.parquet(*done)
    assert sorted(r.x for r in out.collect()) == list(range(2000))
    f = footer.footers(spark, done[0])
    assert f.agg(F.max("rows"), F.sum("rows")).first() == (150, 600)
    meta = pq.read_metadata(scan.list_files(spark, done[0])[0].removeprefix("file:")).row_group(0).column(1)
    assert meta.compression == "UNCOMPRESSED" and "PLAIN_DICTIONARY" not in meta.encodings and "RLE_DICTIONARY" not in meta.encodings
    layout.rewrite(spark, done[0], str(tmp_path / "again"), rows=50)
    assert footer.footers(spark, str(tmp_path / "again")).agg(F.max("rows")).first()[0] == 50
    assert footer.metadata_ratio(spark, str(tmp_path / "again")).first().row_groups == 12
    assert footer.footers(spark, str(tmp_path / "again")).where("group_meta_bytes > 100").count() == 12
    assert scan.raw_bytes(spark, done[0]).first().files == 1
    with pytest.raises(Exception, match="Parquet"):
        footer.footers(spark, src).collect()


def test_group_mode_reads_the_groups_that_stay(spark, tmp_path):
    path = str(tmp_path / "g")
    df = spark.range(5500).select("id", (F.col("id") * 1.5).alias("x"), F.concat(F.lit("s"), F.col("id")).alias("s"), F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,0,id)").alias("t"))
    layout.write_groups(df.coalesce(1), path)
    source = spark.read.parquet(path)
    for text, rows in (("id > 5400", 550), ("id < 10 OR id >= 5499", 1100), ("NOT id > 600", 1100), ("x > 8000.0", 550), ("id > 99999", 0), ("t >= 2020-01-01-01:30:00", 550), ("s == nothing", 0)):
        out = run(source, parse_query(text), "group").rows
        assert out.schema == source.schema
        got = scan.measured(out)
        assert got.rows_read == rows == out.count(), text
    whole = scan.measured(run(source, parse_query(""), "none").rows)
    assert scan.measured(run(source, parse_query("id > 5400"), "group").rows).bytes_read < 0.3 * whole.bytes_read
    pq.write_table(pa.table({"id": [1, 2]}), str(tmp_path / "g" / "other.parquet"))  # a file that lacks columns
    assert run(spark.read.schema(source.schema).parquet(path), parse_query("x > 8000.0"), "group").rows.count() == 552
    assert {r.id for r in run(source, parse_query("id == 77"), [Feature.GROUP, Feature.BLOOM]).rows.collect()} == set(range(550))
    assert "5499" in scan.console(source.where("id = 5499"))


def test_bloom_files(spark, tmp_path):
    df = spark.range(20_000).select((F.xxhash64("id") % 1000 * 2).alias("k"))
    path = str(tmp_path / "b")
    layout.write_groups(df.coalesce(1), path, rows=2000, **bloom.writer_options({"k": 1000}))
    assert scan.measured(spark.read.parquet(path).where("k = 7777777")).rows_read == 0
    assert scan.measured(spark.read.parquet(path).where("k = 101")).rows_read < 20_000


def test_measure_and_workload(spark, tmp_path, sf):
    path = str(tmp_path / "z")
    layout.write_groups(spark.range(11_000).withColumn("v", F.rand(3)).coalesce(1), path, rows=550)
    few, whole = (scan.measured(run(spark.read.parquet(path), parse_query(f), "column").rows) for f in ("id > 10900", ""))
    assert few.rows_read <= 550 < whole.rows_read == 11_000 and few.bytes_read < whole.bytes_read
    t = workload.read_thresholds("0 10999\n1 10900\n25 8000\n50 5500\n75 2700\n99 100\n")
    assert workload.filter_of("half", "id", t) == "id > 5500"
    out = workload.benchmark(spark, path, "column", workload.filter_of("real", "id", t), "id")
    assert out["files"] == 1 and out["rows_read"] <= 550
    got = dict(footer.thresholds(zonemap.zone_map(spark.range(100), F.col("id"), ["id"])).collect())
    assert got[0] == 99 and got[1] == 99 and got[50] == 50 and got[99] == 1
    stats = footer.statistics(spark, path, "id")
    assert [tuple(r) for r in stats.select("row_group", "rows", "min_0", "max_0").orderBy("row_group").limit(2).collect()] == [(0, 550, 0, 549), (1, 550, 550, 1099)]
    assert dict(footer.thresholds(stats).collect())[50] == 10 * 550 + 549


def test_stream(spark, tmp_path, sf):
    src = f"{sf}/events.parquet"
    schema = spark.read.parquet(src).schema
    pq.write_table(pq.read_table(src), os.path.join(tmp_path, "e.parquet"))
    q = parse_query("event_type == purchase AND value > 100.0", "event_id", "COUNT(event_id),SUM(event_id)")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    a = incremental.rows(stream, q).writeStream.format("memory").queryName("rows_out").trigger(availableNow=True).start()
    b = incremental.aggregates(stream, q).writeStream.format("memory").queryName("agg_out").outputMode("complete").trigger(availableNow=True).start()
    a.awaitTermination()
    b.awaitTermination()
    want = run(spark.read.parquet(src), q, "aggr")
    assert {r.event_id for r in spark.table("rows_out").collect()} == {r.event_id for r in want.rows.collect()}
    assert spark.table("agg_out").first() == want.aggregates.first()

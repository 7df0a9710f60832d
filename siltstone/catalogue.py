"""The registered queries of the scan engine and the SQL that says the same.

Most are the three strings of a query; ROUND, where a sum of floats depends on its order, belongs to the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import bloom, zonemap
from siltstone.plans.ast import Feature
from siltstone.plans.parser import parse_filter, parse_query
from siltstone.plans.query import run
from siltstone.sources import example, footer, layout, scan, scratch

#: name: (table, filter, select, aggregates)
SPECS: dict[str, tuple[str, str, str, str]] = {
    "scan_all": ("region", "", "", ""),
    "project_schema_order": ("orders", "", "o_totalprice,o_orderkey", ""),
    "filter_int32_lt": ("lineitem", "l_linenumber < 3", "l_orderkey,l_linenumber", ""),
    "filter_int64_le": ("orders", "o_orderkey <= 100", "o_orderkey", ""),
    "filter_int64_eq": ("orders", "o_custkey == 7", "o_orderkey,o_custkey", ""),
    "filter_double_gt": ("lineitem", "l_quantity > 25.0", "l_orderkey,l_quantity", ""),
    "filter_double_ge": ("lineitem", "l_discount >= 0.05", "l_orderkey,l_discount", ""),
    "filter_string_eq": ("lineitem", "l_returnflag == R", "l_orderkey,l_returnflag", ""),
    "filter_string_range": ("orders", "o_orderpriority < 3-MEDIUM", "o_orderkey,o_orderpriority", ""),
    "filter_ts_ge": ("lineitem", "l_shipdate >= 1996-01-01-00:00:00", "l_orderkey,l_shipdate", ""),
    "filter_and": ("lineitem", "l_quantity > 25.0 AND l_discount < 0.05", "l_orderkey", ""),
    "filter_or": ("lineitem", "l_quantity < 3.0 OR l_linenumber == 7", "l_orderkey", ""),
    "filter_not": ("lineitem", "NOT (l_quantity > 3.0)", "l_orderkey", ""),
    "filter_precedence": ("lineitem", "(l_linenumber >= 6) AND (l_quantity < 10.0 OR l_quantity <= 12.0) OR l_linenumber == 1", "l_orderkey", ""),
    "filter_not_and": ("orders", "NOT (o_orderkey > 100 AND o_totalprice > 1000.0)", "o_orderkey", ""),
    "filter_none_match": ("orders", "o_totalprice < 0.0", "o_orderkey", ""),
    "late_projection": ("lineitem", "l_quantity > 49.0", "l_extendedprice", ""),
    "agg_int": ("lineitem", "", "", "SUM(l_linenumber),AVG(l_linenumber),COUNT(l_linenumber),MIN(l_linenumber),MAX(l_linenumber)"),
    "agg_double": ("lineitem", "", "", "SUM(l_extendedprice),AVG(l_extendedprice),COUNT(l_extendedprice),MIN(l_extendedprice),MAX(l_extendedprice)"),
    "agg_filtered": ("lineitem", "l_quantity > 25.0", "", "SUM(l_extendedprice)"),
    "agg_empty": ("orders", "o_orderkey < 0", "", "SUM(o_orderkey),AVG(o_orderkey),COUNT(o_orderkey),MIN(o_orderkey)"),
    "agg_skips_unsupported": ("orders", "", "", "COUNT(o_orderstatus),COUNT(o_orderkey),MAX(o_orderdate),SUM(missing),COUNT(*)"),
    "workload_half": ("orders", "o_totalprice > 251488.88", "o_totalprice", ""),
    "workload_best": ("orders", "o_totalprice > 499978.59", "o_totalprice", ""),
    "event_scan": ("events", "event_type == purchase AND value > 100.0", "event_id,value", ""),
}
ROUNDED = {"agg_double": {"SUM(l_extendedprice)": 2, "AVG(l_extendedprice)": 4}, "agg_filtered": {"SUM(l_extendedprice)": 2}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_spec(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, filter, select, aggregates = SPECS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = run(_table(spark, sf_dir, table), parse_query(filter, select, aggregates), "aggr" if aggregates else "column")
        if not aggregates:
            return result.rows
        out = result.aggregates
        return out.select(*[F.round(f"`{c}`", ROUNDED[name][c]).alias(c) if c in ROUNDED.get(name, {}) else f"`{c}`" for c in out.columns])

    return query


def filter_bool_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return run(labels, parse_query("good == true"), "column").rows


def _zone(column: str, rows: int):
    return F.floor(F.col(column) / rows)


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zonemap.zone_map(_table(spark, sf_dir, "orders"), _zone("o_orderkey", 550).alias("zone"), ["o_totalprice"])
    return out.select("zone", F.col("min_0").alias("min_v"), F.col("max_0").alias("max_v"), "n")


def _pruned(filter: str, rows: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: zonemap.prune(_table(spark, sf_dir, "orders"), parse_filter(filter), _zone("o_orderkey", rows))


def selectivity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer.thresholds(zonemap.zone_map(_table(spark, sf_dir, "orders"), _zone("o_orderkey", 550).alias("zone"), ["o_orderkey"]))


def _in_groups(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table again, in row groups of 550 rows."""
    path = scratch.path(spark, "groups")
    layout.write_groups(_table(spark, sf_dir, name).coalesce(1), path)
    return spark.read.parquet(path)


def group_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_in_groups(spark, sf_dir, "orders"), parse_query("o_orderkey > 14000"), "group").rows


def group_mode_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups whose least price is low, or whose highest date is late; NaN aside, as footers tell."""
    return run(_in_groups(spark, sf_dir, "orders"), parse_query("o_totalprice < 1100.0 OR o_orderkey >= 14800"), "group").rows


def row_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_table(spark, sf_dir, "orders"), parse_query("o_orderkey > 14000", "o_orderkey"), "row").rows


def bloom_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that may hold a value, and of these the rows that do: the same as without the filter."""
    return bloom.prune_equal(_table(spark, sf_dir, "orders"), parse_filter("o_custkey == 7"), _zone("o_orderkey", 550), 550).where("o_custkey = 7")


def bloom_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real row groups that may hold a value, then its rows."""
    return run(_in_groups(spark, sf_dir, "orders"), parse_query("o_custkey == 7"), [Feature.GROUP, Feature.BLOOM]).rows.where("o_custkey = 7")


def filter_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On columns that were written unsigned, beyond the signed types' range."""
    path = scratch.path(spark, "unsigned")
    wide = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(2**31)).alias("u32"), (F.col("o_orderkey").cast("decimal(20,0)") + F.lit(2**63 - 5000).cast("decimal(20,0)")).cast("decimal(20,0)").alias("u64"))
    wide.write.parquet(path)
    return run(spark.read.parquet(path), parse_query("u64 > 9223372036854775807 AND u32 > 2147490000", "o_orderkey,u32"), "column").rows


def agg_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("decimal(20,0)") + F.lit(2**63 - 5000).cast("decimal(20,0)")).cast("decimal(20,0)").alias("u64"))
    out = run(wide, parse_query("", "", "MIN(u64),MAX(u64),COUNT(u64)"), "aggr").aggregates
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns])


def _with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, NaN for every seventh order and none for every eleventh."""
    v = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))


def filter_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_with_nan(spark, sf_dir), parse_query("NOT v > 100000.0", "o_orderkey"), "column").rows


def agg_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_with_nan(spark, sf_dir), parse_query("", "", "MIN(v),MAX(v),COUNT(v)"), "aggr").aggregates


def zone_prune_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone that holds NaN stays under a negated comparison."""
    return zonemap.prune(_with_nan(spark, sf_dir), parse_filter("NOT v > 2000.0"), _zone("o_orderkey", 4)).select("o_orderkey")


def per_file_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run(_table(spark, sf_dir, "orders"), parse_query("", "", "COUNT(o_orderkey),MAX(o_orderkey)"), "aggr", per_file=True).aggregates
    return out.withColumn("file", F.element_at(F.split("file", "/"), -1))


def footer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What footers tell of row groups of 550 rows."""
    path = scratch.path(spark, "groups")
    layout.write_groups(_table(spark, sf_dir, "orders").coalesce(1), path)
    stats = footer.statistics(spark, path, "o_orderkey")
    return stats.select(F.col("row_group").cast("long").alias("row_group"), "rows", F.col("min_0").alias("low"), F.col("max_0").alias("high"))


def layout_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table again, from files with 550 rows in a row group."""
    out = scratch.path(spark, "rewrite")
    layout.rewrite(spark, f"{sf_dir}/orders.parquet", out)
    return spark.read.parquet(out)


def layout_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table again, from its compaction out of 20 files into at most 16."""
    many, few = scratch.path(spark, "many"), scratch.path(spark, "few")
    _table(spark, sf_dir, "orders").repartition(20).write.parquet(many)
    return spark.read.parquet(*layout.compact(spark, many, few).outputs)


def footer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether footers are a small part of the files, and what they count; their exact sizes depend on the writer."""
    path = f"{sf_dir}/orders.parquet"
    out = footer.metadata_ratio(spark, path).agg(F.max("ratio").alias("ratio"))
    counted = footer.footers(spark, path).agg(F.sum("rows").alias("rows"), F.min("columns").cast("long").alias("columns"), F.min(F.least("group_bytes", "group_meta_bytes", "footer_bytes")).alias("least"))
    return counted.crossJoin(F.broadcast(out)).select("rows", "columns", (F.col("ratio") < 0.2).alias("small"), (F.col("least") > 0).alias("sizes_known"))


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the largest table, read and discarded, then counted."""
    df = scan.parquet(spark, f"{sf_dir}/lineitem.parquet")
    scan.discard(df)
    return df.agg(F.count("*").alias("n"))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of the table's files; how many there are depends on the writer."""
    out = scan.raw_bytes(spark, f"{sf_dir}/lineitem.parquet")
    return out.select((F.col("files") >= 1).alias("files"), (F.col("bytes") > 10_000).alias("bytes"))


def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selective query reads of row groups of 550 rows: some rows, but under a tenth of those a scan reads."""
    df = _in_groups(spark, sf_dir, "orders")
    top = df.agg(F.max("o_orderkey")).first()[0]
    few, whole = (scan.measured(run(df, parse_query(f"o_orderkey > {k}", "o_orderkey"), "column").rows) for k in (top - 10, -1))
    group = scan.measured(run(df, parse_query(f"o_orderkey > {top - 10}"), "group").rows)
    told = (whole.rows_read, 0 < few.rows_read <= 1100, 0 < group.rows_read <= 1100, few.bytes_read < whole.bytes_read)
    return spark.createDataFrame([told], "rows_of_a_scan long, few_rows boolean, few_rows_of_groups boolean, fewer_bytes boolean")


def example_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of the example file; those of its times and booleans are left out."""
    path = scratch.path(spark, "example")
    example.write(spark, path)
    ops = ",".join(f"{op}(Age)" for op in ("AVG", "MAX", "MIN", "COUNT", "SUM")) + ",SUM(Birthday),COUNT(Float),MAX(Float),MIN(Float)"
    return run(spark.read.parquet(path), parse_query("Birthday >= 1020-1-1-1:1:1", "Age", ops), "aggr").aggregates


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _by_spec(name) for name in SPECS} | {
    "filter_bool_eq": filter_bool_eq,
    "zone_map": zone_map,
    "zone_prune_gt": _pruned("o_orderkey > 14000", 550),
    "zone_prune_not_eq": _pruned("NOT o_orderstatus == O", 2),
    "zone_prune_string_eq": _pruned("o_orderstatus == O", 2),
    "selectivity_thresholds": selectivity_thresholds,
    "group_mode": group_mode,
    "group_mode_float": group_mode_float,
    "bloom_groups": bloom_groups,
    "filter_unsigned": filter_unsigned,
    "agg_unsigned": agg_unsigned,
    "filter_nan": filter_nan,
    "agg_nan": agg_nan,
    "zone_prune_nan": zone_prune_nan,
    "footer_groups": footer_groups,
    "row_mode": row_mode,
    "bloom_prune": bloom_prune,
    "per_file_agg": per_file_agg,
    "layout_rewrite": layout_rewrite,
    "layout_compact": layout_compact,
    "footer_ratio": footer_ratio,
    "full_scan": full_scan,
    "raw_scan": raw_scan,
    "scan_metrics": scan_metrics,
    "example_query": example_query,
}

ORACLE_SQL: dict[str, str] = {
    "scan_all": """SELECT * FROM region""",
    "project_schema_order": """SELECT o_orderkey, o_totalprice FROM orders""",
    "filter_int32_lt": """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3""",
    "filter_int64_le": """SELECT o_orderkey FROM orders WHERE o_orderkey <= 100""",
    "filter_int64_eq": """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7""",
    "filter_double_gt": """SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25.0""",
    "filter_double_ge": """SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= 0.05""",
    "filter_string_eq": """SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag = 'R'""",
    "filter_string_range": """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3-MEDIUM'""",
    "filter_bool_eq": """SELECT doc_id, quality = 1 AS good FROM labels WHERE (quality = 1) = true""",
    "filter_ts_ge": """SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'""",
    "filter_and": """SELECT l_orderkey FROM lineitem WHERE l_quantity > 25.0 AND l_discount < 0.05""",
    "filter_or": """SELECT l_orderkey FROM lineitem WHERE l_quantity < 3.0 OR l_linenumber = 7""",
    "filter_not": """SELECT l_orderkey FROM lineitem WHERE NOT (l_quantity > 3.0)""",
    "filter_precedence": """SELECT l_orderkey FROM lineitem WHERE (l_linenumber >= 6) AND (l_quantity < 10.0 OR l_quantity <= 12.0) OR l_linenumber = 1""",
    "filter_not_and": """SELECT o_orderkey FROM orders WHERE NOT (o_orderkey > 100 AND o_totalprice > 1000.0)""",
    "filter_none_match": """SELECT o_orderkey FROM orders WHERE o_totalprice < 0.0""",
    "late_projection": """SELECT l_extendedprice FROM lineitem WHERE l_quantity > 49.0""",
    "agg_int": """SELECT COALESCE(CAST(SUM(l_linenumber) AS BIGINT),0) AS "SUM(l_linenumber)", AVG(l_linenumber) AS "AVG(l_linenumber)", COUNT(l_linenumber) AS "COUNT(l_linenumber)", CAST(MIN(l_linenumber) AS BIGINT) AS "MIN(l_linenumber)", CAST(MAX(l_linenumber) AS BIGINT) AS "MAX(l_linenumber)" FROM lineitem""",
    "agg_double": """SELECT ROUND(COALESCE(SUM(l_extendedprice),0.0),2) AS "SUM(l_extendedprice)", ROUND(AVG(l_extendedprice),4) AS "AVG(l_extendedprice)", COUNT(l_extendedprice) AS "COUNT(l_extendedprice)", MIN(l_extendedprice) AS "MIN(l_extendedprice)", MAX(l_extendedprice) AS "MAX(l_extendedprice)" FROM lineitem""",
    "agg_filtered": """SELECT ROUND(COALESCE(SUM(l_extendedprice),0.0),2) AS "SUM(l_extendedprice)" FROM lineitem WHERE l_quantity > 25.0""",
    "agg_empty": """SELECT COALESCE(CAST(SUM(o_orderkey) AS BIGINT),0) AS "SUM(o_orderkey)", AVG(o_orderkey) AS "AVG(o_orderkey)", COUNT(o_orderkey) AS "COUNT(o_orderkey)", CAST(MIN(o_orderkey) AS BIGINT) AS "MIN(o_orderkey)" FROM orders WHERE o_orderkey < 0""",
    "agg_skips_unsupported": """SELECT COUNT(o_orderkey) AS "COUNT(o_orderkey)" FROM orders""",
    "zone_map": """SELECT CAST(FLOOR(o_orderkey/550.0) AS BIGINT) AS zone, MIN(o_totalprice) AS min_v, MAX(o_totalprice) AS max_v, COUNT(*) AS n FROM orders GROUP BY 1""",
    "zone_prune_gt": """SELECT o.* FROM orders o JOIN (SELECT CAST(FLOOR(o_orderkey/550.0) AS BIGINT) z, MAX(o_orderkey) mx FROM orders GROUP BY 1) m ON CAST(FLOOR(o.o_orderkey/550.0) AS BIGINT) = m.z WHERE m.mx > 14000""",
    "zone_prune_not_eq": """SELECT o.* FROM orders o JOIN (SELECT CAST(FLOOR(o_orderkey/2.0) AS BIGINT) z, MIN(o_orderstatus) mn, MAX(o_orderstatus) mx FROM orders GROUP BY 1) m ON CAST(FLOOR(o.o_orderkey/2.0) AS BIGINT) = m.z WHERE NOT (m.mn = 'O' AND m.mx = 'O')""",
    "zone_prune_string_eq": """SELECT o.* FROM orders o JOIN (SELECT CAST(FLOOR(o_orderkey/2.0) AS BIGINT) z, MIN(o_orderstatus) mn, MAX(o_orderstatus) mx FROM orders GROUP BY 1) m ON CAST(FLOOR(o.o_orderkey/2.0) AS BIGINT) = m.z WHERE m.mn <= 'O' AND m.mx >= 'O'""",
    "selectivity_thresholds": """WITH g AS (SELECT MAX(o_orderkey) mx FROM orders GROUP BY FLOOR(o_orderkey/550.0)), r AS (SELECT mx, ROW_NUMBER() OVER (ORDER BY mx)-1 AS i, COUNT(*) OVER () AS n FROM g) SELECT p.pct, r.mx AS threshold FROM (SELECT UNNEST(RANGE(100)) AS pct) p JOIN r ON r.i = LEAST(r.n-1, r.n - CAST(FLOOR(r.n/100.0*p.pct) AS BIGINT))""",
    "workload_half": """SELECT o_totalprice FROM orders WHERE o_totalprice > 251488.88""",
    "workload_best": """SELECT o_totalprice FROM orders WHERE o_totalprice > 499978.59""",
    "event_scan": """SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 100.0""",
    "group_mode": """SELECT o.* FROM (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1)/550.0) AS BIGINT) z FROM orders) t JOIN (SELECT z, MAX(o_orderkey) mx FROM (SELECT o_orderkey, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1)/550.0) AS BIGINT) z FROM orders) GROUP BY 1) m USING (z) JOIN orders o ON o.o_orderkey = t.o_orderkey WHERE m.mx > 14000""",
    "group_mode_float": """WITH t AS (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1)/550.0) AS BIGINT) z FROM orders), m AS (SELECT z, MAX(o_orderkey) mx, MIN(o_totalprice) mn FROM t GROUP BY 1) SELECT t.* EXCLUDE (z) FROM t JOIN m USING (z) WHERE mn < 1100.0 OR mx >= 14800""",
    "bloom_prune": """SELECT * FROM orders WHERE o_custkey = 7""",
    "bloom_groups": """SELECT * FROM orders WHERE o_custkey = 7""",
    "filter_unsigned": """SELECT o_orderkey, o_orderkey + 2147483648 AS u32 FROM orders WHERE o_orderkey > 5000 AND o_orderkey + 2147483648 > 2147490000""",
    "agg_unsigned": """SELECT CAST(MIN(o_orderkey)::HUGEINT + 9223372036854770808 AS VARCHAR) AS "MIN(u64)", CAST(MAX(o_orderkey)::HUGEINT + 9223372036854770808 AS VARCHAR) AS "MAX(u64)", CAST(COUNT(*) AS VARCHAR) AS "COUNT(u64)" FROM orders""",
    "filter_nan": """SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 7 = 0 OR NOT o_totalprice > 100000.0)""",
    "agg_nan": """SELECT MIN(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS "MIN(v)", MAX(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS "MAX(v)", COUNT(*) AS "COUNT(v)" FROM orders WHERE o_orderkey % 11 <> 0""",
    "zone_prune_nan": """WITH v AS (SELECT o_orderkey, CAST(FLOOR(o_orderkey/4.0) AS BIGINT) z, o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 AS nan, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders), m AS (SELECT z, MIN(v) mn, BOOL_OR(nan) nan FROM v GROUP BY 1) SELECT o_orderkey FROM v JOIN m USING (z) WHERE m.mn IS NULL OR m.mn <= 2000.0 OR m.nan""",
    "footer_groups": """SELECT z AS row_group, COUNT(*) AS rows, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1)/550.0) AS BIGINT) z FROM orders) GROUP BY 1""",
    "per_file_agg": """SELECT 'orders.parquet' AS file, COUNT(o_orderkey) AS "COUNT(o_orderkey)", MAX(o_orderkey) AS "MAX(o_orderkey)" FROM orders""",
    "footer_ratio": """SELECT COUNT(*) AS rows, 6::BIGINT AS columns, true AS small, true AS sizes_known FROM orders""",
    "raw_scan": """SELECT true AS files, true AS bytes""",
    "scan_metrics": """SELECT COUNT(*) AS rows_of_a_scan, true AS few_rows, true AS few_rows_of_groups, true AS fewer_bytes FROM orders""",
    "row_mode": """SELECT * FROM orders WHERE o_orderkey > 14000""",
    "layout_rewrite": """SELECT * FROM orders""",
    "layout_compact": """SELECT * FROM orders""",
    "full_scan": """SELECT COUNT(*) AS n FROM lineitem""",
    "example_query": """SELECT 20.0::DOUBLE AS "AVG(Age)", 60::BIGINT AS "MAX(Age)", -30::BIGINT AS "MIN(Age)", 6::BIGINT AS "COUNT(Age)", 120::BIGINT AS "SUM(Age)", 6::BIGINT AS "COUNT(Float)", 3.4028234663852886e38::DOUBLE AS "MAX(Float)", -3.4028234663852886e38::DOUBLE AS "MIN(Float)" """,
}

"""Queries of sources, the organization dimension, frames' verbs and the manifests, over the same panels as ``core``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import quoted
from ..operators.dimension import join_dimension, prepare
from ..plans.assemble import panelize, panelize_pf
from ..plans.catalog import cardinality, data_source, default_version, form_family, resolve_tables, table_catalog
from ..plans.dictionary import Dictionary, Field
from ..plans.frame import apply_frame, create_frame
from ..plans.panel import Panel
from ..sources.dimension import build_manifest, dimension_url, manifest_bytes, resolve_states, retrieve
from ..sources.keyed import store_keyed
from ..sources.shared import shared_folder, write_each
from ..sources.stage import Staged, budget, download_manifest, download_tables, retrieval_log, write_log
from ..sources.tables import file_dims, read_manifest, read_table, read_tables, scan, stack
from .core import C_SQL, F_SQL, _dimension, filings, longs, panel, query, table

HEADER, SUMMARY = "F9-P00-T00-HEADER", "F9-P01-T00-SUMMARY"


def _text_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as filings, all text, with a year."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("EIN-"), F.col("o_custkey").cast("string")).alias("EIN2"), F.col("o_orderkey").cast("string").alias("OBJECTID"),
        F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("RETURN_TYPE"), F.col("o_totalprice").cast("string").alias("amount"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("number"))


def _write_years(df: DataFrame, root: str, name: str, years: list[int]) -> None:
    """Write a table's years, told by ``y``, in one scan."""
    write_each(df, "y", {y: f"{root}/{name}-{y}.parquet" for y in years})


def _years(orders: DataFrame) -> list[int]:
    return [r["y"] for r in orders.select("y").distinct().sort("y").collect()]


# ---- scans ----------------------------------------------------------------------


@query("SELECT 'EIN-' || o_custkey AS \"EIN2\", o_orderkey::VARCHAR AS \"OBJECTID\", round(o_totalprice, 4) AS amount, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS number, year(o_orderdate)::BIGINT AS \"TAX_YEAR\" FROM orders")
def read_csv_types(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV files by year, read with declared types."""
    root, o = shared_folder(spark, "csv"), _text_orders(spark, sf)
    d = Dictionary([Field("amount", "PC", "numeric", money=True), Field("number", "PC", "numeric")])
    files = {y: f"{root}/{HEADER}-{y}.CSV" for y in _years(o)}
    write_each(o.drop("RETURN_TYPE"), "y", files, "csv", header=True)
    parts = [read_table(scan(spark, at), y, dictionary=d) for y, at in files.items()]
    return longs(stack(parts).withColumn("number", F.col("number").cast("long")))


@query("SELECT 'EIN-' || o_custkey AS \"EIN2\", count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 4, 7, 11) GROUP BY ALL")
def read_listed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named in the filter, in any case and with blanks around."""
    raw = _text_orders(spark, sf).drop("y")
    return read_table(raw, 1995, filters={"EIN2": [" ein-1", "EIN-2 ", "ein-4", "EIN-7", "eIn-11", "EIN-999999999"]}).groupBy("EIN2").agg(F.count("*").alias("n"))


@query("SELECT 'EIN-' || o_custkey AS \"EIN2\", count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def read_table_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a table of entities."""
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit(" ein-"), F.col("c_custkey").cast("string")).alias("id"))
    return read_table(_text_orders(spark, sf).drop("y"), 1995, ids=ids).groupBy("EIN2").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, l_returnflag, l_linestatus FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)")
def distinct_wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every line twice, and once again."""
    raw = table(spark, sf, "lineitem")
    return longs(read_table(raw.unionAll(raw), 1995).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"))


@query("SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax, l_shipdate::DATE::VARCHAR AS l_shipdate) FROM (SELECT DISTINCT * FROM lineitem)")
def distinct_few_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Every line, and those of every fiftieth order once again: whole rows are compared only where their hashes repeat."""
    raw = table(spark, sf, "lineitem")
    raw = raw.select(*[F.col(c).cast("date").cast("string").alias(c) if k.startswith("timestamp") else c for c, k in raw.dtypes])
    return longs(read_table(raw.unionAll(raw.where("l_orderkey % 50 = 0")), 1995).drop("TAX_YEAR"))


@query("SELECT 'EIN-' || o_custkey AS \"EIN2\", count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL")
def read_keyed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stored by entity; those of a table of entities, found by the stored key."""
    at = f"{shared_folder(spark, 'keyed')}/{HEADER}"
    store_keyed(_text_orders(spark, sf), at)
    ids = table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit(" ein-"), F.col("c_custkey").cast("string")).alias("id"))
    rows = read_table(scan(spark, at, "parquet"), 1995, ids=ids)
    return rows.groupBy("EIN2").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("amount"))


@query("""SELECT year(o_orderdate)::BIGINT AS year, '1x1' AS cardinality, 'virtual' AS status, 2 * count(*) AS rows_source, 6::BIGINT AS cols_source, count(*) AS rows_selected, 6::BIGINT AS cols_selected,
count(*) AS exact_duplicates_removed FROM orders GROUP BY ALL""")
def read_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows before and after reading, of table-years that hold each row twice."""
    root, o = shared_folder(spark, "counts"), _text_orders(spark, sf)
    years = _years(o)
    rows = o.withColumn("TAX_YEAR", F.col("y"))
    _write_years(rows.unionAll(rows), root, HEADER, years)
    return longs(read_manifest(spark, read_tables(spark, "P00", years, data_source(root))).select(
        "year", "cardinality", "status", "rows_source", "cols_source", "rows_selected", "cols_selected", "exact_duplicates_removed"))


@query("SELECT count(*) AS n, 6::BIGINT AS k FROM orders")
def table_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Of the table's file, by its footers."""
    return spark.createDataFrame([file_dims(spark, f"{sf}/orders.parquet")], "n long, k long")


@query("SELECT o_orderkey AS k, (o_totalprice::DECIMAL(12, 2))::DOUBLE AS x, 'decimal(14,2)' AS kind FROM orders UNION ALL SELECT o_orderkey + 1000000000, (o_orderkey % 1000)::DOUBLE, 'decimal(14,2)' FROM orders")
def stack_decimals(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as decimals of two sizes, and whole numbers: one decimal that holds all."""
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("x"))
    b = o.where("o_orderkey % 2 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(14,2)").alias("x"))
    c = o.select((F.col("o_orderkey") + 1_000_000_000).alias("k"), (F.col("o_orderkey") % 1000).cast("smallint").alias("x"))
    out = stack([a, b, c])
    return out.select("k", F.col("x").cast("double").alias("x"), F.lit(dict(out.dtypes)["x"]).alias("kind"))


# ---- catalog, as tables -----------------------------------------------------------


@query("SELECT form, n, n * (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS table_years FROM (VALUES ('990', 136::BIGINT), ('990PF', 84)) AS v(form, n)")
def catalog_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Published tables of both families, and table-years over the years of all orders."""
    years = table(spark, sf, "orders").agg(F.count_distinct(F.year("o_orderdate")).alias("k"))
    parts = [table_catalog(spark, form=f).agg(F.count("*").alias("n")).select(F.lit(form_family(f)).alias("form"), "n") for f in ("990", " pf")]
    return parts[0].unionAll(parts[1]).crossJoin(F.broadcast(years)).select("form", "n", (F.col("n") * F.col("k")).alias("table_years"))


@query("""SELECT v.*, count(*) AS "rows" FROM (VALUES ('P00', 'F9-P00-T00-HEADER', '1x1', TRUE), ('new-p01-t02-x', 'NEW-P01-T02-X', '1xm', FALSE)) AS v(request, "table", cardinality, known), orders GROUP BY ALL""")
def resolved_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A known and an unknown table, found and read for every year of the orders."""
    root, o = shared_folder(spark, "resolved"), _text_orders(spark, sf)
    years = _years(o)
    for t in (HEADER, "NEW-P01-T02-X"):
        _write_years(o, root, t, years)
    reads = read_tables(spark, ["P00", "new-p01-t02-x"], years, data_source(root), unique_rows=False)
    m = read_manifest(spark, reads).groupBy("request", "table").agg(F.sum("rows_source").alias("rows"))
    known = spark.createDataFrame([(r.request, cardinality(r.table), r.known) for r in resolve_tables(["P00", "new-p01-t02-x"], data_source(root))], "request string, cardinality string, known boolean")
    return m.join(known, "request").select("request", "table", "cardinality", "known", "rows")


@query("""SELECT year(o_orderdate)::BIGINT AS year, '/m/efile_V/F9-P00-T00-HEADER-' || year(o_orderdate) || '.parquet' AS release, '/r/F9-P00-T00-HEADER-' || year(o_orderdate) || '.CSV' AS csv,
'/c/990PF/' || year(o_orderdate) || '/F9-P00-T00-HEADER-' || year(o_orderdate) || '.parquet' AS cache, count(*) AS n FROM orders GROUP BY ALL""")
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where the files of each year of the orders lie: the default release (its name as V), a root of CSV files, a cache; and how many rows go there."""
    counts = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    release, csv, cache = data_source(mirror="/m"), data_source("/r", format="CSV"), data_source("/x", form="PF")
    rows = [(y, release.path(HEADER, y).replace(release.version or default_version(), "V"), csv.path(HEADER, y), cache.cache_path("/c", HEADER, y)) for y in _years(_text_orders(spark, sf))]
    return longs(spark.createDataFrame(rows, "year int, release string, csv string, cache string").join(counts, "year"))


@query("SELECT o_orderpriority AS priority, count(*) * 1000000 AS size, least(greatest(30, ceil(count(*) * 1000000 / 524288)), 2147483)::BIGINT AS seconds FROM orders GROUP BY ALL")
def transfer_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds that files of a million bytes an order may take, one file a priority."""
    sizes = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg((F.count("*") * 1_000_000).alias("size")).collect()
    return spark.createDataFrame([(r["priority"], r["size"], budget(30.0, r["size"])) for r in sizes], "priority string, size long, seconds long")


# ---- staging ----------------------------------------------------------------------


@query("SELECT * FROM (VALUES (2021::BIGINT, 'downloaded', 1::BIGINT), (2022, 'downloaded', 1), (2023, 'failed', 2)) AS v(year, status, attempts)")
def staged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two table-years that are there and one that isn't; what became of them."""
    root = shared_folder(spark, "mirror").removeprefix("file://")
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("EIN2"), F.col("n_name").alias("OBJECTID"))
    for y in (2021, 2022):
        names.coalesce(1).toPandas().to_csv(_made(f"{root}/{HEADER}-{y}.CSV"), index=False)
    staged = download_tables([2021, 2022, 2023], "P00", data_source(root, format="csv"), f"{root}/cache", retry_max=2, backoff=0)
    write_log(f"{root}/log", staged)
    retrieval_log(spark, f"{root}/log").count()
    return longs(download_manifest(spark, staged).select("year", "status", "attempts"))


def _single_csv(df: DataFrame, at: str) -> None:
    """One CSV file at ``at``."""
    df.coalesce(1).write.option("header", True).csv(f"{at}.parts")
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{at}.parts")
    fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    (part,) = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(at))


@query("""SELECT year(o_orderdate)::BIGINT AS year, CASE WHEN year(o_orderdate) % 2 = 0 THEN 'reused' ELSE 'failed' END AS again, count(*) AS n, count(DISTINCT o_custkey) AS entities, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL""")
def staged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file of orders for each year, copied in ranges of 64 KiB and read from the cache; then staged again, with another size published for odd years, so that these copies count for nothing."""
    root, o = shared_folder(spark, "release"), _text_orders(spark, sf).drop("number")
    years = _years(o)
    source = data_source(root, format="csv")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda y: _single_csv(o.where(F.col("y") == y).drop("y"), source.path(HEADER, y)), years))
    options = {"retry_max": 2, "backoff": 0, "range_bytes": 1 << 16}
    first = download_tables(years, "P00", source, f"{root}/cache", **options)
    rows = stack([t.df for t in read_tables(spark, "P00", years, source, first, unique_rows=False)])
    found = rows.groupBy(F.col("TAX_YEAR").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("EIN2").alias("entities"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("amount"))
    again = download_manifest(spark, download_tables(years, "P00", source, f"{root}/cache", expected_bytes={source.filename(HEADER, y): 1 for y in years if y % 2}, **options))
    return longs(found.join(again.select("year", F.col("status").alias("again")), "year"))


@query("""SELECT kind, count(*) AS resources, count(*) FILTER (y % 2 = 0) AS downloaded, 0::BIGINT AS reused, count(*) FILTER (y % 2 = 1) AS failed, sum(n)::BIGINT AS bytes FROM
(SELECT 'download' AS kind, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'dimension', year(o_orderdate), count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) GROUP BY kind""")
def retrieval_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs in a log: files of each year of the orders, of as many bytes as there are orders; odd years failed."""
    root, o = shared_folder(spark, "runs"), _text_orders(spark, sf)
    for kind, rows in (("download", o), ("dimension", o.where("RETURN_TYPE = 'F'"))):
        counts = rows.groupBy("y").count().collect()
        write_log(root, [Staged(r["y"], "P00", HEADER, "1x1", "a", "b", "failed" if r["y"] % 2 else "downloaded", 1, r["count"]) for r in counts], kind)
    return retrieval_log(spark, root).select("kind", "resources", "downloaded", "reused", "failed", "bytes")


def _made(path: str) -> str:
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


# ---- the organization dimension ----------------------------------------------------

_DIM_FIELDS = ("EIN2", "org_name_display", "geo_county", "asset_amount", "ruling_year")
_DIM = """d AS (SELECT 'EIN-' || c_custkey AS "EIN2", CASE WHEN c_custkey % 2 = 0 THEN 'renewed' ELSE c_name END AS org_name_display, n_name AS geo_county, round(c_acctbal, 4) AS asset_amount,
CASE WHEN c_custkey % 3 <> 0 THEN 1910 + c_custkey % 80 END::BIGINT AS ruling_year, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f'WITH {_DIM} SELECT "EIN2", org_name_display, geo_county, asset_amount, ruling_year FROM d')
def dim_csv(spark: SparkSession, sf: str) -> DataFrame:
    """From one CSV file, all text, of which some fields are asked for."""
    at = dimension_url(shared_folder(spark, "dimension"), "csv")
    _dimension(spark, sf).withColumn("extra", F.lit("x")).write.option("header", True).csv(at)
    return longs(retrieve(spark, at, _DIM_FIELDS).df.withColumn("asset_amount", F.col("asset_amount").cast("double")))


@query(f"""WITH {_DIM} SELECT "EIN2", org_name_display, geo_county, asset_amount, ruling_year FROM d""")
def dim_states(spark: SparkSession, sf: str) -> DataFrame:
    """From files of five states, Parquet and CSV, stacked without their partition column."""
    root, d = shared_folder(spark, "states"), _dimension(spark, sf)
    asked = resolve_states(["ca", "NY", "TX", "wa", "OR"])
    for k, s in enumerate(asked):
        part = d.where(F.pmod(F.hash(F.upper("EIN2")), F.lit(len(asked))) == k)
        if s == "NY":
            part.write.option("header", True).csv(f"{root}/bmf_master_{s}.csv")
        else:
            (part.withColumn("state", F.lit(s)) if k % 2 else part).write.parquet(f"{root}/state={s}")
    return longs(retrieve(spark, root, _DIM_FIELDS, states=asked).df.withColumn("asset_amount", F.col("asset_amount").cast("double")))


@query(f"""WITH {_DIM} SELECT "EIN2", org_name_display, geo_county, asset_amount, ruling_year FROM d WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def dim_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Only the entities of a table, whose keys are spelled otherwise."""
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit(" Ein-"), F.col("o_custkey").cast("string")).alias("id")).distinct()
    return longs(retrieve(spark, _dimension(spark, sf), _DIM_FIELDS, ids=ids).df)


@query("""SELECT count(*) AS output_rows, count(*) FILTER (o_custkey % 5 <> 0) AS matched_rows, count(DISTINCT o_custkey) AS panel_distinct_ids, count(DISTINCT o_custkey) FILTER (o_custkey % 5 <> 0) AS matched_distinct_ids,
count(DISTINCT o_custkey) FILTER (o_custkey % 5 = 0) AS unmatched_distinct_ids FROM orders""")
def dim_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows and entities find their organization; a fifth of these is known by another key."""
    renamed = F.when(F.substring("EIN2", 5, 20).cast("long") % 5 == 0, F.concat("EIN2", F.lit("x"))).otherwise(F.col("EIN2"))
    prepared = prepare(_dimension(spark, sf).withColumn("EIN2", renamed), _DIM_FIELDS).df
    got = join_dimension(_text_orders(spark, sf).drop("y"), prepared).diagnostics()
    names = ("output_rows", "matched_rows", "panel_distinct_ids", "matched_distinct_ids", "unmatched_distinct_ids")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""SELECT 'bmf_unified_geocoded.parquet' AS name, count(*) AS size FROM customer UNION ALL SELECT 'bmf_unified_geocoded.csv', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'else', NULL""")
def dim_build(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes that a build's manifest publishes: here, counts of customers and of their nations."""
    at = dimension_url(shared_folder(spark, "build"), "manifest")
    names = [dimension_url("", f).lstrip("/") for f in ("parquet", "csv")]
    sizes = table(spark, sf, "customer").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("k"))
    sizes.select(F.format_string('{"files": {"%s": {"bytes": %d}, "%s": {"bytes": %d}}}', F.lit(names[0]), "n", F.lit(names[1]), "k").alias("value")).coalesce(1).write.text(at)
    m = build_manifest(spark, at)
    return spark.createDataFrame([(n, manifest_bytes(m, n)) for n in (*names, "else")], "name string, size long")


@query(f"""WITH {_DIM} SELECT 'unified_parquet' AS source_type, count(*) AS rows_prepared, '2026-08' AS bmf_vintage, NULL::VARCHAR AS states FROM d
UNION ALL SELECT 'unified_csv', count(*), '2026-06', NULL FROM d UNION ALL SELECT 'state_marts', count(*) FILTER (c_custkey % 2 = 0), '2026-06', 'CA' FROM d""")
def dim_published(spark: SparkSession, sf: str) -> DataFrame:
    """Builds laid out as they are published: of Parquet and a manifest, of CSV alone, and one state's file."""
    d = _dimension(spark, sf).withColumn("bmf_vintage_ym", F.lit("2026-06"))
    roots = [shared_folder(spark, f"published-{k}") for k in range(3)]
    d.write.parquet(dimension_url(roots[0]))
    spark.createDataFrame([('{"vintage": "2026-08"}',)], "value string").coalesce(1).write.text(dimension_url(roots[0], "manifest"))
    d.write.option("header", True).csv(dimension_url(roots[1], "csv"))
    d.where(F.substring("EIN2", 5, 20).cast("long") % 2 == 0).write.parquet(f"{roots[2]}/state=CA")
    found = [retrieve(spark, r, _DIM_FIELDS, states=s).diagnostics() for r, s in zip(roots, (None, None, "ca"))]
    names = ("source_type", "rows_prepared", "bmf_vintage", "states")
    return spark.createDataFrame([tuple(x[n] for n in names) for x in found], "source_type string, rows_prepared long, bmf_vintage string, states string")


# ---- frames -------------------------------------------------------------------------


@query(f"""WITH {F_SQL} SELECT rec, id, t::BIGINT AS t FROM f WHERE form <> 'P'
QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY (grp = 'X'), (coalesce(par, '') = 'x'), (amd = 'yes') DESC, ts DESC NULLS LAST, rec, v, form, pri) = 1""")
def frame_dedup_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A filter, then one filing a year, as rules of a frame."""
    f = create_frame(entity="id", time="t").add_rule("filter", column="form", op="!=", values="P").add_rule("dedup", group="grp", partial="par", amended="amd", timestamp="ts")
    return longs(apply_frame(filings(spark, sf).select("rec", "id", "t", "v", "form", "pri", "grp", "par", "amd", "ts"), f).df.select("rec", "id", "t"))


@query(f"WITH {F_SQL} SELECT rec, id FROM f WHERE form IN ('F', 'O') AND t IN (1996, 1998)")
def frame_adhoc(spark: SparkSession, sf: str) -> DataFrame:
    """Filters given when the frame is applied, beside its own."""
    f = create_frame(entity="id", time="t", form=["f", "o"])
    return apply_frame(filings(spark, sf), f, years=[1996, 1998]).df.select("rec", "id")


@query(f"WITH {F_SQL} SELECT rec, id FROM f WHERE v > 200000")
def frame_updated_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule changed, one removed."""
    f = create_frame(entity="id", time="t").add_rule("filter", "price", column="v", op=">", values=1.0).add_rule("filter", "form", column="form", op="in", values=["P"])
    return apply_frame(filings(spark, sf), f.update_rule("price", values=200000.0).remove_rule("form")).df.select("rec", "id")


@query("SELECT 'entity' AS role, 'id' AS \"column\" UNION ALL SELECT 'time', 't' UNION ALL SELECT lower(r_name), 'nations_' || count(*) FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def frame_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A role for each region; the last column given to it counts."""
    f = create_frame(entity="id", time="t")
    held = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.lower("r_name").alias("role")).count()
    for r in held.collect():
        f = f.add_key(r["role"], "else").add_key(r["role"], f"nations_{r['count']}")
    return spark.createDataFrame([(k["role"], k["column"]) for k in f.get_keys()], "role string, column string")


@query(f"WITH {F_SQL} SELECT rec, round(v * 2, 4) AS twice FROM f")
def frame_refresh_function(spark: SparkSession, sf: str) -> DataFrame:
    """A derived column by a function; a function that is only kept on file isn't run."""
    f = create_frame(entity="id", time="t").add_refresh(fn=lambda df: df.withColumn("twice", F.col("v") * 2)).add_function("kept", fn=lambda df: df.limit(0))
    return longs(apply_frame(filings(spark, sf), f).df.select("rec", "twice"))


@query("SELECT o_orderkey AS rec FROM orders WHERE o_custkey % 2 = 1")
def subset_many_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number ids against text keys, as many as there are: half of all customers, and 2,000 that aren't there."""
    n = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), F.col("o_custkey").cast("string").alias("id"))
    return apply_frame(rows, create_frame(entity="id", time="t").add_rule("subset", ids=list(range(1, n + 4001, 2)))).df.select("rec")


@query("SELECT o_orderkey, round(o_totalprice, 4) AS F9_08_X, o_orderstatus AS \"HEAD\" FROM orders")
def frame_select_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by scope and by the beginning of a table's name."""
    d = Dictionary([Field("HEAD", "HD", table=HEADER), Field("F9_08_X", "PZ", "numeric", "F9-P08-T00-REVENUE", True), Field("F9_08_Y", "PC", "numeric", "F9-P08-T00-REVENUE", True),
                    Field("F9_09_Z", "EZ", "numeric", "F9-P09-T00-EXPENSES", True)])
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("F9_08_X"), F.col("o_totalprice").alias("F9_08_Y"), F.col("o_totalprice").alias("F9_09_Z"), F.col("o_orderstatus").alias("HEAD"))
    both = set(d.in_scope("both")) | {"o_orderkey"}
    money = d.financial("core", "PZ")
    names = [c for c in d.select(rows.columns, scope=None, tables="P08") if c in both]
    assert money == ["F9_08_X"]
    return longs(rows.select(*[quoted(c) for c in names]))


# ---- panels --------------------------------------------------------------------------


@query(f"WITH {C_SQL} SELECT rec FROM p JOIN c USING (id) WHERE panel_type = 'exit' AND panel_spell = 'seamless'")
def panel_update(spark: SparkSession, sf: str) -> DataFrame:
    """Labels brought up to date, then used by a rule."""
    p = Panel(panel(spark, sf), create_frame(entity="id", time="t")).update()
    return p.apply(panel_type="exit", panel_spell="seamless").df.select("rec")


@query("""SELECT 'EIN-' || o_custkey AS "EIN2", o_orderkey::VARCHAR AS "OBJECTID", year(o_orderdate)::BIGINT AS "TAX_YEAR", round(o_totalprice, 4) AS "PF_01_REV_TOT_BOOKS" FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7) AND o_totalprice > 1000""")
def panelize_pf_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A 990PF panel; entities named both by the call and by the frame are those of both."""
    root, o = shared_folder(spark, "pf"), _text_orders(spark, sf)
    keys = ["EIN2", "OBJECTID", F.col("y").cast("string").alias("TAX_YEAR")]
    years = _years(o)
    _write_years(o.select("y", *keys, "RETURN_TYPE"), root, HEADER, years)
    _write_years(o.select("y", *keys, F.col("amount").alias("PF_01_REV_TOT_BOOKS")), root, "PF-P01-T00-REVENUE-EXPENSE", years)
    frame = create_frame("pf", record="OBJECTID", eins=[f"ein-{k}" for k in (1, 2, 4, 5, 7, 10)]).add_rule("filter", column="PF_01_REV_TOT_BOOKS", op=">", values=1000.0)
    p = panelize_pf(spark, ["P00", "PF01"], years, root, frame=frame, filters={"EIN2": [f"ein-{k}" for k in (1, 2, 4, 5, 7, 8)]})
    return longs(p.df.select("EIN2", "OBJECTID", "TAX_YEAR", "PF_01_REV_TOT_BOOKS"))


@query("SELECT 'F9-P00-T00-HEADER' AS \"left\", 'F9-P01-T00-SUMMARY' AS \"right\", year(o_orderdate)::BIGINT AS year, '1x1' AS expected_cardinality FROM orders GROUP BY ALL")
def panelize_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The record of a panel's joins."""
    root, o = shared_folder(spark, "joins"), _text_orders(spark, sf)
    years = _years(o)
    keys = ["EIN2", "OBJECTID", F.col("y").cast("string").alias("TAX_YEAR")]
    _write_years(o.select("y", *keys, "RETURN_TYPE"), root, HEADER, years)
    _write_years(o.select("y", *keys, F.col("amount").alias("F9_01_REV_TOT_CY")), root, SUMMARY, years)
    p = panelize(spark, ["P00", "P01"], years, data_source(root))
    return longs(spark.createDataFrame([(j["left"], j["right"], j["year"], j["expected_cardinality"]) for j in p.joins], "left string, right string, year long, expected_cardinality string"))

"""Each query takes (spark, sf_dir). Orders make the panel: customers are entities, order years times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate
from ..operators.accounting import accounting_check, reconcile
from ..operators.balance import balance
from ..operators.dedup import deduplicate
from ..operators.dimension import join_dimension, prepare
from ..operators.impute import complete, impute
from ..operators.incremental import classify_state, membership_state, merge_states
from ..operators.levels import set_levels
from ..operators.membership import classify, describe, filter_members, label
from ..operators.normalize import normalize
from ..operators.order_stats import group_medians
from ..operators.smooth import smooth
from ..plans.dictionary import Dictionary, Field, concordance
from ..plans.frame import SampleFrame, apply_frame, conform, create_frame, run_checks, views
from ..plans.identities import parse
from ..plans.merge import join_tables, merge_unique
from ..plans.panel import Panel
from ..plans.requirements import satisfying
from ..sources.tables import cast_audit, cast_declared, stack

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """All integers as long, all doubles to four places: types and digits that both engines share."""
    def one(c: str, k: str) -> Column:
        if k in ("int", "smallint", "tinyint"):
            return F.col(c).cast("long").alias(c)
        return F.round(c, 4).alias(c) if k in ("double", "float") else F.col(c)

    return df.select(*[one(c, k) for c, k in df.dtypes])


# ---- the panels -----------------------------------------------------------------


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order: its customer, year, price, and flags made of status and priority."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("t"), F.col("o_orderkey").alias("rec"), F.col("o_totalprice").alias("v"),
        F.col("o_orderstatus").alias("form"), F.col("o_orderpriority").alias("pri"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority").startswith("5"), "X").otherwise("").alias("grp"), F.when(F.col("o_orderpriority").startswith("4"), "x").alias("par"),
        F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise("no").alias("amd"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The best order of each customer and year."""
    return deduplicate(filings(spark, sf), "id", "t", "grp", "par", "amd", "ts", tie=["rec"])


F_SQL = """
f AS (SELECT o_custkey AS id, year(o_orderdate)::INT AS t, o_orderkey AS rec, o_totalprice AS v, o_orderstatus AS form, o_orderpriority AS pri, o_orderdate AS ts,
             CASE WHEN o_orderpriority LIKE '5%' THEN 'X' ELSE '' END AS grp, CASE WHEN o_orderpriority LIKE '4%' THEN 'x' END AS par,
             CASE WHEN o_orderpriority LIKE '1%' THEN 'yes' ELSE 'no' END AS amd FROM orders)"""
P_SQL = F_SQL + """,
p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY (grp = 'X'), (coalesce(par, '') = 'x'), (amd = 'yes') DESC, ts DESC NULLS LAST, rec) = 1)"""
C_SQL = P_SQL + """,
y AS (SELECT t, row_number() OVER (ORDER BY t) AS pos FROM (SELECT DISTINCT t FROM p)),
g AS (SELECT p.id, p.t, y.pos, y.pos - lag(y.pos) OVER (PARTITION BY p.id ORDER BY y.pos) - 1 AS gap FROM p JOIN y USING (t)),
c AS (SELECT id, min(t) AS panel_year_first, max(t) AS panel_year_last, count(*) AS panel_year_count,
             CASE WHEN min(pos) = 1 AND max(pos) = (SELECT count(*) FROM y) THEN 'persistent' WHEN max(pos) = (SELECT count(*) FROM y) THEN 'entrant'
                  WHEN min(pos) = 1 THEN 'exit' ELSE 'transient' END AS panel_type,
             CASE WHEN max(pos) - min(pos) + 1 = count(*) THEN 'seamless' ELSE 'segmented' END AS panel_spell,
             coalesce(sum((gap > 0)::INT), 0) AS panel_gap_count, coalesce(max(gap), 0) AS panel_gap_size_max FROM g GROUP BY id)"""
C_OUT = "id, panel_year_first::BIGINT AS panel_year_first, panel_year_last::BIGINT AS panel_year_last, panel_year_count::BIGINT AS panel_year_count, panel_type, panel_spell, panel_gap_count::BIGINT AS panel_gap_count, panel_gap_size_max::BIGINT AS panel_gap_size_max"


def rows_of(rule: dict, columns=("rec", "id", "v", "form")) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return longs(apply_frame(filings(spark, sf), create_frame(entity="id", time="t").add_rule(**rule)).df.select(*columns))

    return run


def filter_query(name: str, where: str, **rule) -> None:
    f = rows_of({"type": "filter", **rule})
    f.__name__ = name
    query(f"WITH {F_SQL} SELECT rec, id, round(v, 4) AS v, form FROM f WHERE {where}")(f)


# ---- predicates and rules -------------------------------------------------------

filter_query("filter_in", "upper(trim(form)) IN ('F', 'O')", column="form", op="in", values=[" f", "O"])
filter_query("filter_not_in_null", "par IS NULL OR upper(trim(par)) <> 'X'", column="par", op="not_in", values=["X"])
filter_query("filter_compare", "v >= 100000", column="v", op=">=", values=100000.0)
filter_query("filter_unequal", "form <> 'F'", column="form", op="!=", values="F")
filter_query("filter_between", "t BETWEEN 1996 AND 1998", column="t", op="between", values=[1996, 1998])
filter_query("filter_truthy", "amd = 'yes'", column="amd", op="is_true")
filter_query("filter_falsy", "par IS NULL", column="par", op="is_false")
filter_query("filter_expr", "v > 50000 AND form = 'P'", expr="v > 50000 and form = 'P'")
filter_query("filter_absent_column", "TRUE", column="nothing", op="==", values=1)


@query(f"WITH {F_SQL}, big AS (SELECT id FROM f GROUP BY id HAVING sum(v) > 1000000) SELECT rec, id, round(v, 4) AS v, form FROM f WHERE id IN (SELECT id FROM big)")
def subset_semi(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf)
    big = f.groupBy("id").agg(F.sum("v").alias("s")).where("s > 1000000").select("id")
    return longs(apply_frame(f, create_frame(entity="id", time="t").add_rule("subset", ids=big)).df.select("rec", "id", "v", "form"))


@query(f"WITH {F_SQL} SELECT rec, id FROM f WHERE id IN (1, 2, 3, 5, 8)")
def subset_values(spark: SparkSession, sf: str) -> DataFrame:
    return apply_frame(filings(spark, sf), create_frame(entity="id", time="t").add_rule("subset", ids=[1, 2, 3, 5, 8])).df.select("rec", "id")


def require_query(name: str, having: str, **rule) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = SampleFrame().add_rule("require", "r", **rule).rule("r")
        return satisfying(filings(spark, sf), r, "id", "t", 7).withColumnRenamed("kept_id", "id")

    run.__name__ = name
    query(f"WITH {F_SQL} SELECT id FROM f GROUP BY id HAVING {having}")(run)


require_query("require_all_years", "count(DISTINCT t) >= 7", present_in="all")
require_query("require_min_years", "count(DISTINCT t) >= 5", present_in=5)
require_query("require_every", "count(DISTINCT t) >= 3 AND bool_and(form <> 'P')", present_in=3, column="form", op="!=", values="P")
require_query("require_any", "bool_or(v > 400000)", present_in="any", holds="any", column="v", op=">", values=400000.0)


@query(f"WITH {F_SQL} SELECT id FROM f GROUP BY id HAVING count(DISTINCT t) >= 4 INTERSECT SELECT id FROM f GROUP BY id HAVING bool_or(form = 'P')")
def require_intersect(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf)
    a = SampleFrame().add_rule("require", "r", present_in=4).rule("r")
    b = SampleFrame().add_rule("require", "r", present_in="any", holds="any", column="form", op="==", values="P").rule("r")
    return satisfying(f, a, "id", "t", 7).join(satisfying(f, b, "id", "t", 7), "kept_id", "left_semi").withColumnRenamed("kept_id", "id")


@query("SELECT o_orderkey AS rec, o_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE upper(trim(c_mktsegment)) = 'BUILDING'")
def label_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = create_frame(entity="id", time="t").add_rule("label", "segment", label="segment", map=table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    return apply_frame(filings(spark, sf), f, segment="building").df.select("rec", "id")


@query(f"WITH {F_SQL}, s AS (SELECT id, avg(round(v * 100)::BIGINT) AS cents_mean FROM f GROUP BY id) SELECT rec, cents_mean FROM f JOIN s USING (id)")
def group_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Means of whole cents, whose sums are exact in whatever order they are added."""
    f = create_frame(entity="id", time="t").add_refresh(action="group_stat", by="id", value="cents", fun="mean")
    return apply_frame(filings(spark, sf).withColumn("cents", F.round(F.col("v") * 100).cast("long")), f).df.select("rec", "cents_mean")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def select_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = Dictionary([Field("l_orderkey", "HD", table="L"), Field("l_quantity", "PC", "numeric", "L", True), Field("l_tax", "EZ", "numeric", "L", True)])
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return apply_frame(items, create_frame(entity="l_orderkey").add_rule("select", scope="PC"), dictionary=d).df


@query(f"""WITH {F_SQL}, n AS (SELECT count(*) AS n, sum((v > 1000)::INT) AS a, sum((form IN ('F', 'O'))::INT) AS b FROM f)
SELECT 'price' AS "check", n, a::BIGINT AS pass, (n - a)::BIGINT AS fail, n = a AS ok, '' AS note FROM n
UNION ALL SELECT 'form', n, b::BIGINT, (n - b)::BIGINT, n = b, '' FROM n UNION ALL SELECT 'gone', n, NULL, NULL, NULL, 'column absent' FROM n""")
def checks(spark: SparkSession, sf: str) -> DataFrame:
    f = (create_frame(entity="id", time="t").add_rule("check", "price", column="v", op=">", values=1000.0)
         .add_rule("check", "form", column="form", op="in", values=["F", "O"]).add_rule("check", "gone", column="nothing", op="is_true"))
    return run_checks(filings(spark, sf), f)


@query(f"WITH {F_SQL} SELECT count(*) AS rows_total, sum((NOT (form = 'F' AND t BETWEEN 1995 AND 1999))::INT)::BIGINT AS rows_violating FROM f")
def conformity(spark: SparkSession, sf: str) -> DataFrame:
    f = create_frame(entity="id", time="t").add_rule("filter", column="form", op="==", values="F").add_rule("filter", column="t", op="between", values=[1995, 1999])
    c = conform(filings(spark, sf), f)
    return spark.createDataFrame([(c.rows_total, c.rows_violating)], "rows_total long, rows_violating long")


@query(f"WITH {F_SQL} SELECT par, count(*) AS count FROM f WHERE par IS NOT NULL GROUP BY par")
def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views(filings(spark, sf), SampleFrame().add_view("v", rows="par"))["v"]


@query(f"""WITH {F_SQL} SELECT pri, sum((form = 'F')::INT)::BIGINT AS "F", sum((form = 'O')::INT)::BIGINT AS "O", sum((form = 'P')::INT)::BIGINT AS "P" FROM f GROUP BY pri""")
def view_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return views(filings(spark, sf), SampleFrame().add_view("v", rows="pri", cols="form"))["v"].select("pri", "F", "O", "P")


@query(f"WITH {F_SQL} SELECT form, round(median(v), 4) AS median FROM f GROUP BY form")
def view_tapply(spark: SparkSession, sf: str) -> DataFrame:
    return longs(views(filings(spark, sf), SampleFrame().add_view("v", rows="form", value="v", fun="median"))["v"])


# ---- panel verbs ----------------------------------------------------------------


@query(f"WITH {P_SQL} SELECT id, t::BIGINT AS t, rec, round(v, 4) AS v FROM p")
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    return longs(panel(spark, sf).select("id", "t", "rec", "v"))


@query(f"""WITH {F_SQL} SELECT id, t::BIGINT AS t, rec FROM f QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY
CASE rec % 3 WHEN 0 THEN ts::DATE::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) END DESC NULLS LAST, rec) = 1""")
def dedup_timestamp_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("rec") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("rec") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-05:00'")).otherwise("unknown")
    return longs(deduplicate(filings(spark, sf).withColumn("stamp", text), "id", "t", None, None, None, "stamp", tie=["rec"]).select("id", "t", "rec"))


@query(f"WITH {C_SQL} SELECT {C_OUT} FROM c")
def classify_members(spark: SparkSession, sf: str) -> DataFrame:
    return longs(classify(panel(spark, sf), "t", "id"))


@query(f"""WITH {C_SQL} SELECT panel_type, sum((panel_spell = 'seamless')::INT)::BIGINT AS seamless, sum((panel_spell = 'segmented')::INT)::BIGINT AS segmented, count(*) AS total,
round(100.0 * count(*) / (SELECT count(*) FROM c), 1)::DOUBLE AS pct FROM c GROUP BY panel_type""")
def describe_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return describe(panel(spark, sf), "t", "id").by_type()


@query(f"""WITH {C_SQL} SELECT p.t::BIGINT AS year, panel_type, count(*) AS n FROM p JOIN c USING (id) GROUP BY ALL""")
def describe_by_year(spark: SparkSession, sf: str) -> DataFrame:
    wide = describe(panel(spark, sf), "t", "id").by_year()
    kinds = [c for c in wide.columns if c != "year"]
    tall = wide.select(F.col("year").cast("long").alias("year"), F.explode(F.array(*[F.struct(F.lit(k).alias("panel_type"), F.col(k).alias("n")) for k in kinds])).alias("x"))
    return tall.select("year", "x.panel_type", "x.n").where("n > 0")


@query(f"WITH {C_SQL} SELECT rec, panel_type, panel_spell FROM p LEFT JOIN c USING (id)")
def label_members(spark: SparkSession, sf: str) -> DataFrame:
    return label(panel(spark, sf), "t", "id").select("rec", "panel_type", "panel_spell")


def member_query(name: str, where: str, **cond) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return longs(filter_members(panel(spark, sf), time="t", id="id", **cond).select("rec", "id", "t"))

    run.__name__ = name
    query(f"WITH {C_SQL} SELECT rec, p.id, p.t::BIGINT AS t FROM p JOIN c USING (id) WHERE {where}")(run)


member_query("members_of_type", "panel_type IN ('persistent', 'exit')", panel_type=["persistent", "exit"])
member_query("members_of_spell", "panel_spell = 'segmented'", spell="segmented")
member_query("members_min_obs", "panel_year_count >= 6 AND panel_type = 'persistent'", min_obs=6, panel_type="persistent")


@query(f"WITH {P_SQL} SELECT rec, t::BIGINT AS t FROM p WHERE id IN (SELECT id FROM p GROUP BY id HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM p))")
def balance_window(spark: SparkSession, sf: str) -> DataFrame:
    return longs(balance(panel(spark, sf), id="id", time="t").df.select("rec", "t"))


@query(f"WITH {P_SQL} SELECT rec, t::BIGINT AS t FROM p WHERE t BETWEEN 1996 AND 1998 AND id IN (SELECT id FROM p WHERE t BETWEEN 1996 AND 1998 GROUP BY id HAVING count(DISTINCT t) = 3)")
def balance_years(spark: SparkSession, sf: str) -> DataFrame:
    return longs(balance(panel(spark, sf), years=[1996, 1997, 1998, 2050], id="id", time="t").df.select("rec", "t"))


@query(f"""WITH {C_SQL}, w AS (SELECT a.pos AS i, b.pos AS j FROM y a JOIN y b ON a.pos < b.pos),
s AS (SELECT i, j, count(*) AS n FROM (SELECT w.i, w.j, g.id FROM w JOIN g ON g.pos BETWEEN w.i AND w.j GROUP BY w.i, w.j, g.id HAVING count(*) = w.j - w.i + 1) GROUP BY i, j),
b AS (SELECT i, j FROM s ORDER BY n * (j - i + 1) DESC, j - i DESC, i LIMIT 1)
SELECT rec, p.t::BIGINT AS t FROM p JOIN y USING (t) JOIN b ON y.pos BETWEEN b.i AND b.j
WHERE p.id IN (SELECT g.id FROM g JOIN b ON g.pos BETWEEN b.i AND b.j GROUP BY g.id, b.i, b.j HAVING count(*) = b.j - b.i + 1)""")
def balance_max_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    return longs(balance(panel(spark, sf), strategy="max_rectangle", id="id", time="t").df.select("rec", "t"))


_FILL = {"mean": "(a + b) / 2", "interpolate": "a + (b - a) * (n.t - lo) / (hi - lo)", "locf": "a", "nocb": "b"}


def impute_query(name: str, method: str, where: str, **args) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = (complete if "types" not in args else impute)(panel(spark, sf).select("id", "t", "v", "form"), method=method, time="t", id="id", vars=["v"], **args)
        return longs(out)

    run.__name__ = name
    query(f"""WITH {C_SQL}, e AS (SELECT id FROM c WHERE panel_spell = 'segmented' AND {where}),
s AS (SELECT p.id, y.pos, p.t AS lo, p.v AS a, lead(y.pos) OVER w AS np, lead(p.t) OVER w AS hi, lead(p.v) OVER w AS b FROM p JOIN y USING (t) JOIN e USING (id) WINDOW w AS (PARTITION BY p.id ORDER BY y.pos)),
n AS (SELECT s.*, y.t FROM s JOIN y ON y.pos > s.pos AND y.pos < s.np)
SELECT id, t::BIGINT AS t, round(v, 4) AS v, form, FALSE AS imputed_row FROM p
UNION ALL SELECT n.id, n.t::BIGINT, round({_FILL[method]}, 4), NULL, TRUE FROM n""")(run)


impute_query("impute_mean", "mean", "panel_type = 'persistent'", types="persistent")
impute_query("impute_gap_limits", "interpolate", "panel_type IN ('persistent', 'entrant') AND panel_gap_size_max <= 1 AND panel_gap_count <= 1", types=["persistent", "entrant"], max_gap_size=1, max_gap_count=1)
impute_query("complete_interpolate", "interpolate", "TRUE")
impute_query("complete_locf", "locf", "TRUE")
impute_query("complete_nocb", "nocb", "TRUE")


def weight_sql(weights: str, distance: str, others: str) -> str:
    return {"equal": "1.0", "decay": f"pow(0.5, {distance})", "half": f"CASE WHEN {distance} = 0 THEN CASE WHEN {others} = 0 THEN 1.0 ELSE 0.5 END ELSE 0.5 / ({others}) END"}[weights]


def smooth_query(align: str, weights: str, window: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        some = panel(spark, sf).select("id", "t", F.when(F.col("rec") % 5 != 0, F.col("v")).alias("v"))
        return longs(smooth(some, "v", window, weights, align, "t", "id"))

    run.__name__ = f"smooth_{align}_{weights}"
    base = f"WITH {P_SQL}, q AS (SELECT id, t, CASE WHEN rec % 5 <> 0 THEN v END AS v, row_number() OVER (PARTITION BY id ORDER BY t) AS r, count(*) OVER (PARTITION BY id) AS n FROM p)"
    if align == "center":
        w = weight_sql(weights, "abs(a.r - b.r)", "a.size - 1")
        sql = f"""{base}, s AS (SELECT *, least({window}, n) AS size, greatest(1, least(r - least({window}, n) // 2, n - least({window}, n) + 1)) AS begin FROM q)
SELECT a.id, a.t::BIGINT AS t, round(sum(b.v * {w}) FILTER (b.v IS NOT NULL) / sum({w}) FILTER (b.v IS NOT NULL), 4) AS v
FROM s a JOIN s b ON a.id = b.id AND b.r >= a.begin AND b.r < a.begin + a.size GROUP BY a.id, a.t"""
    else:
        d = "a.t - b.t" if align == "right" else "b.t - a.t"
        w = weight_sql(weights, f"({d})", str(window - 1))
        sql = f"""{base} SELECT a.id, a.t::BIGINT AS t, round(sum(b.v * {w}) FILTER (b.v IS NOT NULL) / sum({w}) FILTER (b.v IS NOT NULL), 4) AS v
FROM q a JOIN q b ON a.id = b.id AND {d} BETWEEN 0 AND {window - 1} GROUP BY a.id, a.t"""
    query(sql)(run)


for _align in ("center", "right", "left"):
    for _weights in ("equal", "half", "decay"):
        smooth_query(_align, _weights, 3)


# ---- assembly -------------------------------------------------------------------


def _header(spark: SparkSession, sf: str) -> DataFrame:
    """Every order; the keys of a quarter are shifted, so that nothing matches them."""
    key = F.when(F.col("o_orderkey") % 4 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return table(spark, sf, "orders").select(key.alias("OBJECTID"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("VERSION"), F.col("o_totalprice").alias("price"))


def _shifted(key: Column) -> Column:
    return F.when(key % 3 == 0, key + 1_000_000_000_000).otherwise(key)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    status = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return lines.join(status, lines.l_orderkey == status.o_orderkey).select(
        _shifted(F.col("l_orderkey")).alias("OBJECTID"), F.when(F.col("l_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("VERSION"), "quantity")


_SHIFTED = "CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey + 1000000000000 ELSE l_orderkey END"
_HS = f"""h AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE o_orderkey END AS OBJECTID, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS VERSION, o_totalprice AS price FROM orders),
s AS (SELECT {_SHIFTED} AS OBJECTID, CASE WHEN l_orderkey % 10 <> 0 THEN o_orderstatus END AS VERSION, sum(l_quantity) AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(f"""WITH {_HS} SELECT coalesce(h.OBJECTID, s.OBJECTID) AS "OBJECTID", coalesce(h.VERSION, s.VERSION) AS "VERSION", round(price, 4) AS price, round(quantity, 4) AS quantity
FROM h FULL JOIN s ON h.OBJECTID IS NOT DISTINCT FROM s.OBJECTID AND h.VERSION IS NOT DISTINCT FROM s.VERSION""")
def merge_outer(spark: SparkSession, sf: str) -> DataFrame:
    return longs(join_tables(_header(spark, sf), _summary(spark, sf), "S"))


@query(f"""WITH {_HS}, i AS (SELECT {_SHIFTED} AS OBJECTID, l_linenumber, l_partkey FROM lineitem)
SELECT coalesce(h.OBJECTID, i.OBJECTID) AS "OBJECTID", h.VERSION AS "VERSION", round(price, 4) AS price, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM h FULL JOIN i USING (OBJECTID)""")
def merge_many(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(_shifted(F.col("l_orderkey")).alias("OBJECTID"), "l_linenumber", "l_partkey")
    return longs(join_tables(_header(spark, sf), items, "I"))


@query(f"""WITH {_HS} SELECT coalesce(h.OBJECTID, s.OBJECTID) AS "OBJECTID", coalesce(h.VERSION, s.VERSION) AS "VERSION", round(h.price, 4) AS price, round(s.quantity, 4) AS "S__price"
FROM h FULL JOIN s ON h.OBJECTID IS NOT DISTINCT FROM s.OBJECTID AND h.VERSION IS NOT DISTINCT FROM s.VERSION""")
def merge_prefix_collision(spark: SparkSession, sf: str) -> DataFrame:
    return longs(join_tables(_header(spark, sf), _summary(spark, sf).withColumnRenamed("quantity", "price"), "S", collision="prefix"))


@query(f"""WITH {_HS}, r AS (SELECT l_orderkey AS OBJECTID, CASE WHEN l_orderkey % 10 <> 0 THEN o_orderstatus END AS VERSION, max(l_extendedprice) AS dearest, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25 GROUP BY ALL),
c AS (SELECT o_orderkey AS OBJECTID, o_orderstatus AS VERSION, o_custkey AS customer, o_orderpriority AS price FROM orders WHERE o_orderpriority < '3'),
k AS (SELECT OBJECTID, VERSION FROM h UNION SELECT OBJECTID, VERSION FROM s UNION SELECT OBJECTID, VERSION FROM r UNION SELECT OBJECTID, VERSION FROM c)
SELECT k.OBJECTID AS "OBJECTID", k.VERSION AS "VERSION", round(h.price, 4) AS price, round(quantity, 4) AS quantity, round(dearest, 4) AS dearest, lines, customer, c.price AS "C__price" FROM k
LEFT JOIN h ON k.OBJECTID = h.OBJECTID AND k.VERSION IS NOT DISTINCT FROM h.VERSION LEFT JOIN s ON k.OBJECTID = s.OBJECTID AND k.VERSION IS NOT DISTINCT FROM s.VERSION
LEFT JOIN r ON k.OBJECTID = r.OBJECTID AND k.VERSION IS NOT DISTINCT FROM r.VERSION LEFT JOIN c ON k.OBJECTID = c.OBJECTID AND k.VERSION IS NOT DISTINCT FROM c.VERSION""")
def merge_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Four tables with one row a key, side by side after one shuffle."""
    orders = table(spark, sf, "orders")
    version = F.when(F.col("l_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("VERSION")
    lines = table(spark, sf, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("dearest"), F.count("*").alias("lines"))
    dear = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("OBJECTID"), version, "dearest", "lines")
    urgent = orders.where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("OBJECTID"), F.col("o_orderstatus").alias("VERSION"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("price"))
    return longs(merge_unique([("H", _header(spark, sf)), ("S", _summary(spark, sf)), ("R", dear), ("C", urgent)], collision="prefix"))


@query("""SELECT o_orderkey AS k, o_totalprice::VARCHAR <> '' AS priced, o_orderpriority AS pri, NULL::VARCHAR AS only_late FROM orders WHERE year(o_orderdate) <= 1996
UNION ALL SELECT o_orderkey, TRUE, NULL, o_orderstatus FROM orders WHERE year(o_orderdate) > 1996""")
def stack_years(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    a = o.where("y <= 1996").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("pri"))
    b = o.where("y > 1996").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("string").alias("x"), F.col("o_orderstatus").alias("only_late"))
    return stack([a, b]).select("k", (F.col("x") != "").alias("priced"), "pri", "only_late")


@query(f"WITH {C_SQL} SELECT {C_OUT} FROM c")
def classify_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """A state of the first years, and after it each year's rows alone: the classification of all."""
    rows = panel(spark, sf).select("id", "t")
    years = [r["t"] for r in rows.select("t").distinct().sort("t").collect()]
    base = years[0] - 1
    state = membership_state(rows.where(F.col("t") <= years[2]), base, "t", "id")
    for y in years[3:]:
        state = merge_states(state, membership_state(rows.where(F.col("t") == y), base, "t", "id"))
    return longs(classify_state(state, base, "id", years))


@query(f"""WITH {F_SQL}, l AS (SELECT unnest(['5-LOW', '0-NONE', '1-URGENT']) AS pri), k AS (SELECT * FROM f WHERE form <> 'P')
SELECT l.pri, count(*) FILTER (form = 'F') AS "F", count(*) FILTER (form = 'O') AS "O", count(*) FILTER (form = 'P') AS "P" FROM l LEFT JOIN k ON k.pri = l.pri GROUP BY l.pri""")
def view_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A crosstab of two columns with levels: those that no row has any more count zero."""
    rows = set_levels(filings(spark, sf), {"form": ["F", "O", "P"], "pri": ["5-LOW", "0-NONE", "1-URGENT"]})
    f = create_frame(entity="id", time="t").add_rule("filter", column="form", op="!=", values="P").add_view("v", rows="pri", cols="form")
    return apply_frame(rows, f).views()["v"].select("pri", "F", "O", "P")


@query(f"""WITH {F_SQL}, k AS (SELECT * FROM f WHERE form <> 'P') SELECT form, count(*) AS count FROM k GROUP BY form""")
def refresh_droplevels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels made of a column's values, a filter, then those without a row dropped."""
    f = (create_frame(entity="id", time="t").add_refresh("levels", action="factor", cols="form").add_refresh("gone", fn=lambda df: df.where("form <> 'P'"))
         .add_refresh("drop", action="droplevels").add_view("v", rows="form"))
    return apply_frame(filings(spark, sf), f).views()["v"]


@query("SELECT l_returnflag AS flag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY ALL")
def large_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of groups with a third of all lines and more, by rank."""
    return longs(group_medians(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", buffered=1000).toDF("flag", "median"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import read_table

    raw = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return longs(read_table(raw, 1995).drop("TAX_YEAR"))


_MIXED = "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE (o_orderkey / 4.0)::DOUBLE::VARCHAR END"


def _declared() -> Dictionary:
    return Dictionary([Field("amount", "PC", "numeric", money=True), Field("days", "PC", "integer")])


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise((F.col("o_orderkey") / 4.0).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("amount"), text.alias("days"))


@query(f"SELECT o_orderkey, round(TRY_CAST({_MIXED} AS DOUBLE), 4) AS amount, trunc(TRY_CAST({_MIXED} AS DOUBLE))::BIGINT AS days FROM orders")
def cast_types(spark: SparkSession, sf: str) -> DataFrame:
    return longs(cast_declared(_texts(spark, sf), _declared()))


@query("SELECT field, count(*) AS bad_count FROM orders, (VALUES ('amount'), ('days')) AS v(field) WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 GROUP BY field")
def cast_bad_values(spark: SparkSession, sf: str) -> DataFrame:
    return cast_audit(_texts(spark, sf), _declared()).select("field", "bad_count")


def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("ein-"), F.col("c_custkey").cast("string"))
    cols = [key.alias("EIN2"), F.col("c_name").alias("org_name_display"), F.col("n_name").alias("geo_county"), F.col("c_acctbal").alias("asset_amount")]
    date = F.when(F.col("c_custkey") % 3 == 0, "1900-01-01").otherwise(F.concat(F.lit("19"), (10 + F.col("c_custkey") % 80).cast("string"), F.lit("-05-01")))
    old = c.select(*cols, date.alias("ruling_date"), F.lit("202301").alias("bmf_vintage_ym"), F.lit("legacy").alias("bmf_source"))
    new = c.where("c_custkey % 2 = 0").select(F.upper(cols[0]).alias("EIN2"), F.lit("renewed").alias("org_name_display"), *cols[2:], date.alias("ruling_date"), F.lit("202406").alias("bmf_vintage_ym"), F.lit("current").alias("bmf_source"))
    return old.unionByName(new)


_DIM = """d AS (SELECT 'EIN-' || c_custkey AS "EIN2", CASE WHEN c_custkey % 2 = 0 THEN 'renewed' ELSE c_name END AS org_name_display, n_name AS geo_county, round(c_acctbal, 4) AS asset_amount,
CASE WHEN c_custkey % 3 <> 0 THEN 1910 + c_custkey % 80 END::BIGINT AS ruling_year FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_DIM_VARS = ("EIN2", "org_name_display", "geo_county", "asset_amount", "ruling_year")


@query(f"WITH {_DIM} SELECT * FROM d")
def dim_prepare(spark: SparkSession, sf: str) -> DataFrame:
    return longs(prepare(_dimension(spark, sf), _DIM_VARS).df)


@query(f"""WITH {_DIM} SELECT o_orderkey, 'EIN-' || o_custkey AS "EIN2", org_name_display, geo_county, asset_amount, ruling_year FROM orders LEFT JOIN d ON d."EIN2" = 'EIN-' || o_custkey AND o_custkey % 5 <> 0""")
def dim_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the organizations is known by another key, which no order has."""
    renamed = F.when(F.substring("EIN2", 5, 20).cast("long") % 5 == 0, F.concat("EIN2", F.lit("x"))).otherwise(F.col("EIN2"))
    some = prepare(_dimension(spark, sf).withColumn("EIN2", renamed), _DIM_VARS).df
    left = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" ein-"), F.col("o_custkey").cast("string")).alias("EIN2"))
    return longs(join_dimension(left, some).df)


# ---- normalisation and accounting -----------------------------------------------

_ROWS = """r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '990' WHEN 'O' THEN '990EZ' END AS form, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount,
CASE o_orderkey % 5 WHEN 0 THEN ' x ' WHEN 1 THEN 'No' WHEN 2 THEN '' WHEN 3 THEN 'maybe' END AS box FROM orders)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", " 990").when(F.col("o_orderstatus") == "O", "990ez").alias("form"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(k % 5 == 0, " x ").when(k % 5 == 1, "No").when(k % 5 == 2, "").when(k % 5 == 3, "maybe").alias("box"))


def _rules() -> list:
    return concordance(["amount", "box", "o_orderkey"], ["implicit_zero", "implicit_false", "literal_missing"], ["990", "990|990EZ", "*"])


@query(f"WITH {_ROWS} SELECT o_orderkey, round(CASE WHEN amount IS NULL AND form = '990' THEN 0 ELSE amount END, 4) AS amount FROM r")
def normalize_zero(spark: SparkSession, sf: str) -> DataFrame:
    return longs(normalize(_rows(spark, sf), _rules(), "form").df.select("o_orderkey", "amount"))


@query(f"WITH {_ROWS} SELECT o_orderkey, CASE WHEN form IS NULL THEN NULL WHEN box = ' x ' THEN TRUE WHEN box = 'No' OR box = '' OR box IS NULL THEN FALSE END AS box FROM r")
def normalize_checkbox(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(_rows(spark, sf), _rules(), "form").df.select("o_orderkey", "box")


@query(f"""WITH {_ROWS}
SELECT 'amount' AS field, count(*) FILTER (form = '990') AS applicable_rows, count(*) FILTER (form = '990' AND amount IS NULL) AS values_normalized,
       count(*) FILTER (form IS DISTINCT FROM '990' AND amount IS NULL) AS out_of_scope_blanks, 0::BIGINT AS unrecognized_count, NULL::VARCHAR AS unrecognized_values FROM r
UNION ALL SELECT 'box', count(*) FILTER (form IS NOT NULL), count(*) FILTER (form IS NOT NULL AND coalesce(box, '') = ''), count(*) FILTER (form IS NULL AND coalesce(box, '') = ''),
       count(*) FILTER (form IS NOT NULL AND box = 'maybe'), 'maybe' FROM r
UNION ALL SELECT 'o_orderkey', count(*), 0, 0, 0, NULL FROM r""")
def normalize_audit(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(_rows(spark, sf), _rules(), "form").audit().select("field", "applicable_rows", "values_normalized", "out_of_scope_blanks", "unrecognized_count", "unrecognized_values")


_MONEY = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '990' WHEN 'O' THEN '990EZ' END AS form, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 2 END AS b FROM orders"


@query(f"""WITH r AS ({_MONEY}) SELECT o_orderkey, round(CASE WHEN a IS NULL AND b IS NOT NULL THEN 0 ELSE a END, 4) AS "F9_01_REV_TOT_CY",
round(CASE WHEN b IS NULL AND a IS NOT NULL AND form IS DISTINCT FROM '990EZ' THEN 0 ELSE b END, 4) AS "F9_08_REV_TOT_TOT" FROM r""")
def normalize_panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.normalize import panel_normalize

    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "990").when(F.col("o_orderstatus") == "O", "990EZ").alias("RETURN_TYPE"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("F9_01_REV_TOT_CY"), F.when(k % 4 != 0, F.col("o_totalprice") / 2).alias("F9_08_REV_TOT_TOT"))
    return longs(panel_normalize(rows).df.drop("RETURN_TYPE"))


BOOKS = parse("net_of_discount: net: net = gross - discount\nwith_tax: subtotal: total = net + tax", "sales", "990")
_BOOK = """i AS (SELECT l_orderkey AS id, 1995 AS t, sum(round(l_extendedprice)) AS gross, sum(round(l_extendedprice * l_discount)) AS discount, sum(round(l_extendedprice * l_tax)) AS tax FROM lineitem GROUP BY l_orderkey),
k AS (SELECT id, t, gross, CASE WHEN id % 11 <> 0 THEN discount END AS discount, tax, gross - discount + CASE WHEN id % 7 = 0 THEN 30 ELSE 0 END AS net, gross - discount + tax + CASE WHEN id % 5 = 0 THEN 12 ELSE 0 END AS total FROM i)"""


def _books(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_extendedprice")
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.round(p)).alias("gross"), F.sum(F.round(p * F.col("l_discount"))).alias("discount"), F.sum(F.round(p * F.col("l_tax"))).alias("tax"))
    plain = F.col("gross") - F.col("discount")
    return i.select("id", F.lit(1995).alias("t"), "gross", F.when(F.col("id") % 11 != 0, F.col("discount")).alias("discount"), "tax",
                    (plain + F.when(F.col("id") % 7 == 0, 30).otherwise(0)).alias("net"), (plain + F.col("tax") + F.when(F.col("id") % 5 == 0, 12).otherwise(0)).alias("total"))


_RESIDUALS = "x AS (SELECT id, t, 'net_of_discount' AS identity, net - gross + discount AS residual FROM k UNION ALL SELECT id, t, 'with_tax', total - net - tax FROM k)"


@query(f"WITH {_BOOK}, {_RESIDUALS} SELECT id, t::BIGINT AS t, identity, round(residual, 4) AS residual, FALSE AS ok FROM x WHERE abs(residual) > 1")
def accounting_violations(spark: SparkSession, sf: str) -> DataFrame:
    return longs(accounting_check(_books(spark, sf), id="id", time="t", identities=BOOKS, sort=False))


@query(f"WITH {_BOOK}, {_RESIDUALS} SELECT id, t::BIGINT AS t, identity, round(residual, 4) AS residual, abs(residual) <= 20 AS ok FROM x")
def accounting_all(spark: SparkSession, sf: str) -> DataFrame:
    return longs(accounting_check(_books(spark, sf), id="id", time="t", tol=20, violations_only=False, identities=BOOKS, sort=False))


def reconcile_query(name: str, w: tuple[float, float, float], **args) -> None:
    """With gross and total fixed and weights w of net, discount and tax, the change solves a 2 x 2 system, as in the SQL."""
    a, b, c = (1 / x for x in w)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return longs(reconcile(_books(spark, sf), fixed=["gross", "total"], identities=BOOKS, **args).drop("t"))

    run.__name__ = name
    det = (a + b) * (a + c) - a * a
    query(f"""WITH {_BOOK}, m AS (SELECT *, net - gross + discount AS r1, total - net - tax AS r2 FROM k),
s AS (SELECT *, ({a + c} * r1 + {a} * r2) / {det} AS l1, ({a} * r1 + {a + b} * r2) / {det} AS l2 FROM m)
SELECT id, gross, round(CASE WHEN discount IS NULL THEN NULL ELSE discount - {b} * l1 END, 4) AS discount, round(CASE WHEN discount IS NULL THEN tax ELSE tax + {c} * l2 END, 4) AS tax,
round(CASE WHEN discount IS NULL THEN net ELSE net - {a} * (l1 - l2) END, 4) AS net, total FROM s""")(run)


reconcile_query("reconcile_equal", (1.0, 1.0, 1.0))
reconcile_query("reconcile_weighted", (4.0, 1.0, 2.0), weights={"net": 4.0, "tax": 2.0})


# ---- whole pipelines ------------------------------------------------------------


@query(f"""WITH {C_SQL} SELECT 'deduplicate' AS step, (SELECT count(*) FROM f) AS rows_before, (SELECT count(*) FROM p) AS rows_after
UNION ALL SELECT 'describe', (SELECT count(*) FROM p), (SELECT count(*) FROM p)
UNION ALL SELECT 'filter', (SELECT count(*) FROM p), (SELECT count(*) FROM p JOIN c USING (id) WHERE panel_type = 'persistent')""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    start = Panel(filings(spark, sf), create_frame(entity="id", time="t"))
    return start.deduplicate(group="grp", partial="par", amended="amd", timestamp="ts", tie=["rec"]).filter(panel_type="persistent").manifest().select("step", "rows_before", "rows_after")


@query(f"""WITH {C_SQL} SELECT panel_spell, count(DISTINCT p.id) AS n_ids, count(*) AS n_rows, round(sum(v), 2) AS v FROM p JOIN c USING (id) WHERE panel_type = 'persistent' GROUP BY panel_spell""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, deduplicate, classify, keep persistent entities, sum up."""
    out = label(panel(spark, sf).select("id", "t", "v"), "t", "id").where(Predicate.of("panel_type", "==", "persistent").on({"panel_type": "string"}))
    return out.groupBy("panel_spell").agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n_rows"), F.round(F.sum("v"), 2).alias("v"))


@query("""WITH e AS (SELECT user_id AS id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS t, value AS v FROM events),
d AS (SELECT id, t, min(v) AS v FROM e GROUP BY id, t)
SELECT a.id, a.t, round(avg(b.v), 4) AS v FROM d a JOIN d b ON a.id = b.id AND a.t - b.t BETWEEN 0 AND 6 GROUP BY a.id, a.t""")
def weekly_smooth_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("t"), F.col("value").alias("v"))
    return longs(smooth(e.groupBy("id", "t").agg(F.min("v").alias("v")), "v", 7, "equal", "right", "t", "id"))


@query("""WITH f AS (SELECT 'EIN-' || o_custkey AS "EIN2", o_orderkey, year(o_orderdate)::BIGINT AS t, o_orderstatus AS form, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS revenue
FROM orders), k AS (SELECT "EIN2" FROM f GROUP BY "EIN2" HAVING count(DISTINCT t) >= 5)
SELECT "EIN2", o_orderkey::VARCHAR AS "OBJECTID", t AS "TAX_YEAR", form AS "RETURN_TYPE", round(revenue, 4) AS "F9_01_REV_TOT_CY", c_name AS org_name_display FROM f
LEFT JOIN customer ON "EIN2" = 'EIN-' || c_custkey WHERE "EIN2" IN (SELECT "EIN2" FROM k) AND revenue > 50000 AND c_name IS NOT NULL""")
def panelize_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Write table-years of orders, all text, and build a panel from them: requirement, outer joins, stacking, dimension, rules."""
    from ..plans.assemble import panelize
    from ..plans.catalog import data_source
    from ..sources.shared import shared_folder, write_each

    root = shared_folder(spark, "table-years")
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    keys = [F.concat(F.lit("EIN-"), F.col("o_custkey").cast("string")).alias("EIN2"), F.col("o_orderkey").cast("string").alias("OBJECTID"), F.col("y").cast("string").alias("TAX_YEAR")]
    years = [r["y"] for r in o.select("y").distinct().sort("y").collect()]
    amount = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).cast("string").alias("F9_01_REV_TOT_CY")
    write_each(o.select("y", *keys, F.col("o_orderstatus").alias("RETURN_TYPE")), "y", {y: f"{root}/F9-P00-T00-HEADER-{y}.parquet" for y in years})
    write_each(o.select("y", *keys, amount), "y", {y: f"{root}/F9-P01-T00-SUMMARY-{y}.parquet" for y in years})
    names = table(spark, sf, "customer").select(F.concat(F.lit("ein-"), F.col("c_custkey").cast("string")).alias("EIN2"), F.col("c_name").alias("org_name_display"))
    frame = (create_frame("orders", record="OBJECTID").add_rule("require", table="P00", present_in=5).add_rule("filter", column="F9_01_REV_TOT_CY", op=">", values=50000.0)
             .add_rule("filter", column="org_name_display", op="not_in", values=[None]))
    p = panelize(spark, ["P00", "P01"], years, data_source(root), frame, dimension=prepare(names, ["EIN2", "org_name_display"]).df, attach="auto")
    return longs(p.df.select("EIN2", "OBJECTID", "TAX_YEAR", "RETURN_TYPE", "F9_01_REV_TOT_CY", "org_name_display"))

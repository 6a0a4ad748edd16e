"""Sample frames: keys and typed rules that say which rows and columns a panel has.

Frames are values: every change gives a new one. Rules lower into columns, semi
joins and projections, so applying a frame only extends the plan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, as_list
from ..functions.values import kinds, need, quoted
from ..operators.dedup import deduplicate
from ..operators.levels import drop_levels, each_level, factor, levels_of
from ..operators.membership import classify, place
from ..operators.order_stats import group_medians, large_groups
from .dictionary import FORM_SCOPES, Dictionary
from .ledger import Ledger

RULE_TYPES = ("subset", "require", "filter", "dedup", "label", "refresh", "select", "check", "view", "function")
# Short names of filters. @entity and @time stand for the frame's keys.
SUGAR = {
    "years": "@time", "year": "@time", "tax_year": "@time", "eins": "@entity", "ein": "@entity",
    "formtype": "RETURN_TYPE", "form_type": "RETURN_TYPE", "return_type": "RETURN_TYPE",
    "state": "geo_state_abbr", "county": "geo_county", "msa": "geo_metro_area", "metro": "geo_metro_area",
    "ntee": "ntee_code_clean", "ntee_industry": "ntee_code_major_group", "ntee_type": "nteev2_org_type",
    "subsection": "subsection_code", "filter_501c": "subsection_code",
}
#: Ids that go into the plan as literals; more become a table to join. Both are compared as text.
LITERAL_IDS = 1000
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "length": lambda c: F.count(F.lit(1)), "count": F.count, "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max,
    "median": F.median, "sd": F.stddev_samp, "var": F.var_samp, "n_distinct": F.count_distinct,
}
#: Of these, a group with a missing value has none either, as values are not dropped.
STRICT = ("sum", "mean", "avg", "min", "max", "median", "sd", "var")


@dataclass(frozen=True)
class Rule:
    """One rule; what its fields mean depends on ``type``."""

    name: str
    type: str
    active: bool = True
    predicate: Predicate | None = None
    ids: Any = None  # values, or a table whose first column holds them
    table: str = "P00"
    present_in: str | int = "all"
    holds: str = "every"
    column: str | None = None
    map: Any = None  # dict, or a table of ids and values
    options: dict = field(default_factory=dict)

    def detail(self) -> str:
        o = self.options
        if self.type in ("filter", "check"):
            return self.predicate.detail()
        if self.type == "subset":
            return "ids of a table" if isinstance(self.ids, DataFrame) else f"{len(self.ids)} ids"
        if self.type == "require":
            base = f"{self.table}: present in {self.present_in}"
            return base if self.predicate is None else f"{base}; {self.holds} year {self.predicate.detail()}"
        if self.type == "label":
            return f"-> {self.column}"
        if self.type == "select":
            return "; ".join(f"{k}={','.join(map(str, as_list(v)))}" for k, v in o.items() if v is not None)
        if self.type == "dedup":
            return "one per entity-time"
        if self.type == "refresh":
            return "fn" if o.get("fn") else f"action: {o['action']}"
        if self.type == "view":
            return " x ".join(str(o[k]) for k in ("rows", "cols") if o.get(k))
        return "fn" if o.get("fn") else "code"


def _make(name: str, type: str, o: dict) -> Rule:
    """Check a rule's arguments and build it."""
    if type in ("filter", "check"):
        return Rule(name, type, predicate=Predicate.of(o.get("column"), o.get("op"), o.get("values"), o.get("expr")))
    if type == "subset":
        ids = o.get("subset", o.get("ids"))
        if ids is None:
            raise ValueError("a subset rule needs ids")
        return Rule(name, type, ids=ids if isinstance(ids, DataFrame) else tuple(as_list(ids)))
    if type == "require":
        present = o.get("present_in", "all")
        if isinstance(present, str):
            present = present.strip().lower()
            if present not in ("all", "any"):
                raise ValueError("present_in must be all, any, or a number of years")
        elif isinstance(present, bool) or int(present) < 1:
            raise ValueError("present_in must be all, any, or a number of years")
        if o.get("expr") is not None:
            raise ValueError("a require rule takes column, op and values, not expr")
        holds = o.get("holds", "every")
        if holds not in ("every", "any"):
            raise ValueError("holds must be every or any")
        p = Predicate.of(o["column"], o.get("op"), o.get("values")) if o.get("column") else None
        return Rule(name, type, predicate=p, table=o.get("table", "P00"), present_in=present if isinstance(present, str) else int(present), holds=holds)
    if type == "label":
        column = o.get("label") or o.get("column")
        if column is None:
            raise ValueError("a label rule needs label, the name of the derived column")
        if o.get("map") is not None:
            return Rule(name, type, column=column, map=o["map"])
        source, keys = o.get("source"), o.get("keys")
        if source is None or keys is None:
            raise ValueError("a label rule needs map, or source, keys and label")
        need(source, keys, column)
        return Rule(name, type, column=column, map=source.select(quoted(keys).alias("id"), quoted(column).alias("value")))
    if type == "refresh":
        if o.get("fn") is None and o.get("action") is None:
            raise ValueError("a refresh rule needs fn or action")
        if o.get("fn") is not None and not callable(o["fn"]):
            raise ValueError("refresh fn must be a function")
        if o.get("action") not in (None, "droplevels", "factor", "group_stat"):
            raise ValueError(f"unknown refresh action: {o['action']}")
    if type == "function" and not any(o.get(k) for k in ("value", "code", "fn")):
        raise ValueError("a function rule needs code or fn")
    return Rule(name, type, options={k: v for k, v in o.items() if v is not None})


@dataclass(frozen=True)
class SampleFrame:
    name: str = "frame"
    keys: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    meta: dict = field(default_factory=dict)
    policy: dict = field(default_factory=dict)
    ledger: Ledger = field(default_factory=Ledger)

    @property
    def entity(self) -> str:
        return self.keys.get("entity", "EIN2")

    @property
    def time(self) -> str:
        return self.keys.get("time", "TAX_YEAR")

    @property
    def record(self) -> str:
        return self.keys.get("unique_record", "OBJECTID")

    def add_key(self, role: str, column: str) -> SampleFrame:
        """The column in a role (``entity``, ``time``, ``unique_record`` or another); one for each."""
        return replace(self, keys={**self.keys, role: column})

    def add_rule(self, type: str, name: str | None = None, **options) -> SampleFrame:
        """With a rule of ``type``; one of the same name is replaced where it stands."""
        if type not in RULE_TYPES:
            raise ValueError(f"type must be one of {', '.join(RULE_TYPES)}")
        name = name or f"{type}_{1 + sum(r.type == type for r in self.rules)}"
        rule = _make(name, type, options)
        if any(r.name == name for r in self.rules):
            return replace(self, rules=tuple(rule if r.name == name else r for r in self.rules))
        return replace(self, rules=(*self.rules, rule))

    def rule(self, name: str) -> Rule:
        found = [r for r in self.rules if r.name == name]
        if not found:
            raise KeyError(f"no rule named {name}")
        return found[0]

    def update_rule(self, name: str, **options) -> SampleFrame:
        """The named rule with other arguments, in its place."""
        r = self.rule(name)
        old: dict = dict(r.options)
        if r.predicate is not None:
            old |= {"column": r.predicate.column, "op": r.predicate.op, "values": r.predicate.values or None}
            if r.predicate.expr is not None:
                old = {"expr": r.predicate.expr}
        if r.type == "subset":
            old["ids"] = r.ids
        if r.type == "require":
            old |= {"table": r.table, "present_in": r.present_in, "holds": r.holds}
        if r.type == "label":
            old |= {"label": r.column, "map": r.map}
        if "column" in options or "op" in options:
            old.pop("expr", None)
        return self.add_rule(r.type, name, **{**old, **options})

    def remove_rule(self, name: str) -> SampleFrame:
        self.rule(name)
        return replace(self, rules=tuple(r for r in self.rules if r.name != name))

    def of(self, *types: str) -> list[Rule]:
        return [r for r in self.rules if r.active and r.type in types]

    def get_rules(self) -> list[dict]:
        return [{"name": r.name, "type": r.type, "active": r.active, "detail": r.detail()} for r in self.rules]

    def get_keys(self) -> list[dict]:
        return [{"role": k, "column": v} for k, v in self.keys.items()]

    def column_of(self, name: str) -> str:
        """The column that a short name stands for."""
        found = SUGAR.get(name.lower(), name)
        return {"@time": self.time, "@entity": self.entity}.get(found, found)

    def where(self, **filters) -> SampleFrame:
        """With an ``in`` filter for each name and its values; see ``SUGAR``."""
        out = self
        for k, v in filters.items():
            out = out.add_rule("filter", f"filter:{self.column_of(k)}", column=self.column_of(k), op="in", values=v)
        return out

    def add_function(self, name: str, fn: Callable | None = None, value: str | None = None) -> SampleFrame:
        """Archive a function or its code; applying the frame never runs it."""
        return self.add_rule("function", name, fn=fn, value=value)

    def add_view(self, name: str, rows: str, cols: str | None = None, value: str | None = None, fun: str = "length") -> SampleFrame:
        return self.add_rule("view", name, rows=rows, cols=cols, value=value, fun=fun)

    def add_refresh(self, name: str | None = None, fn: Callable | None = None, action: str | None = None, cols=None, by: str | None = None,
                    value: str | None = None, into: str | None = None, fun: str | None = None) -> SampleFrame:
        return self.add_rule("refresh", name, fn=fn, action=action, cols=cols, by=by, value=value, into=into, fun=fun)

    def add_meta(self, **meta) -> SampleFrame:
        return replace(self, meta={**self.meta, **meta})

    def set_policy(self, **policy) -> SampleFrame:
        """Notes on intended use; no operation reads them."""
        return replace(self, policy={**self.policy, **policy})

    def classified(self, df: DataFrame, classification: DataFrame | None = None) -> SampleFrame:
        """With the panel type and spell of each entity as label rules."""
        cls = classify(df, self.time, self.entity) if classification is None else classification
        out = self
        for c in ("panel_type", "panel_spell"):
            out = out.add_rule("label", c, label=c, map=cls.select(quoted(self.entity).alias("id"), F.col(c).alias("value")))
        return out

    def __repr__(self) -> str:
        lines = [f"<frame> {self.name}", "  keys: " + ", ".join(f"{k}={v}" for k, v in self.keys.items())]
        lines += [f"  [{r.type}] {r.name}{'' if r.active else ' (inactive)'}: {r.detail()}" for r in self.rules]
        return "\n".join(lines)


def create_frame(name: str = "frame", entity: str = "EIN2", time: str = "TAX_YEAR", record: str | None = None, meta: dict | None = None, **filters) -> SampleFrame:
    """A frame with its keys, and a filter for every further name."""
    keys = {"entity": entity, "time": time} | ({"unique_record": record} if record else {})
    return SampleFrame(name, keys, meta=meta or {}).where(**filters)


# ---- rules to plans -----------------------------------------------------------


def _id_table(spark: SparkSession, ids) -> DataFrame:
    """Ids as text, the way ``_listed`` compares them."""
    if isinstance(ids, DataFrame):
        return ids.select(quoted(ids.columns[0]).cast("string").alias("kept_id")).where("kept_id is not null").distinct()
    return spark.createDataFrame([(str(i),) for i in dict.fromkeys(ids) if i is not None], "kept_id string")


def keep_ids(df: DataFrame, ids, entity: str) -> DataFrame:
    """Rows whose entity is among ``ids``: literals if few, else a semi join. No ids, no rows."""
    if not isinstance(ids, DataFrame) and len(ids) <= LITERAL_IDS:
        return df.where(F.coalesce(_listed(df, ids, entity), F.lit(False)))
    return df.join(_id_table(df.sparkSession, ids), quoted(entity).cast("string") == F.col("kept_id"), "left_semi")


def _listed(df: DataFrame, ids, entity: str) -> Column:
    values = [str(i) for i in ids if i is not None]
    return quoted(entity).cast("string").isin(*values) if values else F.lit(False)


def _label_table(spark: SparkSession, rule: Rule) -> DataFrame:
    """Ids and values; the first value of an id counts."""
    if isinstance(rule.map, DataFrame):
        a, b = rule.map.columns[:2]
        return rule.map.select(quoted(a).cast("string").alias("id"), quoted(b).alias("value")).groupBy("id").agg(F.min("value").alias("value"))
    return spark.createDataFrame([(str(k), v) for k, v in dict(rule.map).items()], "id string, value string" if all(v is None or isinstance(v, str) for v in rule.map.values()) else None or ["id", "value"])


def _evaluate(df: DataFrame, frame: SampleFrame, rule: Rule) -> tuple[DataFrame, Column] | None:
    """The predicate on ``df``, which may have got the label it needs; None where it can't be told."""
    p = rule.predicate
    if p.expr is not None:
        try:
            df.where(F.expr(p.expr).cast("boolean"))
        except AnalysisException as e:
            warnings.warn(f"rule {rule.name} skipped: {e.getCondition()}", stacklevel=3)
            return None
        return df, p.on(kinds(df))
    if p.column in df.columns:
        return df, p.on(kinds(df))
    labels = [r for r in frame.of("label") if r.column == p.column]
    if not labels:
        return None
    t = _label_table(df.sparkSession, labels[-1])
    out = df.join(t.select(F.col("id").alias("__label_id"), F.col("value").alias("__label")), quoted(frame.entity).cast("string") == F.col("__label_id"), "left").drop("__label_id")
    return out, p.test(F.col("__label"), kinds(out)["__label"])


@dataclass(frozen=True)
class Applied:
    """What a frame makes of a table. Checks and views are lazy."""

    df: DataFrame
    frame: SampleFrame
    steps: tuple[tuple[str, str, DataFrame, DataFrame], ...]
    skipped: tuple[str, ...] = ()
    makes: tuple[Callable[[DataFrame], DataFrame] | None, ...] = ()

    def checks(self) -> DataFrame:
        return run_checks(self.df, self.frame)

    def views(self) -> dict[str, DataFrame | None]:
        return views(self.df, self.frame)


def apply_frame(df: DataFrame, frame: SampleFrame, columns: bool = True, dictionary: Dictionary | None = None, **adhoc) -> Applied:
    """Run the active rules: subset, filter (then the ad-hoc ones), dedup, refresh, select.

    A filter whose column is neither in the table nor a label is skipped.
    """
    steps: list[tuple[str, str, DataFrame, DataFrame]] = []
    skipped: list[str] = []

    makes: list[Callable[[DataFrame], DataFrame] | None] = []

    def step(name: str, detail: str, make: Callable[[DataFrame], DataFrame], lazy: bool = True) -> DataFrame:
        after = make(df)
        steps.append((name, detail, df, after))
        makes.append(make if lazy else None)
        return after

    def filtered(rule: Rule) -> Callable[[DataFrame], DataFrame]:
        def make(d: DataFrame) -> DataFrame:
            wide, keep = _evaluate(d, frame, rule)
            return wide.where(keep).drop("__label")

        return make

    for r in frame.of("subset"):
        df = step(f"subset: {r.name}", r.detail(), lambda d, r=r: keep_ids(d, r.ids, frame.entity))
    extra = [Rule(f"adhoc:{k}", "filter", predicate=Predicate.of(frame.column_of(k), "in", v)) for k, v in adhoc.items()]
    for r in frame.of("filter") + extra:
        if _evaluate(df, frame, r) is None:
            skipped.append(r.name)
            continue
        df = step(f"filter: {r.name}", r.detail(), filtered(r))
    for r in frame.of("dedup"):
        some = {k: v for k, v in r.options.items() if k in ("group", "partial", "amended", "timestamp")}
        df = step(f"dedup: {r.name}", r.detail(), lambda d, some=some: deduplicate(d, frame.entity, frame.time, **some))
    for r in frame.of("refresh"):
        df = step(f"refresh: {r.name}", r.detail(), lambda d, r=r: refresh(d, r), lazy=False)
    selects = frame.of("select")
    if columns and selects:
        pooled = {k: [x for r in selects for x in as_list(r.options.get(k))] for k in ("scope", "tables", "vars", "drop")}
        names = (dictionary or Dictionary()).select(df.columns, pooled["scope"], pooled["tables"], pooled["vars"], pooled["drop"])
        df = step("select", "column selection", lambda d: d.select(*[quoted(c) for c in names]))
    return Applied(df, frame, tuple(steps), tuple(skipped), tuple(makes))


def refresh(df: DataFrame, rule: Rule) -> DataFrame:
    """Values derived anew. ``factor`` makes the values of columns their levels, ``droplevels`` drops the levels that no row has."""
    o = rule.options
    if o.get("fn"):
        out = o["fn"](df)
        if not isinstance(out, DataFrame):
            raise TypeError(f"refresh {rule.name} must return a DataFrame")
        return out
    if o["action"] == "factor" and not o.get("cols"):
        raise ValueError("a factor refresh needs cols")
    if o["action"] == "factor":
        return factor(df, as_list(o["cols"]))
    if o["action"] == "droplevels":
        return drop_levels(df, as_list(o["cols"]) if o.get("cols") else None)
    if not o.get("by") or not o.get("value"):
        raise ValueError("group_stat needs by and value")
    fun = o.get("fun", "mean")
    if fun not in AGGREGATES:
        raise ValueError(f"fun must be one of {', '.join(AGGREGATES)}")
    by, value = quoted(o["by"]), quoted(o["value"])
    into = o.get("into", f"{o['value']}_{fun}")
    # summed before the shuffle, then joined by the key: no group goes to one task whole
    stats = _stats(df, o["by"], o["value"], fun)
    told = df.drop(into) if into != o["value"] and into != o["by"] else df
    flat = told.toDF(*[f"c{i}" for i in range(len(told.columns))])
    own, mine = F.col(place(told, o["by"])), F.col(place(told, o["value"]))
    joined = flat.join(stats, own == F.col("by"), "left").withColumn("stat", F.when(own.isNull(), mine.cast("double")).otherwise(F.col("stat")))
    named = joined.drop("by").toDF(*told.columns, "__stat")
    return named.withColumn(into, F.col("__stat")).drop("__stat")


def _stats(df: DataFrame, by: str, value: str, fun: str) -> DataFrame:
    """``by`` and ``stat``, a group's statistic; groups without a key are left out. Medians are exact whatever a group's size."""
    rows, v = df.where(quoted(by).isNotNull()), quoted(value)
    whole = F.count(v) == F.count(F.lit(1))
    if fun == "median" and (large := large_groups(df, by, value)) is not None:
        held = rows.groupBy(quoted(by).alias("key")).agg(whole.alias("whole"))
        stats = held.join(group_medians(df, by, value, large=large), F.col("key") == F.col("by"), "left")
        return stats.select(F.col("key").alias("by"), (F.when(F.col("whole"), F.col("stat")) if fun in STRICT else F.col("stat")).alias("stat"))
    stat = AGGREGATES[fun](v)
    return rows.groupBy(quoted(by).alias("by")).agg((F.when(whole, stat) if fun in STRICT else stat).alias("stat"))


CHECKS = "check string, n long, pass long, fail long, ok boolean, note string"


def run_checks(df: DataFrame, frame: SampleFrame) -> DataFrame:
    """A row for each check rule: how many rows pass and fail. One aggregation for all of them."""
    wide, parts = df, []
    for r in frame.of("check"):
        found = _evaluate(wide, frame, r)
        if found is None:
            parts.append((r.name, None))
            continue
        wide, keep = found
        name = f"__check{len(parts)}"
        wide = wide.withColumn(name, keep).drop("__label")
        parts.append((r.name, name))
    if not parts:
        return df.sparkSession.createDataFrame([], CHECKS)
    n = F.count(F.lit(1))
    rows = []
    for name, column in parts:
        ok = F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0)) if column else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(name).alias("check"), n.alias("n"), ok.alias("pass"), (n - ok).alias("fail"), (n == ok).alias("ok"), F.lit("" if column else "column absent").alias("note")))
    return wide.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def view(df: DataFrame, rule: Rule) -> DataFrame | None:
    """Counts by ``rows``; by ``rows`` and ``cols`` (zeros filled in); or ``fun`` of ``value`` by ``rows``. Missing groups are left out.

    Levels of a column that no row has count zero, and have a null statistic. Columns of a crosstab are its levels where it has
    any, so that no job looks for its values.
    """
    o = rule.options
    rows, cols, value = o.get("rows"), o.get("cols"), o.get("value")
    if not rows or rows not in df.columns or (cols and cols not in df.columns):
        return None
    some = df.where(quoted(rows).isNotNull())
    if cols:
        some = some.where(quoted(cols).isNotNull())
        return each_level(df, rows, some.groupBy(quoted(rows)).pivot(cols, levels_of(df, cols)).count().fillna(0))
    if value and value in df.columns:
        fun = o.get("fun", "length")
        if fun not in AGGREGATES:
            raise ValueError(f"fun must be one of {', '.join(AGGREGATES)}")
        return each_level(df, rows, _stats(df, rows, value, fun).toDF(rows, fun), fill=False)
    return each_level(df, rows, some.groupBy(quoted(rows)).agg(F.count("*").alias("count")))


def views(df: DataFrame, frame: SampleFrame) -> dict[str, DataFrame | None]:
    return {r.name: view(df, r) for r in frame.of("view")}


@dataclass(frozen=True)
class Conformity:
    conformant: bool
    rows_total: int
    rows_violating: int
    missing_keys: tuple[str, ...]
    checks: tuple[dict, ...]


def conform(df: DataFrame, frame: SampleFrame) -> Conformity:
    """Whether all rows keep the subset and filter rules, the keys are there and the checks hold."""
    absent = tuple(k for k in (frame.entity, frame.time) if k not in df.columns)
    wide, keeps = df, []
    for r in frame.of("subset", "filter"):
        if r.type == "subset":
            if isinstance(r.ids, DataFrame) or len(r.ids) > LITERAL_IDS:
                t = _id_table(df.sparkSession, r.ids).withColumn("__in", F.lit(True))
                name = f"__keep{len(keeps)}"
                wide = wide.join(t, quoted(frame.entity).cast("string") == F.col("kept_id"), "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("kept_id", "__in")
                keeps.append(F.col(name))
            else:
                keeps.append(F.coalesce(_listed(df, r.ids, frame.entity), F.lit(False)))
            continue
        found = _evaluate(wide, frame, r)
        if found is not None:
            name = f"__keep{len(keeps)}"
            wide = found[0].withColumn(name, found[1]).drop("__label")
            keeps.append(F.col(name))
    keep = reduce(lambda a, b: a & b, keeps, F.lit(True))
    row = wide.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~keep).cast("long")), F.lit(0)).alias("bad")).first()
    checks = tuple(r.asDict() for r in run_checks(df, frame).collect())
    ok = row["bad"] == 0 and not absent and all(c["ok"] is not False for c in checks)
    return Conformity(ok, row["n"], row["bad"], absent, checks)


def check_form_scope(frame: SampleFrame, form: str) -> None:
    """990 scopes mean nothing on a 990PF panel, which has one form."""
    if form != "990PF":
        return
    bad = [s for r in frame.of("select") for s in as_list(r.options.get("scope")) if s.upper() not in ("990PF", "PF", "HD", "SG")]
    if bad:
        raise ValueError(f"form scope {', '.join(bad)} does not apply to a 990PF panel")


def wanted_columns(frame: SampleFrame, dictionary: Dictionary) -> list[str] | None:
    """Columns that the frame's select rules and predicates name; None: all."""
    selects = frame.of("select")
    if not selects:
        return None
    scope = [x for r in selects for x in as_list(r.options.get("scope"))]
    tables = [x for r in selects for x in as_list(r.options.get("tables"))]
    every = dictionary.fields()
    out = {f.name for f in every if f.scope == "HD"} | {x for r in selects for x in as_list(r.options.get("vars"))}
    if scope and all(s in FORM_SCOPES for s in scope):
        out |= {n for s in scope for n in dictionary.in_scope(s)}
    elif scope:
        out |= {f.name for f in every if f.scope in {s.upper() for s in scope}}
    if tables:
        expanded = set(dictionary.expand_tables(tables))
        out |= {f.name for f in every if f.table in expanded}
    if any(r.predicate.expr for r in frame.of("filter", "check")) or frame.of("refresh", "view"):
        return None
    return sorted(out | {r.predicate.column for r in frame.of("filter", "check")} | {"RETURN_TYPE"})

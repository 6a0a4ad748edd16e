"""Conditions across table-years: who is present in every year, or satisfies a predicate in each."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import kinds, need, quoted
from ..sources.stage import exists
from ..sources.tables import cast_declared, scan, stack
from .catalog import DataSource, resolve_tables
from .dictionary import Dictionary
from .frame import Rule, SampleFrame

#: Entities that may be gathered as values of a rule.
MAX_CAPTURED = 100_000


def satisfying(df: DataFrame, rule: Rule, entity: str, time: str, n_years: int) -> DataFrame:
    """Entities of ``df`` that meet the rule, one column: one aggregation, two or three columns read.

    ``present_in`` counts distinct times. A predicate must hold in every row, or in
    any; rows where it can't be told don't count, and an entity without others fails.
    """
    need(df, entity, time)
    k = {"all": n_years, "any": None}.get(rule.present_in, None if isinstance(rule.present_in, str) else min(int(rule.present_in), n_years))
    aggs = [F.count_distinct(quoted(time)).alias("years")]
    if rule.predicate is not None:
        kind = kinds(df)
        if rule.predicate.column not in kind:
            raise ValueError(f"column not found: {rule.predicate.column}")
        c = quoted(rule.predicate.column)
        told = F.when(c.isNotNull(), rule.predicate.test(c, kind[rule.predicate.column]))
        aggs.append((F.bool_and if rule.holds == "every" else F.bool_or)(told).alias("holds"))
    out = df.groupBy(quoted(entity).alias("kept_id")).agg(*aggs)
    if k is not None:
        out = out.where(F.col("years") >= k)
    if rule.predicate is not None:
        out = out.where(F.coalesce("holds", F.lit(False)))
    return out.select("kept_id")


def resolve_frame(spark: SparkSession, frame: SampleFrame, years, source: DataSource, name: str = "resolved", capture: bool = False, dictionary: Dictionary | None = None) -> SampleFrame:
    """The frame with its require rules answered by one subset rule; they stay on record, inactive.

    The ids stay a lazy table that is semi-joined to whatever the frame is applied
    to; ``capture`` gathers them as values at the driver, and raises if there are more than
    ``MAX_CAPTURED``. Years without a file are passed over.
    """
    rules = frame.of("require")
    if not rules:
        return frame
    sets, ledger = [], frame.ledger
    for r in rules:
        table = resolve_tables(r.table, source)[0].table
        paths = {y: p for y in sorted({int(y) for y in years}) if exists(spark, p := source.path(table, y))}
        if not paths:
            raise ValueError(f"no {table} file for the years asked for under {source.root}")
        wanted = {frame.entity, frame.time} | ({r.predicate.column} if r.predicate else set())
        parts = {y: scan(spark, p, source.format) for y, p in paths.items()}
        # a file without the year is of the year that its name tells
        parts = [p if frame.time in p.columns else p.withColumn(frame.time, F.lit(y)) for y, p in parts.items()]
        df = stack([cast_declared(p.select(*[quoted(c) for c in p.columns if c in wanted]), dictionary) for p in parts])
        ids = satisfying(df, r, frame.entity, frame.time, len(paths))
        ledger = ledger.add(f"require: {r.name}", r.detail(), None, ids)
        sets.append(ids)
    ids = reduce(lambda a, b: a.join(b, "kept_id", "left_semi"), sets)
    if len(sets) > 1:
        ledger = ledger.add("resolve_frame", f"{len(sets)} requirements intersected", None, ids)
    kept = tuple(replace(r, active=False) if r.type == "require" else r for r in frame.rules)
    out = replace(frame, rules=kept, ledger=ledger)
    if capture:
        got = [r[0] for r in ids.limit(MAX_CAPTURED + 1).collect()]
        if len(got) > MAX_CAPTURED:
            raise ValueError(f"more than {MAX_CAPTURED} entities satisfy the requirements: resolve without capture, which keeps them a table")
        return out.add_rule("subset", name, ids=got)
    return out.add_rule("subset", name, ids=ids)

"""From table-years to one panel: join within a year, stack years, attach the dimension, apply the frame."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import as_list
from ..functions.values import quoted
from ..operators.dimension import FIELDS, join_dimension
from ..sources.dimension import retrieve
from ..sources.distinct import row_hash
from ..sources.keyed import folded_values, keep_entities
from ..sources.shared import shared_folder
from ..sources.stage import download_tables
from ..sources.tables import READABLE, ROW, TableYear, read_tables, stack
from .catalog import DataSource, data_source, form_family, resolve_tables
from .dictionary import FILING_KEYS, Dictionary
from .frame import SampleFrame, apply_frame, check_form_scope, create_frame, wanted_columns
from .merge import join_tables, merge_unique, right_names, shared_keys
from .panel import Panel
from .requirements import resolve_frame


def duplicate_keys(df: DataFrame, keys=FILING_KEYS) -> DataFrame | None:
    """``d``: how many rows of a table have filing keys that another has already. None without keys."""
    by = [quoted(k) for k in keys if k in df.columns]
    if not by:
        return None
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))


def verify_keys(tables: list[TableYear], keys=FILING_KEYS) -> None:
    """Raise if a table with one row a filing has repeated keys. One job for all tables, which reads their keys only."""
    asked = [(t, d) for t in tables if t.table.cardinality == "1x1" and (d := duplicate_keys(t.df, keys)) is not None]
    if not asked:
        return
    found = reduce(DataFrame.unionAll, [d.select(F.lit(i).alias("i"), "d") for i, (_, d) in enumerate(asked)])
    bad = found.where("d > 0").sort("i").collect()
    if bad:
        raise ValueError("; ".join(f"{r['d']} repeated keys in {asked[r['i']][0].table.table} of {asked[r['i']][0].year}" for r in bad) + ", which should have one row a filing")


def joined_by(tables: list[TableYear], keys=FILING_KEYS) -> list[str] | None:
    """The keys that each table of a year is joined by to those before it, if they are the same at each join; of a table alone its own keys."""
    columns = tables[0].df.columns
    found = [[k for k in keys if k in columns]] if len(tables) == 1 else []
    for t in tables[1:]:
        found.append([k for k in keys if k in columns and k in t.df.columns])
        columns = [*columns, *t.df.columns]
    return found[0] if found[0] and all(by == found[0] for by in found) else None


def repeating(tables: list[tuple[TableYear, list[str]]]) -> set[int]:
    """Places of the table-years in which different rows have the same values of the given keys, as far as hashes tell. One job.

    A key is a 64-bit hash, so this may name too many; different rows are told apart by 128 bits. What is shuffled are these, whatever the
    rows hold, aggregated before in part. Rows that are equal as a whole repeat nothing, unless the table keeps them.
    """
    parts = []
    for i, (t, by) in enumerate(tables):
        whole = [F.col(r) if ROW[0] in t.marked.columns else F.lit(None).cast("long") for r in ROW]
        parts.append(t.marked.select(F.lit(i).alias("i"), row_hash(t.marked.select(*[quoted(k) for k in by]))[1].alias("k"), *[w.alias(f"r{j}") for j, w in enumerate(whole)]))
    counts = reduce(DataFrame.unionAll, parts).groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"), *[f(r).alias(f"{r}{name}") for r in ("r0", "r1") for name, f in (("a", F.min), ("z", F.max))])
    # without hashes of rows, each row counts
    several = (F.col("n") > 1) & ~F.coalesce((F.col("r0a") == F.col("r0z")) & (F.col("r1a") == F.col("r1z")), F.lit(False))
    return {r["i"] for r in counts.where(several).select("i").distinct().collect()}


def _taking_part(tables: list[TableYear], include_many: bool) -> dict[int, list[TableYear]]:
    found: dict[int, list[TableYear]] = {}
    for t in sorted((t for t in tables if t.status in READABLE and t.df is not None), key=lambda t: t.year):
        if t.table.cardinality == "1x1" or include_many:
            found.setdefault(t.year, []).append(t)
    return found


def single_years(tables: list[TableYear], keys=FILING_KEYS, include_many: bool = False) -> dict[int, list[str]]:
    """The years all of whose tables have one row for each value of the keys that they are joined by, and these keys.

    Raises for a table with one row a filing whose own keys repeat: those are looked at exactly where a hash does.
    """
    asked, years = [], {}
    for year, of_year in _taking_part(tables, include_many).items():
        one = [t for t in of_year if t.table.cardinality == "1x1"]
        by = joined_by(of_year, keys) if len(one) == len(of_year) else None
        years[year] = by
        own = [(t, [k for k in keys if k in t.df.columns]) for t in one]
        asked += [(t, by or k) for t, k in own if by or k]
    bad = repeating(asked) if asked else set()
    verify_keys([asked[i][0] for i in sorted(bad)], keys)
    not_single = {asked[i][0].year for i in bad}
    return {y: by for y, by in years.items() if by and y not in not_single}


def merge_years(tables: list[TableYear], by_year: dict[int, DataFrame], single: dict[int, list[str]], collision: str = "error") -> DataFrame:
    """All years in one table. Those of ``single`` that have the same columns are merged in one shuffle for all of them, by year and keys.

    Whole rows that a table repeats fall together there, so they needn't be made distinct before.
    """
    shapes: dict[tuple, list[int]] = {}
    of = {y: [t for t in tables if t.year == y and t.df is not None and t.status in READABLE and t.table.cardinality == "1x1"] for y in single}
    for y, by in single.items():
        if len(of[y]) > 1:
            shapes.setdefault((tuple(by), *[(t.table.table, *t.df.dtypes) for t in of[y]]), []).append(y)
    done: dict[int, DataFrame] = {}
    for (by, *_), years in shapes.items():
        parts = []
        for n, t in enumerate(of[years[0]]):
            rows = [of[y][n].rows.withColumn("__year", F.lit(y)) for y in years]
            parts.append((t.table.table, reduce(DataFrame.unionAll, rows)))
        merged = merge_unique(parts, [*by, "__year"], collision)
        done |= {years[0]: merged.select(*[quoted(c) for c in by_year[years[0]].columns])} | dict.fromkeys(years[1:])
    frames = [done[y] if y in done else df for y, df in by_year.items()]
    return stack([f for f in frames if f is not None])


def merge_tables(tables: list[TableYear], keys=FILING_KEYS, include_many: bool = False, collision: str = "error", verify: bool = True, verified: bool = False) -> tuple[dict[int, DataFrame], list[dict]]:
    """One wide table a year, and a record of each join.

    Tables with many rows a filing are left out unless ``include_many``. ``verify``
    counts repeated keys in tables that should have none, and raises; without it
    repeats multiply rows. ``verified`` tables aren't counted again.
    """
    verify = verify or verified
    if verify and not verified:
        verify_keys([t for t in tables if t.status in READABLE and t.df is not None], keys)
    years: dict[int, DataFrame] = {}
    joins = []
    for year in sorted({t.year for t in tables if t.status in READABLE}):
        of_year = [t for t in tables if t.year == year and t.df is not None and (t.table.cardinality == "1x1" or include_many)]
        if not of_year:
            continue
        names, columns = of_year[0].table.table, of_year[0].df.columns
        for t in of_year[1:]:
            by = shared_keys(columns, t.df.columns, t.table.table, keys)
            named = right_names(columns, t.df.columns, t.table.table, by, collision)
            joins.append({"year": year, "left": names, "right": t.table.table, "keys": ";".join(by), "expected_cardinality": t.table.cardinality, "collisions": ";".join(c for c, new in named.items() if c != new)})
            names, columns = f"{names}+{t.table.table}", [*by, *[c for c in columns if c not in by], *named.values()]
        # a run of verified tables is merged in one shuffle; tables with many rows a filing are joined in their place
        done: DataFrame | None = None
        run: list[tuple[str, DataFrame]] = []
        for t in of_year:
            if verify and t.table.cardinality == "1x1" and done is None:
                run.append((t.table.table, t.df))
                continue
            if done is None and run:
                done = merge_unique(run, keys, collision)
            done = t.df if done is None else join_tables(done, t.df, t.table.table, keys, collision)
        years[year] = (merge_unique(run, keys, collision) if done is None else done).select(*[quoted(c) for c in columns])
    return years, joins


def names_traits(frame: SampleFrame) -> bool:
    """Whether a rule names a field of the organization dimension other than the key."""
    traits = set(FIELDS) - {"EIN2", frame.entity}
    named = {r.predicate.column for r in frame.rules if r.predicate is not None}
    named |= {v for r in frame.rules for v in as_list(r.options.get("vars"))}
    return bool(named & traits)


def store_ids(spark: SparkSession, frame: SampleFrame) -> SampleFrame:
    """The frame with the ids of its subset rules that are tables stored in the shared folder: they are asked for by several jobs, and found once."""

    def stored(ids: DataFrame) -> DataFrame:
        path = f"{shared_folder(spark, 'entities')}/ids"
        ids.select(quoted(ids.columns[0]).alias("kept_id")).distinct().write.parquet(path)
        return spark.read.parquet(path)

    asked = [r for r in frame.of("subset") if isinstance(r.ids, DataFrame)]
    return replace(frame, rules=tuple(replace(r, ids=stored(r.ids)) if any(r is a for a in asked) else r for r in frame.rules)) if asked else frame


def fits_broadcast(ids: DataFrame) -> bool:
    """Whether Spark may broadcast these ids as text."""
    about = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(quoted(ids.columns[0]).cast("string"))), F.lit(0)).alias("size")).first()
    return about["size"] + 16 * about["n"] <= int(ids.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def panelize(spark: SparkSession, tables, years, source: DataSource, frame: SampleFrame | None = None, dimension: DataFrame | str | None = None, attach="auto",
             path: str | None = None, filters: dict[str, list] | None = None, columns: list[str] | None = None, include_many: bool = False,
             collision: str = "error", unique_rows: bool = True, overwrite: bool = False, verify: bool = True, dictionary: Dictionary | None = None) -> Panel:
    """Build a panel: one lazy plan from scans to rules.

    The ids of requirements and of subset tables are stored once; where they fit a broadcast they are kept at each
    scan, else in one semi join after the merge, which takes all years of the same shape in one shuffle. The entities of subset rules and of ``in``
    filters on the entity key are pushed to each scan below the outer joins, where
    Spark can't put them by itself. The ``dimension`` is joined if ``attach``, or if
    a rule names one of its fields. Files are read in place unless ``path`` names a
    cache to stage them in.
    """
    d = dictionary or Dictionary()
    years = sorted({int(y) for y in years})
    if frame is None:
        asked = as_list(tables)
        frame = create_frame(f"panel[{', '.join(asked) if len(asked) <= 6 else f'{len(asked)} tables'} | {years[0]}-{years[-1]}]", record="OBJECTID")
    elif "unique_record" not in frame.keys:
        frame = frame.add_key("unique_record", "OBJECTID")
    check_form_scope(frame, source.form)
    resolve_tables(tables, source)
    frame = resolve_frame(spark, frame, years, source, dictionary=d)

    frame = store_ids(spark, frame)
    listed, table = dict(filters or {}), None
    for r in frame.of("subset"):
        if isinstance(r.ids, DataFrame):
            table = r.ids if table is None else table.join(r.ids, table.columns[0], "left_semi")
        else:
            listed = _narrow(listed, frame.entity, r.ids)
    for r in frame.of("filter"):
        if r.predicate.column == frame.entity and r.predicate.op == "in":
            listed = _narrow(listed, frame.entity, r.predicate.values)
    if columns is None:
        columns = wanted_columns(frame, d)
    if columns is not None:
        columns = list(dict.fromkeys([*frame.keys.values(), *FILING_KEYS, *columns]))
    staged = download_tables(years, tables, source, path, overwrite) if path else None
    # ids that aren't broadcast would shuffle each table once more: they are joined once, to the merged rows
    late = verify and table is not None and len(as_list(tables)) > 1 and not fits_broadcast(table)
    reads = read_tables(spark, tables, years, source, staged, columns=columns, filters=listed or None, unique_rows=unique_rows, dictionary=d, ids=table, entity=frame.entity, late=late)
    keys = list(dict.fromkeys([*frame.keys.values(), *FILING_KEYS]))
    single = single_years(reads, keys, include_many) if verify else {}
    by_year, joins = merge_tables(reads, keys, include_many, collision, verify=False, verified=verify)
    if not by_year:
        raise ValueError("no table-years could be read")
    df = merge_years(reads, by_year, single, collision)
    if late and frame.entity in df.columns:
        df = keep_entities(df, frame.entity, ids=table)
    frame = replace(frame, ledger=frame.ledger.add("panelize", f"{len(as_list(tables))} tables x {len(years)} years", None, df))
    if dimension is not None and (attach is True or (attach == "auto" and names_traits(frame))):
        prepared = retrieve(spark, dimension, id=frame.entity)
        joined = join_dimension(df, prepared.df, frame.entity)
        frame = replace(frame, ledger=frame.ledger.add("join_dimension", "organization fields", df, joined.df))
        df = joined.df
    applied = apply_frame(df, frame, dictionary=d)
    ledger = frame.ledger
    for (step, detail, before, after), make in zip(applied.steps, applied.makes):
        ledger = ledger.add(step, detail, before, after, make)
    return Panel(applied.df, replace(frame, ledger=ledger), False, tuple(reads), tuple(joins), source)


def _narrow(filters: dict[str, list], column: str, values) -> dict[str, list]:
    """``filters`` with ``column`` among ``values`` too; entities are compared as at the scan, without regard to case and blanks around."""
    asked, have = folded_values(values), filters.get(column)
    if have is not None:
        also = set(asked)
        asked = [v for v in folded_values(have) if v in also]
    return {**filters, column: asked}


def panelize_pf(spark: SparkSession, tables, years, root: str, format: str = "parquet", **options) -> Panel:
    """``panelize`` on the 990PF release under ``root``."""
    if "source" in options:
        raise ValueError("panelize_pf makes its own source: give root")
    return panelize(spark, tables, years, data_source(root, format=format, form=form_family("990PF")), **options)

"""Reading table-years: declared types, exact filters, distinct rows, in one lazy scan each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import quoted, trim
from ..plans.catalog import DataSource, Resolved, format_of, resolve_tables
from ..plans.dictionary import Dictionary
from .distinct import WIDE, RowProfile, count_rows, distinct_rows, profile_rows, row_hash
from .keyed import FOLDED, LISTED, keep_entities, visible
from .stage import Staged, exists

READABLE = ("downloaded", "reused", "virtual")
#: Hashes of a whole row as it lies, beside its columns.
ROW = ("__row1", "__row2")


def cast_declared(df: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Text columns that the dictionary calls numeric or integer, cast; what can't be is null.

    An integer column takes the whole part of a number. Columns it doesn't know, or
    that are not text, stay as read.
    """
    d = dictionary or Dictionary()
    return df.select(*[_cast(c, k, d).alias(c) for c, k in df.dtypes])


def _cast(name: str, kind: str, d: Dictionary) -> Column:
    type_ = d.type_of(name)
    if kind != "string" or type_ not in ("numeric", "integer"):
        return quoted(name)
    number = trim(quoted(name)).try_cast("double")
    return number if type_ == "numeric" else number.try_cast("int")


def cast_audit(df: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """``field``, ``bad_count`` and up to three ``bad_values`` of declared numbers that are neither blank nor numbers. One pass."""
    d = dictionary or Dictionary()
    names = [c for c, k in df.dtypes if k == "string" and d.type_of(c) in ("numeric", "integer")]
    schema = "field string, bad_count long, bad_values array<string>"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    parts = []
    for c in names:
        text = trim(quoted(c))
        bad = F.coalesce((text != "") & text.try_cast("double").isNull(), F.lit(False))
        parts.append(F.struct(
            F.lit(c).alias("field"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad_count"),
            F.array_compact(F.array(F.min(F.when(bad, text)), F.nullif(F.max(F.when(bad, text)), F.min(F.when(bad, text))))).alias("bad_values"),
        ))
    return df.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*").where(F.col("bad_count") > 0)


def scan(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A file as it lies. CSV columns are read as text, so that both formats take the same declared types."""
    if (format or format_of(path)) == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)


@dataclass(frozen=True)
class TableYear:
    """One table of one year: the plan that reads it, and what lies behind it."""

    table: Resolved
    year: int
    path: str
    status: str
    df: DataFrame | None
    raw: DataFrame | None
    profile: RowProfile | None = None
    filtered: bool = False
    unique: bool = True
    #: The rows of ``df`` with their repeats and, where these are to go, the hashes ``ROW`` of the whole rows.
    marked: DataFrame | None = None

    @property
    def rows(self) -> DataFrame | None:
        return self.marked.drop(*ROW) if self.marked is not None else None


def filtered_rows(raw: DataFrame, filters: dict[str, list] | None = None, ids: DataFrame | None = None, entity: str = "EIN2") -> DataFrame:
    """Rows that pass, with all columns of the table."""
    for f in filters or {}:
        if f not in raw.columns:
            raise ValueError(f"filter field not found: {f}")
    df = raw
    for f, values in (filters or {}).items():
        if f == entity:
            df = keep_entities(df, entity, values)
            continue
        c, listed = quoted(f).cast("string"), list(dict.fromkeys(str(v) for v in values))
        if len(listed) <= LISTED:
            df = df.where(c.isin(*listed))
        else:
            df = df.join(raw.sparkSession.createDataFrame([(v,) for v in listed], "__listed string"), c == F.col("__listed"), "left_semi")
    if ids is not None and entity in raw.columns:
        df = keep_entities(df, entity, ids=ids)
    return visible(df)


def read_table(raw: DataFrame, year: int, columns: list[str] | None = None, filters: dict[str, list] | None = None, unique_rows: bool = True,
               dictionary: Dictionary | None = None, ids: DataFrame | None = None, entity: str = "EIN2", profile: RowProfile | None = None) -> DataFrame:
    """Distinct rows that pass the filters, their wanted columns, in their declared types, with a ``TAX_YEAR``.

    Filters are exact, but for blanks and case at the entity key, listed or in ``ids``, a table of
    entities to keep. Filters reach the scan, and so does the projection where rows needn't be made distinct, or no
    row hash repeats: ``profile`` tells of the rows that pass; without it a wide table is profiled now.
    """
    df = filtered_rows(raw, filters, ids, entity)
    if unique_rows:
        df = distinct_rows(df, profile)
    if columns is not None:
        wanted = set(columns)
        df = df.select(*[quoted(c) for c in df.columns if c in wanted])
    df = cast_declared(df, dictionary)
    return df if "TAX_YEAR" in df.columns else df.withColumn("TAX_YEAR", F.lit(int(year)))


def read_tables(spark: SparkSession, tables, years, source: DataSource, staged: list[Staged] | None = None, filters: dict[str, list] | None = None, unique_rows: bool = True,
                ids: DataFrame | None = None, entity: str = "EIN2", late: bool = False, **options) -> list[TableYear]:
    """Plans for every table-year, staged or in place. What can't be read is recorded with its status, not raised.

    Wide tables are profiled by their row hashes, all of them in one job. ``late`` leaves ``ids`` out of the
    ``marked`` rows, for a caller that joins them later, once for all tables; but for files with a stored key.
    """
    found = []
    by_key = {(s.table, s.year): s for s in staged or ()}
    for year in sorted({int(y) for y in years}):
        for t in resolve_tables(tables, source):
            s = by_key.get((t.table, year))
            path, status = (s.path, s.status) if s else (source.path(t.table, year), "virtual")
            there = status in READABLE and (s is not None or exists(spark, path))
            found.append((t, year, path, status if there else "failed", scan(spark, path) if there else None))
    wide = [i for i, (*_, raw) in enumerate(found) if raw is not None and unique_rows and len(visible(raw).columns) >= WIDE]
    profiles = dict(zip(wide, profile_rows([filtered_rows(found[i][-1], filters, ids, entity) for i in wide])))
    out = []
    for i, (t, year, path, status, raw) in enumerate(found):
        df = marked = None
        if raw is not None:
            df = read_table(raw, year, filters=filters, unique_rows=unique_rows, ids=ids, entity=entity, profile=profiles.get(i), **options)
            marked = _marked(raw, year, filters, unique_rows, None if late and FOLDED not in raw.columns else ids, entity, profiles.get(i), **options)
            raw = visible(raw)
        out.append(TableYear(t, year, path, status, df, raw, profiles.get(i), bool(filters) or ids is not None, unique_rows, marked))
    return out


def _marked(raw: DataFrame, year: int, filters, unique_rows: bool, ids: DataFrame | None, entity: str, profile: RowProfile | None, columns: list[str] | None = None, dictionary: Dictionary | None = None) -> DataFrame:
    df = filtered_rows(raw, filters, ids, entity)
    # where no row repeats, the keys tell all, and columns that aren't wanted needn't be read
    if unique_rows and (profile is None or profile.repeated is not None):
        df = df.select("*", *[h.alias(name) for h, name in zip(row_hash(df), ROW)])
    return read_table(df, year, None if columns is None else [*columns, *ROW], unique_rows=False, dictionary=dictionary)


def read_manifest(spark: SparkSession, tables: list[TableYear]) -> DataFrame:
    """Rows and columns of each table-year before and after reading.

    Rows and distinct rows come from one pass over row hashes, unless reading has counted them already; rows after filters are counted, all in one job.
    """
    rows_of = {i: (t.profile.rows, t.profile.distinct) for i, t in enumerate(tables) if t.profile is not None and not t.filtered}
    asked = [i for i, t in enumerate(tables) if t.raw is not None and i not in rows_of]
    rows_of |= dict(zip(asked, count_rows([tables[i].raw for i in asked])))
    selected = counted({i: t.df for i, t in enumerate(tables) if t.raw is not None and t.filtered})
    rows = []
    for i, t in enumerate(tables):
        n, distinct = rows_of.get(i, (None, None))
        m = selected.get(i, distinct if t.unique else n)
        rows.append((t.year, t.table.request, t.table.table, t.table.cardinality, t.path, t.status, n, len(t.raw.columns) if t.raw is not None else None,
                     m, len(t.df.columns) if t.df is not None else None, n - distinct if n is not None else None))
    return spark.createDataFrame(rows, "year int, request string, table string, cardinality string, path string, status string, rows_source long, cols_source int, rows_selected long, cols_selected int, exact_duplicates_removed long")


def counted(frames: dict) -> dict:
    """How many rows each of ``frames`` has, in one job."""
    if not frames:
        return {}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, d in enumerate(frames.values())]
    found = {r["i"]: r["n"] for r in reduce(DataFrame.unionAll, parts).collect()}
    return {key: found[i] for i, key in enumerate(frames)}


def dims(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files (``n``), from their footers: the count is pushed to the scan, which reads no column.

    The plan has a session of its own, as it takes settings that the caller's session keeps as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


def file_dims(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns of a file or folder; of Parquet by its footers, of CSV by counting."""
    raw = visible(scan(spark, path))
    return (footer_count(spark, path).first()["n"] if format_of(path) == "parquet" else raw.count()), len(raw.columns)


#: Digits that whole numbers can have.
WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def common_kind(kinds_of: set[str]) -> str:
    """The type that values of all of ``kinds_of`` go into."""
    decimals = [tuple(map(int, k[8:-1].split(","))) for k in kinds_of if k.startswith("decimal")]
    rest = {k for k in kinds_of if not k.startswith("decimal")}
    if not rest <= {*WHOLE, "double", "float"}:
        return "string"
    if not decimals or not rest <= WHOLE.keys():
        return "double"
    scale = max(s for _, s in decimals)
    digits = max([p - s for p, s in decimals] + [WHOLE[k] for k in rest]) + scale
    return f"decimal({digits},{scale})" if digits <= 38 else "double"


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name, nulls where a column is absent. Of differing types a column becomes text, of differing numbers double, of decimals and whole numbers one decimal that holds all."""
    kinds_of: dict[str, set[str]] = {}
    for f in frames:
        for c, k in f.dtypes:
            kinds_of.setdefault(c, set()).add(k)
    to = {c: common_kind(k) for c, k in kinds_of.items() if len(k) > 1}
    cast = [f.select(*[quoted(c).cast(to[c]).alias(c) if c in to else quoted(c) for c in f.columns]) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out



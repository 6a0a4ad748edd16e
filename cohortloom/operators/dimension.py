"""The organization dimension: one row an entity, joined to every filing."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import fold, kinds, need, quoted, trim

# Fields read by default, those that preparation needs, and the codes of the state files.
FIELDS = (
    "EIN2", "org_name_display", "ntee_code_clean", "ntee_code_major_group", "nteev2", "nteev2_subsector", "nteev2_org_type", "subsection_code",
    "foundation_code", "foundation_code_definition", "ruling_date", "ruling_date_is_missing", "ruling_year", "filing_requirement_code",
    "filing_requirement_code_definition", "asset_amount", "income_amount", "revenue_amount", "org_addr_state", "org_addr_zip5", "geo_is_geocoded",
    "geo_lat", "geo_lon", "geo_state_abbr", "geo_county", "geo_metro_area", "geo_score", "geo_status", "bmf_source", "bmf_vintage_ym",
)
HELPERS = ("EIN2", "bmf_source", "bmf_vintage_ym", "ruling_date", "ruling_date_is_missing")
NO_DATE = ("", "1900-01-01")


@dataclass(frozen=True)
class Prepared:
    df: DataFrame
    source: DataFrame
    requested: tuple[str, ...]
    missing_fields: tuple[str, ...]
    id: str
    origin: dict = field(default_factory=dict)

    def vintage(self) -> str | None:
        """The build's, or the newest that the rows name, before any are left out."""
        whole = self.origin.get("whole", self.source)
        if self.origin.get("vintage") or "bmf_vintage_ym" not in whole.columns:
            return self.origin.get("vintage")
        seen = F.col("bmf_vintage_ym").cast("string")
        return whole.agg(F.max(F.when(seen != "", seen))).first()[0]

    def diagnostics(self) -> dict:
        key = fold(quoted(self.id))
        has = F.coalesce(key != "", F.lit(False))
        r = self.source.agg(
            F.count(F.lit(1)).alias("source_rows"), F.sum((~has).cast("long")).alias("dropped_blank_keys"),
            F.sum((has & ~key.rlike("^EIN-[0-9]{2}-[0-9]{7}$")).cast("long")).alias("invalid_key_count"), F.count_distinct(F.when(has, key)).alias("distinct_ids"),
        ).first().asDict()
        kept = r["source_rows"] - (r["dropped_blank_keys"] or 0)
        return r | {"duplicate_rows_resolved": kept - r["distinct_ids"], "rows_prepared": r["distinct_ids"], "source_cols": len(self.source.columns),
                    "requested_fields": self.requested, "missing_requested_fields": self.missing_fields, "selected_fields": tuple(self.df.columns),
                    "source_type": self.origin.get("source_type", "memory"), "format": self.origin.get("format"), "states": self.origin.get("states"), "bmf_vintage": self.vintage()}


def prepare(dim: DataFrame, vars=FIELDS, strict: bool = False, id: str = "EIN2", tie: list[str] | None = None) -> Prepared:
    """One row an id: the newest vintage (as text), then the current source, then the least of the other columns.

    Keys are trimmed and put in upper case; blank ones go. ``ruling_year`` is the year
    of ``ruling_date`` unless that is missing, empty, 1900-01-01 or flagged so.
    Fields that are not there are warned of, or are an error if ``strict``.
    """
    need(dim, id)
    kind = kinds(dim)
    rows = dim.withColumn(id, fold(quoted(id))).where(F.col(id) != "")
    order = []
    if "bmf_vintage_ym" in kind:
        order.append(F.col("bmf_vintage_ym").cast("string").desc_nulls_last())
    if "bmf_source" in kind:
        order.append(F.coalesce((F.lower(F.col("bmf_source").cast("string")) == "current").cast("int"), F.lit(-1)).desc())
    order += [quoted(c).asc_nulls_last() for c in (tie if tie is not None else dim.columns)]
    w = Window.partitionBy(quoted(id)).orderBy(*order)
    rows = rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")
    if "ruling_date" in kind:
        date = F.col("ruling_date").cast("string")
        none = date.isNull() | date.isin(*NO_DATE)
        if "ruling_date_is_missing" in kind:
            none = none | F.coalesce(F.lower(trim(F.col("ruling_date_is_missing"))).isin("true", "t", "1", "yes"), F.lit(False))
        rows = rows.withColumn("ruling_year", F.when(~none, F.substring(date, 1, 4).try_cast("int")))
    requested = tuple(rows.columns) if vars is None else tuple(dict.fromkeys((id, *vars)))
    absent = tuple(c for c in requested if c not in rows.columns)
    if absent:
        message = f"requested fields unavailable: {', '.join(absent)}"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return Prepared(rows.select(*[quoted(c) for c in requested if c in rows.columns]), dim, requested, absent, id)


@dataclass(frozen=True)
class Joined:
    df: DataFrame
    left: DataFrame
    id: str
    marked: DataFrame

    def diagnostics(self) -> dict:
        """Rows in, and rows and ids with and without a match; one aggregation over the join."""
        r = self.marked.agg(
            F.count(F.lit(1)).alias("output_rows"), F.sum(F.col("__match").cast("long")).alias("matched_rows"),
            F.count_distinct(F.when(quoted(self.id) != "", quoted(self.id))).alias("panel_distinct_ids"),
            F.count_distinct(F.when(F.col("__match"), quoted(self.id))).alias("matched_distinct_ids"),
        ).first().asDict()
        r["matched_rows"] = r["matched_rows"] or 0
        return r | {"unmatched_distinct_ids": r["panel_distinct_ids"] - r["matched_distinct_ids"]}


def join_dimension(df: DataFrame, prepared: DataFrame, id: str = "EIN2") -> Joined:
    """Left join of a prepared dimension: as many rows as before, each with its organization's fields or nulls.

    Fields that ``df`` has too are replaced, with a warning. The dimension grows with
    the number of organizations, so it is Spark that decides by its size whether to broadcast it.
    """
    need(df, id)
    need(prepared, id)
    overlap = [c for c in prepared.columns if c != id and c in df.columns]
    if overlap:
        warnings.warn(f"replacing existing fields: {', '.join(overlap)}", stacklevel=2)
    left = df.drop(*overlap).withColumn(id, fold(quoted(id)))
    right = prepared.withColumnRenamed(id, "__dim_id").withColumn("__match", F.lit(True))
    marked = left.join(right, quoted(id) == F.col("__dim_id"), "left").withColumn("__match", F.coalesce("__match", F.lit(False))).drop("__dim_id")
    return Joined(marked.drop("__match"), df, id, marked)

"""Files stored by entity: a folded key that a scan can be filtered by, and entities kept at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bit_table, hashed
from ..functions.values import fold, quoted
from ..plans.catalog import DataSource, data_source, resolve_tables

#: The entity key without blanks around and in upper case, as it is stored beside the key itself.
FOLDED = "__folded_entity"
#: Entities that are named one by one in a plan, at most; more of them are a table.
LISTED = 1000


def store_keyed(df: DataFrame, path: str, entity: str = "EIN2", rows_a_file: int | None = None) -> None:
    """Write ``df`` as Parquet, ranged and sorted by its folded entity key, with a Bloom filter on it.

    Row groups then hold few entities each, so that statistics and Bloom filters tell a scan which of them to
    read. Rows of one entity, or without any, may lie in several files: a row's hash is the
    second thing that the range goes by.
    """
    keyed = df.withColumn(FOLDED, fold(quoted(entity).cast("string")))
    order = [F.col(FOLDED), F.xxhash64(*[quoted(c) for c in df.columns])]
    writer = (
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).write
        .option(f"parquet.bloom.filter.enabled#{FOLDED}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{FOLDED}", "true")
    )
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    writer.parquet(path)


def stage_keyed(spark: SparkSession, tables, years, source: DataSource, root: str, entity: str = "EIN2", rows_a_file: int | None = None) -> DataSource:
    """The table-years of ``source`` that are there, stored by entity under ``root``; the source to read them from."""
    from .stage import exists
    from .tables import scan

    out = data_source(root, format="parquet", form=source.form)
    for year in sorted({int(y) for y in years}):
        for t in resolve_tables(tables, source):
            if exists(spark, at := source.path(t.table, year)):
                raw = scan(spark, at)
                if entity in raw.columns:
                    store_keyed(raw, out.path(t.table, year), entity, rows_a_file)
                else:
                    raw.write.parquet(out.path(t.table, year))
    return out


def visible(df: DataFrame) -> DataFrame:
    """``df`` without the folded key."""
    return df.drop(FOLDED) if FOLDED in df.columns else df


def folded_values(values) -> list[str]:
    """Entities as they are compared: text, without blanks around, in upper case; each once, in their order."""
    return list(dict.fromkeys(str(v).strip().upper() for v in values))


def keep_entities(df: DataFrame, entity: str, values: list | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose entity is among ``values``, and in ``ids``, a table of entities in its first column; blanks around and case don't count.

    Up to ``LISTED`` values are a filter, which a stored key takes down to row groups. More of them, or a table, are a
    semi join; a stored key is then filtered by the least and the greatest of them, and where they are too many
    to be broadcast, a Bloom filter of fixed size keeps rows out of the shuffle.
    """
    spark = df.sparkSession
    key = F.col(FOLDED) if FOLDED in df.columns else fold(quoted(entity).cast("string"))
    if values is not None:
        listed = folded_values(values)
        if len(listed) <= LISTED:
            df = df.where(key.isin(*listed))
        else:
            df = _semi(df, key, spark.createDataFrame([(v,) for v in listed], "k string"))
    if ids is not None:
        df = _semi(df, key, ids.select(fold(quoted(ids.columns[0]).cast("string")).alias("k")))
    return df


def _semi(df: DataFrame, key, ids: DataFrame) -> DataFrame:
    spark = df.sparkSession
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    here = F.col(f"c{df.columns.index(FOLDED)}") if FOLDED in df.columns else None
    k = ids.distinct()
    if here is not None:
        about = k.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("k").alias("n"), F.sum(F.length("k")).alias("size")).first()
        if not about["n"]:
            return df.where(F.lit(False))
        flat = flat.where(here.between(about["lo"], about["hi"]))
        limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        if about["size"] + 16 * about["n"] > limit:
            flat = flat.where(bit_table(k.select(hashed(F.col("k"))))(hashed(here)))
    else:
        keyed = df.select("*", key.alias("__entity_key"))
        flat = keyed.toDF(*[f"c{i}" for i in range(len(df.columns))], "ek")
        here = F.col("ek")
    out = flat.join(k, here == F.col("k"), "left_semi")
    return out.select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)

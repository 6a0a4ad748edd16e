"""Membership kept up to date from new rows alone.

An entity's years are bits of a whole number. Such numbers merge by "or", whatever the
order and however often a row comes, so a state of one row an entity and the rows
of a new year, or of a micro-batch, give the next state; classes, spells and windows follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import kinds, missing, need, quoted
from .membership import classes_of

#: Years that a state spans, from its base on.
SPAN = 63


def membership_state(df: DataFrame, base: int, time: str = "TAX_YEAR", id: str = "EIN2") -> DataFrame:
    """``id`` and ``years``, a bit for each year from ``base`` on in which an entity has a row. Rows without an id or year don't count.

    A year that doesn't fit is an error when the state is computed. Partially aggregated: one small row an entity and task is shuffled.
    """
    need(df, id, time)
    k = kinds(df)
    there = df.where(~missing(quoted(id), k[id]) & ~missing(quoted(time), k[time]))
    place = quoted(time).cast("int") - F.lit(base)
    odd = F.raise_error(F.concat(F.lit(f"not one of the {SPAN} years from {base} on: "), quoted(time).cast("string"))).cast("int")
    rows = there.select(quoted(id).alias("id"), F.when(place.between(0, SPAN - 1), place).otherwise(odd).alias("place"))
    return rows.groupBy("id").agg(F.bit_or(_bit(F.col("place"))).alias("years"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several; one shuffle of their rows."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("id").agg(F.bit_or("years").alias("years"))


def state_years(state: DataFrame, base: int) -> list[int]:
    """The years in which anybody is observed."""
    mask = state.agg(F.bit_or("years")).first()[0] or 0
    return [base + i for i in range(SPAN) if mask >> i & 1]


def classify_state(state: DataFrame, base: int, id: str = "EIN2", years: list[int] | None = None) -> DataFrame:
    """What ``classify`` says of the rows that the state was made of. No shuffle: each entity's bits are all it needs."""
    years = state_years(state, base) if years is None else years
    places = F.array(*[F.lit(y - base) for y in years]).cast("array<int>")
    at = F.filter(F.transform(places, lambda p, i: F.when(F.col("years").bitwiseAND(_bit(p)) != 0, i + 1)), lambda i: i.isNotNull())
    axis = F.array(*[F.lit(y) for y in years]).cast("array<int>")
    seen = state.select("id", at.alias("at")).where(F.size("at") > 0)
    first, last = F.get(axis, F.get("at", F.lit(0)) - 1), F.get(axis, F.element_at("at", -1) - 1)
    return classes_of(seen.select("id", first.alias("first"), last.alias("last"), "at"), len(years), id)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def covering(state: DataFrame, base: int, first: int, last: int) -> DataFrame:
    """Entities observed in every year from ``first`` to ``last``."""
    window = sum(1 << y - base for y in range(first, last + 1))
    return state.where(F.col("years").bitwiseAND(F.lit(window).cast("long")) == F.lit(window).cast("long")).select("id")


@dataclass(frozen=True)
class MembershipStore:
    """States as Parquet, one folder a version; the last whole one counts.

    A version carries the number of the batch that made it, so a batch that comes again after a
    failure changes nothing. Two versions are kept: readers of the one before finish undisturbed.
    """

    spark: SparkSession
    root: str
    base: int
    time: str = "TAX_YEAR"
    id: str = "EIN2"

    def _files(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the batches whose states are whole, in order."""
        fs, root = self._files()
        if not fs.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def state(self) -> DataFrame | None:
        held = self.versions()
        return self.spark.read.parquet(f"{self.root}/batch={held[-1]}") if held else None

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in the rows of a batch; made for ``writeStream.foreachBatch(store.update)``. Batches come in the order of their numbers."""
        held = self.versions()
        if held and number <= held[-1]:
            return
        new, before = membership_state(batch, self.base, self.time, self.id), self.state()
        (new if before is None else merge_states(before, new)).write.mode("overwrite").parquet(f"{self.root}/batch={number}")
        fs, _ = self._files()
        for old in held[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={old}"), True)

    def classify(self) -> DataFrame:
        """The classification as of the last batch."""
        state = self.state()
        if state is None:
            raise ValueError(f"no state in {self.root}")
        return classify_state(state, self.base, self.id)

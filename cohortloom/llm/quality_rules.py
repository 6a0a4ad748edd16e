"""Quality rules on documents, judged again by their host.

Each document's rule failures are counted from its words and lines; failures are
summed by host, shrunk towards all hosts by a beta prior fitted to them, and the
host's verdict joins back. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RE, cut, pick

SHINGLE = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A host goes when its shrunken failure rate is over this.
MAX_RATE = 0.5
SYMBOLS_RE = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_RE), "")


def repeat_words(words: Column, k: int = SHINGLE) -> Column:
    """Words covered by windows of ``k`` words that stand twice or more in the text.

    Windows are hashed, sorted with their places, and marked where a neighbour in
    the sorted order is equal; a second sort, by place, sums what they cover. So a
    text of n words takes n log n steps, however often it repeats itself.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - (k - 1)),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, k)).alias("h"), i.alias("i")),
    )

    def marked(s: Column) -> Column:
        return F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("sum"), F.lit(-k).alias("last")),
            lambda acc, i: F.struct(
                (acc["sum"] + F.least(F.lit(k), i - acc["last"])).alias("sum"), i.alias("last")
            ),
            lambda acc: acc["sum"],
        )

    # a one-element transform binds the sorted array to a name, so that it is made once
    return F.when(n < k + 1, F.lit(0)).otherwise(
        F.get(F.transform(F.array(F.sort_array(windows)), lambda s: covered(marked(s))), F.lit(0))
    )


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``host`` and the counts that the rules use."""
    src = pick(docs, id=id_col, text=text_col, host=host_col).withColumn("text", F.coalesce("text", F.lit("")))
    src = src.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, WHITE_RE, "")) > 0)
    return src.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS_RE, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk by the empirical beta prior.

    The prior's mean is the failure rate of all documents and its weight comes from
    the spread of the hosts' rates (method of moments), held between 1 and 10,000.
    A single host, or none that fails, leaves the overall rate as it is.
    """
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.var_pop(F.col("failed") / F.col("n")).alias("spread"),
    ).select(
        "mean",
        F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(F.lit(10000.0)))).alias("weight"),
    )
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n", "failed", ((F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate")
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Per row: counts, ``base_failed``, the host's ``host_rate`` and ``kept``.

    A document fails the base rules with fewer than 20 words, or with over 30 % of
    its words in repeated windows of eight; it is also dropped with a host whose
    shrunken failure rate is over ``max_rate``.

    * null and empty texts have no words and fail;
    * rows that share an id are judged each; null ids are carried along;
    * documents without a host form one host of their own;
    * an empty table gives an empty result; extra columns are not read.

    Hosts are summed with map-side partial aggregation, so a host with a third of
    all rows is no burden; the one-row prior is broadcast, being one row.
    """
    c = rule_counts(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    c = cut(c.withColumn("base_failed", failed))
    rates = host_rates(c).select(F.col("host").alias("rated"), F.col("rate").alias("host_rate"))
    out = c.join(rates, F.col("host").eqNullSafe(F.col("rated")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("host_rate", 9).alias("host_rate"),
        (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"),
    )

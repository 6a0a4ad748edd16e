"""URL filters from a tree of path templates.

Per host, variable path segments become wildcards, branches whose labelled rates
don't differ merge, and a template is rejected if its smoothed labelled purity is
low. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, pick, remove, salted, stored

ALLOW, BLOCK = "allow", "block"
#: With more children than this, those of less than this share of their parent's pages, and of too few labelled ones to tell, become a wildcard.
MAX_CHILDREN = 20
MIN_SHARE = 0.05
#: Standard errors within which a branch's labelled rate is that of its siblings.
SIMILAR = 1.96
#: Pages at the parent's rate that smoothing adds to a template.
SMOOTHING = 5.0
MIN_LABELLED = 3
MIN_PURITY = 0.5


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what lies after the first ``://`` up to ``/?#``, A-Z lower-cased, and from there up to ``?#``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, UPPER.lower()), F.regexp_extract(text, parts, 2)


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    nothing = F.lit(None).cast("string")
    return (
        F.coalesce(*[F.when(r.fits(), F.lit(r.name)) for r in ordered], nothing),
        F.coalesce(*[F.when(r.fits(), F.lit(r.verdict)) for r in ordered], nothing),
    )


def segments(path: Column) -> Column:
    """All segments; numbers, hexadecimal ids and long slugs are wildcards already."""
    return F.transform(
        F.array_remove(F.split(path, "/"), ""),
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), "{n}")
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "{x}")
        .when((F.length(s) > 40) | s.rlike("-.*-.*-"), "{s}")
        .otherwise(s),
    )


def templates(judged: DataFrame) -> DataFrame:
    """``host``, ``segs`` (as ``segments`` gives them), the number ``n`` of pages there, ``template`` and its ``purity`` and ``labelled`` pages.

    ``judged`` has ``host``, ``segs`` and ``label`` (null: none). Works on counts per
    host and path, one level of the tree after another, for as long as there are
    branches to tell apart: those with three labelled pages or more, some of them
    blocked, and some pages without a label. Other branches are one template,
    ``/**``: no part of them could be rejected, or there is nothing in them to judge,
    or all that is known of them is allowed.
    """
    good, bad = F.col("label") == ALLOW, F.col("label") == BLOCK
    tree, path = stored(judged.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("a"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("b"),
        F.lit("").alias("prefix"), F.lit(False).alias("done"),
    ))
    level = 0
    while tree.where(~F.col("done")).limit(1).count():
        named = tree.where(~F.col("done")).withColumn("seg", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        nodes = named.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        parents = nodes.groupBy("host", "prefix").agg(F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
        whole = F.col("all_a") + F.col("all_b")
        pooled = F.col("all_a") / whole
        m = F.col("a") + F.col("b")
        differs = (whole >= MIN_LABELLED) & (F.col("all_b") > 0) & (F.col("all_n") > whole)
        # a pool of one kind only has no spread: then any other rate differs
        similar = (m >= MIN_LABELLED) & (F.abs(F.col("a") / m - pooled) <= SIMILAR * F.sqrt(pooled * (1 - pooled) / m) + 1e-12)
        rare = (F.col("k") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all_n")) & (m < MIN_LABELLED)
        merged = nodes.join(parents, ["host", "prefix"]).select(
            "host", "prefix", "seg", (~differs | (F.col("seg") == "")).alias("ends"),
            F.when(~differs, "/**").when(F.col("seg") == "", "").when(rare | (similar & (F.col("k") > 1)), "/*").otherwise(F.concat(F.lit("/"), "seg")).alias("name"),
        )
        grown = named.join(merged, ["host", "prefix", "seg"]).select("host", "segs", "n", "a", "b", F.concat("prefix", "name").alias("prefix"), F.col("ends").alias("done"))
        before = path
        tree, path = stored(grown.unionByName(tree.where("done")))
        remove(tree.sparkSession, before)
        level += 1
    totals = tree.agg(((F.sum("a") + 1) / (F.sum("a") + F.sum("b") + 2)).alias("p0"))
    hosts = tree.groupBy("host").agg(F.sum("a").alias("ha"), F.sum("b").alias("hb"))
    leaves = tree.groupBy("host", "prefix").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    of_host = (F.col("ha") + SMOOTHING * F.col("p0")) / (F.col("ha") + F.col("hb") + SMOOTHING)
    purity = leaves.join(hosts, "host").crossJoin(F.broadcast(totals)).select(
        "host", "prefix", (F.col("a") + F.col("b")).alias("labelled"),
        ((F.col("a") + SMOOTHING * of_host) / (F.col("a") + F.col("b") + SMOOTHING)).alias("purity"),
    )
    return tree.join(purity, ["host", "prefix"]).select("host", "segs", "n", F.concat("host", "prefix").alias("template"), "labelled", "purity")


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, ``host``, ``path``, the ``rule`` that fits (or null), ``verdict``, ``template`` and ``purity``.

    The longest rule decides. Pages that it labels tell how pure each template is:
    the share of allowed ones, smoothed towards the host's and that towards all
    pages'. Pages without a rule are blocked if their template has at least three
    labelled pages and a purity under a half; otherwise they are allowed.

    * a null url, or one without ``://``, has an empty host and path, no rule, and is judged with its like;
    * rows that share an id or a url are judged each, and weigh each;
    * an empty table gives an empty result; extra columns are not read.

    Counts per host and path template are shuffled, summed beforehand in each task.
    The join back to pages is on host and path; pages of a host and path that has over
    a thousandth of all, such as those without a url, are dealt out by id.
    """
    host, path = split_url(F.col("url"))
    name, verdict = rule_of(rules)
    p = pick(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    p = p.select("id", "host", "path", name.alias("rule"), verdict.alias("label"), segments(F.col("path")).alias("segs"))
    t = cut(templates(p.select("host", "segs", "label")))
    rejected = (F.col("labelled") >= MIN_LABELLED) & (F.col("purity") < MIN_PURITY)
    return salted(p, t, ["host", "segs"], "n", ["id", "path"]).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("label", F.when(rejected, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "template", F.round("purity", 9).alias("purity"),
    )

"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within distance 2r have a common neighbour within r of both. So
each fingerprint emits its ball of radius r, the variants are shuffled, and
fingerprints that meet at a variant are linked. With r = 1 a ball has 65 variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_batches, at, cut, flat, pick, salted
from .components import components

SHINGLE = 3
SEED = 42
BITS = 64
#: Shingles whose bits are laid out at once: 64 bytes each.
BLOCK = 50_000
_SHIFT = np.arange(BITS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text's lower-cased words; of the whole sequence if it is shorter."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(words, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), BLOCK):
        part = hashes[begin : begin + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.nonzero(2 * ones > len(hashes))[0]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed 64-bit number."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64))

    return pick(docs, id=id_col, text=text_col).select("id", fp("text").alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that join all distinct fingerprints at most two bits apart into their components.

    All fingerprints that meet at a variant are within one bit of it, hence within
    two of each other, so a star from the least of them loses no connection. At
    most 65 distinct fingerprints can meet at one, however many documents hold them.
    """
    ball = F.concat(F.array(F.col("fp")), *[F.array(F.col("fp").bitwiseXOR(F.lit(np.int64(np.uint64(1) << np.uint64(b)).item()).cast("long"))) for b in range(BITS)])
    # fingerprints are distinct, so sets made before the shuffle would only be larger than their one member
    met = fps.select("fp", F.explode(ball).alias("variant")).repartition("variant").groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return (
        met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .distinct()
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints link at two or fewer differing bits; a component is named by the
    smallest id in it.

    * null and empty texts, and those without words, have fingerprint zero and link like others;
    * rows that share an id or a text share its fingerprint; each returns a row;
    * null ids never name a component, unless no other id is in it;
    * an empty table gives an empty result; extra columns are not read.

    Fingerprints are computed once and written to the shared folder. Documents of
    the same fingerprint fold into one row, with map-side partial aggregation,
    before any ball is emitted, so thousands of copies cost as much as one; the join
    back deals out the documents of a fingerprint that has over a thousandth of all.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    unique = fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    edges = cut(links(unique.select("fp")))
    names = components(edges).withColumnRenamed("node", "fp")
    named = unique.join(names, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "first", "copies")
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    table = cut(named.join(roots, "root").select("fp", "component_id", "copies"))
    return salted(fps, table, ["fp"], "copies", ["id"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by the share of shingles ---------------------------------------

#: Shingles of the similarity that near copies are told by, and its least value.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Five standard errors of the agreement of two sketches below this similarity, and three above it: in between the sets are compared.
BELOW, ABOVE = 0.125, 0.075
#: Least hashes in a sketch, and how many of them make a band key: 32 bands of 8.
SKETCH, BAND = 256, 8
#: Shingles in a block of documents that are compared in one task.
UNIT = 500_000
_ODD = np.random.default_rng(7).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of ``SKETCH`` hash functions over a set: two sets agree in as large a share as they overlap."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(hashes), 2048):
        part = hashes[begin : begin + 2048, None]
        part = part ^ (part >> np.uint64(29))
        np.minimum(least, (part * _ODD[0] + _ODD[1]).min(0), out=least)
    # bits that say nothing of how small the least value is, so that different ones agree once in 65,536 times
    return (least >> np.uint64(16)).astype("<u2")


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.astype(np.uint64).reshape(-1, BAND)
    mixed = (rows * _ODD[0, :BAND]).sum(1, dtype=np.uint64) ^ (np.arange(len(rows), dtype=np.uint64) * _ODD[1, 0])
    return ((mixed ^ (mixed >> np.uint64(32))) * _ODD[1, 1]).view(np.int64)


def _reader():
    """Fingerprint, and of the set of shingles its size, hash, sketch and band keys."""

    @F.pandas_udf("fp long, size int, whole string, sketch binary, bands array<long>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = np.unique(shingle_hashes(t, SIMILAR_WORDS))
                k = sketch(s)
                fp = np.array([simhash(shingle_hashes(t))], np.uint64).view(np.int64)[0]
                rows.append((int(fp), len(s), _whole(s), k.tobytes(), band_keys(k)))
            yield pd.DataFrame(rows, columns=["fp", "size", "whole", "sketch", "bands"])

    return read


def _setter():
    """The set of shingles, as 32 bits of their hashes, and its hash.

    32 bits may take two shingles for one where documents have 10^5 of them, and hardly move a share of so many.
    """

    @F.pandas_udf("whole string, s binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = np.unique(shingle_hashes(t, SIMILAR_WORDS)) if t is not None else np.empty(0, np.uint64)
                rows.append((_whole(s), np.unique((s >> np.uint64(32)).astype("<u4")).tobytes()))
            yield pd.DataFrame(rows, columns=["whole", "s"])

    return sets


def _whole(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id. All columns stay.

    Documents meet if their fingerprints share a ball, at two or fewer differing
    bits, as in ``simhash_groups``; but fingerprints of texts that share 80 % of
    their five-word shingles mostly differ in more bits than any ball can span. So
    they also meet if sketches of their shingle sets share a band. Documents that
    meet link if their sets overlap by ``similarity``, equal fingerprints too: sketches that agree
    clearly more or less often tell that alone, for the others the sets are compared.
    In a ball's or band's bucket each document is first compared with two of its
    members, the same for all. Where that leaves a bucket in several groups, ``_rest`` compares
    all pairs across them.

    Texts with one set of shingles fold into one before anything else, and are told by that set: rows that
    share an id but not a text are judged each by itself.

    * null and empty texts, and those without words, have the empty set and are one group;
    * rows with a null id stay;
    * of rows that share id and set, the one whose columns have the least hash stays;
    * an empty table gives an empty result; extra columns stay, whatever their names; texts are read whole.
    """
    arrow_batches(docs.sparkSession)
    rows, names = flat(docs)
    key, text = at(docs, id_col), at(docs, text_col)
    known = rows.where(F.col(key).isNotNull())
    texts = known.select(F.col(key).alias("id"), F.col(text).alias("text"))
    read = cut(texts.select("id", _reader()(F.coalesce("text", F.lit(""))).alias("x")).select("id", "x.*"))
    first = read.groupBy("whole").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "size", "sketch", "bands")])
    nodes = cut(first.withColumn("node", F.monotonically_increasing_id()))
    buckets = cut(_buckets(nodes))

    sketches = nodes.select("node", "sketch")
    met = cut(_sketches_that_agree(_met(buckets), sketches, similarity - BELOW))
    groups = cut(components(met.where(F.col("agreement") >= similarity + ABOVE).select("a", "b")))
    open_pairs = met.where(F.col("agreement") < similarity + ABOVE).select("a", "b")
    for end in ("a", "b"):
        group = groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
        open_pairs = open_pairs.join(group, end, "left").withColumn(f"{end}_group", F.coalesce(f"{end}_group", end))
    open_pairs = cut(open_pairs.where(F.col("a_group") != F.col("b_group")))
    named = nodes.select("node", "id", "whole", "size")
    more = components(_overlap(texts, named, open_pairs, similarity))

    labelled = named.join(groups.toDF("node", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    labelled = cut(labelled.join(more.toDF("g", "h"), "g", "left").select("node", "id", "whole", "size", F.coalesce("h", "g").alias("grp")))
    rest = components(_rest(texts, labelled, buckets, similarity))
    # of a group the least id stays, and of its rows, if they differ, the one that is in the group
    final = labelled.join(rest.toDF("grp", "r"), "grp", "left").groupBy(F.coalesce("r", "grp").alias("grp"))
    kept = cut(final.agg(F.min(F.struct("id", "whole")).alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.whole").alias("kept_whole")))

    often = cut(read.groupBy("id").count().where("count > 1").select(F.col("id").alias("often_id")))
    once = kept if often.isEmpty() else kept.join(often, F.col("kept_id") == F.col("often_id"), "left_anti")
    out = known.join(once, F.col(key) == F.col("kept_id"), "left_semi")
    if not often.isEmpty():
        several = known.join(often, F.col(key) == F.col("often_id"), "left_semi").withColumn("whole", _setter()(F.coalesce(text, F.lit("")))["whole"])
        mine = several.join(kept, (F.col(key) == F.col("kept_id")) & (F.col("whole") == F.col("kept_whole")), "left_semi")
        one = mine.groupBy(key, "whole").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("row"))
        out = out.unionAll(one.select("row.*"))
    return out.unionAll(rows.where(F.col(key).isNull())).toDF(*names)


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key`` and ``node``: band keys, and variants at which different fingerprints or several documents of one meet; of buckets with the same members one."""
    by_fp = nodes.groupBy("fp").agg(F.count("*").alias("n"))
    ball = F.concat(F.array(F.col("fp")), *[F.array(F.col("fp").bitwiseXOR(F.lit(np.int64(np.uint64(1) << np.uint64(b)).item()).cast("long"))) for b in range(BITS)])
    variants = by_fp.select("fp", "n", F.explode(ball).alias("variant"))
    shared = variants.groupBy("variant").agg(F.sum("n").alias("n"), F.collect_set("fp").alias("fps")).where((F.size("fps") > 1) | ((F.col("n") > 1) & F.array_contains("fps", F.col("variant"))))
    balls = shared.select(F.xxhash64(F.lit("ball"), "variant").alias("key"), F.explode("fps").alias("fp"))
    rows = nodes.select(F.explode("bands").alias("key"), "node").unionAll(balls.join(nodes.select("fp", "node"), "fp").select("key", "node")).distinct()
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"), F.min("node").alias("lo")).where("n > 1")
    return rows.join(held.groupBy("n", "mark", "lo").agg(F.min("key").alias("key")).select("key", "n"), "key")


def _met(buckets: DataFrame) -> DataFrame:
    """``a``, ``b`` of nodes that share a bucket where ``b`` is the least or the greatest of it."""
    ends = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    met = buckets.join(ends, "key").select("node", F.explode(F.array("lo", "hi")).alias("end")).where(F.col("node") != F.col("end"))
    pairs = met.groupBy(F.least("node", "end").alias("x"), F.greatest("node", "end").alias("y")).agg(F.max("end").alias("b"))
    return pairs.select(F.when(F.col("b") == F.col("y"), F.col("x")).otherwise(F.col("y")).alias("a"), "b")


def _sketches_that_agree(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` and ``agreement`` of the pairs whose sketches agree in ``least`` of all places.

    ``b`` is the end of a bucket, which many may meet: it comes last, so that Spark can split it and its sketch is sent once.
    """

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(-1, SKETCH) for c in ("sa", "sb"))
            share = (a == b).mean(1)
            out = pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(share)], ["a", "b", "agreement"])
            yield out.filter(pa.array(share >= least))

    of_a, of_b = sketches.toDF("a", "sa"), sketches.toDF("b", "sb")
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "sa", "sb")
    # one operator that compares and filters: a filter on a UDF's column would be run below it, with a second UDF beside it
    schema = StructType([both.schema["a"], both.schema["b"], StructField("agreement", DoubleType())])
    return both.mapInArrow(agreeing, schema)


def _sets_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``node`` and its set ``s``, for ``asked`` (``node``, ``id``, ``whole``): from the row of that id that has the set."""
    read = texts.join(asked, "id").select("node", F.col("whole").alias("want"), _setter()(F.coalesce("text", F.lit(""))).alias("x"))
    return read.where(F.col("x.whole") == F.col("want")).select("node", F.col("x.s").alias("s")).dropDuplicates(["node"])


def _overlap(texts: DataFrame, named: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Edges between the groups of ``a`` and ``b`` whose shingle sets overlap by ``similarity``."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist()):
                p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similarity * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([x.column("a_group"), x.column("b_group")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(_sets_of(texts, named.join(asked, "node").select("node", "id", "whole")))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a_group", "b_group", "sa", "sb").mapInArrow(alike, "a long, b long")


def joined(sets: list[np.ndarray], groups: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` that overlap by ``similarity`` and join, with ``groups``, all that any such pairs join.

    A set is compared with all sets outside its group at once, by the postings of its
    shingles, and those that it links to come next: once all is one group it ends.
    Members of the largest group need not come of themselves, as all others do.
    """
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
    lengths = np.bincount(code)
    starts = np.cumsum(lengths) - lengths
    label = np.unique(groups, return_inverse=True)[1]
    done = np.zeros(len(sets), bool)
    out = []
    for first in np.nonzero(label != np.bincount(label).argmax())[0].tolist():
        stack = [first]
        while stack:
            if done[x := stack.pop()]:
                continue
            done[x] = True
            others = label != label[x]
            if not others.any():
                return out
            mine = code[begin[x] : begin[x + 1]]
            n = lengths[mine]
            places = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[places], minlength=len(sets))
            hits = np.nonzero(others & (shared > 0) & (shared >= similarity * (sizes[x] + sizes - shared)))[0]
            if len(hits):
                new, at_hit = np.unique(label[hits], return_index=True)
                out += [(x, int(y)) for y in hits[at_hit]]
                label[np.isin(label, new)] = label[x]
                stack += hits.tolist()
    return out


def _rest(texts: DataFrame, labelled: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Edges between groups that hold two documents which share a bucket and whose shingle sets overlap by ``similarity``.

    ``labelled`` has ``node``, ``id``, ``whole``, ``grp`` and ``size``. Only buckets with more than three members, of several groups, are
    asked: in smaller ones all pairs have been compared. Of two documents of different groups
    one at least lies outside the bucket's largest group. So the documents outside it
    are dealt into blocks of about ``UNIT`` shingles, all of the bucket into others,
    and each block meets each in a task of its own.
    """
    members = buckets.where("n > 3").join(labelled.select("node", "grp", "size"), "node")
    by_group = members.groupBy("key", "grp").agg(F.sum("size").alias("size"))
    whole = by_group.groupBy("key").agg(F.count("*").alias("k"), F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by("grp", F.struct("size", "grp")).alias("main"))
    whole = whole.where(F.col("k") > 1).select(
        "key", "main", F.ceil(F.greatest("all", F.lit(1)) / UNIT).cast("int").alias("n_all"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / UNIT).cast("int")).alias("n_out"),
    )
    dealt = members.join(whole, "key").withColumn("i", F.pmod(F.xxhash64("node"), "n_out").cast("int")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "n_all").cast("int"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    as_outer = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    units = F.array_distinct(F.when(F.col("grp") == F.col("main"), as_any).otherwise(F.concat(as_any, as_outer)))
    dealt = cut(dealt.select("node", "key", "grp", units.alias("units")))

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        groups = unit["grp"].to_numpy()
        found = joined([np.frombuffer(x, "<u4") for x in unit["s"]], groups, similarity)
        return pd.DataFrame({"a": groups[[a for a, _ in found]], "b": groups[[b for _, b in found]]})

    asked = labelled.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "id", "whole")
    sets = cut(_sets_of(texts, asked))
    unit = dealt.join(sets, "node").select("key", "grp", "s", F.explode("units").alias("u")).select("key", "u.i", "u.j", "grp", "s")
    return unit.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")

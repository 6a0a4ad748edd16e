"""The operators' queries with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .license_scan import BASE, BASE_CONFIDENCE, BEFORE, CONFIDENCE, GRANT, SPAN, license_scan, signatures
from .line_dedup import line_dedup
from .packing import pack
from .quality import quality
from .quality_rules import quality_rules
from .resampling import BUCKETS, MIN_WORDS, PERCENT, SEED, importance
from .simhash import simhash_groups
from .spelling import MIN_COUNT, MIN_LETTERS, RATIO, TYPO, spelling_variants
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import MAX_CHILDREN, MIN_LABELLED, MIN_PURITY, MIN_SHARE, RULES, SIMILAR, SMOOTHING, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (
        op1_line_dedup, op2_toxicity, op3_packing, op4_quality, op5_url_filter, op6_quality_rules, op7_simhash, op8_decontaminate, op9_license_scan, op10_token_counts,
        op11_importance, op12_spelling, op13_exact_dedup,
    )
    return {f.__name__: f for f in own}


_BLANK = r"[\x20\x09-\x0D]"

#: DuckDB's regular expressions stop at NUL in a class, which texts here don't hold.
_OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') <> '') AS lines FROM d),
g AS (SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
v AS (SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS before FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM b GROUP BY source),
p AS (SELECT sum(failed) / sum(n) AS mean, var_pop(failed / n) AS spread FROM h),
q AS (SELECT mean, greatest(1.0, least(10000.0, CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 10000.0 END)) AS weight FROM p),
t AS (SELECT source, (failed + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate,
       NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
"""


#: Levels of the template tree written out in SQL: as many as the paths of ``pages`` have, and one more.
LEVELS = 4


def _op5() -> str:
    """The template tree, level by level."""
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))

    def case(of) -> str:
        fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{of(r)}'" for r in ordered]
        return "CASE " + " ".join(fits) + " END"

    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    levels = ""
    for d in range(LEVELS):
        m, whole, pooled = "(n.a + n.b)", "(p.all_a + p.all_b)", "(p.all_a / (p.all_a + p.all_b))"
        differs = f"({whole} >= {MIN_LABELLED} AND p.all_b > 0 AND p.all_n > {whole})"
        levels += f""",
s{d} AS (SELECT *, coalesce(segs[{d + 1}], '') AS seg FROM t{d} WHERE NOT done),
n{d} AS (SELECT host, prefix, seg, sum(n) AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM s{d} GROUP BY ALL),
p{d} AS (SELECT host, prefix, count(*) AS k, sum(n) AS all_n, sum(a) AS all_a, sum(b) AS all_b FROM n{d} GROUP BY ALL),
m{d} AS (SELECT n.host, n.prefix, n.seg, NOT {differs} OR n.seg = '' AS ends, CASE WHEN NOT {differs} THEN '/**' WHEN n.seg = '' THEN ''
  WHEN (p.k > {MAX_CHILDREN} AND n.n < {MIN_SHARE} * p.all_n AND {m} < {MIN_LABELLED})
  OR (p.k > 1 AND {m} >= {MIN_LABELLED} AND abs(n.a / {m} - {pooled}) <= {SIMILAR} * sqrt({pooled} * (1 - {pooled}) / {m}) + 1e-12) THEN '/*' ELSE '/' || n.seg END AS name
  FROM n{d} n JOIN p{d} p USING (host, prefix)),
t{d + 1} AS (SELECT s.host, s.segs, s.n, s.a, s.b, s.prefix || m.name AS prefix, m.ends AS done FROM s{d} s JOIN m{d} m USING (host, prefix, seg)
  UNION ALL SELECT host, segs, n, a, b, prefix, done FROM t{d} WHERE done)"""
    last = f"t{LEVELS}"
    of_host = f"((h.ha + {SMOOTHING} * p0) / (h.ha + h.hb + {SMOOTHING}))"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {parts}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages),
l AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u),
j AS (SELECT page_id, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS label,
  list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+(\\.[a-z]{{1,5}})?$') THEN '{{n}}' WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}$') THEN '{{x}}'
    WHEN length(s) > 40 OR regexp_matches(s, '-.*-.*-') THEN '{{s}}' ELSE s END) AS segs FROM l),
t0 AS (SELECT host, segs, count(*) AS n, sum((label IS NOT DISTINCT FROM 'allow')::INT) AS a, sum((label IS NOT DISTINCT FROM 'block')::INT) AS b, '' AS prefix, FALSE AS done FROM j GROUP BY host, segs){levels},
g AS (SELECT (sum(a) + 1) / (sum(a) + sum(b) + 2)::DOUBLE AS p0 FROM {last}),
h AS (SELECT host, sum(a)::DOUBLE AS ha, sum(b)::DOUBLE AS hb FROM {last} GROUP BY host),
f AS (SELECT host, prefix, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM {last} GROUP BY host, prefix),
q AS (SELECT f.host, f.prefix, a + b AS labelled, (a + {SMOOTHING} * {of_host}) / (a + b + {SMOOTHING}) AS purity FROM f JOIN h USING (host), g)
SELECT page_id, j.host, path, rule, coalesce(label, CASE WHEN labelled >= {MIN_LABELLED} AND purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  j.host || t.prefix AS template, round(purity, 9) AS purity
FROM j JOIN {last} t ON j.host = t.host AND j.segs = t.segs JOIN q ON q.host = t.host AND q.prefix = t.prefix
"""


def _op9() -> str:
    """Base phrases and signatures as tables; a detection is hidden by an earlier one that holds it."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    ordered = list(enumerate(signatures()))
    rules = ", ".join(f"({n}, {quoted(f'^ (?:{s.ahead}) ')}, {quoted(f' (?:{s.before})$')}, {quoted(s.label)}, {s.priority})" for n, s in ordered)
    keys = ", ".join(f"({quoted(w)}, {n})" for n, s in ordered for w in s.keywords)
    base = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in BASE)
    firsts = ", ".join(quoted(p.split()[0]) for p, _ in BASE)
    score = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())

    def around(begin: str, end: str) -> str:
        return f"' ' || CASE WHEN {end} > {begin} THEN array_to_string(words[{begin} + 1:{end}], ' ') || ' ' ELSE '' END"

    return rf"""
WITH keys(word, rule) AS (VALUES {keys}), rules(rule, ahead_of, before_of, label, priority) AS (VALUES {rules}), phrases(phrase, label, k) AS (VALUES {base}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
f AS (SELECT doc_id, i, array_to_string(words[i + 1:i + {SPAN}], ' ') AS ahead FROM i WHERE words[i + 1] IN ({firsts})),
b AS (SELECT doc_id, i, label FROM f, phrases WHERE ahead = phrase OR starts_with(ahead, phrase || ' ')),
c AS (SELECT doc_id, list_transform(words, lambda x: CASE x WHEN 'licence' THEN 'license' ELSE x END) AS words FROM w),
p AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM c),
k AS (SELECT doc_id, words, i, words[i + 1] AS word, {around(f"greatest(i - {BEFORE}, 0)", "i")} AS before, {around("i", f"least(i + {SPAN}, len(words))")} AS ahead FROM p WHERE words[i + 1] IN (SELECT word FROM keys)),
m AS (SELECT doc_id, words, i, label, priority, regexp_extract(ahead, ahead_of) AS ahead, regexp_extract(before, before_of) AS before FROM k JOIN keys USING (word) JOIN rules USING (rule)),
d AS (SELECT doc_id, words, i - (len(string_split(before, ' ')) - 2) AS a, i + len(string_split(ahead, ' ')) - 2 AS z, priority, label FROM m WHERE ahead <> '' AND before <> ''),
g AS (SELECT *, len(string_split(regexp_extract({around(f"greatest(a - {BEFORE}, 0)", "a")}, {quoted(f' (?:{GRANT} )$')}), ' ')) - 2 AS n FROM d),
e AS (SELECT DISTINCT doc_id, CASE WHEN priority > 2 AND n > 0 THEN a - n ELSE a END AS a, z, CASE WHEN priority > 2 AND n > 0 THEN 2 ELSE priority END AS priority, label FROM g),
s AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.z >= x.z AND y.priority <= x.priority
      AND (y.a < x.a OR y.z > x.z OR y.priority < x.priority OR y.label < x.label))),
h AS (SELECT doc_id, min(priority) AS best FROM s GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
o AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM s) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE best {score} ELSE CASE WHEN n_base > 0 THEN {BASE_CONFIDENCE} ELSE 0 END END::DOUBLE AS score
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def _crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, byte by byte over the table that its polynomial makes."""
    steps = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        steps.append(n)
    byte = "16 * instr('123456789ABCDEF', substr(x.h, 2 * i + 1, 1)) + instr('123456789ABCDEF', substr(x.h, 2 * i + 2, 1))"
    return f"""(SELECT xor(list_reduce(list_transform(range(len(x.h) // 2), lambda i: {byte}), lambda a, b: xor(a >> 8, list_extract({steps}, (xor(a, b) & 255) + 1)), 4294967295::BIGINT), 4294967295::BIGINT)
  FROM (SELECT hex({text}) AS h) x)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM documents),
b AS (SELECT unnest(list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
w AS (SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT word, 1 AS s, 0 AS t FROM d UNION ALL SELECT word, 0, 1 FROM b) GROUP BY word),
h AS (SELECT word, s, t, {_crc32("word")} % {BUCKETS} AS bucket FROM w),
n AS (SELECT coalesce(sum(s), 0)::BIGINT AS all_s, coalesce(sum(t), 0)::BIGINT AS all_t FROM w),
g AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((sum(s) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM h, n GROUP BY bucket, all_s, all_t),
v AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN v USING (doc_id)),
o AS (SELECT *, n_features >= {MIN_WORDS} AS enough, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM o
"""

#: Words are near if one of them with a letter less is the other, or both with a letter less at the same place are equal.
_OP12 = rf"""
WITH RECURSIVE u AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM u WHERE length(run) >= {MIN_LETTERS} GROUP BY ALL)),
t AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT x.word AS a, x.n AS n_a, w.word AS b, w.n AS n_b FROM x JOIN w ON x.less = w.word
      UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.less = w.word
      UNION SELECT x.word, x.n, y.word, y.n FROM x JOIN x y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
m AS (SELECT a, count(*) AS n_near, arg_min(b, (-n_b, b)) AS best, max(n_b) AS best_n FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN m ON a = word),
s(word, root) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

_OP13 = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _OP1, "op5_url_filter": _op5(), "op6_quality_rules": _OP6, "op9_license_scan": _op9(),
        "op11_importance": _OP11, "op12_spelling": _OP12, "op13_exact_dedup": _OP13,
    }

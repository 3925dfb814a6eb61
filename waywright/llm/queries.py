"""The queries opN_* over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywright.llm import bpe, collocations, decontamination, langid, licenses, near_duplicates, quality_classifier, quality_rules, sharding, spelling, substrings, token_counts, training_order
from waywright.llm.common import documents, held_out


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in (*first, "lang", "source")])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs)
    found = langid.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counts(documents(spark, sf_dir)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(documents(spark, sf_dir), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_training_order": op2_training_order,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}


def _near_duplicates_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s), n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, comp) USING KEY (id) AS (SELECT doc_id, doc_id FROM n UNION SELECT e2.b, min(r.comp) FROM r JOIN e2 ON e2.a = r.id JOIN recurring.r o ON o.id = e2.b WHERE r.comp < o.comp GROUP BY e2.b)
SELECT id AS doc_id, n AS n_shingles, comp AS component_id, comp = id AS kept FROM r JOIN n ON n.doc_id = id"""


def _license_sql() -> str:
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        rows.append(f"('{name}', {licenses.class_of(len(words))}, {pairs})")
    return rf"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') IF x <> ''] AS ws FROM documents),
p AS (SELECT doc_id, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] AS h FROM w),
t(template, class, own) AS (VALUES {", ".join(rows)}),
x AS (SELECT doc_id, template, class, own, h, unnest(range(0, greatest(len(h), 1), class)) AS pos FROM p, t),
k AS (SELECT doc_id, template, pos, len(list_intersect(list_distinct(h[pos + 1:pos + 2 * class - 1]), own)) / len(own) AS share FROM x)
SELECT doc_id, template, max(share) AS containment, arg_min(pos, {{'s': -share, 'a': pos}}) AS first_word FROM k WHERE share >= {licenses.LEAST} GROUP BY 1, 2"""


def _quality_sql() -> str:
    """Statistics by regular expressions and windows; sketches as counts by bucket, quantiles from their running counts."""
    space, gamma = r"[\x20\x09-\x0D]", (1 + quality_rules.ERROR) / (1 - quality_rules.ERROR)
    stats = {"symbol_ratio": ("n_symbols", "word_chars"), "repeat_ratio": ("n_repeat_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "lines"), "upper_ratio": ("upper", "word_chars"), "bang_ratio": ("bangs", "word_chars")}
    count = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"
    value = lambda n: f"CASE WHEN {n} < 0 THEN 0.0 ELSE pow({gamma!r}, {n} - 4000) * (2 / ({gamma!r} + 1)) END"
    each = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS stat, {q} AS share, {s} AS x FROM m WHERE NOT base_failed" for s, q in quality_rules.TAIL.items())
    k = quality_rules.PRIOR
    above = lambda q: f"min(b) FILTER (b >= 0 AND every > zero AND (upto - zero) * 1000 >= {q} * (every - zero))"
    tail, low = value("tail"), value("low")
    limit = f"CASE WHEN tail >= 0 THEN greatest({tail} + {quality_rules.FENCE} * ({tail} - {value('mid')}), {tail} * {1 + 2 * quality_rules.ERROR!r}) WHEN low IS NOT NULL THEN {low} * pow({low} / ({value('high')}), {quality_rules.FENCE}) ELSE {quality_rules.NONE} END"
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '{space}+') IF x <> ''] AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ 	-
]')] AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[j:j + 2] FOR j IN range(1, len(ws) - 1)]) AS win FROM w),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
s AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS lines, {count('[A-Z]')} AS upper, {count('!')} AS bangs FROM w LEFT JOIN c USING (doc_id)),
m AS (SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS {k}' for k, (a, b) in stats.items())}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
k AS (SELECT lang, source, stat, share, CASE WHEN x > 0 THEN greatest(CAST(ceil(ln(x) / {math.log(gamma)!r}) AS BIGINT) + 4000, 0) ELSE -1 END AS b, count(*) AS n FROM ({each}) GROUP BY ALL),
kl AS (SELECT lang, stat, b, sum(n) AS n FROM k GROUP BY ALL), ka AS (SELECT stat, b, sum(n) AS n FROM k GROUP BY ALL), ra AS (SELECT stat, sum(n) AS r FROM k GROUP BY 1), rl AS (SELECT lang, stat, sum(n) AS r FROM k GROUP BY ALL),
grid AS (SELECT g.lang, g.source, g.stat, g.share, ka.b, CAST(coalesce(k.n, 0) AS HUGEINT) * ra.r * (rl.r + {k}) + {k} * (CAST(coalesce(kl.n, 0) AS HUGEINT) * ra.r + {k} * ka.n) AS weight
 FROM (SELECT DISTINCT lang, source, stat, share FROM k) g JOIN ka ON ka.stat = g.stat JOIN ra ON ra.stat = g.stat JOIN rl ON rl.lang IS NOT DISTINCT FROM g.lang AND rl.stat = g.stat LEFT JOIN kl ON kl.lang IS NOT DISTINCT FROM g.lang AND kl.stat = g.stat AND kl.b = ka.b LEFT JOIN k ON k.lang IS NOT DISTINCT FROM g.lang AND k.source IS NOT DISTINCT FROM g.source AND k.stat = g.stat AND k.b = ka.b),
ran AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, stat) AS every, sum(CASE WHEN b < 0 THEN weight ELSE 0 END) OVER (PARTITION BY lang, source, stat) AS zero, sum(weight) OVER (PARTITION BY lang, source, stat ORDER BY b) AS upto FROM grid),
q AS (SELECT lang, source, stat, min(b) FILTER (upto * 1000 >= 500 * every) AS mid, min(b) FILTER (upto * 1000 >= share * every) AS tail, {above(quality_rules.LOW)} AS low, {above(quality_rules.HIGH)} AS high FROM ran GROUP BY 1, 2, 3),
z AS (SELECT lang, source, {', '.join(f"max(round({limit}, 9)) FILTER (stat = '{x}') AS max_{x}" for x in sorted(stats))} FROM q GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(f'coalesce({k} > max_{k}, false)' for k in stats)}) AS kept, {', '.join(stats)}, {', '.join(f'max_{k}' for k in sorted(stats))}
FROM m LEFT JOIN z ON z.lang IS NOT DISTINCT FROM m.lang AND z.source IS NOT DISTINCT FROM m.source"""


def _collocation_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, {collocations.DEPTH + 1})) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f x WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND y.f >= x.f AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
u AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, a, cut, l.f AS l, r.f AS r, n.n, CAST(1000 * a::HUGEINT * n.n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b QUALIFY rank <= {collocations.TOP}"""


#: Learned scores, hashes of other libraries and random permutations have no SQL form; tests hold those queries against
#: the libraries, brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {"op12_collocations": _collocation_sql(), "op3_quality_rules": _quality_sql(), "op4_near_duplicates": _near_duplicates_sql(), "op9_license_scan": _license_sql()}

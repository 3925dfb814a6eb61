"""Quality rules whose thresholds come from the data.

A map over texts makes each document's statistics. For every language, source and statistic a mergeable quantile sketch
(counts of logarithmic buckets, relative error ERROR) of the documents that pass the base rules is summed up by aggregation.
A group's sketch is merged with its language's, scaled to PRIOR documents, and that one with the whole corpus's likewise: so
every group has limits of its own at any size, which follow its parents' while it is small. Weights are whole numbers, so
quantiles don't depend on the order of sums.

A document fails where one of its statistics lies beyond tail + FENCE x (tail - median), tail being the statistic's TAIL
quantile. Where even the tail is zero, most of the group has nothing of the kind, and what has it is judged by the part above
zero: its limit is the LOW quantile, lower by FENCE times the distance on the log scale to the HIGH one. A limit is above the
tail by twice the sketch's error at least, which only parts ties. Thresholds come back to the documents by a join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm.common import append_columns, discard, quoted, staged, unused

# Characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
ERROR = 0.01
#: statistic: how many of a thousand documents lie within its tail quantile
TAIL = {"symbol_ratio": 900, "repeat_ratio": 990, "dup_line_ratio": 990, "upper_ratio": 990, "bang_ratio": 990}
LOW, HIGH = 100, 900  # of a thousand documents above zero
FENCE = 2.0
PRIOR = 200
NONE = 1.0  # where no document of the corpus has any
BROADCAST_ROWS = 20_000


def repeated_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of width words which comes twice or more, the first included."""
    if len(words) <= width:
        return 0
    numbers = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    distinct = len(numbers)
    keys = ids[: len(ids) - width + 1]
    for k in range(1, width):
        if distinct >= 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * distinct + ids[k : len(ids) - width + 1 + k]
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def statistics(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, copies = duplicate_lines(text)
    repeated = repeated_words(words)
    data = np.frombuffer(raw, np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    per = lambda a, b: a / b if b else 0.0
    return n, chars, symbols, copies, repeated, per(symbols, chars), per(repeated, n), per(copies, lines), per(upper, chars), per(text.count("!"), chars)


FIELDS = [(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(c, T.DoubleType()) for c in ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "bang_ratio")]


def _work():
    return lambda texts: list(map(list, zip(*map(statistics, texts), strict=True))) if texts else [[] for _ in FIELDS]


def measure(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the statistics of FIELDS and base_failed (under 50 words, or over half of the words in repeated windows)."""
    made = append_columns(docs, text, FIELDS, _work, keep_text=keep_text)
    return made.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(value):
    """Number of a value's sketch bucket; -1 holds zero."""
    gamma = math.log((1 + ERROR) / (1 - ERROR))
    return F.when(value > 0, F.greatest(F.ceil(F.log(value) / gamma) + 4000, F.lit(0).cast("long"))).otherwise(F.lit(-1).cast("long"))


def bucket_value(number):
    gamma = (1 + ERROR) / (1 - ERROR)
    return F.when(number < 0, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), number - 4000) * (2 / (gamma + 1)))


def sketches(measured: DataFrame, groups: list[str], stats: list[str]) -> DataFrame:
    """(groups, stat, bucket, n): every group's sketch of every statistic. Summing n merges sketches."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), bucket(F.col(s)).alias("bucket")) for s in stats])).alias("x")
    return measured.select(*groups, each).groupBy(*groups, "x.stat", "x.bucket").agg(F.count("*").alias("n"))


def merged(own: DataFrame, prior: int) -> DataFrame:
    """(lang, source, stat, bucket, weight): every group's sketch with its language's as prior documents, and the language's
    with the corpus's as prior documents, all times whole numbers. own: sketches by lang and source."""
    total = lambda df, keys: df.groupBy(*keys, "stat").agg(F.sum("n").alias("rows"))
    by_lang = own.groupBy("lang", "stat", "bucket").agg(F.sum("n").alias("n"))
    overall = own.groupBy("stat", "bucket").agg(F.sum("n").alias("n_a"))
    grid = total(own, ["lang", "source"]).select("lang", "source", "stat").join(overall.join(overall.groupBy("stat").agg(F.sum("n_a").alias("r_a")), "stat"), "stat")  # a row for each bucket that there is
    lang = by_lang.select(F.col("lang").alias("_l"), F.col("stat").alias("_s"), F.col("bucket").alias("_b"), F.col("n").alias("n_l"))
    rows = total(by_lang, ["lang"]).select(F.col("lang").alias("_l2"), F.col("stat").alias("_s2"), F.col("rows").alias("r_l"))
    group = own.select(F.col("lang").alias("_l3"), F.col("source").alias("_src"), F.col("stat").alias("_s3"), F.col("bucket").alias("_b3"), F.col("n").alias("n_g"))
    same = lambda l, s: F.col("lang").eqNullSafe(F.col(l)) & (F.col("stat") == F.col(s))
    joined = grid.join(rows, same("_l2", "_s2")).join(lang, same("_l", "_s") & (F.col("bucket") == F.col("_b")), "left")
    joined = joined.join(group, same("_l3", "_s3") & F.col("source").eqNullSafe(F.col("_src")) & (F.col("bucket") == F.col("_b3")), "left")
    d = lambda c: f"CAST(coalesce({c}, 0) AS DECIMAL(38, 0))"
    weight = F.expr(f"{d('n_g')} * {d('r_a')} * ({d('r_l')} + {prior}) + {prior} * ({d('n_l')} * {d('r_a')} + {prior} * {d('n_a')})")
    return joined.select("lang", "source", "stat", "bucket", weight.alias("weight"))


def quantiles(sketch: DataFrame, groups: list[str], shares: dict[str, tuple[Column | int, bool]]) -> DataFrame:
    """(groups, stat, a bucket for each name of shares): where the running weight reaches so many of a thousand, of all or (True) of
    what is above zero; null if there is nothing. sketch: (groups, stat, bucket, weight)."""
    own = Window.partitionBy(*groups, "stat")
    ran = sketch.withColumn("_all", F.sum("weight").over(own)).withColumn("_zero", F.sum(F.when(F.col("bucket") < 0, F.col("weight")).otherwise(0)).over(own)).withColumn("_upto", F.sum("weight").over(own.orderBy("bucket")))
    reached = lambda q, above: (F.col("bucket") >= 0) & (F.col("_all") > F.col("_zero")) & ((F.col("_upto") - F.col("_zero")) * 1000 >= F.lit(q) * (F.col("_all") - F.col("_zero"))) if above else F.col("_upto") * 1000 >= F.lit(q) * F.col("_all")
    return ran.groupBy(*groups, "stat").agg(*[F.min(F.when(reached(q, above), F.col("bucket"))).alias(name) for name, (q, above) in shares.items()])


def thresholds(measured: DataFrame, *, lang: str = "lang", source: str = "source", tails: dict[str, int] = TAIL, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """A row for each (lang, source) that has documents, nulls being groups too: max_<stat> of every statistic."""
    stats = sorted(tails)
    own = staged(sketches(measured.withColumnsRenamed({lang: "lang", source: "source"}), ["lang", "source"], stats), "sketches")
    tail = F.create_map(*[F.lit(x) for s in stats for x in (s, tails[s])])[F.col("stat")]
    q = quantiles(merged(own, prior), ["lang", "source"], {"mid": (500, False), "tail": (tail, False), "low": (LOW, True), "high": (HIGH, True)})
    v = {c: bucket_value(F.col(c)) for c in ("mid", "tail", "low", "high")}
    fenced = F.greatest(v["tail"] + fence * (v["tail"] - v["mid"]), v["tail"] * (1 + 2 * ERROR))
    limit = F.when(F.col("tail") >= 0, fenced).when(F.col("low").isNotNull(), v["low"] * F.pow(v["low"] / v["high"], F.lit(fence))).otherwise(F.lit(NONE))
    limit = F.round(limit, 9)  # the last digits of powers differ between platforms
    limits = q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("stat") == s, limit)).alias(f"max_{s}") for s in stats])
    limits = staged(limits, "thresholds")
    discard(own)
    return limits.withColumnsRenamed({"lang": lang, "source": source})


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", tails: dict[str, int] = TAIL, keep_text: bool = False, **options) -> DataFrame:
    """docs with their statistics, thresholds, base_failed and kept.

    Null, empty and all-space texts have zeros everywhere and fail for having under 50 words. Null languages or sources
    form groups of their own; a group without a document that passes the base rules has no thresholds and needs none.
    Texts are read whole, however long. Repeated rows get equal results; an empty table stays empty. Columns of the input
    with the names of new ones give way.
    """
    made = {n for n, _ in FIELDS} | {"base_failed", "kept"} | {f"max_{s}" for s in tails}
    docs = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in made])
    measured = staged(measure(docs, text=text, keep_text=keep_text), "quality")
    groups = measured.where("not base_failed").select(F.col(quoted(lang)).alias("lang"), F.col(quoted(source)).alias("source"), *tails)
    limits = thresholds(groups, tails=tails, **options)
    near, far = unused(measured.columns, "own_lang"), unused(measured.columns, "own_source")
    limits = limits.withColumnsRenamed({"lang": near, "source": far})
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else Spark shuffles both sides and splits hot groups
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col(quoted(lang)).eqNullSafe(F.col(near)) & F.col(quoted(source)).eqNullSafe(F.col(far)), "left").drop(near, far)
    beyond = F.lit(False)
    for s in tails:
        beyond = beyond | F.coalesce(F.col(s) > F.col(f"max_{s}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)

"""Phrase collocation mining: generalised suffix automata per shard, counts summed globally, subsumption along suffix links.

Texts are lower-cased (A-Z), cut at [.,;:!?] and line ends into pieces and those at blanks and tabs into words; everything is
per language (null: `und`). A shard is a slice of a task's texts. The states of its automaton are the sets of places where
phrases end; of phrases with one set a state keeps the longest, and its suffix link leads to the phrase without its first word.
Down to a bounded depth the link tree is built level by level from the places themselves, and a node's number of places is its
phrase's count in the shard. Counts of equal phrases are summed over shards.

A phrase that occurs LEAST times has only parts that do. So words are counted first, then pairs of frequent words, then longer
phrases of frequent pairs; the shards know the frequent ones of the pass before as a set of bits of bounded size, which
may let others through but loses none. A candidate goes if a phrase that is longer by one word at either end has its count:
the phrase is then the target of that one's suffix link, or of the link of the mirrored automaton (longer phrases needn't be
looked at, for counts only fall). Arithmetic is decimal, so products beyond 64 bits are exact.

Null and empty texts have no words and no language of theirs appears for them alone. Equal rows count as often as they occur.
Other columns aren't read."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.llm.common import bit_set, by_bytes, discard, holds, quoted, ship, staged

LEAST = 100
DEPTH = 5
TOP = 2000
SLICE = 1 << 23  # bytes of a shard's texts
ROWS_AT_ONCE = 1 << 15  # of what a shard passes on
ROWS = "lang string, phrase string, n long"
_LINES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def hashed(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _ODD[0] + right * _ODD[1]
    out ^= out >> np.uint64(32)
    out *= _ODD[2]
    return out ^ out >> np.uint64(29)


class Shard:
    """The words of a slice of texts as codes, one number for each word and language, with pieces told apart by their runs."""

    def __init__(self, langs: list[str], texts: list[bytes | None]):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts, strict=True):
            if text:
                by.setdefault(lang, []).append(text.translate(_LINES))
        self.langs, self.spelt, codes, pieces, begins = list(by), [], [], [], [0]
        done = 0
        for lang in self.langs:
            new = count(len(self.spelt))
            ids: dict[bytes, int] = _Codes(new)
            words = b"\n".join(by[lang]).replace(b"\n", b" . ").split()
            code = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            stop = code == ids.get(b".", -1)
            codes.append(code[~stop])
            pieces.append((np.cumsum(stop) + done)[~stop])
            done += int(stop.sum()) + 1
            self.spelt += ids
            begins.append(len(self.spelt))
        self.begins = np.array(begins)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.run = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        return np.concatenate([hashed(self.spelt[a:b], lang) for lang, a, b in zip(self.langs, self.begins, self.begins[1:], strict=False)]) if self.langs else np.zeros(0, np.uint64)

    def keep_words(self, frequent: np.ndarray) -> None:
        """Words outside the set go; what they stood between is no longer contiguous."""
        stays = holds(frequent, self.hashes())[self.codes]
        self.run = (self.run + np.cumsum(~stays))[stays]
        self.codes = self.codes[stays]

    def keep_pairs(self, frequent: np.ndarray) -> None:
        """Neighbours that are no pair of the set are no longer contiguous."""
        hashes = self.hashes()[self.codes]
        apart = np.r_[False, ~holds(frequent, paired(hashes[:-1], hashes[1:]))] if len(hashes) else np.zeros(0, bool)
        self.run = self.run + np.cumsum(apart)


class _Codes(dict):
    def __init__(self, new):
        self.new = new

    def __missing__(self, word: bytes) -> int:
        self[word] = out = next(self.new)
        return out


class Automaton:
    """Generalised suffix automaton of a shard down to depth words, as its tree of suffix links.

    levels[k - 1] holds the phrases of k words: link (the phrase without its first word, on the level before), n (end
    positions) and end (one of them). A phrase with as many end positions as its link's target is in that target's state."""

    def __init__(self, shard: Shard, depth: int):
        self.shard, self.levels = shard, []
        codes, run = shard.codes, shard.run
        ends, node = np.arange(len(codes)), codes
        for k in range(1, depth + 1):
            if k > 1:
                ends, node = ends[ends >= k - 1], node[ends >= k - 1]
                inside = run[ends - k + 1] == run[ends]
                ends, node = ends[inside], node[inside]
                node = node * len(shard.spelt) + codes[ends - k + 1]
            _, at, node, n = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
            self.levels.append({"link": self.above[ends[at]] if k > 1 else np.full(len(at), -1), "n": n, "end": ends[at]})
            self.above = np.full(len(codes), -1)
            self.above[ends] = node

    def phrases(self, least: int):
        """Language, phrase and count of everything of at least so many words, level by level."""
        shard, words = self.shard, pa.array(self.shard.spelt, pa.binary()).cast(pa.string())
        langs = pa.array(shard.langs, pa.string())
        for k, level in enumerate(self.levels, 1):
            if k >= least and len(level["end"]):
                for at in range(0, len(level["end"]), ROWS_AT_ONCE):
                    end, n = level["end"][at : at + ROWS_AT_ONCE], level["n"][at : at + ROWS_AT_ONCE]
                    own = [shard.codes[end - j] for j in range(k - 1, -1, -1)]
                    lang = langs.take(pa.array(np.searchsorted(shard.begins, own[0], "right") - 1))
                    yield lang, pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in own), " "), pa.array(n, pa.int64())


def shards(least: int, depth: int, words=None, pairs=None):
    """Phrases of least to depth words of every slice of the texts. Of words only: also the number of words, as the empty phrase."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE):
                shard = Shard(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())
                if depth == 1 and shard.langs:
                    total = np.bincount(np.searchsorted(shard.begins, shard.codes, "right") - 1, minlength=len(shard.langs))
                    yield pa.RecordBatch.from_arrays([pa.array(shard.langs), pa.array([""] * len(total)), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])
                if words is not None:
                    shard.keep_words(words.value)
                if pairs is not None:
                    shard.keep_pairs(pairs.value)
                for columns in Automaton(shard, depth).phrases(least):
                    yield pa.RecordBatch.from_arrays(list(columns), names=["lang", "phrase", "n"])

    return run


def hash_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_each(batch, 0).view(np.int64))], names=["hash"])


def hash_pairs(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(paired(_each(batch, 0), _each(batch, 1)).view(np.int64))], names=["hash"])


def _each(batch: pa.RecordBatch, at: int) -> np.ndarray:
    rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
    return np.fromiter((hashed([phrase.split(b" ")[at]], lang)[0] for lang, phrase in rows), np.uint64, batch.num_rows)


def counted(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, f, k of all phrases of up to depth words that occur least times, and of the empty phrase (k = 0): all words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text_col)).alias("text"))
    summed = lambda work: texts.mapInArrow(work, ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    passes, words, pairs = [], None, None
    for low, high in [(1, 1), (2, 2), *[(k, min(k + 1, depth)) for k in range(3, depth + 1, 2)]]:
        if low > depth:
            break
        found = staged(summed(shards(low, high, words, pairs)), "phrases")
        passes.append(found)
        if high >= depth or high > 2:
            continue
        rows = found.where("k > 0").count()
        bits = spark.sparkContext.broadcast(bit_set(found.where("k > 0").select("lang", "phrase").mapInArrow(hash_words if high == 1 else hash_pairs, "hash long"), "hash", rows))
        words, pairs = (bits, None) if high == 1 else (words, bits)
    out = passes[0]
    for found in passes[1:]:
        out = out.unionByName(found)
    out.parts = passes
    return out


def scored(f: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates among counted phrases that no longer one subsumes."""
    several, big = f.where("k >= 2"), lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    longer = f.where("k >= 3").select("lang", "f", F.expr("split(phrase, ' ')").alias("w"), "k")
    linked = longer.select("lang", "f", F.explode(F.expr("array(array_join(slice(w, 2, k - 1), ' '), array_join(slice(w, 1, k - 1), ' '))")).alias("phrase"))
    free = several.join(linked, ["lang", "phrase", "f"], "left_anti")
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), F.expr("split(phrase, ' ')").alias("w"), "k").select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, k - 1), i -> named_struct('cut', i, 'left', array_join(slice(w, 1, i), ' '), 'right', array_join(slice(w, i + 1, k - i), ' ')))")).alias("c")).select("lang", "phrase", "a", "c.*")
    one = f.where("k >= 1")
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(one.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(f.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def leading(rows: DataFrame, most: int = TOP, at_once: int = 25) -> DataFrame:
    """The first rows of each language by score, count and phrase, ranked from 1. No task sorts more than about at_once x most of them:
    more are first cut down bucket by bucket."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while (largest := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > at_once * most:
        buckets = math.ceil(largest / (at_once * most))
        place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).orderBy(*order))
        rows, before = staged(rows.withColumn("rank", place).where(F.col("rank") <= most).drop("rank"), "leading"), rows
        discard(before)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, most: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    f = counted(docs, least, depth, lang_col, text_col)
    found = staged(scored(f), "collocations")
    discard(*f.parts)
    return leading(found, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Substring dedup: prefix-partitioned suffix trees over words find what is repeated anywhere, and every copy of it goes.

Words are runs without blanks, tabs and line ends, unchanged. A window is WINDOW consecutive words of a document; a word goes
if a window over it has the same words as one that starts anywhere else, in the same document too.

Of a window's PREFIX-word sequences the one of the least hash (the leftmost of equals) is its sample, so equal windows have
equal samples. Suffixes are grouped by their samples' words: a group gets one fragment for each place of the sample, with all
windows that chose it, about 48 words for 14 windows. Places whose sample occurs once in all documents have no repeat and are
left out through a set of bits of bounded size, which may let some through. Prefixes are of variable length: where PREFIX
words occur LEAVES times or more, the windows themselves, of all WINDOW words, are the prefixes; a group of equal ones is a
node on its own and is counted, not gathered: the windows that occur once are taken off these samples' spans. In every other
group the suffix tree of the different fragments is built down to WINDOW words; an internal node of that depth, or a leaf that
stands for several places, is a repeat.

Null and empty texts have no words; texts of fewer words than WINDOW lose none. Rows with equal ids, or none, are documents of
their own: two equal rows are repeats of each other. Other columns, whatever their names, aren't read."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm.common import bit_set, by_bytes, discard, holds, quoted, ship, staged

WINDOW = 35
PREFIX = 8
LEAVES = 4096
CHUNK = 12_288  # fragments whose trees are built at once
LONG = 64  # bytes of a word in a fragment; longer ones stand as a digest
KNOWN = 1 << 18  # words whose hashes a task remembers
ODD = (np.random.default_rng(13).integers(0, 1 << 62, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def samples(hashes: np.ndarray, doc: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """First and last window, place and hash of each sample, given the words' hashes and documents, in order."""
    n, span = len(hashes) - window + 1, window - prefix + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = np.zeros(len(hashes) - prefix + 1, np.uint64)
    for j in range(prefix):
        grams += hashes[j : j + len(grams)] * ODD[j]
    grams ^= grams >> np.uint64(32)
    grams *= ODD[-1]
    grams ^= grams >> np.uint64(29)
    least, at, width = grams, np.arange(len(grams)), 1
    while width < span:  # least: the least hash among width places; at: the first place that has it
        step = min(width, span - width)
        first = least[:-step] <= least[step:]
        least, at = np.where(first, least[:-step], least[step:]), np.where(first, at[:-step], at[step:])
        width += step
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    place = at[start]
    if not len(start):
        return (start,) * 3 + (np.zeros(0, np.uint64),)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return start[new], start[np.r_[new[1:], len(start)] - 1], place[new], grams[place[new]]


def tokens(texts: list[bytes | None], known: Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All words, their hashes and documents, and where each document's words begin."""
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    words = list(chain.from_iterable(split))
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return words, hashes, np.repeat(np.arange(len(texts)), sizes), np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes


def counter(window: int, prefix: int):
    def run(batches):
        known = Hashes()
        for batch in batches:
            for part in by_bytes(batch, 0):
                _, hashes, doc, _ = tokens(part.column(0).cast(pa.binary()).to_pylist(), known)
                found, times = np.unique(samples(hashes, doc, window, prefix)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["sample", "n"])

    return run


def short(word: bytes) -> bytes:
    return word if len(word) <= LONG and word[0] else b"\x00" + xxhash.xxh3_128_hexdigest(word).encode()


def selected(part: pa.RecordBatch, known: Hashes, repeated: np.ndarray, window: int, prefix: int):
    """Words of the slice (id, hash, text); document, first and last window, and hash of the samples in the set repeated; beginnings of documents."""
    words, hashes, doc, begins = tokens(part.column(2).cast(pa.binary()).to_pylist(), known)
    first, last, _, gram = samples(hashes, doc, window, prefix)
    take = holds(repeated, gram)
    first, last, gram = first[take], last[take], gram[take]
    return words, doc[first] if len(first) else first, first, last, gram, begins


def fragments(repeated, hot, window: int, prefix: int):
    """A fragment for each repeated sample; of those in hot only where they are."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for part in by_bytes(batch, 2):
                words, row, first, last, gram, begins = selected(part, known, repeated.value, window, prefix)
                often = holds(hot.value, gram) if hot is not None else np.zeros(len(gram), bool)
                made = [None if h else b" ".join(map(short, words[p : q + window])) for p, q, h in zip(first.tolist(), last.tolist(), often.tolist(), strict=True)]
                gram = np.where(often, gram + ODD[0] * first.astype(np.uint64) + ODD[1] * row.astype(np.uint64), gram)  # anywhere
                start = begins[row] if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(first - start), pa.array(last - start + window - 1), pa.array(made, pa.binary())], names=["sample", "id", "hash", "first", "last", "fragment"])

    return run


def windows(repeated, hot, window: int, prefix: int):
    """Digests of the windows of hot samples, how often each is in the slice, and one place."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for part in by_bytes(batch, 2):
                words, row, first, last, gram, begins = selected(part, known, repeated.value, window, prefix)
                often = holds(hot.value, gram)
                row, first, last = row[often], first[often], last[often]
                found: dict[bytes, list[int]] = {}
                for r, p, q in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
                    for w in range(p, q + 1):
                        found.setdefault(xxhash.xxh3_128_digest(b" ".join(words[w : w + window])), [0, r, w])[0] += 1
                n, row, at = np.array(list(found.values()), np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(n), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(at - begins[row] if len(row) else at)], names=["window", "n", "id", "hash", "first"])

    return run


def nodes(text: np.ndarray, depth: int) -> np.ndarray:
    """The node at the given depth that each suffix of text passes in the suffix tree.

    Nodes at twice a depth are pairs of nodes, so a few passes descend the tree."""
    node, width = text, 1
    while width < depth and len(node):
        step = min(width, depth - width)
        node = pd.factorize(node[: max(0, len(node) - step)] * (node.max() + 1) + node[step:])[0]
        width += step
    return node


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def repeats(parts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: fragment, first and last window in it. Equal fragments are one in the tree."""
    own, codes = Codes(), Codes()
    which = np.fromiter(map(own.__getitem__, parts), np.int64, len(parts))
    split = [p.split(b" ") for p in own]
    sizes = np.array([len(x) for x in split], np.int64)
    text = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(split)), sizes - window + 1)
    leaf = np.arange(len(part)) + part * (window - 1)
    node = nodes(text, window)[leaf]
    deep = np.bincount(node, np.bincount(which)[part])[node] > 1
    at, part = leaf[deep], part[deep]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    begin = (ends - sizes)[part[new]]
    first, last, part = at[new] - begin, at[np.r_[new[1:], len(at)] - 1] - begin if len(at) else at, part[new]
    order = np.argsort(which, kind="stable")  # every place of a fragment has its runs
    places = np.bincount(which, minlength=len(split))
    many, starts = places[part], (np.cumsum(places) - places)[part]
    place = order[np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())]
    return place, np.repeat(first, many), np.repeat(last, many)


def trees(window: int):
    """Spans of repeated words from fragments sorted by sample; groups are read whole, a chunk of them at a time."""

    def found(rows: pa.Table) -> list[pa.RecordBatch]:
        told = rows.filter(pc.is_null(rows.column("fragment")))
        rows = rows.filter(pc.is_valid(rows.column("fragment")))
        part, first, last = repeats(rows.column("fragment").to_pylist(), window)
        start = rows.column("first").to_numpy()[part]
        taken = rows.select(["id", "hash"]).take(pa.array(part)).append_column("first", pa.array(start + first)).append_column("last", pa.array(start + last + window - 1))
        both = pa.concat_tables([taken.append_column("hot", pa.array(np.zeros(len(part), bool))), told.select(["id", "hash", "first", "last"]).append_column("hot", pa.array(np.ones(len(told), bool)))])
        return both.combine_chunks().to_batches()

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            sample = table.column("sample").to_numpy()
            end = int(np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])[-1])  # the last group may go on
            if end:
                yield from found(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, leaves: int = LEAVES) -> DataFrame:
    """Repeated words as id, hash (xxhash64 of the text), first, last (from 0) and hot: spans of each fragment, which may touch or overlap.

    Rows where hot is null are windows (by first) that occur once: a hot span holds no repeat there."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(quoted(text_col)).alias("hash"), F.col(quoted(text_col)).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    counts = texts.select("text").mapInArrow(counter(window, prefix), "sample long, n long").groupBy("sample").agg(F.sum("n").alias("n")).where("n > 1")
    counts = staged(counts, "samples")
    many, rows = counts.agg(F.count_if(F.col("n") >= leaves), F.count("*")).first()
    repeated = spark.sparkContext.broadcast(bit_set(counts, "sample", rows))
    hot = spark.sparkContext.broadcast(bit_set(counts.where(F.col("n") >= leaves), "sample", many)) if many else None
    discard(counts)
    parts = texts.mapInArrow(fragments(repeated, hot, window, prefix), f"sample long, id {kind}, hash long, first long, last long, fragment binary")
    out = parts.repartition("sample").sortWithinPartitions("sample").mapInArrow(trees(window), f"id {kind}, hash long, first long, last long, hot boolean")
    if many:
        own = texts.mapInArrow(windows(repeated, hot, window, prefix), f"window binary, n long, id {kind}, hash long, first long")
        once = own.groupBy("window").agg(F.sum("n").alias("n"), F.first(F.struct("id", "hash", "first")).alias("place")).where("n = 1")
        out = out.unionByName(once.select("place.*", F.col("place.first").alias("last"), F.lit(None).cast("boolean").alias("hot")))
    return out


def covered(n: int, found: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    plain, hot, once = ([(s["first"], s["last"]) for s in found if s["hot"] is h] for h in (False, True, None))
    change = np.zeros(n + 1, np.int64)
    if hot:
        starts = np.zeros(n, bool)
        for first, last in hot:
            starts[first : last - window + 2] = True
        starts[[first for first, _ in once]] = False
        at = np.flatnonzero(starts)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    if plain:
        first, last = np.array(plain).T
        np.add.at(change, first, 1)
        np.add.at(change, last + 1, -1)
    return np.cumsum(change[:-1]) > 0


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, window: int = WINDOW) -> DataFrame:
    """Every row of docs: its id, n_words, n_removed and kept, the words outside the spans joined by one space (digest: their SHA-256)."""
    ship(docs.sparkSession)
    taken = found.groupBy(F.col("id").alias("key"), F.col("hash").alias("key_hash")).agg(F.collect_set(F.struct("first", "last", "hot")).alias("spans"))
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(quoted(text_col)).alias("hash"), F.col(quoted(text_col)).alias("text"))
    joined = texts.join(taken, F.col("id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("key_hash")), "left").select("id", "spans", "text")
    name = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, gone in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split() if text else []
                n = len(words)
                if gone:
                    words = [words[i] for i in np.flatnonzero(~covered(n, gone, window)).tolist()]
                sizes.append(n)
                removed.append(n - len(words))
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", name])

    made = joined.mapInArrow(run, T.StructType([joined.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(name, T.StringType())]))
    return made.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, window: int = WINDOW, prefix: int = PREFIX, leaves: int = LEAVES) -> DataFrame:
    """docs without the words that are repeated anywhere: see cut()."""
    return cut(docs, spans(docs, id_col, text_col, window, prefix, leaves), id_col, text_col, digest, window)

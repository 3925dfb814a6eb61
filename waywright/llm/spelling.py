"""Spelling variant grouping: words at one edit from each other, found by two-dimensional range reporting on wavelet trees.

Two words are near if they differ by one inserted, deleted or replaced code point at some place: what stands before it is a
prefix of both and what stands after it a suffix of both. In a dictionary, words with a prefix are an interval of the forward
order, words with a suffix an interval of the reverse order, and words with both are the points of a rectangle, reported by a
wavelet tree over the reverse ranks in forward order. Words of one length (and of the next) make dictionaries of their own, so
a rectangle holds near words only.

The dictionary is split by the range of places that an edit may have: for places in [a, b) of words of length k all else is
common, so it is the key. At first the ranges are both halves of a word; groups that are too heavy are split by halves of
their range, down to one place, where a group is as small as the alphabet. A task builds one tree for many groups.

A word's form is its near word of largest n, if that n is at least FACTOR times its own; the root is where the chain of forms
ends, found by doubling the steps. Null texts and ids count as empty; equal rows count as often as they occur; other columns
aren't read. Ties between forms go to the smallest in code-point order."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywright.llm.common import discard, quoted, ship, staged

SHORTEST = 6
LEAST = 5
FACTOR = 5
EVERY = 199  # of that many hashes of a run in a document, one takes a code point out
HEAVY = 1 << 16  # code points of a group's varying parts beyond which it is split
CHUNK = 1 << 20  # code points that a tree is built over at once
HELD = 1 << 19  # different words that a task counts before it passes them on
KEY = ["len", "a", "b", "outer"]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, of at least shortest code points and least occurrences.

    Where the crc32 of `<id>:<run>` is a multiple of every, the run's code point at crc32 % length is taken out: planted misspellings."""
    ship(docs.sparkSession)
    runs = re.compile(f"[a-z\\u00C0-\\u00FF]{{{shortest},}}")

    def run(batches):
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(runs.findall(text.lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Wavelet:
    """A wavelet tree over whole numbers, as a matrix: each level puts numbers whose bit is 0 before the others, in order."""

    def __init__(self, values: np.ndarray):
        self.bits, self.zeros = max(1, int(len(values) - 1).bit_length()), []
        for level in reversed(range(self.bits)):
            one = (values >> level & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            values = np.concatenate([values[~one], values[one]])

    def report(self, first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all queries at once, the numbers in [low, high) at places in [first, end): query and number of each."""
        query, node = np.arange(len(first)), np.zeros(len(first), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            left, right = zeros[first], zeros[end]
            first = np.concatenate([left, zeros[-1] + first - left])
            end = np.concatenate([right, zeros[-1] + end - right])
            query, node = np.tile(query, 2), np.concatenate([2 * node, 2 * node + 1])
            stays = (first < end) & (node << level < high[query]) & (node + 1 << level > low[query])
            first, end, query, node = first[stays], end[stays], query[stays], node[stays]
        return query, node


def intervals(group: np.ndarray, chars: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For depth 0, 1, ... (rows) and each string (columns): the first target and the one after the last that share its group
    and so many first characters, in the order of group and characters; and the targets in this order."""
    n, width = chars.shape
    order = np.lexsort((*(chars[:, j] for j in reversed(range(width))), group))
    differ = chars[order[1:]] != chars[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(n - 1, np.int64)
    common = np.r_[-1, np.where(group[order[1:]] != group[order[:-1]], -1, common)]
    rank, place = np.r_[0, np.cumsum(target[order])], np.arange(n)
    first, end = np.empty((width + 1, n), np.int64), np.empty((width + 1, n), np.int64)
    for depth in range(width + 1):
        new = common < depth
        first[depth, order] = rank[np.maximum.accumulate(np.where(new, place, 0))]
        after = np.minimum.accumulate(np.where(new, place, n)[::-1])[::-1]
        end[depth, order] = rank[np.r_[after[1:], n]]
    return first, end, order[target[order]]


def reported(group: np.ndarray, text: list[str], probe: np.ndarray, target: np.ndarray, extra: int, last: np.ndarray):
    """Probes and targets with all in common but one place, with that place: targets are as long as probes, or longer by extra."""
    size = np.array([len(t) for t in text])
    width = int(size.max())
    chars = np.array(text, f"<U{max(1, width)}").view(np.uint32).reshape(len(text), -1)[:, :width]
    turned = np.array([t[::-1] for t in text], f"<U{max(1, width)}").view(np.uint32).reshape(len(text), -1)[:, :width]
    before, before_end, forward = intervals(group, chars, target)
    behind, behind_end, backward = intervals(group, turned, target)
    rank = np.empty(len(text), np.int64)
    rank[backward] = np.arange(len(backward))
    tree = Wavelet(rank[forward])
    alone = 0 if extra else 1  # in its own dictionary a probe is a point of its rectangles
    for place in range(width + 1):
        rows = np.flatnonzero(probe & (place < size + (extra & last)))
        rest = size[rows] - place - 1 + extra
        first, end, low, high = before[place, rows], before_end[place, rows], behind[rest, rows], behind_end[rest, rows]
        take = (end - first > alone) & (high - low > alone)
        query, value = tree.report(first[take], end[take], low[take], high[take])
        found = rows[take][query], backward[value]
        apart = found[0] != found[1]
        if apart.any():
            yield place, found[0][apart], found[1][apart], chars


def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (word, near word) of a chunk of groups."""
    key = [table.column(c).to_numpy() for c in ("len", "a", "b")]
    outer, mid, longer = np.array(table.column("outer").to_pylist(), object), table.column("mid").to_pylist(), table.column("longer").to_numpy(zero_copy_only=False)
    group = np.cumsum(np.r_[False, (outer[1:] != outer[:-1]) | np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
    last = key[2] == key[0]
    here, there = [], []
    several = np.bincount(group)[group] > 1
    for extra in (0, 1):
        keep = np.flatnonzero(several if extra else several & ~longer)
        if not len(keep):
            continue
        probe = ~longer[keep]
        for place, one, two, chars in reported(group[keep], [mid[i] for i in keep], probe, longer[keep] if extra else probe, extra, last[keep]):
            if extra:  # a code point beside its equal can be put in at several places: the first counts
                left = chars[one, place - 1] if place else np.array([ord(outer[i][a - 1]) if (a := key[1][i]) else 0 for i in keep[one]], np.uint32)
                own = left != chars[two, place]
                one, two = one[own], two[own]
                here.append(keep[two])
                there.append(keep[one])
            here.append(keep[one])
            there.append(keep[two])
    return (np.concatenate(here), np.concatenate(there)) if here else (np.zeros(0, int),) * 2


def found(table: pa.Table) -> pa.RecordBatch:
    """Of each word of a chunk: the number of near words in it, the largest n among them, and the first word that has it."""
    here, there = pairs(table)
    outer, start, mid = (table.column(c).to_pylist() for c in ("outer", "a", "mid"))
    n = table.column("n").to_numpy()
    used, at = np.unique(np.r_[here, there], return_inverse=True)
    words = np.array([outer[i][: start[i]] + mid[i] + outer[i][start[i] + 1 :] for i in used.tolist()], object)
    here, there, n = at[: len(here)], at[len(here) :], n[used]
    named, name = np.unique(words, return_inverse=True) if len(words) else (words, np.zeros(0, int))
    order = np.lexsort((name[there], -n[there], name[here]))
    here, there = here[order], there[order]
    new = np.flatnonzero(np.r_[True, name[here[1:]] != name[here[:-1]]]) if len(here) else here
    near = np.diff(np.r_[new, len(here)])
    return pa.RecordBatch.from_arrays([pa.array(named[name[here[new]]], pa.string()), pa.array(near, pa.int64()), pa.array(n[there[new]], pa.int64()), pa.array(named[name[there[new]]], pa.string())], names=["word", "n_near", "best_n", "best"])


def near(chunk: int):
    def run(batches):
        held, weight = [], 0
        for batch in batches:
            held.append(batch)
            weight += batch.num_rows * (1 + max((len(m) for m in batch.column(batch.schema.get_field_index("mid")).to_pylist()), default=0))
            if weight < chunk:
                continue
            table = pa.Table.from_batches(held)
            key = list(zip(*(table.column(c).to_pylist() for c in KEY), strict=True))
            end = len(key) - 1
            while end and key[end - 1] == key[-1]:  # the last group may go on
                end -= 1
            if end:
                yield found(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
                weight = 0
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outer", F.expr("concat(substring(word, 1, a), ' ', substring(word, b + 1 + cast(longer AS INT)))"))


def grouped(words: DataFrame, shortest: int, heavy: int) -> list[DataFrame]:
    """word, n, len, a, b, longer, outer: every word in the groups of its own length and of the one before. Groups are small."""
    base = words.withColumn("len", F.explode(F.expr("filter(array(length(word), length(word) - 1), k -> k > 0)"))).withColumn("longer", F.expr("len < length(word)"))
    rows = base.withColumn("range", F.explode(F.expr("array(named_struct('a', 0, 'b', len div 2), named_struct('a', len div 2, 'b', len))"))).select("word", "n", "len", "longer", "range.a", "range.b")
    out, rows = [], keyed(rows)
    while True:
        large = staged(rows.groupBy(*KEY).agg(F.count("*").alias("rows")).where((F.col("b") - F.col("a") > 1) & (F.col("rows") * (F.col("b") - F.col("a")) > heavy)).drop("rows"), "large")
        if large.isEmpty():
            discard(large)
            return [*out, rows]
        out.append(rows.join(large, KEY, "left_anti"))
        split = rows.join(large, KEY, "left_semi").withColumn("range", F.explode(F.expr("array(named_struct('a', a, 'b', (a + b) div 2), named_struct('a', (a + b) div 2, 'b', b))")))
        rows = staged(keyed(split.select("word", "n", "len", "longer", "range.a", "range.b")), "split")


def neighbours(words: DataFrame, heavy: int = HEAVY, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, best_n, best of each word of words (word, n; words differ) that has a near one."""
    ship(words.sparkSession)
    parts = grouped(words, 1, heavy)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    dealt = rows.select(*KEY, F.expr("substring(word, a + 1, b - a + cast(longer AS INT))").alias("mid"), "longer", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    some = dealt.mapInArrow(near(chunk), "word string, n_near long, best_n long, best string")
    best = some.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("word"))).alias("best"))
    return best.select("word", "n_near", (-F.col("best.least")).alias("best_n"), F.col("best.word").alias("best"))


def variants(words: DataFrame, factor: int = FACTOR, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words (word, n)."""
    words = staged(words, "words")
    close = neighbours(words, **options)
    joined = words.join(close, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form"), F.when(F.col("best_n") >= factor * F.col("n"), F.col("best_n")).alias("form_n"))
    joined = staged(joined, "forms")
    steps = joined.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:  # n grows by factor along a chain, so chains are short; each round doubles the steps taken
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = staged(steps.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(steps)
        steps = moved.select("word", "to")
        steps.staged_path = moved.staged_path
        if moved.where("moved").isEmpty():
            break
    return joined.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")

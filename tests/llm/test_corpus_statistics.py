"""Spelling variants, collocations and substring dedup against plain versions of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waywright.llm import collocations, spelling, substrings
from waywright.llm.common import bit_set, holds

NOTE = "one passage that is in many texts and has more words than the window of the test takes in at a time"


def texts(seed, n, words, sep=" "):
    rng = random.Random(seed)
    return [sep.join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, t, lang in rows], "doc_id long, text string, lang string, n long, word string").repartition(3)


# --- substring dedup


def plain_cut(rows, window):
    split = [(t or "").encode().split() for _, t, _ in rows]
    seen = Counter(tuple(x[i : i + window]) for x in split for i in range(len(x) - window + 1))
    out = []
    for (doc, _, _), x in zip(rows, split, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(x, gone, strict=True) if not g)
        out.append((doc, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    base = texts(1, 60, [f"w{i}" for i in range(40)])
    mixed = [f"{a} {NOTE} {b}" if i % 3 == 0 else a for i, (a, b) in enumerate(zip(base, reversed(base), strict=True))]
    odd = [None, "", " \n\t", "tick " * 30, "a b " * 20, "Ärger x über " * 9, "y" * 300 + " " + "y" * 300 + " " + NOTE, "\x00 \x00a " + NOTE, *mixed[:5]]
    rows = [(i, t, "en") for i, t in enumerate(mixed + odd)]
    return [*rows, (None, NOTE, "en"), (None, NOTE, None), rows[0], (3, "another text of that id " + NOTE, "en")]


@pytest.mark.parametrize("window, prefix, leaves", [(12, 3, 4096), (12, 3, 4), (5, 5, 2), (2, 1, 3)])
def test_repeated_windows_go(spark, window, prefix, leaves):
    rows = passages()
    found = substrings.deduplicate(frame(spark, rows), digest=True, window=window, prefix=prefix, leaves=leaves)
    assert sorted(map(tuple, found.collect()), key=str) == plain_cut(rows, window)


def test_trees_over_many_chunks(spark, monkeypatch):
    rows = [("sample", d, 0, 0, f"{d % 7} b c d".encode()) for d in range(50)]
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CHUNK", 8)
    table = pa.table({"sample": [r[1] % 7 for r in rows], "id": [r[1] for r in rows], "hash": [0] * 50, "first": [0] * 50, "last": [3] * 50, "fragment": pa.array([r[4] for r in rows], pa.binary())}).sort_by("sample")
    made = [r for b in substrings.trees(4)(table.to_batches(max_chunksize=3)) for r in b.to_pylist()]
    assert sorted(r["id"] for r in made) == list(range(50)) and {(r["first"], r["last"]) for r in made} == {(0, 3)}


def test_kept_words_and_empty_table(spark):
    rows = [(1, f"before {NOTE} after", "en"), (2, f"{NOTE}\nend", "en")]
    assert sorted(r.kept for r in substrings.deduplicate(frame(spark, rows), window=8, prefix=2).collect()) == ["before after", "end"]
    assert substrings.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_bits_lose_no_hash(spark):
    rng = random.Random(5)
    own = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    import numpy as np

    bits = bit_set(spark.createDataFrame([(x,) for x in own], "h long"), "h", 100)
    assert holds(bits, np.array(own, np.int64).view(np.uint64)).all()
    assert holds(bits, np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.5


# --- spelling variants


def plain_counts(rows, shortest, least, every):
    count = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= shortest:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count, factor):
    close = {w: [x for x in count if near(w, x)] for w in count}
    best = {w: min(c, key=lambda x: (-count[x], x)) for w, c in close.items() if c}
    form = {w: best[w] if w in best and count[best[w]] >= factor * n else None for w, n in count.items()}
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), count[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"heavy": 4, "chunk": 60}])
def test_variants_equal_all_pairs(spark, options):
    rng, letters = random.Random(2), "abé"
    count = {}
    for _ in range(500):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
        count[word] = rng.choice([1, 2, 5, 5, 10, 25, 125, 700])
    count |= {"z" * 2000: 9, "z" * 1999: 900, "z" * 1000 + "y" + "z" * 999: 1, "aaaa" * 5: 3, "aaaa" * 5 + "a": 3}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = spelling.variants(words, **options).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == plain_variants(count, 5)


def test_words_and_planted_misspellings(spark):
    words = ["House", "HOUSES", "Maßstab", "été", "naïve", "÷times×", "abcdefgh", "Íslands", "a"]
    rows = [(i, t, None) for i, t in enumerate(texts(3, 80, words, ", "))] + [(None, "House HOUSES abcdefgh", "en"), (4, None, "en"), (5, "", "en"), (6, "x" * 100_000, "en"), (6, "x" * 100_000, "en")]
    got = spelling.counts(frame(spark, rows), shortest=4, least=2, every=3)
    assert {r.word: r.n for r in got.collect()} == plain_counts(rows, 4, 2, 3)
    assert spelling.variants(spelling.counts(frame(spark, rows).limit(0))).count() == 0


# --- collocations


def plain_collocations(rows, least, depth, most):
    n, f, out = Counter(), Counter(), []
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    by = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) < 2 or any(b >= a and len(x) > len(words) and l == lang and any(x[i : i + len(words)] == words for i in range(len(x))) for (l, x), b in f.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        by[lang].append((-score, -a, " ".join(words).encode(), l, r))
    for lang, found in by.items():
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def phrases():
    words = ["The", "the", "of", "new", "York", "city", "é", "x y", "of,", "end.", "\U0001f600", "a\tb", "line\nbreak", "tab\x0bpage\x0c"]
    rows = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts(4, 120, words))]
    return [*rows, (1, None, "de"), (2, "", "de"), (3, " \t.,;", "es"), rows[0], rows[0], (9, "word " * 3000, "en"), (9, "the of " * 800, "und")]


@pytest.mark.parametrize("least, depth, most", [(3, 5, 50), (12, 4, 2000), (5, 2, 7), (1, 3, 10_000)])
def test_collocations_equal_counts_of_all_phrases(spark, least, depth, most):
    rows = phrases()
    got = collocations.collocations(frame(spark, rows), least, depth, most)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, depth, most)


def test_first_rows_in_buckets_equal_a_sort(spark):
    rng = random.Random(6)
    rows = [(lang, f"p{i}", rng.randint(1, 3), rng.randint(1, 4)) for lang, n in (("en", 700), ("fr", 30), ("de", 3)) for i in range(n)]
    want = sorted((lang, i, p) for lang in ("en", "fr", "de") for i, (_, _, p) in enumerate(sorted((-s, -a, p) for l, p, a, s in rows if l == lang)[:10], 1))
    got = collocations.leading(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 10, 3)
    assert sorted((r.lang, r.rank, r.phrase) for r in got.collect()) == want


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_007
    f = spark.createDataFrame([("en", "", 10 * big, 0), ("en", "a", 2 * big + 3, 1), ("en", "b", big + 11, 1), ("en", "a b", big, 2)], "lang string, phrase string, f long, k int")
    assert [r.score for r in collocations.scored(f).collect()] == [1000 * big * 10 * big // ((2 * big + 3) * (big + 11))]


def test_automaton_states_and_links():
    shard = collocations.Shard(["en", "en"], [b"a b c a b c, a b", b"a b"])
    tree = collocations.Automaton(shard, 3)
    names = [{tuple(shard.spelt[shard.codes[e - j]] for j in range(k, -1, -1)): i for i, e in enumerate(level["end"])} for k, level in enumerate(tree.levels)]
    count = [{p: int(level["n"][i]) for p, i in own.items()} for level, own in zip(tree.levels, names, strict=True)]
    assert count[0] == {(b"a",): 4, (b"b",): 4, (b"c",): 2}
    assert count[1] == {(b"a", b"b"): 4, (b"b", b"c"): 2, (b"c", b"a"): 1}
    for k in (1, 2):
        for phrase, i in names[k].items():
            assert tree.levels[k]["link"][i] == names[k - 1][phrase[1:]]


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, phrases()).limit(0)).where(F.col("lang") == "en").count() == 0

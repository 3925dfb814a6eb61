"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from waywright.llm import bpe, decontamination, langid, licenses, near_duplicates, quality_classifier, quality_rules, queries, sharding, token_counts, training_order

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", "   \n\t", "a", "ab cd", "Ünïcode ſtraße 日本語 😀", "same words here again " * 30, "same words here again " * 30, "x" * 50_000, "<|endoftext|> it's 3.5 km\x1c\x1fz"]
SCHEMA = "doc_id long, text string, lang string, source string, score string, hash string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, None if k % 3 == 0 else "en", None if k % 2 else "s", "mine", "mine", "mine") for k, t in enumerate(ODD)], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_bpe_equals_the_library_and_round_trips(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in bpe.digest(table.select("doc_id", "text"), keep_text=False).collect():
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd)).collect()
    assert [r["decoded"] for r in back] == [t or "" for t in ODD]
    assert bpe.digest(none).count() == 0
    assert {"lang", "score", "hash"} <= set(bpe.digest(odd).columns) and bpe.digest(odd).columns.count("n_tokens") == 1


def test_one_tree_and_shared_arrays_agree():
    own = bpe.encoder(P.path("byte_bpe_50k.json"))
    pieces = [b"abababababab", b"thththere", b"aaaaaaa", b"zq", bytes(range(90, 122))]
    want = [np.array(bpe.merge_one(own.vocabulary.of_byte[np.frombuffer(p, np.uint8)].tolist(), own.vocabulary), "<u4").tobytes() for p in pieces]
    assert bpe.merge_many(pieces, own.vocabulary) == want


def test_token_counts_equal_the_library(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in token_counts.count(table.select("doc_id", "text"), keep_text=False).collect():
            t = texts[r["doc_id"]]
            assert r["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids)
            assert r["n_bytes"] == len(t.encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    assert token_counts.count(none).count() == 0


def test_chunk_maps_compose(monkeypatch):
    own = token_counts.Counter(P.path("word_bpe_49k.json"))
    text = "hello wonderful worlds " * 50 + "y" * 200 + "  it's \n"
    whole = own.segment(text)
    for size in (1, 3, 17, 64):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert own.segment(text) == whole


def components(texts):
    sets = {}
    for k, t in texts.items():
        words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in texts}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and both:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in texts}


def near_texts():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(130):  # a group larger than a small node, with links that only chains make
        words = list(base)
        for i in rng.integers(0, 60, k % 3):
            words[i] = f"x{k}"
        texts[k] = " ".join(words)
    for k in range(130, 160):
        texts[k] = " ".join(f"v{i}" for i in rng.integers(0, 5000, 40))
    return texts


def test_near_duplicates_equal_brute_force(spark, docs, odd, none):
    for table in (docs, odd, spark.createDataFrame(list(near_texts().items()), "doc_id long, text string")):
        want = components({r["doc_id"]: r["text"] for r in table.collect()})
        got = near_duplicates.near_duplicates(table).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "NEAR", -1)
    table = spark.createDataFrame(list(near_texts().items()), "doc_id long, text string")
    want = components(near_texts())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(table).collect()} == want


def test_rows_that_share_an_id_or_have_none_are_looked_at_each(spark):
    rng = np.random.default_rng(9)
    one, two = ([f"{k}{i}" for i in rng.integers(0, 10**6, 80)] for k in "pq")
    a, b, c = " ".join(one), " ".join(two), " ".join([*two[:78], "other", "end"])
    for rows in ([(1, a), (1, b), (2, c)], [(1, b), (1, a), (2, c)], [(1, b), (1, b), (1, b.upper()), (1, a), (2, c)]):
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((i, 1, i == 1) for i, _ in rows)
    rows = [(None, a), (None, b), (7, c), (None, None), (None, "")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter([(None, None, True)] * 3 + [(None, 7, False), (7, 7, True)])


def test_a_large_group_of_texts_that_are_alike_but_mostly_unlinked(spark):
    """Texts that share a passage; some have a twin. Nodes stay large, and the links are few."""
    rng = np.random.default_rng(11)
    own = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10**9, k))
    common = own(70)
    texts = [f"{common} {own(30)}" for _ in range(2500)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[::50]]
    want = {k: k for k in range(2500)} | {2500 + k: 50 * k for k in range(50)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(table).collect()} == want


def base_statistics(text):
    words = SPACE.findall(text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(three)
    covered = {i + j for i, w in enumerate(three) if often[w] > 1 for j in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), copies, len(covered)


def test_quality_rules_statistics_and_thresholds(docs, odd, none):
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in quality_rules.judge(table).collect():
            want = base_statistics(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(none).count() == 0


def test_quantile_sketches_merge_and_are_close(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(-2, 1, 4000)
    table = spark.createDataFrame([(("a", "b")[i % 2], float(v)) for i, v in enumerate(values)], "g string, x double")
    own = quality_rules.sketches(table, ["g"], ["x"])
    merged = own.groupBy("stat", "bucket").agg(F.sum("n").alias("weight"))
    got = quality_rules.quantiles(merged, [], {"q": (750, False)}).select(quality_rules.bucket_value(F.col("q")).alias("q")).first()["q"]
    assert abs(got / np.quantile(values, 0.75, method="inverted_cdf") - 1) < 0.011


def test_classifiers_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    quality = queries.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in quality]) > 0.95
    langs = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in langs]) > 0.95


def test_classifiers_on_odd_tables(docs, odd, none):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(none) is None and langid.identify(odd, None).where("lang_pred = 'und'").count() == len(ODD)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality_classifier.train(docs, labels, max_rows=20)
    got = quality_classifier.score(odd, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality_classifier.train(none, labels.where("false")) is None and quality_classifier.score(odd, None).count() == len(ODD)
    assert quality_classifier.score(none, model).count() == langid.identify(none, None).count() == 0


def test_sharding_laws(docs, odd, none):
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        got = sharding.interleave(table).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(texts)
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
        for r in got:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    mixed = sharding.interleave(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").pivot("shard", list(range(8))).count().na.fill(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 2 for r in mixed)
    assert sharding.interleave(none).count() == 0


def test_license_scan_equals_search(spark, docs, odd, none):
    more = spark.createDataFrame([(900, "Code. ALL RIGHTS RESERVED"), (901, "all rights are reserved"), (902, "x " * 500 + licenses.TEMPLATES["GPL-notice"])], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text")).union(more)
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(table).where("containment = 1").collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    want = {(r["doc_id"], k) for r in table.collect() for k, v in licenses.TEMPLATES.items() if plain(v) in plain(r["text"])}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    assert licenses.scan(none).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_decontamination_finds_copies_and_reparameterised_items(spark, docs, odd, none):
    item = "A train leaves for Paris at 7 with 30 passengers and then Mary counts 12 km before they all stop to rest near the river bank"
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "too short"), (5, "each morning the baker sells loaves")], "item_id long, text string")
    other = item.replace("Paris", "London").replace("30", "55").replace("12", "90")
    clash = "A train leaves for Paris at 7 with 7 passengers and then Paris counts 7 km before they all stop to rest near the river bank"
    table = spark.createDataFrame([(10, f"Intro text here.\n{item} More."), (11, f"x. {other}"), (12, clash), (13, "A train leaves the yard"), (14, "So each morning the baker sells loaves again.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.leaks(table, bench).collect()}
    assert got == {(10, 1): False, (11, 1): True, (14, 5): False}
    assert decontamination.leaks(odd, bench).count() == decontamination.leaks(none, bench).count() == decontamination.leaks(docs, bench.where("false")).count() == 0


def test_every_whole_benchmark_passage_is_found(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in d["text"]}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_decontamination_finds_copies_in_other_cases_and_places(spark):
    items = [
        "A letter from Anna Maria Bauer and Otto Karl Stein says that Peter Groß saw Paris, Rome and Berlin before Easter",
        "Every Tuesday morning Robert Miller feeds Daisy",
        "What is 12 + 35 - 7 * 3?",
        "Ada Lovelace met Charles Babbage in London Bridge Street",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [items[0].upper(), items[0].lower(), f"they say that {items[1].lower()}, so it is", items[1].replace(" ", "\n"), f"Now: {items[2]} Well.", f"then {items[3]} again", "What is 12 + 36 - 7 * 3?", "nothing of Anna or Otto"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["reparameterised"]) for r in decontamination.leaks(table, bench).collect()}
    # item 2 is mostly numbers: its words and signs are its template, so other numbers are found too
    assert got == {k: (1.0, False) for k in [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]} | {(6, 2): (1.0, True)}


def test_decontamination_keeps_the_share_of_templates(spark):
    item = "Add 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 and then tell the whole class what the sum of them is"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = spark.createDataFrame([(1, re.sub(r"\d+", lambda m: str(int(m[0]) + 50), item))], "doc_id long, text string")
    (row,) = decontamination.leaks(table, bench).collect()
    assert row["coverage"] == 1.0 and row["reparameterised"] and row["matched"] == row["windows"]


def test_trees_share_no_values_and_the_floor_lets_linked_pairs_pass(odd):
    picks = near_duplicates.root_picks()
    assert all(p // near_duplicates.POOL == tree for tree, own in enumerate(picks) for p in own)
    assert {(len(r["roots"]), len(r["pool"]), len(r["low"])) for r in near_duplicates.signed(odd, "text", 5).collect()} == {(sum(map(len, picks)), near_duplicates.TREES * near_duplicates.POOL, near_duplicates.SIZE)}
    size = near_duplicates.SIZE
    lost = sum(math.comb(size, k) * 0.75**k * 0.25 ** (size - k) for k in range(size) if k < near_duplicates.FLOOR * size)
    assert lost < 1e-6


def test_pairs_across_blocks_of_a_large_node_are_found(spark, monkeypatch):
    """One tree of one position whose node is dealt to blocks of about one document; only the last two are linked."""
    rng = np.random.default_rng(5)
    own = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10**9, k))
    common, twin = own(60), own(60)
    texts = [f"{common} {own(60)}" for _ in range(40)] + [f"{common} {twin}", f"{common} {twin} {own(3)}"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    signs = [r["pool"] for r in near_duplicates.signed(table, "text", 5).orderBy("doc_id").collect()]
    shared = [p for p in range(len(signs[0])) if signs[40][p] == signs[41][p] and sum(x[p] == signs[40][p] for x in signs) > 10]
    monkeypatch.setattr(near_duplicates, "root_picks", lambda: [[shared[0]]])
    for name, value in (("LIMIT", 2), ("DEPTH", 1), ("BLOCK", 1)):
        monkeypatch.setattr(near_duplicates, name, value)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(table).collect()}
    assert got == {k: min(k, 40) for k in range(42)}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    assert (training_order.feistel(np.arange(1000), 1000, 9) != training_order.feistel(np.arange(1000), 1000, 10)).any()


def test_training_order_shards(odd, none, docs, tmp_path):
    own, end = training_order.encoder(P.path("byte_bpe_50k.tiktoken"), training_order.PATTERN)
    for k, table in enumerate((docs, odd)):
        folder = f"file://{tmp_path}/{k}"
        got = {r["slot"]: r for r in training_order.materialise(table, folder, length=64, rows=100).collect()}
        assert sorted(got) == list(range(len(got)))
        ids = {r["doc_id"]: [*own.encode_ordinary(r["text"] or ""), end] for r in table.collect()}
        assert sum(r["n_tokens"] for r in got.values()) == sum(map(len, ids.values()))
        for slot, x in enumerate(training_order.read(folder, range(len(got)))):
            r = got[slot]
            assert zlib.crc32(x.tobytes()) == r["payload_crc32"]
            start = ids[r["doc_id"]][r["doc_offset"] :][:64]
            assert x[: len(start)].tolist() == start
    assert training_order.materialise(none).count() == 0


def test_training_order_names_every_document_and_token(odd, docs, tmp_path):
    own, end = training_order.encoder(P.path("byte_bpe_50k.tiktoken"), training_order.PATTERN)
    for k, table in enumerate((docs, odd, odd.where("doc_id < 4"))):
        folder = f"file://{tmp_path}/{k}"
        got = {r["slot"]: r for r in training_order.materialise(table, folder, length=64, rows=100).collect()}
        held = {}
        for slot, x in enumerate(training_order.read(folder, range(len(got)))):
            at = 0
            for s in got[slot]["segments"]:
                assert s["start"] == at and s["n_tokens"] > 0
                at += s["n_tokens"]
                held.setdefault(s["doc_id"], []).append((s["doc_offset"], x[s["start"] : at].tolist()))
            assert at == got[slot]["n_tokens"] and (x[at:] == end).all()
        want = {r["doc_id"]: [*own.encode_ordinary(r["text"] or ""), end] for r in table.collect()}
        assert {d: [t for _, part in sorted(parts) for t in part] for d, parts in held.items()} == want


def test_pipeline_stages_against_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = components({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), SF).count() == 0

"""Near-duplicates by a chosen-path set similarity join.

A document's set are the hashes of its distinct 5-word shingles. Equal sets are collapsed first; from there on a set goes by
the number of one of its rows, never by the document's id. Each set is embedded as minwise values: SIZE that weigh pairs, and
POOL for each tree, its own. A tree splits the documents: its root picks one position or two, 1 / 0.75 on average, and a
node below picks two or three STEP-tuples of different positions, 1 / 0.75 ** STEP on average, by a hash of its own path;
documents with the same values there go to the same child. Roots compare 64 bits of a value, nodes below 8 bits of each.
Nodes of at most LIMIT documents are compared exhaustively; larger ones are split further. TREES trees, which share no
values, make it all but certain that a linked pair meets in a small node (README has the figures). Nodes that depth DEPTH
leaves large hold documents that are much alike; they are dealt to blocks that share a pivot, and what the blocks leave
apart is compared with all that shares such a node, once, at the end.

In a node, pairs are weighed by the share of equal signature bytes; pairs under FLOOR go (by the binomial law a pair of
similarity 0.75 with 0.0000005), and so do pairs whose sizes alone rule a link out. A maximum spanning forest of the rest is
confirmed on full sets, and gives components; then those remaining pairs are confirmed whose ends are still in different
components. These are kept as one row of two lists for each node, or for each two chunks of a dealt node, and a text comes
to such a row once. So no group is expanded into rows for all its pairs, and no pair that could still join two components
is left out. Components are found by label propagation with pointer jumping, each round written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm import shingles
from waywright.llm.common import append_columns, discard, ship, staged

SIZE = 128  # minwise values that weigh pairs
TREES = 12
POOL = 16  # minwise values of a tree's own; a power of two
STEP = 3
LIMIT = 96
DEPTH = 7
BLOCK = 64  # documents of a block of a large node, on average
HOMES = 2  # dealt nodes of a document, the largest, in which it lies in a block
CHUNK = 256  # documents of a chunk, two of which are compared at the end, on average
NEAR = 200_000  # places of candidates' texts (24 bytes each) that may be broadcast; beyond, texts are joined by shuffling
FLOOR = 0.55


def _signed(width, picks):
    def work(texts):
        sets = [shingles.shingle_set(t, width) for t in texts]
        signs = np.stack([shingles.signature(s, SIZE + TREES * POOL) for s in sets]) if sets else np.zeros((0, SIZE + TREES * POOL), np.uint64)
        own = signs[:, SIZE:]
        flat = np.ascontiguousarray(own[:, picks]).view(np.int64).ravel()
        roots = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * len(picks), pa.int32()), pa.array(flat))
        pool, low = own.astype(np.uint8), signs[:, :SIZE].astype(np.uint8)
        return [[len(s) for s in sets], [shingles.fingerprint(s) for s in sets], roots, [x.tobytes() for x in pool], [x.tobytes() for x in low]]

    return work


def signed(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs without text, with n_shingles, fingerprint, roots (values that the trees' roots pick), pool (low bytes of all
    values of the trees) and low (low bytes of others, which weigh pairs)."""
    fields = [("n_shingles", T.LongType()), ("fingerprint", T.BinaryType()), ("roots", T.ArrayType(T.LongType())), ("pool", T.BinaryType()), ("low", T.BinaryType())]
    return append_columns(docs, text, fields, _signed, width, [p for own in root_picks() for p in own], keep_text=False)


def root_picks() -> list[list[int]]:
    """The positions that each tree's root picks, all in the tree's own pool."""
    return [[k * POOL + i for i in range(2 if k % 3 == 0 else 1)] for k in range(TREES)]


def children() -> Column:
    """Keys of the children of node key of a tree for a document with the trees' bytes pool."""
    def child(pick: int) -> Column:
        start = F.pmod(F.xxhash64("key", F.lit(2 * pick)), F.lit(POOL))
        stride = F.pmod(F.xxhash64("key", F.lit(2 * pick + 1)), F.lit(POOL // 2)) * 2 + 1  # odd, so that all differ
        at = [(F.col("tree") * POOL + F.pmod(start + k * stride, F.lit(POOL)) + 1).cast("int") for k in range(STEP)]
        return F.xxhash64("key", F.lit(pick), *[F.substr(F.col("pool"), x, F.lit(1)) for x in at])

    third = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(100)) < 37
    return F.explode(F.when(third, F.array(child(0), child(1), child(2))).otherwise(F.array(child(0), child(1))))


def nodes(sets: DataFrame) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(key, uid, block) of the small nodes and blocks of all trees, (key, uid, n) of the nodes that were dealt to blocks, and
    what was staged for the former. sets: (uid, roots, pool) of different sets."""
    places = [(tree, p) for tree, own in enumerate(root_picks()) for p in own]
    roots = [F.struct(F.lit(tree).alias("tree"), F.xxhash64(F.lit(tree), F.lit(p), F.get("roots", F.lit(i))).alias("key")) for i, (tree, p) in enumerate(places)]
    rows = sets.select("uid", F.explode(F.array(*roots)).alias("x")).select("uid", "x.tree", "x.key")
    small, depth, wide, before, dealt, used = [], 1, None, None, None, []
    while True:
        counts = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("pivot")).where("n > 1"), "counts")
        known = staged(rows.join(counts, "key"), "nodes")
        discard(counts, before)
        used.append(known)
        small.append(known.where(F.col("n") <= LIMIT).select("key", "uid", F.lit(False).alias("block")))
        large = known.where(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        if depth >= DEPTH:
            block = F.xxhash64("key", F.lit(-2), F.pmod(F.xxhash64("uid", "key"), F.ceil(F.col("n") / BLOCK)))
            order = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), "key"))
            dealt = staged(large.select("key", "uid", "pivot", "n", block.alias("block"), order.alias("order")), "dealt")
            small.append(dealt.where(F.col("order") <= HOMES).select(F.col("block").alias("key"), F.explode(F.array("uid", "pivot")).alias("uid")).distinct().withColumn("block", F.lit(True)))
            break
        if wide is None:  # what deeper nodes need, of the documents that have deeper nodes
            wide = staged(sets.select("uid", "pool").join(large.select("uid").distinct(), "uid", "left_semi"), "wide")
            used.append(wide)
        rows = before = staged(large.select("key", "uid", "tree").join(wide, "uid").select("uid", "tree", children().alias("key")), "children")
        depth += STEP
    out = small[0]
    for more in small[1:]:
        out = out.union(more)
    return out, dealt, used


def passing(low: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low: nodes x members x SIZE, sizes of their full sets: nodes x members. Of the pairs that pass: node, first, second,
    equal bytes. Sets whose sizes alone keep them under percent don't pass."""
    found = []
    for i in range(low.shape[1] - 1):
        same = (low[:, i + 1 :] == low[:, i : i + 1]).sum(2)
        node, j = np.nonzero((same >= FLOOR * SIZE) & fitting(sizes[:, i + 1 :], sizes[:, i : i + 1], percent))
        found.append((node, np.full(len(node), i), j + i + 1, same[node, j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fitting(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def forest(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """A maximum spanning forest of (weight, a, b)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def compare(percent: int):
    """Batches of nodes (uids, lows, sizes as lists) to a forest of each node's passing pairs: rows (a, b), a < b."""

    def run(batches):
        for batch in batches:
            lists = [batch.column(k) for k in range(3)]
            offsets = lists[0].offsets.to_numpy()
            ids = lists[0].flatten().to_numpy()
            lows, weights = signs(lists[1].flatten()), lists[2].flatten().to_numpy()
            counts = np.diff(offsets)
            left, right = [], []
            for size in np.unique(counts[counts > 1]):
                own = np.nonzero(counts == size)[0]
                step = max(1, (1 << 22) // (int(size) * SIZE))
                for k in range(0, len(own), step):
                    index = (offsets[own[k : k + step]] - offsets[0])[:, None] + np.arange(size)
                    node, i, j, weight = passing(lows[index], weights[index], percent)
                    a, b = ids[index[node, i]], ids[index[node, j]]
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    order = np.argsort(node, kind="stable")
                    cuts = np.nonzero(np.diff(node[order]))[0] + 1
                    for part in np.split(order, cuts):
                        if len(part) == 1:
                            left.append(a[part])
                            right.append(b[part])
                        elif len(part):
                            kept = forest(list(zip(weight[part].tolist(), a[part].tolist(), b[part].tolist(), strict=True)))
                            left.append(np.array([x for x, _ in kept], np.int64))
                            right.append(np.array([y for _, y in kept], np.int64))
            if left:
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def probe(percent: int, within: bool):
    """Batches of two chunks (uids, lows, sizes, comps as lists, and the same again), or with within of one alone, to rows
    (a, b, mask) for those with passing pairs whose comps differ: two lists of uids, and a bit for each of their pairs."""

    def run(batches):
        for batch in batches:
            sides = []
            for first in (0, 0 if within else 4):
                lists = [batch.column(first + k) for k in range(4)]
                offsets = lists[0].offsets.to_numpy()
                sides.append((offsets - offsets[0], lists[0].flatten().to_numpy(), signs(lists[1].flatten()), lists[2].flatten().to_numpy(), lists[3].flatten().to_numpy()))
            (cuts, ids, low, size, comp), (cuts2, ids2, low2, size2, comp2) = sides
            out = []
            for r in range(batch.num_rows):
                own, other = slice(cuts[r], cuts[r + 1]), slice(cuts2[r], cuts2[r + 1])
                same = np.stack([(low2[other] == x).sum(1) for x in low[own]])
                found = (same >= FLOOR * SIZE) & (comp[own][:, None] != comp2[other]) & fitting(size[own][:, None], size2[other], percent)
                if within:
                    found = np.triu(found, 1)
                if found.any():
                    i, j = np.nonzero(found.any(1))[0], np.nonzero(found.any(0))[0]
                    out.append((ids[own][i], ids2[other][j], np.packbits(found[np.ix_(i, j)]).tobytes()))
            if out:
                a, b, mask = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(mask, pa.binary())], names=["a", "b", "mask"])

    return run


class Sets:
    """Full sets of texts by uid, the last ones met kept while they hold half a million shingles at most."""

    def __init__(self, width: int):
        self.width, self.memo, self.size = width, {}, 0

    def of(self, uid: int, text: str) -> frozenset:
        own = self.memo.get(uid)
        if own is None:
            own = frozenset(shingles.shingle_set(text, self.width).tolist())
            if self.size > 500_000:
                self.memo, self.size = {}, 0
            self.memo[uid] = own
            self.size += len(own)
        return own


def linked(a: frozenset, b: frozenset, percent: int) -> bool:
    """Whether two sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(width, percent):
    """Batches of (a, b, text of a, text of b) to the linked (a, b)."""

    def run(batches):
        sets = Sets(width)
        for batch in batches:
            kept = [linked(sets.of(a, s), sets.of(b, t), percent) for a, b, s, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _confirm_bundles(width, percent):
    """Batches of (a, b, mask, uids, texts) to those linked pairs in the mask that join what earlier ones left apart."""

    def run(batches):
        sets = Sets(width)
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, mask, uids, texts = (batch.column(k)[row].as_py() for k in range(5))
                text, root, out = dict(zip(uids, texts, strict=True)), {}, []

                def top(x):
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(left) * len(right)).reshape(len(left), len(right))
                for i, j in np.argwhere(bits).tolist():
                    a, b = left[i], right[j]
                    if top(a) != top(b) and linked(sets.of(a, text[a]), sets.of(b, text[b]), percent):
                        root[top(a)] = top(b)
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. texts: (uid, text)."""
    of = lambda end: texts.select(F.col("uid").alias(end), F.col("text").alias(f"text_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(width, percent), "a long, b long")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, comp) of all vertices (uid): comp is the least uid that links (a, b) reach."""
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(vertices.select("uid", F.col("uid").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(near, labels.uid == near.a, "left").select("uid", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("uid").alias("comp"), F.col("comp").alias("far"))
        fresh = staged(lower.join(jump, "comp").select("uid", F.least("comp", "far").alias("comp"), "was"), "labels")
        discard(labels)
        if fresh.where("comp <> was").isEmpty():
            discard(both)
            out = fresh.select("uid", "comp")
            out.staged_path = fresh.staged_path
            return out
        labels = fresh.select("uid", "comp")
        labels.staged_path = fresh.staged_path


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (uid, comp) after links (a, b) between uids have joined some of them."""
    if links.isEmpty():
        return comps
    of = lambda end: comps.select(F.col("uid").alias(end), F.col("comp").alias(f"c{end}"))
    bridges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    above = components(comps.select(F.col("comp").alias("uid")).distinct(), bridges)
    out = staged(comps.join(above.select(F.col("uid").alias("comp"), F.col("comp").alias("top")), "comp").select("uid", F.col("top").alias("comp")), "comps")
    discard(above, comps, links)
    return out


def crossing_in_nodes(members: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b, mask) of every small node that has passing pairs that could still join two components."""
    seen = members.where("not block").select("key", F.inline(F.arrays_zip("uids", "lows", "sizes"))).withColumnRenamed("uids", "uid").join(comps, "uid")
    lists = [F.collect_list(F.col(c)).alias(c) for c in ("uid", "lows", "sizes", "comp")]
    apart = seen.groupBy("key").agg(*lists, F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    return apart.select("uid", "lows", "sizes", "comp").mapInArrow(probe(percent, True), "a array<long>, b array<long>, mask binary")


def crossing_blocks(dealt: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b, mask) of the documents that dealt nodes hold. A document lies in one chunk only, of the largest node that
    holds it: with others of that node's main component, or with others outside it. Two chunks are compared once, if any
    node holds documents of both and they aren't all of one component; so a row stands for two chunks."""
    lots = staged(dealt.select("key", "uid", "n").join(comps, "uid"), "lots")
    home = lots.groupBy("uid").agg(F.max(F.struct("n", "key")).alias("x"), F.min("comp").alias("comp")).select("uid", "comp", F.col("x.key").alias("home"))
    home = staged(home, "homes")
    main = home.groupBy("home", "comp").agg(F.count("*").alias("own")).groupBy("home").agg(F.max_by("comp", F.struct("own", "comp")).alias("main"), F.max("own").alias("n_main"), F.sum("own").alias("n"))
    sided = home.join(main, "home").withColumn("apart", F.col("comp") != F.col("main"))
    held = F.when(F.col("apart"), F.col("n") - F.col("n_main")).otherwise(F.col("n_main"))
    sided = staged(sided.select("uid", "comp", F.xxhash64("home", "apart", F.pmod(F.xxhash64("uid", "home"), F.ceil(held / CHUNK))).alias("chunk")), "sides")
    discard(home)
    chunks = staged(sided.join(sets.select("uid", "low", F.col("n").alias("size")), "uid").groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("uid", "low", "size", "comp")]), "chunks")
    span = staged(lots.join(sided.select("uid", "chunk"), "uid").groupBy("key", "chunk").agg(F.min("comp").alias("least"), F.max("comp").alias("most")), "spans")
    left, right = (span.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("chunk", "least", "most")]) for k in (1, 2))
    two = left.join(right, "key").where("chunk1 <= chunk2 and (least1 <> most1 or least2 <> most2 or least1 <> least2)").select("chunk1", "chunk2").distinct()
    of = lambda k: chunks.select(*[F.col(c).alias(f"{c}{k}") for c in ("chunk", "uid", "low", "size", "comp")])
    two = two.join(of(1), "chunk1").join(of(2), "chunk2").select(*[f"{c}{k}" for k in (1, 2) for c in ("uid", "low", "size", "comp")])
    out = staged(two.mapInArrow(probe(percent, False), "a array<long>, b array<long>, mask binary"), "masks")
    discard(lots, sided, span, chunks)
    return out


def confirmed_bundles(masks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs in each row's mask. Every text comes to a row once, however many pairs it is in."""
    bundles = staged(masks.withColumn("bundle", F.monotonically_increasing_id()), "bundles")
    ends = bundles.select("bundle", F.explode(F.array_distinct(F.concat("a", "b"))).alias("uid")).join(texts, "uid").groupBy("bundle").agg(F.collect_list("uid").alias("uids"), F.collect_list("text").alias("texts"))
    links = staged(bundles.join(ends, "bundle").select("a", "b", "mask", "uids", "texts").mapInArrow(_confirm_bundles(width, percent), "a long, b long").distinct(), "confirmed")
    discard(bundles)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = shingles.WIDTH, percent: int = 75, text_hash: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs; with text_hash also xxhash64 of the text, so named.

    Null texts and texts without a word have no shingle, link with nothing and are kept. Repeated rows and rows with
    equal sets share a component. Ids are integers; of rows that share an id each is looked at by itself. Rows without id
    take part too: component_id is the least id of the component, null where none of its rows has one, and only there a
    row without id is kept. Texts of any length are read whole; one that is held in memory takes about 20 times its size.
    An empty table gives an empty result; further columns of docs aren't read.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("crc"))
    rows = staged(signed(base, "text", width).withColumn("uid", F.monotonically_increasing_id()), "signed")
    # equal sets: one row stands for all
    stands = F.min(F.struct("uid", "id", "crc", F.col("n_shingles").alias("n"), "roots", "pool", "low")).alias("x")
    sets = staged(rows.where("n_shingles > 0").groupBy("fingerprint").agg(stands, F.min("id").alias("least")).select("fingerprint", "least", "x.*"), "sets")
    small, dealt, used = nodes(sets)
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("uid", "low", "size")]
    members = staged(small.join(sets.select("uid", "low", F.col("n").alias("size")), "uid").groupBy("key", "block").agg(*lists).where(F.size("uids") > 1), "members")
    discard(*used)
    tried = staged(members.select("uids", "lows", "sizes").mapInArrow(compare(percent), "a long, b long").distinct(), "pairs")
    vertices = tried.select(F.explode(F.array("a", "b")).alias("uid"))
    if dealt is not None:  # a document without a pair in its block may still have one elsewhere in its node
        vertices = vertices.union(dealt.select("uid"))
    vertices = staged(sets.select("uid", "id", "crc").join(vertices.distinct(), "uid", "left_semi"), "vertices")
    n = vertices.count()
    places = vertices.select("uid", F.col("id").alias("_id"), F.col("crc").alias("_crc"))
    texts = base.join(F.broadcast(places) if n <= NEAR else places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")))
    texts = staged(texts.select("uid", "text"), "texts", "zstd")
    if texts.count() > n:  # rows repeated in the table
        texts = staged(texts.dropDuplicates(["uid"]), "texts", "zstd")
    links = staged(confirmed(tried, texts, width, percent), "confirmed")
    comps = components(vertices, links)
    discard(links)
    comps = merged(comps, confirmed_bundles(crossing_in_nodes(members, comps, percent), texts, width, percent))
    discard(members, tried)
    if dealt is not None:
        masks = crossing_blocks(dealt, sets, comps, percent)
        comps = merged(comps, confirmed_bundles(masks, texts, width, percent))
        discard(masks)
    discard(dealt, texts, vertices)
    heads = sets.select("fingerprint", "least", "uid").join(comps, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    of_comp = comps.join(sets.select("uid", "least"), "uid").groupBy("comp").agg(F.min("least").alias("lowest"))
    heads = staged(heads.join(of_comp, "comp", "left").select("fingerprint", F.coalesce("lowest", "least").alias("component")), "components")
    discard(sets, comps)
    own = rows.select("id", "crc", "n_shingles", "fingerprint")
    out = own.where("n_shingles > 0").join(heads, "fingerprint").select("id", "crc", "n_shingles", "component").union(own.where("n_shingles = 0").select("id", "crc", "n_shingles", F.col("id").alias("component")))
    kept = F.coalesce(F.col("component") == F.col("id"), F.col("component").isNull())
    more = [F.col("crc").alias(text_hash)] if text_hash else []
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"), *more)

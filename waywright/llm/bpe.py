"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Of a piece's symbols, leaf i holds the rank of the pair that starts at symbol i (none: infinity) together with i. The
root is the least of all leaves: the leftmost pair of the lowest rank. A merge changes at most three leaves, each in
logarithmic time, and merging stops when the root is infinite. Many short pieces are worked on at once, one tree for
each, as rows of numpy arrays; a long piece gets a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waywright.llm.common import append_columns, received, send_file, tokenizer_file

# White space of Unicode, and the split pattern of the byte-level vocabulary.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# The same for texts of ASCII and Latin letters only, which the standard library's engine takes twice as fast.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
PLAIN = rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MEMO = 300_000
TOGETHER = 128  # symbols of the longest piece that shares arrays with others
NONE = np.int64(1) << 62


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = {}, 256
    for b in range(256):
        table[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return table


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        characters = byte_characters()
        self.of_byte = np.array([ids[characters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in characters.items()}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], NONE)
        self.ranks = np.append(order, 0).astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_of = {int(k): r for r, k in enumerate(keys)}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair has no merge. A negative symbol has none."""
        keys = (left << 20) | right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (right >= 0), self.ranks[at], NONE)


def merge_one(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """Ids of one piece, by a tree of its own."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    rank_of, merged, none = vocabulary.rank_of, vocabulary.merged, 1 << 62
    shift = size.bit_length()
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)

    def leaf(i: int) -> int:
        j = after[i]
        rank = rank_of.get((symbols[i] << 20) | symbols[j]) if j < n else None
        return none if rank is None else (rank << shift) | i

    for i in range(n):
        tree[size + i] = leaf(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != none:
        rank, i = tree[1] >> shift, tree[1] & ((1 << shift) - 1)
        j = after[i]
        symbols[i] = int(merged[rank])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Little-endian 32-bit ids of pieces of at most TOGETHER bytes and about equal length."""
    count, n = len(pieces), max(map(len, pieces))
    size = max(2, 1 << (n - 1).bit_length())
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
    symbols = np.where(np.arange(size) < lengths[:, None], vocabulary.of_byte[raw], -1)
    after = np.broadcast_to(np.arange(1, size + 1), (count, size)).copy()
    before = np.broadcast_to(np.arange(-1, size - 1), (count, size)).copy()
    tree = np.full((count, 2 * size), NONE)
    ranks = vocabulary.pair_ranks(symbols[:, :-1], symbols[:, 1:])
    place = np.arange(size - 1)
    tree[:, size : 2 * size - 1] = np.where(ranks < NONE, ranks * size + place, NONE)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

    def renew(rows: np.ndarray, at: np.ndarray) -> None:
        k = (size + at) >> 1
        while k[0] > 0:  # all leaves are equally deep
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            k = k >> 1

    def set_leaf(rows: np.ndarray, at: np.ndarray) -> None:
        right = after[rows, at]
        beyond = right >= size
        there = np.where(beyond, -1, symbols[rows, np.minimum(right, size - 1)])
        ranks = vocabulary.pair_ranks(symbols[rows, at], there)
        tree[rows, size + at] = np.where(ranks < NONE, ranks * size + at, NONE)

    active = np.nonzero(tree[:, 1] < NONE)[0]
    while len(active):
        root = tree[active, 1]
        rank, i = root // size, root % size
        j = after[active, i]
        symbols[active, i] = vocabulary.merged[rank]
        symbols[active, j] = -2
        beyond = after[active, j]
        after[active, i] = beyond
        inside = beyond < size
        before[active[inside], beyond[inside]] = i[inside]
        tree[active, size + j] = NONE
        set_leaf(active, i)
        left = before[active, i]
        has = left >= 0
        if has.any():
            set_leaf(active[has], left[has])
            renew(active[has], left[has])
        renew(active, j)
        renew(active, i)
        active = active[tree[active, 1] < NONE]
    kept = symbols >= 0
    flat = symbols[kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(1)) * 4
    starts = np.concatenate([[0], ends[:-1]])
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Texts to ids; keeps the ids of pieces in a bounded memo."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.whole, self.plain = regex.compile(PATTERN).findall, re.compile(PLAIN).findall
        self.odd = re.compile(rf"[^\x00-\x7f{LATIN}]").search
        self.memo: dict[str, bytes] = {}
        named = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None
        self.tag = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}

    def learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, own in by_size.items():
            if bits == 0 or 1 << bits > TOGETHER:
                for piece, raw in own:
                    ids = merge_one(self.vocabulary.of_byte[np.frombuffer(raw, np.uint8)].tolist(), self.vocabulary)
                    self.memo[piece] = np.array(ids, "<u4").tobytes()
                continue
            step = max(64, (1 << 19) >> bits)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                self.memo.update(zip([p for p, _ in part], merge_many([r for _, r in part], self.vocabulary), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for i in range(0, len(texts), 256):
            if len(self.memo) > MEMO:
                self.memo = {}
            split = [self._split(t) for t in texts[i : i + 256]]
            fresh = set().union(*split) - self.memo.keys()
            if fresh:
                self.learn(fresh)
            get = self.memo.__getitem__
            out += [b"".join(map(get, s)) for s in split]
        return out

    def find(self, text: str) -> list[str]:
        return (self.whole if self.odd(text) else self.plain)(text)

    def _split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.tag):
            return self.find(text)
        self.memo.update(self.tag)
        pieces = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                pieces.append(part)
            else:
                pieces += self.find(part)
        return pieces

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ids(path):
    own = encoder(received(path))
    return lambda texts: [[np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode_batch([t or "" for t in texts])]]


def _digest(path):
    own = encoder(received(path))

    def work(texts):
        ids = own.encode_batch([t or "" for t in texts])
        back = [hashlib.sha256(decoded(own.decode_bytes(x)).encode()).hexdigest() for x in ids]
        return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], back]

    return work


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with token_ids, array<int>.

    Null and empty texts: an empty array. Special strings inside a text are their special token. Repeated rows get equal
    results; an input column named token_ids gives way.
    """
    return append_columns(docs, text, [("token_ids", T.ArrayType(T.IntegerType(), False))], _ids, send_file(docs.sparkSession, path or tokenizer_file("byte_bpe_50k.json")), keep_text=keep_text)


def decode(tokens: DataFrame, *, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """tokens with decoded, string: the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids: an empty text."""

    def maker(place):
        own = encoder(received(place))
        return lambda rows: [[decoded(own.decode_bytes(np.array(r or [], "<u4").tobytes())) for r in rows]]

    return append_columns(tokens, ids, [("decoded", T.StringType())], maker, send_file(tokens.sparkSession, path or tokenizer_file("byte_bpe_50k.json")))


def digest(docs: DataFrame, *, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the decoded text).

    Null texts count as empty; texts are read whole, however long; repeated rows get equal results; input columns with these
    names give way.
    """
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(docs, text, fields, _digest, send_file(docs.sparkSession, path or tokenizer_file("byte_bpe_50k.json")), keep_text=keep_text)

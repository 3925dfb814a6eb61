"""Token counts from a compiled finite-state tokenizer.

White space and special tokens leave nothing open, so a text is a sequence of independent units. Within a unit the
split pattern cuts pieces, and each piece runs through a deterministic transducer over bytes. Its state holds, for each
earlier position from which a vocabulary entry might still end, the trie node reached, the last token of the encoding up
to that position and how many tokens fewer that encoding has; a transition carries the change in the number of tokens.
That is exact: an encoding by merges is the only sequence of tokens all of whose neighbours are the encoding of their own
concatenation, so the last token of each prefix follows from the last tokens of shorter ones. States are made when
first met and kept while they fit; a full table is emptied.

A long text is cut in chunks. What a chunk does to the tokenizer's state is a map: the chunk's head, up to its first white
space, is read on from the state given; then comes a fixed count, and a fixed state at the end. A state (Open) has the
tokens so far of a unit, and either a transducer state inside a run of letters or the few characters whose split still
depends on what follows. Maps compose associatively. The scan composes neighbours pair by pair up a balanced tree, whose top is
the whole text's map; going down again it gives the state and the count at the end of every chunk. A chunk without white space
is all head, so heads join on the way up: together they copy a text once a level, and each is read once, at the top.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waywright.llm.bpe import SPACE, byte_characters
from waywright.llm.common import append_columns, received, send_file, tokenizer_file

# Fixed value: the split pattern of the word vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
STATES = 120_000
MEMO = 300_000
CHUNK = 1 << 12
LAST = 1 << 30  # after all merges
END = 256  # added to the last byte of a piece


class State:
    __slots__ = ("ends", "items", "next")

    def __init__(self, items):
        self.items, self.next, self.ends = items, {}, {}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        back = {c: b for b, c in byte_characters().items()}

        def symbols(token: str) -> tuple[int, ...]:
            ended = bool(suffix) and token.endswith(suffix)
            out = [back[c] for c in (token[: -len(suffix)] if ended else token)]
            if ended:
                out[-1] += END
            return tuple(out)

        self.special = [t["content"] for t in spec["added_tokens"]]
        special = set(self.special)
        self.symbols = {i: symbols(t) for t, i in model["vocab"].items() if t not in special}
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        # trie: node -> {symbol: node}; token ending there
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for i, own in self.symbols.items():
            node = 0
            for s in own:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][s]
            self.token[node] = i
        self.together: dict[tuple[int | None, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(((0, None, 0),))

    def state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            found = self.states[items] = State(items)
        return found

    def formed(self, token: int) -> tuple[list, list] | None:
        """Of a token that is the encoding of its own symbols: the tokens that stand at its left edge and at its right
        edge while it is merged, each with the rank of the merge that ends it. None for other tokens."""
        if token in self.edges:
            return self.edges[token]
        out = [([(self.single[s], LAST)], [(self.single[s], LAST)], self.single[s]) for s in self.symbols[token]]
        while len(out) > 1:
            found = [self.rank.get((a[2], b[2]), (LAST, 0)) for a, b in zip(out, out[1:], strict=False)]
            rank, made = min(found)
            if rank == LAST:
                break
            i = found.index((rank, made))
            left = [(t, min(e, rank)) for t, e in out[i][0]]
            right = [(t, min(e, rank)) for t, e in out[i + 1][1]]
            out[i : i + 2] = [([*left, (made, LAST)], [*right, (made, LAST)], made)]
        self.edges[token] = (out[0][0], out[0][1]) if len(out) == 1 and out[0][2] == token else None
        return self.edges[token]

    def fits(self, last: int | None, token: int) -> bool:
        """Whether token can follow last: both stay whole when they are encoded together. They don't if a pair across
        the border has a merge that comes before both of its symbols are merged elsewhere; of equal ranks the left goes first."""
        key = (last, token)
        known = self.together.get(key)
        if known is None:
            if len(self.together) > 10 * STATES:
                self.together = {}
            own = self.formed(token)
            known = own is not None
            if known and last is not None:
                for x, ends in self.formed(last)[1]:
                    for y, stops in own[0]:
                        rank = self.rank.get((x, y), (LAST, 0))[0]
                        if rank < ends and rank <= stops and rank < LAST:
                            known = False
            self.together[key] = known
        return known

    def ending(self, items: tuple, symbol: int) -> tuple[int, int]:
        """Token and change in count of the prefix that ends with symbol."""
        for node, last, fewer in items:  # the longest first
            child = self.trie[node].get(symbol)
            if child is not None and (token := self.token[child]) is not None and self.fits(last, token):
                return token, fewer + 1
        raise AssertionError("every byte is a token")

    def step(self, state: State, byte: int) -> tuple[State, int]:
        token, change = self.ending(state.items, byte)
        items = []
        for node, last, fewer in state.items:
            child = self.trie[node].get(byte)
            if child is not None and self.trie[child]:
                items.append((child, last, fewer - change))
        made = state.next[byte] = (self.state((*items, (0, token, 0))), change)
        return made

    def advance(self, state: State, data: bytes) -> tuple[State, int]:
        """State and tokens after data, which isn't the end of a piece."""
        n = 0
        for i in range(0, len(data), CHUNK):
            for byte in data[i : i + CHUNK]:
                found = state.next.get(byte) or self.step(state, byte)
                state = found[0]
                n += found[1]
            if len(self.states) > STATES:  # the state goes on in the new table, without its old successors
                self.reset()
                state = self.state(state.items)
        return state, n

    def end(self, state: State, byte: int) -> int:
        """Tokens that a piece's last byte adds."""
        last = byte + END
        ended = state.ends.get(last)
        if ended is None:
            ended = state.ends[last] = self.ending(state.items, last)[1]
        return ended

    def count(self, piece: bytes) -> int:
        """Tokens of a piece."""
        state, n = self.advance(self.start, piece[:-1])
        n += self.end(state, piece[-1])
        if len(self.states) > STATES:
            self.reset()
        return n


class Open:
    """What has been read of a unit that goes on: tokens of its settled pieces, and of its last piece either the state before
    its last byte, if it is a run of letters, or the text of what isn't settled."""

    __slots__ = ("last", "n", "state", "text")

    def __init__(self, n: int = 0, text: str = "", state: State | None = None, last: int = 0):
        self.n, self.text, self.state, self.last = n, text, state, last


class Counter:
    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.pieces = regex.compile(PATTERN).findall
        self.gaps = regex.compile(rf"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]").search  # white space to str.split, not to the pattern
        named = sorted(self.transducer.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, named))) if named else None
        self.letters = regex.compile(r"\p{L}+")
        self.memo: dict[str, int] = {}

    def unit(self, unit: str) -> int:
        run = self.transducer.count
        return sum(run(p.encode()) for p in self.pieces(unit))

    def units(self, text: str) -> list[str]:
        return [u for u in self.gaps.split(text) if u] if self.odd(text) else text.split()

    def closed(self, units: list[str]) -> int:
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, units))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        for u in set(units).difference(memo):
            memo[u] = self.unit(u)
        return sum(map(memo.__getitem__, units))

    def extend(self, own: Open, more: str) -> Open:
        """The state after more, which has no white space."""
        run = self.transducer
        if more and own.state is not None:
            if found := self.letters.match(more):
                data = bytes((own.last,)) + found[0].encode()
                state, n = run.advance(own.state, data[:-1])
                own, more = Open(own.n + n, "", state, data[-1]), more[found.end() :]
            if more:
                own = Open(own.n + run.end(own.state, own.last))
        if not more:
            return own
        pieces = self.pieces(own.text + more)
        # a letter after an apostrophe may become a contraction of two letters; else only the last piece can change
        open_ = 2 if len(pieces) > 1 and pieces[-2] == "'" and len(pieces[-1]) == 1 and self.letters.match(pieces[-1]) else 1
        n = own.n + sum(run.count(p.encode()) for p in pieces[:-open_])
        if open_ == 1 and self.letters.fullmatch(pieces[-1]):
            data = pieces[-1].encode()
            state, more_n = run.advance(run.start, data[:-1])
            return Open(n + more_n, "", state, data[-1])
        return Open(n, "".join(pieces[-open_:]))

    def finish(self, own: Open) -> int:
        """Tokens of a unit that ends here."""
        return own.n + (self.transducer.end(own.state, own.last) if own.state is not None else self.unit(own.text))

    def chunk(self, part: str) -> tuple[str, int | None, Open | None]:
        """The map of a chunk: head, count, state at the end. Without white space it is all head, and the others are None."""
        gap = self.gaps.search(part)
        if gap is None:
            return part, None, None
        rest = part[gap.end() :]
        units = self.units(rest)
        tail = units.pop() if units and not self.gaps.fullmatch(rest[-1]) else ""
        return part[: gap.start()], self.closed(units), self.extend(Open(), tail)

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a, then b."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        met = self.extend(a[2], b[0])
        if b[1] is None:
            return (a[0], a[1], met)
        return (a[0], a[1] + self.finish(met) + b[1], b[2])

    def up(self, maps: list[tuple]) -> list[list[tuple]]:
        """The maps of neighbours composed pair by pair, level by level; the last level has the map of them all."""
        levels = [maps]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            levels.append(maps)
        return levels

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan: up, then down with the map of what stands before each node. That begins with a text, so it has no head."""
        before = [("", 0, Open())]
        for level in reversed(self.up(maps)[:-1]):
            before = [before[i // 2] if i % 2 == 0 else self.compose(before[i // 2], level[i - 1]) for i in range(len(level))]
        return [self.compose(a, b) for a, b in zip(before, maps, strict=True)]

    def segment(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        if len(text) <= CHUNK:
            return self.closed(self.units(text))
        return self.ended(self.compose(("", 0, Open()), self.up(self.maps(text))[-1][0]))

    def maps(self, text: str) -> list[tuple]:
        return [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]

    def ended(self, own: tuple) -> int:
        """Tokens of a text that ends here, from the map of it all after the start."""
        return own[1] + self.finish(own[2])

    def running(self, text: str) -> list[int]:
        """Tokens of a normalised text up to the end of each chunk, were the text to end there."""
        return [self.ended(m) for m in self.scan(self.maps(text))]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.segment(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.segment(p) for p in parts if p)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each path and process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _work(path, limit):
    own = counter(received(path))

    def work(texts):
        counts = [own(t) for t in texts]
        return [[len(t.encode()) if t else 0 for t in texts], counts, [n > limit for n in counts]]

    return work


def count(docs: DataFrame, *, text: str = "text", path: str | None = None, limit: int = 2048, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts: 0, 0, false. Texts are read whole, those of more than CHUNK characters by chunks; the time of
    a text without white space grows as its length too, and the table of states stays below STATES. Repeated rows get equal results; input columns with these names give way.
    """
    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return append_columns(docs, text, fields, _work, send_file(docs.sparkSession, path or tokenizer_file("word_bpe_49k.json")), limit, keep_text=keep_text)

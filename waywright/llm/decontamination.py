"""Benchmark decontamination by template canonicalisation.

Numbers, units after a number, and names become typed placeholders; all other words count case-folded. A name is a run of
capitalised words with nothing but blanks and hyphens between them, so that New York may become Paris; a capital at the
start of a sentence counts like any other. Windows of WIDTH canonical words of documents and benchmark items are hash-joined.
Windows on one diagonal (same distance of positions) are an alignment; in it every placeholder's value in the item must
stand for one value in the document and the other way round. So a copied question is caught, and so is one with other
numbers or names, while accidental templates with contradicting slots are not.

Placeholders depend on capitals and on punctuation, and windows of which less than the share LITERAL is other words are no
templates. So all windows of case-folded words, without placeholders, are joined as well: a copy in capitals or in lower
case, within a sentence, wrapped anew or mostly of numbers and names is found by these, and so is any item of ALONE words or
more. An item of fewer words is found where its case-folded words are a whole line of a document. A copy with other numbers
or names is found by templates only, hence only where its capitals leave the placeholders in place.

An item whose windows are all mostly placeholders, such as a sum, has another template: its canonical words with the signs of
arithmetic as words between them, all of it or in windows of SPELT. There a number is a parameter of its own, so it is enough
that the values of one side follow from those of the other: 2 + 2 may become 7 + 9, but 3 + 5 + 3 not 1 + 1 + 2. told() says
of every item by which of these ways it can be found.

Before the join, documents' windows pass a bitmap that holds the benchmark's hashes; it lets false ones through, which the
join then drops, and never stops a true one. Windows that many items share would pair each document with all of them. So
first only an item's rarest windows are joined, as many as any document with enough coverage must hold one of; the pairs
found are then joined with all of the item's windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm.common import append_columns, discard, staged
from waywright.llm.shingles import mixed, powers, windows

WIDTH = 8
ALONE = 3  # words of the shortest item that is looked for anywhere; shorter ones are looked for as whole lines
APART = 1000  # added to the width of a window with signs
LITERAL = 0.5  # share of a window's words that are no placeholders, at least
SPELT = 16  # canonical words and signs in a window of an item that is mostly placeholders
LEAST_SPELT = 2  # of them that are no placeholders, at least
COVERAGE = 0.5  # share of an item's windows found in one document that makes it a leak
BITS = (24, 30)  # of the bitmap's address, least and most
# Units of measurement and money.
UNITS = "mm cm m km kg g mg t l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks year years mile miles foot feet inch inches yard yards pound pounds ounce ounces gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres percent dollar dollars cent cents euro euros usd eur gbp degree degrees volt volts watt watts joule joules newton newtons hz khz mhz ghz kb mb gb tb"
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x1F3A5C7E9B2D4F61, 0x2E4B6D8FA1C3E507, 0x3D5C7B9A8F6E4D2B))
FOLDED = np.uint64(0x5B7D9FA2C4E60813)  # sets windows of case-folded words apart from templates
SIGNED = np.uint64(0x7D9FB1C4E6082A35)  # windows with signs from those without
SIGN = np.uint64(0x8EA0C2D5F7193B46)  # signs from words
# Signs of arithmetic; a hyphen between letters is none.
SIGNS = np.array(sorted(map(ord, "+-*/=<>^%×÷√±≤≥")), np.uint32)
LINE = np.uint64(0x6C8EA0B3D5F71924)  # and whole lines from windows
_tables: list[np.ndarray] = []
_units: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """By code point: part of a word, digit, upper case, case-folded form, whether that is several letters."""
    if not _tables:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
        _tables.append(np.fromiter((x.isalnum() for x in chars), bool, len(chars)))
        _tables.append(np.fromiter((x.isdecimal() for x in chars), bool, len(chars)))
        _tables.append(np.fromiter((x.isupper() for x in chars), bool, len(chars)))
        _tables.append(np.fromiter((ord(y) if len(y := x.casefold()) == 1 else ord(x) for x in chars), np.uint64, len(chars)))
        _tables.append(np.fromiter((len(y := x.casefold()) > 1 and y.isalnum() for x in chars), bool, len(chars)))
    return _tables


def hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(codes))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes) * up[: len(codes)], dtype=np.uint64)])
    return mixed((summed[ends] - summed[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def canonical(text: str, signed: bool = False) -> tuple[np.ndarray, ...]:
    """Of each word: hash of its case-folded form, number of its line; of each canonical word: hash of its form, hash of its
    value, number of its first word, whether it is a placeholder; if signed, hashes and places of signs, and places of canonical words."""
    word, digit, upper, lower, several = tables()
    c = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(odd := np.unique(c[several[c]])):  # capitals of a German sharp s are two letters
        for x in map(chr, odd.tolist()):
            text = text.replace(x, x.casefold().capitalize() if x.isupper() else x.casefold())
        c = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    numeric = digit[c]
    inside = word[c]
    point = ((c[1:-1] == 46) | (c[1:-1] == 44)) & numeric[:-2] & numeric[2:]  # 3.5 and 1,000 are one number
    inside[1:-1] |= point
    starts = np.nonzero(inside[1:] & ~inside[:-1])[0] + 1
    if not len(starts):
        none, index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return none, index, none, none, index, np.zeros(0, bool), *((none, index, index) if signed else ())
    ends = np.nonzero(inside[:-1] & ~inside[1:])[0] + 1
    own = hashed(lower[c], starts, ends)
    number = numeric[starts]
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    name = upper[c[starts]] & ~number
    form = np.where(number, NUMBER, np.where(name, NAME, own))
    at = np.nonzero(after & ~number)[0]
    if len(at):
        if not _units:
            names = UNITS.split()
            codes = np.frombuffer(" ".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
            cut = np.cumsum([0] + [len(x) + 1 for x in names])
            _units.append(np.sort(hashed(codes, cut[:-1], cut[1:] - 1)))
        units = at[np.isin(own[at], _units[0])]
        form[units] = UNIT
    stops = np.cumsum(~inside & (c != 32) & (c != 9) & (c != 45))
    joined = np.zeros(len(starts), bool)
    joined[1:] = (form[1:] == NAME) & (form[:-1] == NAME) & (stops[starts[1:]] == stops[ends[:-1] - 1])
    first = np.nonzero(~joined)[0]
    up, down = powers(len(own) + 1)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)], dtype=np.uint64)])
    last = np.append(first[1:], len(own))
    value = np.where(last - first > 1, mixed((summed[last] - summed[first]) * down[first]), own[first])
    slot = np.isin(form[first], np.array([NUMBER, UNIT, NAME]))
    out = own, np.cumsum(c == 10)[starts], form[first], value, first, slot
    if not signed:
        return out
    signs = np.nonzero(np.isin(c, SIGNS))[0]
    letter = lambda x: word[x] & ~digit[x]
    signs = signs[~((c[signs] == 45) & letter(c[signs - 1]) & letter(c[signs + 1]))]
    return *out, mixed(c[signs].astype(np.uint64) + SIGN), signs, starts[first]


ROW = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("folded", T.BooleanType()), T.StructField("slots", T.ArrayType(T.LongType()))]))
KIND = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("place", pa.int32()), ("width", pa.int32()), ("folded", pa.bool_()), ("slots", pa.list_(pa.int64()))]))


def templates(form: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows of width canonical words that have enough literal words."""
    if len(form) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    filled = np.concatenate([[0], np.cumsum(slot)])
    at = np.nonzero(filled[width:] - filled[:-width] <= (1 - LITERAL) * width)[0]
    return windows(form, width)[at] + np.uint64(width), at


def spelt(form: np.ndarray, value: np.ndarray, first: np.ndarray, slot: np.ndarray, sign: np.ndarray, sign_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Canonical words and signs in one order: form, value, number of the first word (of a sign, of the word after it), placeholder."""
    order = np.argsort(np.concatenate([at, sign_at]), kind="stable")
    after = np.minimum(np.searchsorted(at, sign_at), len(at) - 1) if len(at) else sign_at
    both = lambda a, b: np.concatenate([a, b])[order]
    return both(form, sign), both(value, np.zeros(len(sign), np.uint64)), both(first, first[after] if len(at) else after), both(slot, np.zeros(len(sign), bool))


def spelt_windows(form: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows with a placeholder and enough that are none."""
    if len(form) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    filled = np.concatenate([[0], np.cumsum(slot)])
    filled = filled[width:] - filled[:-width]
    at = np.nonzero((filled > 0) & (width - filled >= LEAST_SPELT))[0]
    return windows(form, width)[at] + SIGNED + np.uint64(width), at


def _item(texts):
    """Each item's rows: its templates, and its case-folded windows or, if it is short, the line that it is."""

    def one(text):
        own, _, form, value, first, slot, *signs = canonical(text or "", True)
        if not len(own):
            return []
        width = min(len(form), WIDTH)
        h, at = templates(form, slot, width)
        signed = not len(at)
        if signed:
            form, value, first, slot = spelt(form, value, first, slot, *signs)
            width = min(len(form), SPELT)
            h, at = spelt_windows(form, slot, width)
        rows = [{"hash": int(x), "at": int(a), "place": int(first[a]), "width": width + signed * APART, "folded": False, "slots": value[a : a + width][slot[a : a + width]].view(np.int64).tolist()} for x, a in zip(h.view(np.int64), at, strict=True)] if len(own) >= ALONE else []
        width = min(len(own), WIDTH)
        h = (windows(own, width) + (FOLDED if len(own) >= ALONE else LINE) + np.uint64(width)).view(np.int64)
        return rows + [{"hash": int(x), "at": a, "place": a, "width": width if len(own) >= ALONE else -width, "folded": True, "slots": []} for a, x in enumerate(h)]

    return [pa.array([one(t) for t in texts], KIND)]


def _cut(template_widths, folded_widths, spelt_widths, lines, bitmap):
    """Of each document: the windows and lines whose hashes are in the bitmap."""
    address = np.uint64(len(bitmap) * 8 - 1)

    def held(h):
        index = h & address
        return np.nonzero(bitmap[(index >> np.uint64(3)).astype(np.int64)] >> (index & np.uint64(7)).astype(np.uint8) & 1)[0]

    def one(text):
        own, line, form, value, first, slot, *signs = canonical(text or "", bool(spelt_widths))
        rows = []
        if spelt_widths:
            s_form, s_value, _, s_slot = spelt(form, value, first, slot, *signs)
            for width in spelt_widths:
                h, at = spelt_windows(s_form, s_slot, width)
                for k in held(h).tolist():
                    a = int(at[k])
                    rows.append({"hash": int(h[k : k + 1].view(np.int64)[0]), "at": a, "place": 0, "width": width, "folded": False, "slots": s_value[a : a + width][s_slot[a : a + width]].view(np.int64).tolist()})
        for width in template_widths:
            h, at = templates(form, slot, width)
            for k in held(h).tolist():
                a = int(at[k])
                rows.append({"hash": int(h[k : k + 1].view(np.int64)[0]), "at": a, "place": 0, "width": width, "folded": False, "slots": value[a : a + width][slot[a : a + width]].view(np.int64).tolist()})
        whole = []
        for width in folded_widths:
            h = windows(own, width) + FOLDED + np.uint64(width)
            whole.append(h[held(h)])
        if lines and len(own):
            begin = np.nonzero(np.diff(line, prepend=-1))[0]
            size = np.diff(np.append(begin, len(own)))
            for width in range(1, ALONE):
                if len(at := begin[size == width]):
                    h = windows(own, width)[at] + LINE + np.uint64(width)
                    whole.append(h[held(h)])
        if whole:
            rows += [{"hash": int(x), "at": 0, "place": 0, "width": 0, "folded": True, "slots": []} for x in np.unique(np.concatenate(whole)).view(np.int64)]
        return rows

    return lambda texts: [pa.array([one(t) for t in texts], KIND)]


def told(benchmark: DataFrame, *, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, by_words, by_template): how each item can be found: by_words `anywhere`, `whole line` (fewer than ALONE
    words) or null (no word); by_template `words`, `words and signs` or null (too few that are no placeholders)."""
    rows = append_columns(benchmark.select(F.col(item_col).alias(item_col), F.col(item_text).alias("_text")), "_text", [("rows", ROW)], lambda: _item, keep_text=False)
    any_ = lambda f: F.exists("rows", f)
    by_words = F.when(any_(lambda x: x["folded"] & (x["width"] > 0)), "anywhere").when(any_(lambda x: x["folded"]), "whole line")
    by_template = F.when(any_(lambda x: ~x["folded"] & (x["width"] < APART)), "words").when(any_(lambda x: ~x["folded"]), "words and signs")
    return rows.select(item_col, by_words.alias("by_words"), by_template.alias("by_template"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id_col, item_col, matched, windows, coverage, reparameterised): a row for each document that holds at least the
    share coverage of an item's windows; reparameterised where a placeholder's value differs. A place of the item is
    matched by its template in a consistent alignment or by its case-folded words; coverage is the share of all places
    matched by either or, where that is larger, the share of the templates, and matched and windows are of that share.

    Null and empty texts and items match nothing, nor do items without a letter or digit. Texts are read whole, however
    long. Of rows that share an id, a null one too, each is looked at by itself and the best counts; repeated items count
    each. Empty tables give an empty result; further columns aren't read.
    """
    items = append_columns(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), "text", [("rows", ROW)], lambda: _item, keep_text=False)
    items = items.withColumn("copy", F.monotonically_increasing_id())
    count = lambda folded: F.size(F.filter("rows", lambda x: x["folded"] == folded))
    items = staged(items.select("copy", "item", count(True).alias("places"), count(False).alias("templates"), F.inline("rows")), "items")
    shared = items.groupBy("hash").agg(F.count_distinct("copy").alias("shared"))
    ranked = items.join(shared, "hash").withColumn("hard", F.max("shared").over(Window.partitionBy("copy", "place")))
    ranked = ranked.withColumn("rank", F.dense_rank().over(Window.partitionBy("copy").orderBy("hard", "place"))).withColumn("own", F.row_number().over(Window.partitionBy("copy", "folded").orderBy("shared", "place")))
    spare = lambda n: F.col(n) - F.ceil(F.lit(coverage) * F.col(n)) + 1
    probes = (F.col("rank") <= spare("places")) | (~F.col("folded") & (F.col("own") <= spare("templates")))
    known = staged(ranked.select("copy", "item", "places", "templates", "hash", "at", "place", "width", "folded", "slots", probes.alias("probe")), "benchmark")
    discard(items)
    # at most 2 ** (BITS[1] - 15) bitmaps of 4 KB, however large the benchmark is
    bits = min(BITS[1], max(BITS[0], known.count().bit_length() + 4))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    place = F.pmod(F.col("hash"), F.lit(1 << bits))
    for r in known.select(F.expr(f"int(pmod(hash, {1 << bits}L) div 32768)").alias("part"), (place % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bitmap[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    kinds = known.select("width", "folded").distinct().collect()  # those that occur of -2 to WIDTH, and to SPELT
    widths = [sorted(r["width"] for r in kinds if r["folded"] == folded and 0 < r["width"] < APART) for folded in (False, True)]
    widths.append(sorted(r["width"] - APART for r in kinds if r["width"] >= APART))
    found = append_columns(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", [("rows", ROW)], _cut, *widths, any(r["width"] < 0 for r in kinds), bitmap, keep_text=False)
    found = found.where(F.size("rows") > 0).withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.inline("rows"))
    found = staged(found.select("id", "row", "hash", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots")), "windows")
    near = found.select("row", "hash").join(known.where("probe").select("hash", "copy"), "hash").select("row", "copy").distinct()
    both = found.join(near, "row").join(known, ["copy", "hash"]).withColumn("pairs", F.arrays_zip("slots", "doc_slots"))
    diagonal = F.when(~F.col("folded"), F.col("doc_at") - F.col("at")).alias("diagonal")
    lines = both.groupBy("id", "row", "copy", "item", "places", "templates", "folded", diagonal).agg(F.collect_set("place").alias("found"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.bool_or(F.col("width") >= APART).alias("spelt"))
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    one, other = distinct("slots") == F.size("pairs"), distinct("doc_slots") == F.size("pairs")
    lines = lines.where(one & other | F.col("spelt") & (one | other))
    changed = F.exists("pairs", lambda p: p["slots"] != p["doc_slots"])
    union = lambda found: F.size(F.array_distinct(F.flatten(F.collect_list(found))))
    whole = lines.groupBy("id", "row", "copy", "item", "places", "templates").agg(union("found").alias("either"), union(F.when(~F.col("folded"), F.col("found"))).alias("template"), F.max(changed).alias("reparameterised"))
    by_template = F.col("template") * F.col("places") > F.col("either") * F.col("templates")
    whole = whole.withColumn("matched", F.when(by_template, F.col("template")).otherwise(F.col("either")).cast("long")).withColumn("windows", F.when(by_template, F.col("templates")).otherwise(F.col("places")).cast("long"))
    whole = whole.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage)
    best = whole.groupBy("id", "item").agg(F.max(F.struct("coverage", "matched", "windows", "reparameterised")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.matched", "x.windows", "x.coverage", "x.reparameterised")

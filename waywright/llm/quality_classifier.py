"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram of a word (with a boundary mark at its ends) and every pair of neighbouring words is
hashed to a row of an embedding table; a document is the mean of its rows; a linear layer with softmax gives the
classes. Table and layer are trained by stochastic gradient descent in numpy. The two hashes of a word pair are combined
by exclusive or, so that all immediate repetitions share a row.

Scoring uses that the layer is linear: table x layer is computed once, and a text is the mean of single numbers. Rows
are hashed with numpy over a text's code points at once, so memory is bounded by one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm.common import append_columns, held_out, share

BITS = 17
BUCKETS = 1 << BITS
PAIRS = 1 << 14
MIX, STEP = np.uint32(2654435761), 2246822519
_powers = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


@dataclass
class Model:
    logits: np.ndarray  # rows x classes: table x layer
    bias: np.ndarray


def powers(n: int) -> list[np.ndarray]:
    """STEP ** i and STEP ** -i modulo 2 ** 32 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((STEP, pow(STEP, -1, 1 << 32))):
            out = np.full(size, base, np.uint32)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out, dtype=np.uint32)
    return _powers


def rows_of(text: str) -> np.ndarray:
    """Rows of all words, character 3- and 4-grams and neighbouring pairs, each as often as it comes.

    Words are parted by the six ASCII white-space characters; a text without a word has no rows.
    """
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    if space.all():
        return np.zeros(0, np.int64)
    c = np.where(space, np.uint32(32), c)
    inner = ~space
    starts = np.nonzero(inner[1:] & space[:-1])[0] + 1
    ends = np.nonzero(inner[:-1] & space[1:])[0] + 1
    up, down = powers(len(c))
    summed = np.cumsum(c * up[: len(c)], dtype=np.uint32)
    words = (summed[ends - 1] - summed[starts - 1]) * down[starts]
    words ^= words >> np.uint32(15)
    words *= MIX
    three = (c[:-2] * np.uint32(40503) + c[1:-1] * np.uint32(2971215073) + c[2:] * np.uint32(433494437))[inner[1:-1]]
    out = [words >> np.uint32(32 - BITS), (three * MIX) >> np.uint32(32 - BITS)]
    if len(c) > 3:
        four = (c[:-3] * np.uint32(1640531527) + c[1:-2] * np.uint32(97787) + c[2:-1] * np.uint32(3266489917) + c[3:] * np.uint32(668265263))[inner[1:-2] & inner[2:-1]]
        out.append((four * MIX) >> np.uint32(32 - BITS))
    out.append(np.uint32(BUCKETS) + ((words[1:] ^ words[:-1]) >> np.uint32(18)))
    return np.concatenate(out).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text and how often each comes."""
    return np.unique(rows_of(text), return_counts=True)


def fit(rows: list[tuple[str, int]], *, dim: int = 8, epochs: int = 6, rate: float = 0.5, classes: int = 2, seed: int = 1) -> Model | None:
    """rows: (text, class). None if not every class occurs."""
    if len({c for _, c in rows}) < classes:
        return None
    bags = []
    for text, c in rows:
        found, times = bag(text)
        if len(found):
            bags.append((found.astype(np.int32), (times / times.sum()).astype(np.float32), c))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + PAIRS, dim)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    steps, done = epochs * max(1, len(bags)), 0
    scale = 20.0  # means over many rows are small
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            found, share, c = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ table[found] * scale
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[c] -= 1
            back = layer @ p
            layer -= lr * 0.1 * np.outer(mean, p).astype(np.float32)
            bias -= np.float32(lr * 0.02) * p
            table[found] -= lr * scale * share[:, None] * back
    return Model((table @ layer * scale).astype(np.float32), bias)


def scorer(model: Model | None):
    """Softmax probability of class 1; 0.5 without a model; a text without words gets what the bias says."""
    if model is None:
        return lambda texts: [[0.5] * len(texts), [1] * len(texts)]
    gain = (model.logits[:, 1] - model.logits[:, 0]).astype(np.float64)
    base = float(model.bias[1] - model.bias[0])

    def one(text: str | None) -> float:
        rows = rows_of(text) if text else ()
        z = base + (float(gain[rows].mean()) if len(rows) else 0.0)
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

    def work(texts):
        scores = [one(t) for t in texts]
        return [scores, [int(s >= 0.5) for s in scores]]

    return work


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 1500, **options) -> Model | None:
    """Fit on at most max_rows rows of each class, those with the least hash of their id, never held-out ones. About 5 / 4
    as many ids are drawn and their rows collected; ids name a document each."""
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col), F.col(label).cast("int").alias("_class")).groupBy(id_col).agg(F.max("_class").alias("_class"))
    counts = {r["_class"]: r["n"] for r in known.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1)
    most = F.lit(-1).cast("long")
    for c, n in sorted(counts.items()):
        most = F.when(F.col("_class") == c, F.lit(share(max_rows, n)).cast("long")).otherwise(most)
    # the drawn ids are about 5 / 4 x max_rows of each class, whatever the table's size: few enough to broadcast
    drawn = known.where(draw <= most)
    rows: dict[int, list] = {}
    for r in docs.where(F.col(text).isNotNull()).select(id_col, text).join(F.broadcast(drawn), id_col).select(draw.alias("d"), id_col, text, "_class").collect():
        rows.setdefault(r["_class"], []).append((r["d"], r[id_col], r[text]))
    picked = [(t, c) for c in sorted(rows) for _, _, t in sorted(rows[c])[:max_rows]]
    return fit(picked, **options)


def score(docs: DataFrame, model: Model | None, *, text: str = "text", keep_text: bool = True, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= 0.5), or columns of other names.

    Null, empty and all-space texts get the score of the bias alone; without a model (a class has no labelled row) every
    row gets 0.5 and 1. Repeated rows get equal results; an input column with one of the names gives way. Texts are
    read whole, however long.
    """
    return append_columns(docs, text, [(names[0], T.DoubleType()), (names[1], T.IntegerType())], scorer, model, keep_text=keep_text)

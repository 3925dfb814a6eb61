"""Language ID by a string kernel.

A text's features are the distinct byte n-grams (n = 1, 2, 3) of its lower-cased UTF-8 form: the blended spectrum,
presence only. The kernel of two texts is the number of n-grams they share over the geometric mean of their numbers.
A bounded set of training texts serves as Nystroem landmarks; the spectrum is taken over the n-grams that occur in the
landmarks. One-versus-rest ridge regression on the Nystroem features gives a matrix, so that scoring a batch is two
matrix products: presence x landmarks, then kernel x weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waywright.llm.common import append_columns, held_out, share

LETTER = regex.compile(r"\p{L}")  # numerals such as a half aren't letters
ROWS = 128


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted n-gram codes
    landmarks: np.ndarray  # n-grams x landmarks, presence over root of count
    weights: np.ndarray  # landmarks x languages


def codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of all 1-, 2- and 3-grams; a leading 1 keeps the lengths apart."""
    x = data.astype(np.int32)
    one = x + (1 << 8)
    two = (x[:-1] << 8 | x[1:]) + (1 << 16)
    three = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) + (1 << 24)
    return [one, two, three]


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def presence(texts: list[str], table: np.ndarray, width: int) -> np.ndarray:
    """A row of 0 and 1 for each text. table: the column of each n-gram code, width for those outside the spectrum.
    A text is read whole, however long; only its distinct n-grams matter."""
    out = np.zeros((len(texts), width + 1), np.float32)
    for row, text in zip(out, texts, strict=True):
        for c in codes(raw(text)):
            row[table[c]] = 1
    return out[:, :width]


def lookup(vocabulary: np.ndarray) -> np.ndarray:
    kind = np.min_scalar_type(len(vocabulary))
    table = np.full(2 << 24, len(vocabulary), kind)
    table[vocabulary] = np.arange(len(vocabulary), dtype=kind)
    return table


def fit(rows: list[tuple[str, str]], landmarks_per_language: int = 32, ridge: float = 1e-2) -> Model | None:
    """rows: (text, language). None if there is nothing to learn from. The spectrum is all n-grams of the landmarks."""
    rows = [(t, l) for t, l in rows if t and LETTER.search(t)]
    languages = sorted({l for _, l in rows})
    if not languages:
        return None
    chosen = []
    for language in languages:
        own = sorted((t for t, l in rows if l == language), key=lambda t: abs(len(t) - 600))
        chosen += own[:landmarks_per_language]
    found = np.unique(np.concatenate([np.unique(np.concatenate(codes(raw(t)))) for t in chosen]))
    table = lookup(found)

    def unit(texts):
        p = presence(texts, table, len(found))
        return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    marks = unit(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    useful = values > 1e-6 * values[-1]
    root = vectors[:, useful] / np.sqrt(values[useful])
    texts, truth = [t for t, _ in rows], np.array([languages.index(l) for _, l in rows])
    phi = np.concatenate([unit(texts[i : i + ROWS]) @ marks.T for i in range(0, len(texts), ROWS)]).astype(np.float64) @ root
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(truth, minlength=len(languages))[truth]  # languages count alike
    weight = (weight / weight.mean())[:, None]
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(phi) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (weight * target))
    return Model(languages, found, np.ascontiguousarray(marks.T), (root @ solved).astype(np.float32))


def scorer(model: Model | None):
    table = None if model is None else lookup(model.vocabulary)

    def work(texts):
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        at = [] if model is None else [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for i in range(0, len(at), ROWS):
            part = at[i : i + ROWS]
            p = presence([texts[k] for k in part], table, len(model.vocabulary))
            kernel = p @ model.landmarks / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
            s = (kernel @ model.weights).astype(np.float64)
            best = s.argmax(1)
            for k, b, v in zip(part, best, s[np.arange(len(part)), best], strict=True):
                langs[k] = model.languages[b]
                scores[k] = min(1.0, max(0.0, (v + 1) / 2))
        return [langs, scores.tolist()]

    return work


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 400, **options) -> Model | None:
    """Fit on at most max_rows rows of each language, those with the least hash of id and text, never held-out ones. About
    5 / 4 as many are drawn and collected, however large the table is."""
    seen = docs.where(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(id_col, text, lang)
    counts = {r[lang]: r["n"] for r in seen.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text)), 1)
    most = F.lit(-1).cast("long")
    for language, n in sorted(counts.items()):
        most = F.when(F.col(lang) == language, F.lit(share(max_rows, n)).cast("long")).otherwise(most)
    rows: dict[str, list] = {}
    for r in seen.where(draw <= most).select(draw.alias("d"), id_col, text, lang).collect():
        rows.setdefault(r[lang], []).append((r["d"], r[id_col], r[text]))
    return fit([(t, language) for language in sorted(rows) for _, _, t in sorted(rows[language], key=lambda x: (x[0], str(x[1]), x[2]))[:max_rows]], **options)


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (0 to 1), or columns of other names.

    Null texts and texts without a letter (empty ones too): `und`, score 0. Without a model (no labelled row): the same
    for every row. Repeated rows get equal results; an input column with one of the names gives way to the new one.
    """
    return append_columns(docs, text, [(names[0], T.StringType()), (names[1], T.DoubleType())], scorer, model, keep_text=keep_text)

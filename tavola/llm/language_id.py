"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (by
elementwise product) its letters' vectors, each permuted (rotated) once per
place; a text's vector bundles (adds) the vectors of its n-grams, and so does
a language's prototype over its training texts.  A text gets the language
whose prototype has the largest cosine with the text's vector.

Letters' vectors come from a keyed generator on the code point, so they agree
on all workers.  Bundling is linear: training adds up n-gram counts per
partition, bundles them there and sums the partial prototypes on Spark; only
the prototypes (languages x dimensions) reach the driver.

Defined results: ``und`` with score 0 for a null text, a text without a
letter, or when nothing was learned; ties go to the first language by name;
null ids are not held out and are not learned from; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
ORDER = 3
FOLDS = 5
SEED = 7_919
UNKNOWN = "und"
# Texts encoded at a time: (texts x n-grams) counts meet the n-gram vectors in one product.
TEXTS_AT_ONCE = 16
# Characters of a text whose n-grams are counted at a time.
BLOCK_CHARS = 1 << 20
# N-gram vectors kept by a worker (int8); the store starts anew beyond.
STORED_GRAMS = 60_000

NO_LETTERS = re.compile(r"[\W\d_]+")
PLACE = np.uint64(1 << 21)  # above every code point


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


class Grams:
    """n-gram keys -> rows of a growing matrix of bound vectors."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.order = np.empty(0, np.int64)
        self.matrix = np.empty((0, DIMENSIONS), np.int8)

    def _bind(self, key: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for place in range(ORDER):
            key, code = divmod(key, int(PLACE))
            if code not in self.letters:
                self.letters[code] = letter_vector(code)
            out = out * np.roll(self.letters[code], place)
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Bound vectors of sorted distinct keys."""
        if len(self.keys) + len(keys) > max(STORED_GRAMS, 2 * len(keys)):
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = keys[~known]
        if len(new):
            self.matrix = np.concatenate([self.matrix, np.stack([self._bind(int(k)) for k in new])])
            self.order = np.concatenate([self.order, np.arange(len(self.matrix) - len(new), len(self.matrix))])
            merged = np.concatenate([self.keys, new])
            by = np.argsort(merged, kind="stable")
            self.keys, self.order = merged[by], self.order[by]
            at = np.searchsorted(self.keys, keys)
        return self.matrix[self.order[at]]


_GRAMS = Grams()


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram keys, counts) of the whole text: letters in lower case, words set off by one space."""
    words = NO_LETTERS.sub(" ", text or "").strip().lower()
    if not any(map(str.isalpha, words)):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = []
    for i in range(0, max(1, len(codes) - ORDER + 1), BLOCK_CHARS):
        c = codes[i : i + BLOCK_CHARS + ORDER - 1]
        n = max(0, len(c) - ORDER + 1)
        key = np.zeros(n, np.uint64)
        for place in range(ORDER):
            key = key * PLACE + c[ORDER - 1 - place : ORDER - 1 - place + n]
        parts.append(np.unique(key, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _merge_counts(parts)


def _merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def bundle(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One bundled vector per text (float32)."""
    keys, at = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
    counts = np.zeros((len(texts), len(keys)), np.float32)
    row = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
    counts[row, at] = np.concatenate([n for _, n in texts])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i in range(0, len(keys), STORED_GRAMS // 8):
        part = slice(i, i + STORED_GRAMS // 8)
        out += counts[:, part] @ _GRAMS.rows(keys[part]).astype(np.float32)
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def prototypes(train: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Unit prototype per language, bundled over every n-gram of its texts."""

    def run(frames):
        held: dict[str, list] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                parts = held.setdefault(lang, [])
                parts.append(gram_counts(text))
                if len(parts) > 64:
                    held[lang] = [_merge_counts(parts)]
        for lang, parts in held.items():
            vector = _bundle_exact(_merge_counts(parts))
            yield pd.DataFrame({"lang": lang, "place": np.arange(DIMENSIONS), "value": vector})

    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    partial = rows.filter("lang is not null and text is not null").mapInPandas(run, "lang string, place int, value bigint")
    total = partial.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    model = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    out = {r.lang: np.array([x.value for x in r.v], np.float64) for r in model}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in out.items() if v.any()}


def _bundle_exact(counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, n = counts
    out = np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(keys), 4096):
        out += n[i : i + 4096] @ _GRAMS.rows(keys[i : i + 4096]).astype(np.int64)
    return out


def predict(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (cosine with the prototype, 0 at least)."""
    names = sorted(model)
    matrix = np.stack([model[n] for n in names]) if names else np.empty((0, DIMENSIONS), np.float32)

    def run(frames):
        for frame in frames:
            langs, scores = [], []
            for i in range(0, len(frame), TEXTS_AT_ONCE):
                counts = [gram_counts(t) for t in frame["text"].iloc[i : i + TEXTS_AT_ONCE]]
                some = [c for c in counts if len(c[0])]
                if not some or not names:
                    langs += [UNKNOWN] * len(counts)
                    scores += [0.0] * len(counts)
                    continue
                vectors = bundle(some)
                cosines = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                best = iter(zip(cosines.argmax(axis=1), cosines.max(axis=1)))
                for c in counts:
                    at, cosine = next(best) if len(c[0]) else (None, 0.0)
                    langs.append(UNKNOWN if at is None else names[at])
                    scores.append(float(min(1.0, max(0.0, cosine))))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the labelled rows that are not held out."""
    train = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = prototypes(train, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Quality rules: counts of a text, and a line labeller that decides retention.

A linear-chain conditional random field labels every line with a word as
content or boilerplate from its surface (length, symbols, capitals, digits,
repetition, ending).  Viterbi decoding gives the best label sequence; a
document stays if content lines hold at least half of its words.

The field is trained by gradient ascent on the exact log-likelihood over a
bounded sample of labelled documents, one whole text per labelled id: the lines
of a document of quality 1 count as content, those of quality 0 as boilerplate.
Documents of both kinds are joined to sequences that change their label, in
either order, so that the field learns what a change looks like and labels
lines, not documents.

Defined results: a null text has no words, fails the base rule and is not
kept, like an empty text; null and repeated ids are ordinary rows; of rows that
repeat a labelled id the least text by its hash is trained on, of labels the
least; without
labelled documents of both kinds every line counts as content; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
# Bound of the training sample: documents per class.
SAMPLE_DOCS = 400
STEPS = 150
RATE = 0.1
DECAY = 1e-3

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
FEATURES = ("bias", "length", "symbols", "capitals", "letters", "digits", "marks", "word_length", "distinct", "repeated", "sentence", "first")


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def content_lines(data: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    """Lines with a word, and their words."""
    lines = data.split(b"\n")
    words = [x.split() for x in lines]  # on bytes: ASCII white space only
    return [x for x, w in zip(lines, words) if w], [w for w in words if w]


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    seen: set[bytes] = set()
    out = np.empty((len(lines), len(FEATURES)), np.float32)
    for i, (line, own) in enumerate(zip(lines, words)):
        size = sum(map(len, own))
        letters = _count(line, LETTERS)
        distinct = len(set(own))
        out[i] = (
            1.0,
            min(np.log1p(len(own)) / 5, 2.0),
            10 * min(_count(line, SYMBOLS) / size, 0.2),
            2 * _count(line, UPPER) / max(letters, 1),
            letters / size,
            2 * _count(line, DIGITS) / size,
            10 * min(_count(line, b"!?;=_/\\{}[]@") / size, 0.2),
            min(size / len(own), 20) / 10,
            min(distinct / len(own) ** 0.85, 1.5),
            line in seen,
            own[-1][-1:] in b".!?:\"",
            i == 0,
        )
        seen.add(line)
    return out


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by a window of ``size`` words that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    at: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        first = at.setdefault(w, i)
        if first != i:
            covered[i : i + size] = b"\1" * size
            covered[first : first + size] = b"\1" * size
    return sum(covered)


class Field:
    """Two-label linear-chain conditional random field: label 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the best label of every line."""
        scores = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            x0, y0, x1, y1 = a + m00, b + m10, a + m01, b + m11
            back.append((y0 > x0, y1 > x1))
            a, b = max(x0, y0) + s0, max(x1, y1) + s1
        labels = [int(b >= a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return np.array(labels[::-1])

    @classmethod
    def train(cls, sequences: list[np.ndarray], labels: list) -> Field:
        """Gradient ascent on the mean log-likelihood per line (Adam), all sequences at once.

        A sequence's label is a number, or an array of one per line.  Lines are
        held without padding, the lines of one place of all sequences next to
        each other, longest sequences first.
        """
        by_length = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in by_length])
        size, total = int(lengths[0]), int(lengths.sum())
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(size), side="right")  # sequences that have this place
        start = np.concatenate([[0], np.cumsum(active)])
        x, of, y = np.empty((total, len(FEATURES))), np.empty(total, np.int64), np.empty(total, np.int64)
        for r, i in enumerate(by_length):
            at = start[: lengths[r]] + r
            x[at], of[at], y[at] = sequences[i], r, labels[i]
        gold = np.stack([1 - y, y], 1)
        last = start[lengths - 1] + np.arange(len(lengths))
        rest = slice(active[0], total)
        before = np.concatenate([np.arange(start[t - 1], start[t - 1] + active[t]) for t in range(1, size)] or [np.empty(0, np.int64)])
        gold_moves = np.array([[((y[before] == a) & (y[rest] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        w, m = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
        places = [(slice(start[t - 1], start[t - 1] + active[t]), slice(start[t], start[t + 1])) for t in range(1, size)]
        for step in range(1, STEPS + 1):
            e = x @ w
            forward, backward = e.copy(), np.zeros_like(e)
            for old, new in places:
                f = forward[old]
                forward[new] += np.logaddexp(f[:, :1] + m[0], f[:, 1:] + m[1])
            for old, new in reversed(places):
                ahead = backward[new] + e[new]
                backward[old] = np.logaddexp(ahead[:, :1] + m[:, 0], ahead[:, 1:] + m[:, 1])
            log_z = np.logaddexp(forward[last, 0], forward[last, 1])[of, None]
            node = np.exp(np.minimum(forward + backward - log_z, 0))
            edge = forward[before][:, :, None] + m + (e + backward)[rest][:, None, :] - log_z[rest][..., None]
            edge = np.exp(np.minimum(edge, 0))
            grad_w = x.T @ (gold - node) / total - DECAY * w
            grad_m = (gold_moves - edge.sum(0)) / total - DECAY * m
            for p, g, k in ((w, grad_w, 0), (m, grad_m, 2)):
                state[k] = 0.9 * state[k] + 0.1 * g
                state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
                p += RATE * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
        return cls(w, m)


ALL_CONTENT = Field(np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (len(FEATURES) - 1)), np.zeros((2, 2)))  # the bias alone decides


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """The field fitted on at most ``sample`` documents of each quality, the first by a hash of the id."""
    known = labels.select(F.col(id_col).alias("doc_id"), "quality").filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    picks = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))

    def run(frames):
        for frame in frames:
            kept = []
            for quality, data in zip(frame["quality"], frame["data"]):
                x = line_features(*content_lines(bytes(data)))
                if len(x):
                    kept.append((int(quality), x.astype(np.float32).tobytes()))
            yield pd.DataFrame(kept, columns=["quality", "features"])

    one = rows.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("data").alias("hash"), "data", "quality")).alias("row"))
    found = one.select("row.quality", "row.data").mapInPandas(run, "quality int, features binary").collect()  # at most 2 * sample
    found.sort()
    kinds = [[np.frombuffer(r.features, np.float32).reshape(-1, len(FEATURES)) for r in found if r.quality == q] for q in (0, 1)]
    if not all(kinds):
        return ALL_CONTENT
    return Field.train(*joined(*kinds))


def joined(junk: list[np.ndarray], content: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(sequences, their labels): documents of both kinds in pairs, every one at least once, in turn with either kind first."""
    sequences, labels = [], []
    for i in range(max(len(junk), len(content))):
        pair = [(junk[i % len(junk)], 0), (content[i % len(content)], 1)][:: 1 - 2 * (i % 2)]
        later = pair[1][0].copy()
        later[0, FEATURES.index("first")] = 0
        sequences.append(np.concatenate([pair[0][0], later]))
        labels.append(np.concatenate([np.full(len(x), label) for x, label in pair]))
    return sequences, labels


def judge(text: bytes, field: Field) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    lines, per_line = content_lines(text)
    words = [w for own in per_line for w in own]
    n = len(words)
    chars = len(text.translate(None, SPACES).decode("utf-8", "replace"))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    share = 0.0
    if n:
        labels = field.decode(line_features(lines, per_line))
        share = sum(len(own) for own, label in zip(per_line, labels) if label) / n
    return n, chars, _count(text, SYMBOLS), len(lines) - len(set(lines)), repeats, failed, not failed and share >= MIN_CONTENT_SHARE, share


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ", ".join(f"{n} bigint" for n in COUNTS) + ", base_failed boolean, kept boolean, content_share double"


def verdict(text: Column, field: Field) -> Column:
    """The counts and the verdict of a text, as a struct."""

    @F.pandas_udf(VERDICT)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x, field) for x in data], columns=[*COUNTS, "base_failed", "kept", "content_share"])

    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, content_share.  No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text_col), field).alias("_v")).select("doc_id", "_v.*")


def keep_content(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The input's rows and columns that the verdict keeps."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.withColumn("verdict", verdict(F.col("row")[text_col], field)).filter("verdict.kept").select("row.*")

"""Pack token sequences of fixed length by vector bin packing.

Every example asks for three things at once: tokens, one segment, and
loss-bearing tokens; a sequence holds a limited amount of each.  Bins are
filled one after the other from a window of waiting examples: of those that fit
the room left, the one goes in whose demand has the greatest dot product with
that room, every dimension weighed by its mean demand.  When none fits whole,
the longest is cut to what fits.  A sequence that is still not full (too many
segments, too many loss tokens, or the end of the input) is taken back to the
largest power of two, a length that needs no padding; what was taken off waits
on.  Examples longer than a bin are cut on arrival.

Each task packs the rows it reads as a stream: no shuffle, no key, and memory
for one window and one example.  A sequence id is the task's number and a
counter, so a task that is run again gives the same rows; a different division
of the input into tasks gives other sequences.

Defined results: a null or empty text has the closing id alone, a null or empty
array of ids gives no piece; null ids of rows and rows repeating an id are
examples of their own; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 512
CACHED_WORDS = 1 << 20
LONGEST_CACHED = 64
SIGNS = tuple(".,;:!?")
# Small letters of ASCII and Latin-1.
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")
# Byte-level vocabularies name bytes without a printable Latin-1 character by numbers from 256 on.
BYTE_NAMES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
BATCH_ROWS = 8192
BATCH_TOKENS = 1 << 20
TASK_SHIFT = 36


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


class Example:
    """What is left of one row's ids, from ``start`` on; ``cost[i]`` = loss tokens among the first i ids."""

    __slots__ = ("key", "ids", "cost", "start")

    def __init__(self, key, ids: np.ndarray, cost: np.ndarray):
        self.key, self.ids, self.cost, self.start = key, ids, cost, 0

    def fitting(self, at: int, tokens: int, loss: int) -> int:
        """The most ids from ``at`` on that stay within both limits."""
        end = int(np.searchsorted(self.cost, self.cost[at] + loss, side="right")) - 1
        return min(len(self.ids) - at, tokens, end - at)


class Packer:
    """Fills sequences from a window of waiting pieces; a piece is (example, start, length)."""

    def __init__(self, limits: Limits, window: int = WINDOW):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.window = limits, window
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.pieces: list[tuple[Example, int, int]] = []
        self.demand = np.zeros((2 * window, 3), np.int64)

    def wait(self, example: Example, start: int, length: int) -> None:
        n = len(self.pieces)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[n] = (length, 1, example.cost[start + length] - example.cost[start])
        self.pieces.append((example, start, length))

    def add(self, example: Example) -> Iterator[list[tuple[Example, int, int]]]:
        """Let an example wait, cut to what a bin takes; yields the sequences that this fills."""
        at = 0
        while at < len(example.ids):
            length = example.fitting(at, self.limits.tokens, self.limits.loss)
            if length == self.limits.tokens:
                yield [(example, at, length)]
            else:
                self.wait(example, at, length)
            at += length
            while len(self.pieces) >= self.window:
                yield self.fill()

    def rest(self) -> Iterator[list[tuple[Example, int, int]]]:
        while self.pieces:
            yield self.fill()

    def fill(self) -> list[tuple[Example, int, int]]:
        """One sequence; at least one piece waits."""
        n, cap = len(self.pieces), self.cap
        demand = self.demand[:n]
        weight = demand.mean(0) / cap / cap / cap
        left, waits, chosen = cap.copy(), np.ones(n, bool), []
        while left[0] and left[1]:
            fits = waits & (demand <= left).all(1)
            i = int(np.argmax(np.where(fits, demand @ (weight * left), -1.0)))
            if not fits[i]:
                break
            chosen.append(i)
            waits[i] = False
            left -= demand[i]
        sequence = [self.pieces[i] for i in chosen]
        back = []
        if left[0] and left[1] and waits.any():
            i = int(np.argmax(np.where(waits, demand[:, 0], -1)))
            example, start, length = self.pieces[i]
            part = example.fitting(start, min(int(left[0]), length), int(left[2]))
            if part:
                waits[i] = False
                sequence.append((example, start, part))
                back.append((example, start + part, length - part))
        used = sum(length for _, _, length in sequence)
        if used < cap[0]:
            surplus = used - (1 << (used.bit_length() - 1))
            while surplus:
                example, start, length = sequence.pop()
                off = min(surplus, length)
                if off < length:
                    sequence.append((example, start, length - off))
                back.append((example, start + length - off, off))
                surplus -= off
        stay = np.flatnonzero(waits)
        self.demand[: len(stay)] = demand[stay]
        self.pieces = [self.pieces[i] for i in stay]
        for piece in back:
            self.wait(*piece)
        return sequence


class WordTokenizer(dict):
    """Ids of whole texts by a ``tokenizers`` file that splits at white space and lower-cases.

    Such a tokenizer merges nothing over ASCII white space, so every stretch
    between it is encoded by the library once and remembered here (stretch ->
    little-endian unsigned 32-bit ids); the memory for this is bounded.  Words of
    small letters, which normalising leaves as they are, go straight to the
    library's merges.  Equality with the library on whole texts is tested.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if PLAIN_WORD.fullmatch(word):
            name = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_NAMES)
            out = array("I", [t.id for t in self.merges(name)]).tobytes()
        elif word[-1:] in SIGNS and PLAIN_WORD.fullmatch(word, 0, len(word) - 1):
            out = self[word[:-1]] + self[word[-1:]]
        else:
            out = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        for space in "\n\t\r\v\f":
            if space in text:
                text = text.replace(space, " ")
        if "<|" not in text:  # names of special tokens keep their case
            try:
                text = text.encode("latin-1").decode("latin-1").lower()
            except UnicodeEncodeError:  # beyond Latin-1 only A-Z, the rest is left to the library
                text = text.encode().lower().decode()
        return b"".join(map(self.__getitem__, text.split(" ")))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a file; one that Spark distributed is found by its name."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _TOKENIZERS[path]


def _packed(examples: Iterable[Example], limits: Limits, keep_ids: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    packer, sequence = Packer(limits), (TaskContext.get().partitionId() << TASK_SHIFT) - 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", *(["ids"] if keep_ids else [])]
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:8]]]
        if keep_ids:
            arrays.append(pa.array(columns[8], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names)

    def sequences() -> Iterator[list]:
        for example in examples:
            yield from packer.add(example)
        yield from packer.rest()

    for pieces in sequences():
        sequence, offset = sequence + 1, 0
        for example, start, length in pieces:
            ids = example.ids[start : start + length]
            loss = int(example.cost[start + length] - example.cost[start])
            row = (example.key, start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(example.ids), sequence, offset, loss)
            rows.append((*row, ids.tolist()) if keep_ids else row)
            offset += length
        held += offset
        if len(rows) >= BATCH_ROWS or keep_ids and held >= BATCH_TOKENS:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _pack(rows: DataFrame, example_of: Callable, limits: Limits, keep_ids: bool) -> DataFrame:
    """``example_of`` turns a batch into examples; it runs in the tasks."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = rows.schema["doc_id"].dataType
    kind = to_arrow_type(key)

    def run(batches):
        yield from _packed((e for b in batches for e in example_of(b)), limits, keep_ids, kind)

    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return rows.mapInArrow(run, f"doc_id {key.simpleString()}, {columns}" + (", ids array<long>" if keep_ids else ""))


def pack_documents(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", close: int | None = 2, limits: Limits = Limits(), keep_ids: bool = False
) -> DataFrame:
    """Tokenise and pack texts: one row per piece.

    A text's ids are the library's, without special tokens, and then ``close``.
    All but a document's first id bear loss, as nothing stands before the first.
    Columns: doc_id, start and length (of the piece in its document's ids),
    ids_crc32 (of the piece as little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset, loss_tokens, and the ids if asked for.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = b"" if close is None else np.array([close], "<u4").tobytes()

    def examples(batch: pa.RecordBatch) -> Iterator[Example]:
        own = tokenizer(tokenizer_file)
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(own.encode(text.as_py()) + end, "<u4")
            yield Example(key, ids, np.maximum(np.arange(-1, len(ids)), 0))

    return _pack(rows, examples, limits, keep_ids)


def pack_examples(df: DataFrame, id_col: str = "id", ids_col: str = "ids", loss_col: str | None = None, limits: Limits = Limits(), keep_ids: bool = True) -> DataFrame:
    """Pack rows that hold their ids, such as tokenised instructions with answers.

    ``loss_col`` is an array beside the ids, true where a token bears loss
    (null: not; a shorter array: not beyond its end); without it all do.
    Columns as in :func:`pack_documents`.
    """
    loss = F.col(loss_col).cast("array<boolean>") if loss_col else F.lit(None).cast("array<boolean>")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"), loss.alias("loss"))

    def examples(batch: pa.RecordBatch) -> Iterator[Example]:
        for key, ids, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            ids = np.array([x or 0 for x in ids.as_py() or []], np.int64)
            bears = np.ones(len(ids), np.int64) if loss_col is None else np.zeros(len(ids), np.int64)
            if loss_col is not None:
                marks = (marks.as_py() or [])[: len(ids)]
                bears[: len(marks)] = [bool(x) for x in marks]
            yield Example(key, ids, np.concatenate([[0], np.cumsum(bears)]))

    return _pack(rows, examples, limits, keep_ids)

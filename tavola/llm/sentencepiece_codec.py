"""Offset-preserving SentencePiece (BPE) encoding and decoding.

The model file is read once per Python worker.  A text is normalised by
longest-prefix replacement through the compiled character map, which records
for every normalised byte the source offset it came from; the normalised text
is cut where no piece can span, each part is merged by piece score, and every
piece is projected through the alignment to a span of source bytes.  Words that
a worker has not met go to the library many at once, where a model maps no
characters and its dummy prefix is the space mark before a word.

Defined results: a null text counts as empty, an empty text has no pieces and
decodes to an empty text; null and repeated ids pass through; an empty table
gives no rows; other columns, whatever their names, are ignored.  Models with
user-defined or unused pieces, or of another kind than BPE, are refused.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format

# A part's ids are kept per worker; the memory is cleared beyond this many parts.
CACHED_PARTS = 400_000
# Parts longer than this are merged with a queue instead of repeated scans.
SCAN_LENGTH = 48
# Source bytes of the texts that one output batch holds, unless one text is longer.
BATCH_BYTES = 2_000_000
NO_PIECE = float("inf")


class CharacterMap:
    """The compiled map: a double-array trie over source bytes and its replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that starts at ``at``."""
        units, node, found = self.units, 0, None
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node ^= offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normalizer:
    """Source text -> (normalised text, source offset of every normalised byte and of the end)."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        if self.map is None and not self.squeeze:
            return self._plain(text, data)
        return self._mapped(data)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        if not data:
            return "", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        widths = np.diff(starts, append=len(data))
        widths[raw[starts] == 32] = len(self.space.encode())
        head = [0] * (len(self.space.encode()) if self.dummy else 0)
        align = np.concatenate([head, np.repeat(starts, widths), [len(data)]]).astype(np.int64)
        return (self.space if self.dummy else "") + text.replace(" ", self.space), align

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(data, at) if self.map else None
        if hit:
            return hit
        end = at + 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        return end - at, data[at:end]

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        space, at, out, align = self.space.encode(), 0, bytearray(), []
        if self.squeeze:
            while at < len(data) and (hit := self._prefix(data, at))[1] == b" ":
                at += hit[0]
        if at == len(data):
            return "", np.full(1, at, np.int64)

        def put(piece: bytes) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.dummy:
            put(space)
        after_space = self.squeeze
        while at < len(data):
            width, piece = self._prefix(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", space))
                after_space = self.squeeze and piece.endswith(b" ")
            at += width
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = align[len(out)]
                del align[len(out) :]
        return out.decode("utf-8", "replace"), np.array([*align, at], np.int64)


class _Parts(dict):
    """Part -> its ids as int32 bytes, filled on demand."""

    def __init__(self, merge, mark: str):
        self.merge, self.mark = merge, mark

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHED_PARTS:
            self.clear()
        ids = array("i", self.merge(self.mark + part)).tobytes()
        if len(part) <= SCAN_LENGTH:
            self[part] = ids
        return ids


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces")
        self.normalize = Normalizer(proto.normalizer_spec)
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.ranks = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.fallback = proto.trainer_spec.byte_fallback
        surface = {UNKNOWN: proto.trainer_spec.unk_surface.encode(), CONTROL: b""}
        self.width = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else surface.get(p.type, p.piece.replace(SPACE, " ").encode()) for p in proto.pieces
        ]
        self.leading = {i for i, p in enumerate(proto.pieces) if p.type == NORMAL and p.piece.startswith(SPACE)}
        # If no piece has a space mark after another character, none spans the start of a word.
        self.words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.bare, self.marked = _Parts(self._merge, ""), _Parts(self._merge, SPACE)
        plain = self.normalize.map is None and not self.normalize.squeeze and self.normalize.space == SPACE
        self.library = None
        if plain and self.words and self.dummy and self.fallback and not proto.trainer_spec.treat_whitespace_as_suffix:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_proto=model)

    def _emit(self, symbols: list[str]) -> list[int]:
        ids = list(map(self.ids.get, symbols))
        if None not in ids:
            return ids
        if not self.fallback:
            return [self.unknown if i is None else i for i in ids]
        return [b for i, s in zip(ids, symbols) for b in ([i] if i is not None else [self.bytes[x] for x in s.encode()])]

    def _merge(self, part: str) -> list[int]:
        """Merge neighbours, the best score first and the leftmost of equals."""
        if len(part) > SCAN_LENGTH:
            return self._emit(self._merge_long(part))
        symbols, rank = list(part), self.ranks.get
        ranks = [rank(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != NO_PIECE:
            at = ranks.index(best)
            symbols[at] += symbols.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], NO_PIECE)
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], NO_PIECE)
        return self._emit(symbols)

    def _merge_long(self, part: str) -> list[str]:
        symbols, ranks = list(part), self.ranks
        after, before = list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (rank := ranks.get(pair := symbols[left] + symbols[right])) is not None:
                heapq.heappush(queue, (rank, left, right, pair))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while queue:
            _, left, right, pair = heapq.heappop(queue)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s]

    def _parts(self, normal: str) -> list[bytes]:
        """The ids of every part in turn; words after single spaces are looked up without their space mark."""
        if not self.words:
            return [self.bare[normal]] if normal else []
        if SPACE + SPACE in normal:
            return list(map(self.bare.__getitem__, self.runs.findall(normal)))
        first, *rest = normal.split(SPACE)
        return [self.bare[first] if first else b"", *map(self.marked.__getitem__, rest)]

    def meet(self, texts: list[str]) -> None:
        """Remember the ids of the words after spaces that are new; others are merged when they come up."""
        if self.library is None:
            return
        words: set[str] = set()
        for text in texts:
            words.update(text.split(" "))
        if len(self.marked) + len(words) > CACHED_PARTS:
            self.marked.clear()
        new = [w for w in words if w not in self.marked and 0 < len(w) <= SCAN_LENGTH]
        for word, ids in zip(new, self.library.encode(new, num_threads=1)):
            self.marked[word] = array("i", ids).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, source byte offsets of the n + 1 piece borders)."""
        normal, align = self.normalize(text)
        ids = np.frombuffer(b"".join(self._parts(normal)), np.int32)
        widths = self.width[ids]
        if not self.fallback:
            unknown = np.flatnonzero(ids == self.unknown)
            if len(unknown):
                parts = self.runs.findall(normal) if self.words else [normal]
                widths[unknown] = [len(s.encode()) for part in parts for s in self._merge_long(part) if s not in self.ids]
        borders = align[np.concatenate([[0], np.cumsum(widths)])]
        return ids, borders

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD one by one."""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if self.dummy and first in self.leading:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _decode_bytewise(data)


def _decode_bytewise(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[at : at + width].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            width = 1
        at += width
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The worker's codec for a model file; one that Spark distributed is found by its name."""
    if model not in _CODECS:
        path = model if os.path.exists(model) else SparkFiles.get(os.path.basename(model))
        with open(path, "rb") as f:
            _CODECS[model] = Codec(f.read())
    return _CODECS[model]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, begins, ends (source byte span of every piece), decoded.

    ``model`` is the path of the model file on every worker, or the name of a
    file given to ``SparkContext.addFile``.  No shuffle; memory is bounded by
    an output batch of about 2 MB of text or one text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        own = codec(model)
        names = ["doc_id", "ids", "begins", "ends", "decoded"]
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            start, held, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(column[i].as_py())
                held += len(texts[-1])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    own.meet(texts)
                    ids, begins, ends, decoded = [], [], [], []
                    for text in texts:
                        got, borders = own.encode(text)
                        ids.append(got)
                        begins.append(borders[:-1])
                        ends.append(borders[1:])
                        decoded.append(own.decode(got.tolist()))
                    columns = [keys.slice(start, i + 1 - start), _lists(ids), _lists(begins), _lists(ends), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start, held, texts = i + 1, 0, []

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (source bytes under the pieces' spans), and ids if asked for."""
    out = encode(docs, model, id_col, text_col)
    # Every span begins where the one before it ends.
    covered = F.get("ends", F.size("ends") - 1).cast("long") - F.get("begins", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("span_bytes"),
        *(["ids"] if keep_ids else []),
    )

"""Substring dedup on a de Bruijn graph of word windows.

Every window of ``WINDOW`` words is an edge (its first and last 19 words are
the nodes it joins).  Edges travel in super-edges: consecutive windows whose
smallest hashed ``ANCHOR``-word piece is the same one, the anchor.  Equal
windows have equal anchors, so

1. super-edges are strung into blocks that begin where an anchor's hash says
   so, about ``BLOCK`` to a block, so that copies of a passage fall into equal
   blocks but for its ends and edits.  All but the first occurrence of a block
   are later copies as a whole; an edge's first occurrence is never in one of
   these, so the rest of the work is on first occurrences alone;
2. there, anchors that occur once rule out most of the text (a narrow row each);
3. the super-edges of the other anchors are grouped; where an anchor has one
   kind of super-edge, all its edges share their occurrences, otherwise its
   distinct super-edges are opened into edges.  Every repeated edge gets its
   multiplicity and its home, the first place in document order;
4. edges whose homes follow each other with equal multiplicity are a
   nonbranching path, compacted by a join of each edge's end with the next
   one's start;
5. occurrences away from home are collected per path and displacement; their
   source coordinates verify that they run on without a gap, as one span.
   Gaps leave them in pieces.

The words under the spans are removed.

Defined results: a null text has no words; texts under 20 words have no
window; rows with equal id and text count as one document and get equal
results, rows with equal id and different texts come in order of a hash of the
text; null ids come last; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.llm.common import id_key, release
from tavola.session import materialize_table

WINDOW = 20
ANCHOR = 5
# Super-edges of a block on average (a power of two).
BLOCK = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
DOC = ["no_id", "id", "text_hash"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= _BASE
        out += hashes[i : i + n]
    return _mix(out)


def super_edges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge hash per window, first window, number of windows and anchor hash per super-edge)."""
    if len(words) < WINDOW:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    edges, pieces = _rolled(hashes, WINDOW), _rolled(hashes, ANCHOR)
    inside = np.lib.stride_tricks.sliding_window_view(pieces, WINDOW - ANCHOR + 1)
    anchor_at = inside.argmin(axis=1) + np.arange(len(edges))
    first = np.flatnonzero(np.diff(anchor_at, prepend=-1))
    return edges, first, np.diff(first, append=len(edges)), pieces[anchor_at[first]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, bytes and the document key (no_id, id, text_hash) without nulls."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text.cast("binary").alias("bytes"),
        *id_key(docs, id_col),
        F.xxhash64(text).alias("text_hash"),
    )


def _blocks(rows: DataFrame, per_block: int = BLOCK) -> DataFrame:
    """Document key, at, windows, block (128-bit hash of its edges) and anchors of every block."""

    def run(batches):
        names = [*DOC, "at", "windows", "block", "anchors"]
        for batch in batches:
            where, at, windows, hashes, anchors = [], [], [], [], []
            for i, data in enumerate(batch.column(3)):
                edges, first, _, own = super_edges(data.as_py().split())
                if not len(edges):
                    continue
                begins = (own & np.uint64(per_block - 1)) == 0
                begins[0] = True
                head = np.flatnonzero(begins)
                start, packed = first[head], edges.tobytes()
                stop = np.append(start[1:], len(edges))
                where.append(np.full(len(head), i))
                at.append(start)
                windows.append(stop - start)
                hashes += [xxhash.xxh3_128_digest(packed[8 * a : 8 * b]) for a, b in zip(start.tolist(), stop.tolist())]
                anchors += np.split(own.view(np.int64), head[1:])
            pick = pa.array(np.concatenate([np.empty(0, np.int64), *where]))
            ends = np.cumsum([0, *map(len, anchors)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *anchors])))
            numbers = [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (at, windows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pick) for k in range(3)], *numbers, pa.array(hashes, pa.binary()), lists], names)

    schema = f"no_id boolean, id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, at bigint, windows bigint, block binary, anchors array<bigint>"
    return rows.select(*DOC, "bytes").mapInArrow(run, schema)


def first_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(later copies of whole blocks: document key, at, windows; first occurrences: doc_key, anchors)."""
    blocks = materialize_table(_blocks(rows), "blocks")
    first = blocks.groupBy("block").agg(F.min(F.struct(*DOC, "at", "anchors")).alias("home"), F.count(F.lit(1)).alias("n"))
    first = materialize_table(first, "first-blocks")
    homes = first.filter("n > 1").select("block", F.struct(*[F.col(f"home.{c}").alias(c) for c in (*DOC, "at")]).alias("home"))
    copies = blocks.select(*DOC, "at", "windows", "block").join(homes, "block").filter(_place() != F.col("home"))
    # Blocks that follow each other in a document are one span.
    order = Window.partitionBy(*DOC).orderBy("at")
    head = F.when(F.lag(F.col("at") + F.col("windows")).over(order) == F.col("at"), 0).otherwise(1)
    runs = copies.select(*DOC, "at", "windows", head.alias("head")).withColumn("run", F.sum("head").over(order))
    copies = materialize_table(runs.groupBy(*DOC, "run").agg(F.min("at").alias("at"), F.sum("windows").alias("windows")).drop("run"), "block-copies")
    release(blocks)
    return copies, first.select(F.xxhash64(*[F.col(f"home.{c}") for c in DOC]).alias("doc_key"), F.col("home.anchors").alias("anchors"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """The super-edges of ``rows`` whose anchor is in the row's list: document key, at, size, anchor, edges (8 bytes each)."""

    def run(batches):
        names = [*DOC, "at", "size", "anchor", "edges"]
        for batch in batches:
            key = [batch.column(i) for i in range(3)]
            where, at, size, anchors, packed = [], [], [], [], []
            for i in range(batch.num_rows):
                edges, first, sizes, own = super_edges(batch.column(3)[i].as_py().split())
                wanted = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(np.isin(own.view(np.int64), wanted))
                data = edges.tobytes()
                where.append(np.full(len(hit), i))
                at.append(first[hit])
                size.append(sizes[hit])
                anchors.append(own[hit].view(np.int64))
                packed += [data[8 * a : 8 * (a + n)] for a, n in zip(first[hit].tolist(), sizes[hit].tolist())]
            pick = pa.array(np.concatenate([np.empty(0, np.int64), *where]))
            columns = [k.take(pick) for k in key]
            columns += [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(t)) for x, t in ((at, np.int64), (size, np.int32), (anchors, np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names)

    schema = f"no_id boolean, id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, at bigint, size int, anchor bigint, edges binary"
    return rows.select(*DOC, "bytes", "wanted").mapInArrow(run, schema)


def _place(at: Column | str = "at") -> Column:
    return F.struct(*DOC, (F.col(at) if isinstance(at, str) else at).alias("at"))


def repeated_occurrences(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Super-edges, at their occurrences in ``first`` blocks, whose anchor occurs again there; with ``seg``, a name of the whole super-edge."""
    anchors = first.select("doc_key", F.explode("anchors").alias("anchor"))
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    again = materialize_table(again, "repeated-anchors")
    wanted = anchors.join(again, "anchor").groupBy("doc_key").agg(F.collect_set("anchor").alias("wanted"))
    found = rows.withColumn("doc_key", F.xxhash64(*DOC)).join(wanted, "doc_key")
    out = materialize_table(_occurrences(found).withColumn("seg", F.xxhash64("edges")), "super-edges")
    release(again)
    return out


def repeated_edges(occurrences: DataFrame) -> DataFrame:
    """Fragments of the repeated part of the graph, per kind of super-edge.

    (anchor, seg, off, len, home, n): ``len`` edges from ``off`` on, which
    occur ``n`` times, first at ``home``.
    """
    kinds = occurrences.groupBy("anchor", "seg").agg(F.min(_place()).alias("home"), F.count(F.lit(1)).alias("n"), F.first("edges").alias("edges"), F.first("size").alias("size"))
    kinds = materialize_table(kinds, "super-edge-kinds")
    # Anchors of several kinds, written apart: the joins are then free to split an anchor that has very many.
    several = kinds.groupBy("anchor").agg(F.min("seg").alias("least"), F.max("seg").alias("most")).filter("least <> most").select("anchor")
    several = materialize_table(several, "several-kinds")
    whole = kinds.filter("n > 1").join(several, "anchor", "left_anti").select("anchor", "seg", F.lit(0).alias("off"), F.col("size").alias("len"), "home", "n")
    opened = kinds.join(several, "anchor").select("anchor", "seg", "home", "n", "edges", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("off"))
    moved = F.struct(*[F.col(f"home.{c}").alias(c) for c in DOC], (F.col("home.at") + F.col("off")).alias("at"))
    opened = opened.select("anchor", "seg", "off", F.substring("edges", F.col("off") * 8 + 1, F.lit(8)).alias("edge"), moved.alias("first"), "n")
    opened = materialize_table(opened, "opened-edges")
    edges = opened.groupBy("anchor", "edge").agg(F.min("first").alias("home"), F.sum("n").alias("n")).filter("n > 1")
    single = opened.drop("n").join(edges, ["anchor", "edge"]).select("anchor", "seg", "off", F.lit(1).alias("len"), "home", "n")
    return materialize_table(whole.unionByName(single), "repeated-edges")


def compact_paths(fragments: DataFrame) -> DataFrame:
    """(no_id, id, text_hash, at, len, n, path_at): every fragment at its home, and where its nonbranching path begins."""
    homes = fragments.select("home.*", "len", "n").distinct()
    ends = homes.select(*DOC, (F.col("at") + F.col("len")).alias("at"), "n", F.lit(True).alias("follows"))
    linked = homes.join(ends, [*DOC, "at", "n"], "left")
    start = F.when(F.col("follows").isNull(), F.col("at"))
    order = Window.partitionBy(*DOC).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return linked.withColumn("path_at", F.last(start, ignorenulls=True).over(order)).drop("follows")


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The compacted graph: home document key, at, windows and occurrences of every repeated nonbranching path.

    On the whole graph: no block is set aside, so occurrences count all places.
    """
    rows = keyed(docs, id_col, text_col)
    blocks = materialize_table(_blocks(rows), "blocks")
    whole = blocks.select(F.xxhash64(*DOC).alias("doc_key"), "anchors")
    paths = compact_paths(repeated_edges(repeated_occurrences(rows, whole)))
    return paths.groupBy(*DOC, F.col("path_at").alias("at"), "n").agg(F.sum("len").alias("windows")).withColumnRenamed("n", "occurrences")


def later_spans(rows: DataFrame) -> DataFrame:
    """(no_id, id, text_hash, at, windows): runs of windows that also start earlier."""
    copies, first = first_blocks(rows)
    occurrences = repeated_occurrences(rows, first)
    fragments = repeated_edges(occurrences)
    paths = compact_paths(fragments)
    own = occurrences.select(*DOC, "at", "anchor", "seg").join(fragments, ["anchor", "seg"])
    own = own.withColumn("at", F.col("at") + F.col("off")).filter(_place() != F.col("home"))
    homes = paths.select(F.struct(*DOC, "at").alias("home"), "path_at")
    on_path = own.join(homes, "home").select(*DOC, "at", "len", "home", "path_at", (F.col("at") - F.col("home.at")).alias("shift"))
    spans = on_path.groupBy(*DOC, *[F.col(f"home.{c}").alias(f"home_{c}") for c in DOC], "path_at", "shift").agg(
        F.min("at").alias("start"),
        F.sum("len").alias("windows"),
        F.max(F.col("at") + F.col("len")).alias("stop"),
        F.collect_list(F.struct(F.col("at").alias("at"), F.col("len").cast("long").alias("windows"))).alias("pieces"),
    )
    gapless = F.col("stop") - F.col("start") == F.col("windows")
    one = F.array(F.struct(F.col("start").alias("at"), F.col("windows").alias("windows")))
    spans = spans.select(*DOC, F.explode(F.when(gapless, one).otherwise(F.col("pieces"))).alias("s")).select(*DOC, "s.*")
    return materialize_table(copies.unionByName(spans), "later-spans")


def _kept(rows: DataFrame) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for data, spans in zip(batch.column(1), batch.column(2)):
                words = data.as_py().split()  # on bytes: ASCII white space only
                gone = bytearray(len(words))
                for s in spans.as_py() or ():
                    end = s["at"] + s["windows"] + WINDOW - 1
                    gone[s["at"] : end] = b"\1" * (end - s["at"])
                n_words.append(len(words))
                n_removed.append(sum(gone))
                texts.append(b" ".join(w for w, g in zip(words, gone) if not g) if n_removed[-1] else b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "bytes", "spans").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the remaining words joined by one space)."""
    rows = keyed(docs, id_col, text_col)
    spans = later_spans(rows)
    per_doc = spans.groupBy(*DOC).agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    return _kept(rows.join(per_doc, DOC, "left")).withColumn("kept", F.col("kept").cast("string"))

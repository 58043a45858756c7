"""Ranked lexical search: exact top documents of every item by per-term geometric blocks.

The items are the stated queries; they go to the tasks in blocks of bounded size
(items and distinct terms), each against all documents:

1. one pass keeps, of every document, its length and its counts of item terms;
2. the corpus counts N, L and df come from these rows;
3. every task indexes its rows by segments of bounded size and searches all items.

A segment clusters each term's posting list by similarity of the documents
(nearest of evenly picked members by a random projection of their term vectors)
and cuts the clusters into blocks.  A block stores, per term, the greatest value
any of its documents has: its summary.  Terms are numbered from rare to
frequent.  A document is looked for in the list of its rarest term of the item,
so the bound of a block of term t adds up the summary over the item's terms from
t on.  Blocks are read from the highest bound down, and skipped only if their
bound is below the score of the item's k-th document so far.  That bound is
never below a document's score, so the result is exact.

A summary keeps at most ``SUMMARY_TERMS`` terms; for others the segment's greatest
value stands in.  Documents with more than ``LONG_DOCUMENT`` item terms are scored
one by one, outside the lists.

Defined results: null texts have no terms; items without terms and without a
matching document give no rows; equal scores go by document id, null ids last;
rows that repeat an id are documents, or items, of their own; an empty table on
either side gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.llm.common import release
from tavola.session import materialize_table

ITEMS = 4096
ITEM_TERMS = 1 << 20
SEGMENT_POSTINGS = 1 << 20
BLOCK_DOCS = 128
SUMMARY_TERMS = 1024
LONG_DOCUMENT = 1024
SKETCH = 16
NO_ID = np.iinfo(np.int64).max

# Fixed by the definition of a term: ASCII other than digits and letters separates, only A-Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included."""
    return text.translate(_TERM_BYTES).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """Lists of (id, counts of terms) within the bounds of a block; one item alone may exceed them."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    for key, text in rows.toLocalIterator():
        counts = Counter(terms(bytes(text)))
        if block and (len(block) >= ITEMS or size + len(counts) > ITEM_TERMS):
            yield block
            block, size = [], 0
        if counts:
            block.append((key, counts))
            size += len(counts)
    if block:
        yield block


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``sizes`` (each at least 1)."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def counted(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): length in terms, and the terms of the vocabulary by their numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        number = vocabulary.value.get
        for batch in batches:
            found, sizes, lengths = [np.zeros((2, 0), np.int64)], [0], []
            for text in batch.column(1):
                words = terms(text.as_py())
                hits = np.array([i for i in map(number, words) if i is not None], np.int64)
                found.append(np.stack(np.unique(hits, return_counts=True)))
                sizes.append(found[-1].shape[1])
                lengths.append(len(words))
            flat, ends = np.concatenate(found, 1).astype(np.int32), pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Items:
    """A block of items over terms numbered from rare to frequent."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], terms_: int):
        self.items, self.terms = items, terms_
        sizes = [len(t) for t, _ in items]
        flat = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in items]])
        order = np.argsort(flat, kind="stable")
        self.item_of, self.place_of = np.repeat(np.arange(len(items)), sizes)[order], _ragged(np.zeros(len(sizes), np.int64), np.array(sizes, np.int64))[order]
        self.at = np.searchsorted(flat[order], np.arange(terms_ + 1))

    def beside(self, term: int) -> np.ndarray:
        """The terms from ``term`` on that stand in an item with it, at most SUMMARY_TERMS."""
        here = slice(self.at[term], self.at[term + 1])
        near = [self.items[i][0][p : p + SUMMARY_TERMS] for i, p in zip(self.item_of[here].tolist(), self.place_of[here].tolist())]
        return np.unique(np.concatenate(near))[:SUMMARY_TERMS]


class Top:
    """The k best (score, id) of an item."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document needs at least this score to come in."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


class Segment:
    """Some documents as rows of sorted (term, value), their posting lists in blocks with summaries."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms_: np.ndarray, values: np.ndarray, items: Items):
        self.ids, self.sizes, self.terms, self.values, self.items = ids, sizes, terms_, values, items
        self.starts = np.cumsum(sizes) - sizes
        self.greatest = np.zeros(items.terms, np.int64)
        np.maximum.at(self.greatest, terms_, values)
        self.column = np.full(items.terms, -1, np.int64)
        self.lists: dict[int, tuple] = {}
        short = np.repeat(sizes <= LONG_DOCUMENT, sizes)
        posting = np.flatnonzero(short)
        posting = posting[np.argsort(terms_[posting], kind="stable")]
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        self.long = np.flatnonzero(sizes > LONG_DOCUMENT)
        sketch = self._sketches()
        present, first = np.unique(terms_[posting], return_index=True)
        for term, here in zip(present.tolist(), np.split(posting, first[1:])):
            if items.at[term] < items.at[term + 1]:
                self.lists[term] = self._blocks(term, here, doc_of[here], sketch)

    def _sketches(self) -> np.ndarray:
        """Random projections of the documents' term vectors, of length 1."""
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (self.items.terms if self.items.terms < 1 << 16 else 1 << 16, SKETCH))
        parts = signs[self.terms % len(signs)] * self.values[:, None].astype(np.float32)
        out = np.add.reduceat(parts, self.starts, axis=0) if len(self.sizes) else parts
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _blocks(self, term: int, posting: np.ndarray, docs: np.ndarray, sketch: np.ndarray) -> tuple:
        """(docs block by block, where the blocks start, summary terms, summaries)."""
        n = len(docs)
        cuts = np.zeros(1, np.int64)
        if n > BLOCK_DOCS:
            own = sketch[docs]
            cluster = np.argmax(own @ own[:: BLOCK_DOCS // 2].T, axis=1)
            order = np.argsort(cluster, kind="stable")
            posting, docs, cluster = posting[order], docs[order], cluster[order]
            begins = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
            within = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            cuts = np.flatnonzero(within % BLOCK_DOCS == 0)
        kept = self.items.beside(term)
        # A row's terms are sorted: those from this term on stand behind its posting.
        ahead = self.starts[docs] + self.sizes[docs] - posting
        block = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, n)))
        entry = _ragged(posting, ahead)
        self.column[kept] = np.arange(len(kept))
        column = self.column[self.terms[entry]]
        self.column[kept] = -1
        known = column >= 0
        summary = np.zeros(len(cuts) * len(kept), np.int64)
        np.maximum.at(summary, (np.repeat(block, ahead) * len(kept) + column)[known], self.values[entry[known]])
        return docs, np.append(cuts, n), kept, summary.reshape(len(cuts), len(kept))

    def _scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        entry = _ragged(self.starts[docs], self.sizes[docs])
        return _sums(weight[self.terms[entry]] * self.values[entry], self.sizes[docs])

    def search(self, which: int, top: Top, weight: np.ndarray) -> int:
        """Offer this segment's documents to an item; returns how many were scored."""
        asked, weights = self.items.items[which]
        weight[asked] = weights
        scored, seen = len(self.long), np.zeros(len(self.ids), bool)
        top.offer(self._scores(self.long, weight), self.ids[self.long])
        most = np.cumsum((weights * self.greatest[asked])[::-1])[::-1]  # any document's score from this term on
        for i, term in enumerate(asked.tolist()):
            if most[i] < top.least:
                break
            if term not in self.lists:
                continue
            docs, cuts, kept, summary = self.lists[term]
            rest, factor = asked[i:], weights[i:]
            at = np.searchsorted(kept, rest)
            inside = at < len(kept)
            inside[inside] = kept[at[inside]] == rest[inside]
            bound = summary[:, at[inside]] @ factor[inside] + int((factor * self.greatest[rest])[~inside].sum())
            order, step, done = np.argsort(-bound, kind="stable"), 1, 0
            while done < len(order):
                read = order[done : done + step]
                read = read[bound[read] >= top.least]
                if not len(read):
                    break
                found = docs[_ragged(cuts[read], cuts[read + 1] - cuts[read])]
                found = found[~seen[found]]
                seen[found] = True
                scored += len(found)
                top.offer(self._scores(found, weight), self.ids[found])
                done, step = done + step, step * 2
        weight[asked] = 0
        return scored


def _values(n: np.ndarray, counts: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * documents) // words
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def searched(rows: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every item in every task's rows."""

    def segments(batches, items, number, documents, words):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= SEGMENT_POSTINGS:
                    yield segment(held, items, number, documents, words)
                    held, size = [], 0
        if size:
            yield segment(held, items, number, documents, words)

    def segment(held, items, number, documents, words):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        lists = [table[c].combine_chunks() for c in ("terms", "counts")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        own, counts = number[lists[0].flatten().to_numpy()], lists[1].flatten().to_numpy().astype(np.int64)
        values = _values(np.repeat(table["n"].to_numpy(), sizes), counts, documents, words)
        order = np.lexsort((own, np.repeat(np.arange(len(sizes)), sizes)))
        return Segment(ids, sizes, own[order], values[order], items)

    def run(batches):
        items, number, documents, words = shared.value
        best, weight = [Top(k) for _ in items.items], np.zeros(items.terms, np.int64)
        for s in segments(batches, items, number, documents, words):
            for i, top in enumerate(best):
                s.search(i, top, weight)
        item = np.repeat(np.arange(len(best)), [len(t.ids) for t in best])
        ids = np.concatenate([np.zeros(0, np.int64), *[t.ids for t in best]])
        scores = np.concatenate([np.zeros(0, np.int64), *[t.scores for t in best]])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return rows.filter("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, counts in block for w in counts}))}
    words_in = spark.sparkContext.broadcast(vocabulary)
    rows = materialize_table(counted(docs, words_in, id_col, text_col), "search-counts")
    documents, words = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row per item term
        df[term] = n
    order = np.argsort(df, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df[order].tolist()], np.int64)
    items = []
    for _, counts in block:
        own = number[[vocabulary[w] for w in counts]]
        by = np.argsort(own)
        items.append((own[by], weight[own[by]] * np.array(list(counts.values()), np.int64)[by]))
    shared = spark.sparkContext.broadcast((Items(items, len(order)), number, documents, words))
    found = searched(rows, shared, k)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], "item long, item_id long")
    out = materialize_table(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-found")
    release(rows)
    words_in.destroy()
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item its k documents of the highest scores above 0: item_id, rank, doc_id, score."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_id_col, item_text_col):
        out = out.unionByName(_search_block(docs, block, k, id_col, text_col))
    return out

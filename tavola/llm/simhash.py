"""SimHash near-duplicates: fingerprints and a binary-trie self-join.

The distinct fingerprints form a binary trie.  The join walks pairs of its
nodes together from the root, adds up the bits in which the two paths differ
and drops a pair once its errors exceed what is left of the budget.

To keep the walk near-linear and to share it out, the 64 bits are cut into
``budget + 1`` blocks and walked once from each block on, round the ring.  A
pair with at most ``budget`` errors has at least one start from which every
prefix of j blocks holds at most j * budget / (budget + 1) errors (the ring
form of the pigeonhole principle), so each walk may prune with these smaller
budgets, and none allows an error in the first block.  That first block is the
Spark partitioning key: subtries of the trie, one walk each.  Subtries too
large for a task are walked down on Spark, node pair by node pair, until the
sides of every pair are small.

A walk returns a spanning forest of the links it found, never all pairs of a
dense group.

Defined results: a null text counts as empty; texts without a word share the
zero fingerprint and are linked like any other; null ids take part and are
never a component id unless all ids of the component are null; rows repeating
an id are rows like any other; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import one_per_key, packed, same_row, text_key
from tavola.llm.components import components
from tavola.session import materialize_table

BITS = 64
SEED = 42
SHINGLE = 4
BUDGET = 4
# Fingerprints on one side of a node pair that one task walks; larger nodes are split first.
NODE_ROWS = 20_000
# Bits by which a node pair too large for a task is taken further down on Spark.
STRIDE = 4
# Node pairs that a walk expands at a time: bounds its memory.
BLOCK_PAIRS = 1 << 18
# Shingles whose bits are counted at a time.
BLOCK_HASHES = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of every shingle of ``size`` words, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashed = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in spans], "<u8")
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), BLOCK_HASHES):
        part = hashed[i : i + BLOCK_HASHES]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashed), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, seed: int = SEED, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(``keep`` columns, fp): the fingerprint as a signed 64-bit integer."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_bytes"))
    names = [c for c in rows.columns if c != "_bytes"]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), size, seed) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes")
    return rows.mapInArrow(run, f"{schema}, fp bigint")


def block_starts(budget: int) -> list[int]:
    """First bit of every block, counted from the top; blocks differ by a bit at most."""
    n = budget + 1
    return [i * BITS // n for i in range(n)]


def _allowed(budget: int, start: int) -> np.ndarray:
    """Errors allowed in the first d bits, d = 0..64, of the walk that begins at block ``start``."""
    at = block_starts(budget)
    ends = [(at[(start + j + 1) % len(at)] - at[start]) % BITS or BITS for j in range(len(at))]
    out = np.full(BITS + 1, budget, np.int64)
    for j in reversed(range(len(ends))):
        out[: ends[j] + 1] = (j + 1) * budget // (budget + 1)
    return out


def _rotate(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return (values << by) | (values >> ((np.uint64(BITS) - by) % np.uint64(BITS)))


class _Forest:
    """Links kept as a spanning forest: every element points at a smaller one of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.root[x]
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            x = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
        self.root = self.find(np.arange(len(self.root)))


def walk(values: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, errors: np.ndarray, allowed: np.ndarray, budget: int) -> _Forest:
    """Walk node pairs of one trie down from ``roots`` and link values within ``budget`` bits.

    ``values`` are sorted within every node; a root is (lo, hi, lo, hi): the
    value ranges of the two nodes, equal for a node with itself, both
    at ``depth`` with ``errors`` differing bits so far.
    """
    forest = _Forest(len(values))
    quads = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(depth, quads[i : i + BLOCK_PAIRS], errors[i : i + BLOCK_PAIRS]) for i in range(0, len(quads), BLOCK_PAIRS)]
    while stack:
        depth, q, e = stack.pop()
        single = (q[:, 1] - q[:, 0] == 1) & (q[:, 3] - q[:, 2] == 1)
        if single.any():
            a, b = q[single, 0], q[single, 2]
            open_ = forest.root[a] != forest.root[b]
            a, b = a[open_], b[open_]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.link(a[near], b[near])
            q, e = q[~single], e[~single]
        if not len(q) or depth == BITS:
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
        mid_a = q[:, 1] - (ones[q[:, 1]] - ones[q[:, 0]])
        mid_b = q[:, 3] - (ones[q[:, 3]] - ones[q[:, 2]])
        same = (q[:, 0] == q[:, 2]) & (q[:, 1] == q[:, 3])
        zero_a, one_a = np.stack([q[:, 0], mid_a], 1), np.stack([mid_a, q[:, 1]], 1)
        zero_b, one_b = np.stack([q[:, 2], mid_b], 1), np.stack([mid_b, q[:, 3]], 1)
        below = [(zero_a, zero_b, e, None), (one_a, one_b, e, None), (zero_a, one_b, e + 1, None), (one_a, zero_b, e + 1, ~same)]
        parts, errs = [], []
        for x, y, err, only in below:
            ok = (x[:, 1] > x[:, 0]) & (y[:, 1] > y[:, 0]) & (err <= allowed[depth + 1])
            ok &= (x[:, 0] != y[:, 0]) | (x[:, 1] - x[:, 0] > 1)  # a value needs no link with itself
            if only is not None:
                ok &= only
            parts.append(np.concatenate([x[ok], y[ok]], 1))
            errs.append(err[ok])
        q, e = np.concatenate(parts), np.concatenate(errs)
        stack += [(depth + 1, q[i : i + BLOCK_PAIRS], e[i : i + BLOCK_PAIRS]) for i in range(0, len(q), BLOCK_PAIRS)]
    return forest


def trie_links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose closure joins all pairs within ``budget`` bits."""
    spark = fps.sparkSession
    starts = block_starts(budget)
    lengths = [(starts[(i + 1) % len(starts)] - s) % BITS or BITS for i, s in enumerate(starts)]
    turned = F.explode(
        F.array(*[F.struct(F.lit(i).alias("start"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", BITS - s)) if s else F.col("fp")).alias("v")) for i, s in enumerate(starts)])
    )
    rows = fps.select("fp", turned.alias("t")).select("t.start", "t.v")
    length = F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("start") + 1)
    top = F.expr(f"shiftrightunsigned(v, {BITS} - len)")
    pairs = rows.withColumn("len", length).select(
        "start", "v", F.col("len").alias("depth"), F.lit(0).alias("err"), top.alias("na"), top.alias("nb"), F.lit(0).alias("side")
    )
    node = ["start", "depth", "err", "na", "nb"]
    done = None
    while True:
        sizes = pairs.groupBy(*node).agg(F.count_if(F.col("side") == 0).alias("in_a"), F.count_if(F.col("side") == 1).alias("in_b"))
        large = materialize_table(sizes.filter(F.greatest("in_a", "in_b") > node_rows), "trie-nodes")
        if large.filter(F.col("depth") < BITS).isEmpty():
            done = pairs if done is None else done.unionByName(pairs)
            break
        small = pairs.join(large.select(*node), node, "left_anti")
        done = small if done is None else done.unionByName(small)
        pairs = materialize_table(_descend(pairs.join(large.select(*node), node, "left_semi"), budget), "trie-pairs")
        pairs = _both_sides(pairs, node)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = done.repartition(parts, *node).sortWithinPartitions(*node, "side", "v")
    return tasks.mapInPandas(lambda it: _walk_partition(it, budget), "a bigint, b bigint")


def _descend(pairs: DataFrame, budget: int) -> DataFrame:
    """Take node pairs ``STRIDE`` bits down: each row goes to the child pairs that its side of the pair may form.

    A child pair is named by the row's own path and the path, under the
    partner's node, that differs from it in the bits of a mask.
    """
    allowed = F.array(*[F.array(*[F.lit(int(x)) for x in _allowed(budget, s)]) for s in range(budget + 1)])
    out = pairs.withColumn("deeper", F.least(F.col("depth") + STRIDE, F.lit(BITS)))
    out = out.withColumn("ends", F.expr("shiftleft(1L, deeper - depth)")).withColumn("child", F.expr(f"shiftrightunsigned(v, {BITS} - deeper)"))
    out = out.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in range(1 << STRIDE)]))).filter("mask < ends")
    out = out.withColumn("errors", F.col("err") + F.bit_count("mask"))
    out = out.filter(F.col("errors") <= F.element_at(F.element_at(allowed, F.col("start") + 1), F.col("deeper") + 1))
    partner = F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("na"))
    out = out.withColumn("other", partner * F.col("ends") + F.col("child").bitwiseAND(F.col("ends") - 1).bitwiseXOR(F.col("mask")))
    own = F.col("na") == F.col("nb")
    first = F.when(own, F.col("child") <= F.col("other")).otherwise(F.col("side") == 0)
    return out.select(
        "start",
        "v",
        F.col("deeper").alias("depth"),
        F.col("errors").alias("err"),
        F.when(first, F.col("child")).otherwise(F.col("other")).alias("na"),
        F.when(first, F.col("other")).otherwise(F.col("child")).alias("nb"),
        F.when(first, 0).otherwise(1).alias("side"),
    )


def _both_sides(pairs: DataFrame, node: list[str]) -> DataFrame:
    """Drop pairs of two nodes of which one is empty."""
    sides = pairs.groupBy(*node).agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"))
    alive = sides.filter((F.col("na") == F.col("nb")) | ((F.col("_a") > 0) & (F.col("_b") > 0))).select(*node)
    return pairs.join(alive, node, "left_semi")


def _walk_partition(frames, budget: int):
    """Walk the node pairs of a partition, which arrive sorted; a pair may span batches."""
    import pandas as pd

    node = ["start", "depth", "err", "na", "nb"]
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        keys = frame[node].to_numpy()
        last = len(frame) - int((keys[::-1] == keys[-1]).all(axis=1).argmin() or len(frame)) if len(frame) else 0
        rest = frame.iloc[last:]
        yield from _walk_pairs(frame.iloc[:last], budget)
    if rest is not None:
        yield from _walk_pairs(rest, budget)


def _walk_pairs(frame, budget: int):
    import pandas as pd

    starts = np.array(block_starts(budget), np.uint64)
    for (start, depth), part in frame.groupby(["start", "depth"], sort=False):
        values = part["v"].to_numpy().view(np.uint64)
        keys = part[["err", "na", "nb"]].to_numpy()
        new = np.ones(len(part), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(part))
        side = np.concatenate([[0], np.cumsum(part["side"].to_numpy() == 1)])
        middle = end - (side[end] - side[first])
        own = keys[first, 1] == keys[first, 2]
        lo_b, hi_a = np.where(own, first, middle), np.where(own, end, middle)
        order = _sorted_within(values, first, end, middle)
        values = values[order]
        roots = np.stack([first, hi_a, lo_b, end], 1)
        useful = (roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2]) & ~(own & (end - first == 1))
        forest = walk(values, roots[useful], int(depth), keys[first, 0][useful].astype(np.int64), _allowed(budget, int(start)), budget)
        linked = np.flatnonzero(forest.root != np.arange(len(values)))
        if len(linked):
            back = np.full(len(values), (BITS - int(starts[int(start)])) % BITS)
            own_values = _rotate(values, back).view(np.int64)
            yield pd.DataFrame({"a": own_values[linked], "b": own_values[forest.root[linked]]})


def _sorted_within(values, first, end, middle):
    """Order by (node pair, side, unsigned value); Spark sorted the values as signed numbers."""
    pair = np.repeat(np.arange(len(first)), end - first)
    second = np.arange(len(values)) >= np.repeat(middle, end - first)
    return np.lexsort((values, second, pair))


def _components(rows: DataFrame, low: Column, budget: int) -> DataFrame:
    """(fp, low): per fingerprint the smallest ``low`` of its component."""
    fps = materialize_table(rows.groupBy("fp").agg(F.min(low).alias("low")), "distinct-fingerprints")
    found = components(trie_links(fps.select("fp"), budget))
    fps = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = fps.groupBy("component").agg(F.min("low").alias("low"))
    return materialize_table(fps.drop("low").join(lowest, "component").select("fp", "low"), "fingerprint-components")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = materialize_table(fingerprints(docs, text_col, size, keep=(F.col(id_col).alias("doc_id"),)), "fingerprints")
    found = _components(rows, F.col("doc_id"), budget).withColumnRenamed("low", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The input's rows and columns, one row of every component: that of the smallest id (null last).

    Of rows with that id the one whose text hash is least stays, of rows with
    equal id and text the least by content.
    """
    keys = (F.col(id_col).alias("key_id"), text_key(F.col(text_col)).alias("key_text"))
    rows = materialize_table(fingerprints(docs, text_col, size, keep=keys), "fingerprints")
    place = F.struct(F.col("key_id").isNull().alias("no_id"), F.col("key_id").alias("id"), F.col("key_text").alias("text"))
    found = _components(rows, place, budget)
    kept = rows.join(found, "fp").filter(place == F.col("low"))
    kept = materialize_table(kept.groupBy("key_id", "key_text").agg(F.count(F.lit(1)).alias("n")), "representatives")
    out = packed(docs, id_col, text_col)
    out = out.join(kept, same_row(out, kept), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = one_per_key(out)
    return out.select("row.*")

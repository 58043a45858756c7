"""Prefix trie of conversations: shared turns, leaves and the text a prefix cache saves.

Turns become 128-bit codes of (role, text).  A node, that is a sequence of first
turns, is named by its depth and two modular polynomial sums over its codes;
such sums add up, so a conversation may span many tasks.  Conversations with
equal turns become one sequence, sequences are sorted by their codes, and nodes
by (place of their first sequence, depth): the trie's preorder.

The preorder is cut into shards of equal size.  A shard writes its nodes as
balanced parentheses: ``(`` where a node begins, ``)`` where its subtree ends.
A range min-max tree over blocks of the excess answers findclose for all nodes
at once; ranks of the leaf pair ``()`` and cumulative savings between a node's
parentheses give its leaves and savings.  Nodes still open where their shard
ends, the spine, are merged with the shards behind them: every shard reports
where its depth falls to a new least value, which closes the spine down to
there, and running sums over the shards give what lies between.

Defined results: turns go by their number, nulls first, equal numbers by the
MD5 of role and text; null role and text become empty; rows without conv_id
belong to no conversation and are ignored; repeated rows are turns of their own;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.functions.stats import group_rank
from tavola.llm.common import release
from tavola.session import materialize_table

PRIME = (1 << 61) - 1
BASES = (1_000_003_000_000_457, 2_000_000_011_000_003)
KEY = ["depth", "s1", "s2"]
SORTED_TURNS = 1024
BLOCK_BITS = 64
CHUNK_CHARS = 1 << 16
HEAD_TURNS = 8
GROUP = 5


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, p, code, size): the turns of every conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), code.alias("code"), F.octet_length(text).cast("long").alias("size"))
    ranked = group_rank(rows.filter("conv_id is not null"), ["conv_id"], [F.col("turn").asc_nulls_first(), "code", "size"], rank_col="p")
    return ranked.select("conv_id", "p", "code", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of rebuilt turns, the rebuilt turns).

    Conversation c gets the first h turns of conversation c - c % 5, then its
    own from turn h + 1 on; h = crc32 of c's decimal digits, modulo 9.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(sizes, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("turns", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize_table(convs.select("conv_id", "base", "h", "lent", "turns"), "trie-conversations")
    heads = turns.filter((F.col("p") <= HEAD_TURNS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").filter("p <= h").select("conv_id", F.col("p").alias("depth"), "code", "size", "turns")
    own = turns.join(convs, "conv_id").filter("p > h").select("conv_id", (F.col("lent") + F.col("p") - F.col("h")).alias("depth"), "code", "size", "turns")
    return convs, lent.unionByName(own)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds this task's part of the polynomial sums up to every turn; turns come sorted."""
    part, conv, depth, powers, sums = TaskContext.get().partitionId(), None, 0, [1, 1], [0, 0]
    for batch in batches:
        found = []
        for c, d, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if c != conv:
                conv, sums, powers = c, [0, 0], [pow(b, d, PRIME) for b in BASES]
            elif d != depth:
                powers = [x * b % PRIME for x, b in zip(powers, BASES)]
            depth = d
            terms = [int.from_bytes(half, "big") % PRIME * x % PRIME for half, x in zip((code[:8], code[8:]), powers)]
            sums = [(x + t) % PRIME for x, t in zip(sums, terms)]
            found.append((*sums, *terms, part))
        new = zip(*found) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in new)], [*batch.schema.names, "l1", "l2", "t1", "t2", "part"])


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, KEY, parent's p1 and p2, code, size, turns) of every turn's prefix."""
    kinds = "conv_id long, depth long, code binary, size long, turns long"
    by = ["conv_id", "depth"]
    # Range bounds are sampled, so the parts are written once.
    local = rows.select("conv_id", F.col("depth").cast("long"), "code", "size", F.col("turns").cast("long")).repartitionByRange(*by).sortWithinPartitions(*by)
    local = materialize_table(local.mapInArrow(_sums, kinds + ", l1 long, l2 long, t1 long, t2 long, part long"), "trie-sums")
    parts = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("l1", "l2"), "depth").alias("sums"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.pmod(F.sum(F.col(f"sums.{c}").cast("decimal(20,0)")).over(before), F.lit(PRIME)).cast("long")
    # Only conversations that continue an earlier part have a row here.
    offsets = parts.select(F.struct("part", "conv_id").alias("at"), ahead("l1").alias("o1"), ahead("l2").alias("o2")).filter("o1 is not null")
    out = local.withColumn("at", F.struct("part", "conv_id")).join(offsets, "at", "left")
    full = lambda i: F.pmod(F.col(f"l{i}") + F.coalesce(f"o{i}", F.lit(0)), F.lit(PRIME))
    out = out.withColumns({"s1": full(1), "s2": full(2)})
    up = lambda i: F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(PRIME))
    out = materialize_table(out.select("conv_id", *KEY, up(1).alias("p1"), up(2).alias("p2"), "code", "size", "turns"), "trie-prefixes")
    release(local)
    return out


def sequence_places(paths: DataFrame, sorted_turns: int = SORTED_TURNS) -> DataFrame:
    """(conv_id, place): one conversation per distinct sequence, placed in the order of codes.

    Sequences are compared by ``sorted_turns`` turns at a time; only those that
    are still alike, and go on, meet again by their next turns.
    """
    ends = paths.filter("depth = turns").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
    waiting = materialize_table(ends.select("conv_id", F.col("depth").alias("turns"), F.lit(1).cast("long").alias("place")), "trie-sequences")
    codes, placed, at = paths.select("conv_id", "depth", "code"), None, 0
    while True:
        block = codes.filter((F.col("depth") > at) & (F.col("depth") <= at + sorted_turns)).join(waiting.select("conv_id"), "conv_id", "left_semi")
        keys = block.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "code"))), lambda x: x["code"]).alias("key"))
        keys = waiting.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<binary>")))
        ranked = group_rank(keys, ["place"], ["key", "conv_id"], rank_col="_rn").withColumn("_at", F.col("place") + F.col("_rn") - 1)
        at += sorted_turns
        if (waiting.agg(F.max("turns")).first()[0] or 0) <= at:
            done = ranked.select("conv_id", F.col("_at").alias("place"))
            return done if placed is None else placed.unionByName(done)
        ranked = materialize_table(ranked.drop("_rn"), "trie-ranked")
        classes = ranked.groupBy("place", "key").agg(F.min("_at").alias("_class"), F.count(F.lit(1)).alias("_n"))
        ranked = materialize_table(ranked.join(classes, ["place", "key"]).select("conv_id", "turns", F.col("_class").alias("place"), "_n"), "trie-classes")
        done = ranked.filter("_n = 1").select("conv_id", "place")
        placed = done if placed is None else placed.unionByName(done)
        waiting = ranked.filter("_n > 1").drop("_n")


class Parentheses:
    """Balanced parentheses with a range min-max tree over blocks of the excess."""

    def __init__(self, depth: np.ndarray, leaf: np.ndarray):
        """Of nodes in preorder; the last node is closed only if it is a leaf."""
        n = len(depth)
        closes = np.zeros(n, np.int64)  # before each node
        closes[1:] = depth[:-1] - depth[1:] + 1
        self.opens = np.arange(n) + np.cumsum(closes)
        length = int(self.opens[-1]) + 1 + int(bool(leaf[-1])) if n else 0
        bits = np.full(length, -1, np.int64)
        bits[self.opens] = 1
        self.bits, self.excess = bits, np.cumsum(bits)
        # Least excess of every block, then of pairs of blocks, and so on.
        padded = np.full(-(-max(length, 1) // BLOCK_BITS) * BLOCK_BITS, np.iinfo(np.int64).max)
        padded[:length] = self.excess
        self.padded, self.levels = padded, [padded.reshape(-1, BLOCK_BITS).min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.levels.append(low.reshape(-1, 2).min(1))
        self.pairs = np.cumsum((bits == 1) & (np.append(bits[1:], 1) == -1)) if length else bits

    def _scan(self, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block with an excess of at most goal, or -1."""
        out = np.full(len(start), -1, np.int64)
        todo, at = np.arange(len(start)), start.copy()
        for _ in range(BLOCK_BITS):
            if not len(todo):
                break
            hit = self.padded[at] <= goal[todo]
            out[todo[hit]] = at[hit]
            todo, at = todo[~hit], at[~hit] + 1
            go = at % BLOCK_BITS != 0
            todo, at = todo[go], at[go]
        return out

    def findclose(self) -> np.ndarray:
        """The place of every node's closing parenthesis, or -1 where it lies beyond the shard."""
        goal = self.excess[self.opens] - 1
        close, todo = np.full(len(goal), -1, np.int64), np.arange(len(goal))
        start = self.opens + 1
        inner = start % BLOCK_BITS != 0
        close[inner] = self._scan(start[inner], goal[inner])
        todo = np.flatnonzero(close < 0)
        close[todo] = self._blocks(-(-start[todo] // BLOCK_BITS), goal[todo])
        return close

    def _blocks(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place from block ``at`` on with an excess of at most goal, or -1."""
        height = np.full(len(at), -1, np.int64)
        at, live = at.copy(), np.arange(len(at))
        for k, low in enumerate(self.levels):  # climb: this block, its right sibling, then the block after their parent
            for _ in range(2):
                live = live[at[live] < len(low)]
                hit = low[at[live]] <= goal[live]
                height[live[hit]] = k
                live = live[~hit]
                at[live[at[live] % 2 == 0]] += 1
            at[live] = at[live] // 2 + 1
        out = np.full(len(at), -1, np.int64)
        found = np.flatnonzero(height >= 0)
        for k in range(len(self.levels) - 1, 0, -1):  # descend to the first child that reaches the goal
            down = found[height[found] >= k]
            left = at[down] * 2
            at[down] = left + (self.levels[k - 1][left] > goal[down])
        out[found] = self._scan(at[found] * BLOCK_BITS, goal[found])
        return out


SHARD = "depth long, s1 long, s2 long, conv_id long, n_convs long, n_children long, shard long, kind long, parent long, leaves long, saved long, low long"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard of the preorder -> its nodes (kind 0: closed here, 1: spine), the falls of its depth (2) and its totals (3)."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    shard, names = TaskContext.get().partitionId(), [x.strip().split()[0] for x in SHARD.split(",")]
    col = {c: table[c].to_numpy().astype(np.int64) for c in table.column_names}
    depth, n = col["depth"], table.num_rows
    leaf = col["n_children"] == 0
    tree = Parentheses(depth, leaf)
    close = tree.findclose()
    saving = np.cumsum(np.where(depth > 0, (col["n_convs"] - 1) * col["size"], 0))
    place = np.cumsum(tree.bits == 1)  # nodes begun up to every parenthesis
    end = np.where(close < 0, n, place[close])  # first node behind the subtree
    leaves = tree.pairs[np.where(close < 0, len(tree.bits) - 1, close)] - np.where(tree.opens > 0, tree.pairs[tree.opens - 1], 0)
    saved = saving[end - 1] - np.where(np.arange(n) > 0, saving[np.arange(n) - 1], 0)
    parent, last = [], {}
    for d, c in zip(depth.tolist(), col["conv_id"].tolist()):
        last[d] = c
        parent.append(last.get(d - 1))
    # A fall: a depth at which or above which no node of this shard stood before.
    lowest = np.minimum.accumulate(depth)
    falls = np.flatnonzero(np.append(True, lowest[1:] < lowest[:-1]))
    # What a node at these places misses of its parent: siblings at the least depth so far.
    missing = np.array([p is None for p in parent])
    kinds = [
        dict(col, kind=(close < 0).astype(np.int64), leaves=leaves, saved=saved, low=np.where(missing, depth - 1, -2), parent=parent),
        dict(depth=depth[falls], kind=np.full(len(falls), 2), leaves=tree.pairs[tree.opens[falls] - 1] * (falls > 0), saved=saving[falls - 1] * (falls > 0), low=np.append(np.iinfo(np.int64).max, depth[falls][:-1]) - 1),
        dict(kind=np.array([3]), leaves=tree.pairs[-1:], saved=saving[-1:], low=depth[-1:] - leaf[-1:]),  # low: deepest level open at the end
    ]
    for rows in kinds:
        size = len(rows["kind"])
        rows["shard"] = np.full(size, shard)
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], pa.int64()) if c in rows else pa.nulls(size, pa.int64()) for c in names], names)


def shards_of(nodes: DataFrame) -> DataFrame:
    """Nodes with ``first``, the place of their first sequence -> the rows of :func:`_shard`."""
    by = ["first", "depth"]
    rows = nodes.select(*KEY, "conv_id", "n_convs", "n_children", "size", "first").repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize_table(rows.mapInArrow(_shard, SHARD), "trie-shards")


def merged(shards: DataFrame) -> DataFrame:
    """Nodes with n_leaves, saved_tokens and parent_conv_id: spines joined with the shards behind them.

    Per depth, what happens to the spine is a short row of events, at most
    three a shard: a node stays open, a fall closes it, or nodes of a shard ask
    for their parent.  Windows run over these events and over one row a shard.
    """
    by_shard = Window.orderBy("shard")
    total = shards.filter("kind = 3").select(
        F.col("shard").alias("_shard"),
        F.sum("leaves").over(by_shard).alias("leaves_to"),
        F.sum("saved").over(by_shard).alias("saved_to"),
        (F.sum("leaves").over(by_shard) - F.col("leaves")).alias("leaves_at"),
        (F.sum("saved").over(by_shard) - F.col("saved")).alias("saved_at"),
        F.coalesce(F.lag("low").over(by_shard), F.lit(-1)).alias("open"),
    )
    total = materialize_table(total, "trie-totals")
    here = F.col("shard") == F.col("_shard")
    # Places in the whole preorder, counted in leaves and savings.
    stays = shards.filter("kind = 1").join(total, here)
    stays = stays.select("depth", "shard", F.lit(2).alias("event"), "conv_id", (F.col("leaves_to") - F.col("leaves")).alias("leaf"), (F.col("saved_to") - F.col("saved")).alias("save"))
    falls = shards.filter("kind = 2").join(total, here).withColumn("low", F.least("low", "open")).filter("depth <= low")
    falls = falls.select(
        F.explode(F.sequence("depth", "low")).alias("depth"), "shard", F.lit(1).alias("event"), F.lit(None).cast("long").alias("conv_id"), (F.col("leaves_at") + F.col("leaves")).alias("leaf"), (F.col("saved_at") + F.col("saved")).alias("save")
    )
    asks = shards.filter("kind < 2 and low >= 0").select(F.col("low").alias("depth"), "shard").distinct()
    nothing = F.lit(None).cast("long")
    asks = asks.select("depth", "shard", F.lit(0).alias("event"), nothing.alias("conv_id"), nothing.alias("leaf"), nothing.alias("save"))
    along = Window.partitionBy("depth").orderBy("shard", "event")
    falls_only = F.when(F.col("event") == 1, F.struct("leaf", "save"))
    next_fall = F.first(falls_only, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    events = stays.unionByName(falls).unionByName(asks)
    events = events.withColumns({"fall": next_fall, "open_id": F.last("conv_id", ignorenulls=True).over(along)})
    events = materialize_table(events, "trie-events")
    whole = total.agg(F.max("leaves_to").alias("leaf"), F.max("saved_to").alias("save"))
    closed = events.filter("event = 2").select(
        F.col("depth").alias("_depth"),
        F.col("shard").alias("_shard"),
        (F.coalesce("fall.leaf", whole.select("leaf").scalar()) - F.col("leaf")).alias("_leaves"),
        (F.coalesce("fall.save", whole.select("save").scalar()) - F.col("save")).alias("_saved"),
    )
    parents = events.filter("event = 0").select(F.col("depth").alias("_level"), F.col("shard").alias("_in"), F.col("open_id").alias("_parent"))
    out = shards.filter("kind < 2")
    out = out.join(closed, (F.col("kind") == 1) & (F.col("depth") == F.col("_depth")) & here, "left")
    out = out.join(parents, (F.col("low") == F.col("_level")) & (F.col("shard") == F.col("_in")), "left")
    return out.select(
        *KEY,
        "conv_id",
        F.coalesce("parent", "_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("_leaves", "leaves").alias("n_leaves"),
        F.coalesce("_saved", "saved").alias("saved_tokens"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (KEY, conv_id) -> (KEY, least id, ids joined by commas) of bounded length."""
    names = [*KEY, "first", "ids"]
    key, ids, chars = None, [], 0
    for batch in batches:
        rows = []
        for *k, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key or chars > CHUNK_CHARS:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids, chars = k, [], 0
            ids.append(conv)
            chars += 21
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    if ids:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, ids[0], ",".join(map(str, ids)))))])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> the SHA-256 of every node's joined ids, as a running hash."""
    names = [*KEY, "ends"]
    key, state = None, None
    for batch in batches:
        rows = []
        for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if k == key:
                state.update(b",")
            else:
                if state:
                    rows.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest())))])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(KEY, ends): ids are joined where they were sorted, so that a node with many ends meets as few long rows."""
    by = [*KEY, "conv_id"]
    kinds = "depth long, s1 long, s2 long"
    chunks = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, f"{kinds}, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, f"{kinds}, ends string")


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", sorted_turns: int = SORTED_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize_table(turns_of(df, conv_col, turn_col, role_col, text_col), "trie-turns")
    convs, rows = rebuilt(turns)
    paths = prefixes(rows)
    places = sequence_places(paths, sorted_turns)
    nodes = paths.join(places, "conv_id", "left").groupBy(*KEY)
    nodes = nodes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("place").alias("first"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", zero.alias("size"), F.lit(1).cast("long").alias("first"), zero.alias("p1"), zero.alias("p2"))
    nodes = materialize_table(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count(F.lit(1)).alias("n_children"))
    shards = shards_of(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    turnless = convs.filter("turns = 0").select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id")
    ends = end_hashes(paths.filter("depth = turns").select(*KEY, "conv_id").unionByName(turnless))
    none = hashlib.sha256(b"").hexdigest()
    out = merged(shards).join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(none)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

"""Mix sources to target weights with blocks, drawn shards and index permutations.

The words of every source form one stream (its documents in the order of a
mixing hash of id, size and text), packed into blocks of ``BLOCK_WORDS`` words.  A source whose target is t words
gets n = t / (mean block words) output slots, at most two per block.

* Every slot of a source draws its output shard by a mixing hash, so the counts
  of the sources in a shard are multinomial draws, conditioned on the sources'
  totals.  ``mix_sources`` names the shards that take of a document, and
  ``mixed_documents(..., shards=True)`` deals the mix by them.
* Slot i of a source goes to block ``perm(i mod blocks)``, where ``perm`` is a
  keyed permutation of 0..blocks-1 (swap-or-not shuffle): the slots of one pass
  use every block once, a partial pass uses a pseudorandom subset.
* Slots meet the blocks' pieces by (source, block index).

Only DataFrame functions are used.  Draws are arithmetic on indices with fixed
constants, and the shards a hash with a fixed seed, so reruns agree, and SQL can
state the same words taken.

Defined results: a null text or one without words has size 0 and takes 0; the
null source is a source of its own, last in order; null ids are ordinary ids;
rows repeating an id are separate documents; a source without words has target
0; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.functions.stats import group_rank
from tavola.llm.common import SPACE_CLASS, one_per_key, packed, same_row, text_key, word_count
from tavola.session import materialize_table

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 1024
WEIGHTS = (3, 1, 2)
SHARE = 1.5
ROUNDS = 12
PRIME = 2_147_483_647
SHARD_SEED = 784_588_716


def mixed_number(*parts: Column | str) -> Column:
    """32 mixed bits of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def round_keys(rounds: int = ROUNDS, seed: int = 20_240_917) -> list[tuple[int, int, int]]:
    """(shift, factor, addend) of every round, from a linear congruence."""
    keys, x = [], seed
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48_271 + 11) % PRIME
            row.append(x)
        keys.append((row[0], row[1] | 1, row[2]))
    return keys


def permuted(df: DataFrame, index: str, size: str, key: str, out: str) -> DataFrame:
    """``out`` = keyed permutation of 0..size-1 applied to ``index``.

    Swap-or-not: in each round an index and its partner (shift - index mod
    size) change places if a bit drawn from the larger of the two is set.
    Every round is its own inverse, so the whole is one to one for any size.
    """
    n, k = F.col(size), F.col(key)
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("shift"), F.lit(b).cast("long").alias("factor"), F.lit(c).cast("long").alias("addend")) for a, b, c in round_keys()])

    def swap(x: Column, key: Column) -> Column:
        partner = ((key["shift"] + k * 40_503) % n - x + n) % n
        drawn = ((F.greatest(x, partner) % PRIME) * key["factor"] + key["addend"] + k * 69_069) % PRIME
        return F.when(F.floor(drawn / 65_536) % 2 == 1, partner).otherwise(x)

    return df.withColumn(out, F.aggregate(keys, F.col(index).cast("long"), swap))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ord, source_size, weight, target, blocks, slots.

    Sources in code-point order, null last, weigh 3, 1, 2, repeating.  The
    level of words per weight starts at total / weights; sources above twice
    their size stop there and the rest is shared anew until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = group_rank(per.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], rank_col="_rn")
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("_rn") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = materialize_table(ranked.select("source", "source_size", (F.col("_rn") - 1).alias("ord"), weigh.cast("long").alias("weight")), "mix-sources")

    total, level, stopped = per.agg(F.sum("source_size")).first()[0] or 0, -1.0, -1
    while total:
        above = 2.0 * F.col("source_size") < F.lit(level) * F.col("weight")
        fixed, n, free = per.agg(
            F.coalesce(F.sum(F.when(above, 2 * F.col("source_size"))), F.lit(0)), F.count(F.when(above, 1)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (SHARE * total - fixed) / free
    target = F.least(2.0 * F.col("source_size"), F.lit(max(level, 0.0)) * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / F.lit(float(BLOCK_WORDS)))
    per = per.withColumn("target", target.cast("double")).withColumn("blocks", blocks.cast("long"))
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    return per.withColumn("slots", slots.cast("long"))


def buckets_of(documents: int) -> int:
    """Buckets of a source's stream: as many as a bucket then holds documents."""
    return max(1, math.isqrt(max(0, documents - 1)) + 1)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *keep: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's stream, sources).

    The stream's order is that of the MD5 of id, size and text, whose first bits
    are the bucket.  Running sums go by (source, bucket) and then over the bucket
    totals, so that no task holds a source, whatever its ids are; the number of
    buckets follows the number of documents.
    """
    size, text = word_count(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), size.cast("string"), text))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), order.alias("order_key"), *keep)
    sizes = materialize_table(sizes, "mix-sizes")
    per = materialize_table(source_targets(sizes), "mix-targets")
    buckets = buckets_of(sizes.count())
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size", "order_key")]
    bucket = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") % F.lit(buckets)
    rows = (
        sizes.withColumn("_null", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(per.withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))), ["_null", "source"])
        .select("doc_id", "size", "ord", "source_size", "target", "blocks", "slots", *extra, "order_key", bucket.alias("_bucket"))
    )
    inside = Window.partitionBy("ord", "_bucket").orderBy("order_key", *extra).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("ord").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("ord", "_bucket").agg(F.sum("size").alias("_sum"))
    starts = starts.select("ord", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["ord", "_bucket"])
    placed = rows.withColumn("at", (F.col("_start") + F.col("_in")).cast("long")).drop("_bucket", "_start", "_in", "order_key")
    return materialize_table(placed, "mix-streams"), per


def output_slots(placed: DataFrame, per: DataFrame) -> DataFrame:
    """Every output slot: ord, pass, slot, shard, block.

    A block belongs to the document that holds its first word, which makes the
    block indices, and from them the slots, without any task listing a source.
    """
    size = F.lit(BLOCK_WORDS)
    first, last = F.ceil(F.col("at") / size).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / size).cast("long")
    own = placed.filter((F.col("size") > 0) & (first <= last)).select("ord", "blocks", "slots", F.explode(F.sequence(first, last)).alias("_index"))
    slots = own.select("ord", "blocks", "slots", "_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))
    slots = slots.withColumn("slot", F.col("_index") + F.col("pass") * F.col("blocks")).filter("slot < slots")
    shards = max(1, -(-(per.agg(F.sum("slots")).first()[0] or 0) // SLOTS_PER_SHARD))
    slots = slots.withColumn("shard", drawn_shard(F.col("ord"), F.col("slot"), shards))
    slots = slots.withColumn("_key", F.col("ord") * 2 + F.col("pass"))
    return permuted(slots, "_index", "blocks", "_key", "block").select("ord", "pass", "slot", "shard", "block")


def drawn_shard(ord_: Column, slot: Column, shards: int) -> Column:
    """0..shards-1, drawn for every slot by itself."""
    return mixed_number(F.lit(str(SHARD_SEED)), ord_.cast("string"), slot.cast("string")) % F.lit(shards)


def shard_counts(slots: DataFrame) -> DataFrame:
    """The drawn number of slots of every source in every shard."""
    return slots.groupBy("shard", "ord").agg(F.count(F.lit(1)).alias("slots"))


def pieces(placed: DataFrame) -> DataFrame:
    """Every part of a document inside one block: ord, at, block, from_word, words."""
    size = F.lit(BLOCK_WORDS)
    first, last = F.floor(F.col("at") / size).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / size).cast("long")
    cut = placed.filter("size > 0").select("ord", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.col("at"), F.col("block") * size), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * size)
    return cut.select("ord", "at", "block", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"))


def mixed_pieces(docs: DataFrame, *args, **kw) -> tuple[DataFrame, DataFrame]:
    """(placed documents, the pieces the mix takes with pass, shard and slot)."""
    placed, per = streams(docs, *args, **kw)
    return placed, output_slots(placed, per).join(pieces(placed), ["ord", "block"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, shards (those that take of it, ascending, joined by commas)."""
    placed, taken = mixed_pieces(docs, id_col, text_col, source_col)
    words = taken.groupBy("ord", "at").agg(F.sum("words").alias("_taken"), F.array_join(F.sort_array(F.collect_set("shard")).cast("array<string>"), ",").alias("_shards"))
    words = words.withColumnRenamed("ord", "_ord").withColumnRenamed("at", "_at")
    on = (F.col("ord") == F.col("_ord")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0)
    out = placed.join(words, on, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("_shards", F.lit("")).alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: bool = False) -> DataFrame:
    """The mix itself, with the input's columns: one row per document and pass that takes of it.

    With ``shards`` one row per document, pass and shard: a struct ``row`` of the
    input's columns, the shard, and its position there (source, least slot,
    place in the source's stream).

    The text is what the pass takes: the whole text, or the stretches of words
    that fall in taken blocks, in order, each on a line of its own.  Rows that
    repeat an id and a text are documents of their own; of their other columns
    the least by content are returned.
    """
    placed, taken = mixed_pieces(docs, id_col, text_col, source_col, text_key(F.col(text_col)).alias("key_text"))
    cuts = F.sort_array(F.collect_list(F.struct("from_word", "words")))
    position = F.struct("ord", F.min("slot").alias("slot"), "at")
    takes = taken.groupBy("ord", "at", "pass", *(["shard"] if shards else [])).agg(cuts.alias("cuts"), F.sum("words").alias("taken"), position.alias("position"))
    one = F.struct("pass", *(["shard"] if shards else []), "position", "taken", "cuts")
    takes = takes.groupBy("ord", "at").agg(F.sort_array(F.collect_list(one)).alias("takes"))
    takes = placed.filter("size > 0").join(takes, ["ord", "at"]).select(F.col("doc_id").alias("key_id"), "key_text", "size", "takes")
    takes = materialize_table(takes, "mix-takes")
    rows = packed(docs, id_col, text_col)
    if not placed.groupBy("doc_id", "key_text").count().filter("count > 1").isEmpty():
        rows = one_per_key(rows)
    text = F.col("row")[text_col].cast("string")
    # Words are cut out once per document, however many takes there are.
    words = F.when(F.exists("takes", lambda t: t["taken"] != F.col("size")), F.regexp_extract_all(text, F.lit("([^" + SPACE_CLASS[1:] + "+" + SPACE_CLASS + "*)"), F.lit(1)))
    kept = lambda t: [t["shard"].alias("shard"), t["position"].alias("position")] if shards else []
    texts = lambda all_: F.transform("takes", lambda t: F.struct(F.when(t["taken"] == F.col("size"), text).otherwise(_stretches(all_, t["cuts"])).alias("text"), *kept(t)))
    out = rows.join(takes, same_row(rows, takes)).select("row", F.explode(F.transform(F.array(words), texts)[0]).alias("take"))
    out = out.select(F.col("row").withField(f"`{text_col}`", F.col("take.text")).alias("row"), *(["take.shard", "take.position"] if shards else []))
    return out if shards else out.select("row.*")


def _stretches(words: Column, cuts: Column) -> Column:
    """The words of ``cuts`` with the white space between them; a gap between cuts ends a line."""
    start = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(runs: Column, cut: Column) -> Column:
        lo, hi, last = cut["from_word"], cut["from_word"] + cut["words"], F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["lo"].alias("lo"), hi.alias("hi"))))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["hi"] == lo), grown).otherwise(F.concat(runs, F.array(F.struct(lo.alias("lo"), hi.alias("hi")))))

    cut = lambda r: F.regexp_replace(F.array_join(F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""), SPACE_CLASS + r"+\z", "")
    return F.array_join(F.transform(F.aggregate(cuts, start, add), cut), "\n")

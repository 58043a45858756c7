"""Line dedup: maximal repeated line runs from suffix ranks over line-id sequences.

The lines with a word of all documents form sequences of line ids (128-bit
hashes).  Distributed prefix doubling ranks the suffixes of these sequences:
ranks of the first 2^j lines come from pairs of ranks of 2^(j-1) lines, by one
global sort of the distinct repeated pairs per round.  Suffixes that are already
alone are dropped, they belong to no longer repeated run, and doubling goes on
until none is left.

Suffixes that share their first 2^j lines form an interval of the suffix array;
its home is its first suffix in document order.  A suffix that is not the home
of its interval starts a later copy.  The deepest such interval gives the
suffix it copies, and their longest common prefix, found by comparing ranks from
the deepest level down, is the repeated run: it is deleted whole.  A start that
copies the line behind the one its predecessor copies is part of the
predecessor's run.  A run has one line or more, so every line that stands
anywhere earlier goes.

Defined results: a null text counts as empty; lines without a word are in no
run and stay; rows with equal id and text count as one document and get equal
results, rows with equal id and different texts come in order of a hash of the
text; null ids come last; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.functions.stats import group_rank
from tavola.llm.common import SPACE_CLASS, id_key, packed, release, same_row
from tavola.session import materialize_table

KEY = ["no_id", "id", "text_hash"]


def _has_word(line: Column) -> Column:
    return line.rlike(SPACE_CLASS.replace("[", "[^", 1))


def worded_lines(text: Column) -> Column:
    """[(line number, line)] of the lines with a word."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    return F.filter(numbered, lambda x: _has_word(x["text"]))


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with a word: the document's key, at, line_id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*id_key(docs, id_col), F.xxhash64(text).alias("text_hash"), worded_lines(text).alias("lines"))
    ids = F.transform("lines", lambda x: F.unhex(F.md5(x["text"])))
    return rows.select(*KEY, F.posexplode(ids).alias("at", "line_id")).repartition(*KEY).dropDuplicates([*KEY, "at"])


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Per j: (key, at, rank, home) of the suffixes whose first 2^j lines occur again, until there are none."""
    levels: list[DataFrame] = []
    named = lines.select(*KEY, "at", "line_id")
    by: list[str] = ["line_id"]
    while True:
        classes = named.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*KEY, "at")).alias("home"))
        again = materialize_table(classes.filter("_n > 1").drop("_n"), "line-pairs")
        if again.isEmpty():
            release(again)
            return levels
        names = materialize_table(group_rank(again, [], by, rank_col="_named"), "line-names")
        level = materialize_table(named.join(names, by).select(*KEY, "at", F.col("_named").alias("rank"), "home"), "line-ranks")
        release(again, names)
        half = 1 << len(levels)
        levels.append(level)
        ahead = Window.partitionBy(*KEY).orderBy("at").rangeBetween(half, half)
        by = ["rank", "next"]
        named = level.withColumn("next", F.max("rank").over(ahead)).filter("next is not null").select(*KEY, "at", *by)


def copied_runs(levels: list[DataFrame]) -> DataFrame:
    """(key, at, lines): the later copies, each with its longest common prefix with what it copies."""
    place = F.struct(*KEY, "at")
    starts = None
    for j, level in enumerate(levels):
        later = level.filter(place > F.col("home")).select(*KEY, "at", "home", F.lit(j).alias("j"))
        starts = later if starts is None else starts.unionByName(later)
    starts = starts.groupBy(*KEY, "at").agg(F.max(F.struct("j", "home")).alias("m")).select(*KEY, "at", "m.j", "m.home")
    before = F.lag(F.struct(F.col("at") + 1, F.col("home").withField("at", F.col("home.at") + 1))).over(Window.partitionBy(*KEY).orderBy("at"))
    follows = before.eqNullSafe(F.struct("at", "home"))
    runs = materialize_table(starts.withColumn("_follows", follows).filter("not _follows").select(*KEY, "at", "home", "j", F.expr("shiftleft(1, j)").alias("lines")), "line-heads")
    for k in reversed(range(len(levels) - 1)):
        # Where both go on with the same 2^k lines, the run does.
        own = levels[k].select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("at").alias("_at"), F.col("rank").alias("_own"))
        its = levels[k].select(F.struct(*KEY, "at").alias("_its_place"), F.col("rank").alias("_its"))
        longer = runs.filter(F.col("j") > k)
        longer = longer.join(own, [*(F.col(c) == F.col(f"_{c}") for c in KEY), F.col("at") + F.col("lines") == F.col("_at")])
        longer = longer.join(its, F.col("home").withField("at", F.col("home.at") + F.col("lines")) == F.col("_its_place")).filter("_own = _its")
        longer = longer.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("at").alias("_at"), F.lit(1 << k).alias("_more"))
        grown = runs.join(longer, [*(F.col(c) == F.col(f"_{c}") for c in KEY), F.col("at") == F.col("_at")], "left")
        grown = materialize_table(grown.select(*KEY, "at", "home", "j", (F.col("lines") + F.coalesce("_more", F.lit(0))).alias("lines")), "line-heads")
        release(runs)
        runs = grown
    return runs.select(*KEY, "at", "lines")


def later_copies(lines: DataFrame) -> DataFrame:
    """(key, gone, longest): per document the places, among its lines with a word, of later copies, and its longest run."""
    lines = materialize_table(lines, "lines")
    levels = suffix_ranks(lines)
    if not levels:
        return lines.limit(0).select(*KEY, F.array("at").alias("gone"), F.col("at").alias("longest"))
    runs = copied_runs(levels)
    gone = runs.select(*KEY, "lines", F.explode(F.sequence("at", F.col("at") + F.col("lines") - 1)).alias("at"))
    gone = materialize_table(gone.groupBy(*KEY).agg(F.sort_array(F.collect_set("at")).alias("gone"), F.max("lines").alias("longest")), "line-copies")
    release(lines, runs, *levels)
    return gone


def _without_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kept, n_lines, n_removed, n_runs, longest_run): whole rows with their text after the cut."""
    gone = later_copies(line_sequences(docs, id_col, text_col))
    gone = gone.select(F.when(~F.col("no_id"), F.col("id")).alias("key_id"), F.col("text_hash").alias("key_text"), "gone", "longest")
    rows = packed(docs, id_col, text_col)
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    out = rows.join(gone, same_row(rows, gone), "left").withColumn("numbers", F.transform(worded_lines(text), lambda x: x["line"]))
    out = out.withColumn("places", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("places", lambda i: F.get("numbers", i)))
    cut = F.array_join(F.transform(F.array(lines), lambda own: F.transform(stay, lambda i: F.get(own, i)))[0], "\n")
    runs = F.size(F.array_except("places", F.transform("places", lambda i: i + 1)))
    return out.select(
        "row",
        "id",
        F.when(F.size("places") == 0, text).otherwise(cut).alias("kept"),
        F.size("numbers").cast("long").alias("n_lines"),
        F.size("places").cast("long").alias("n_removed"),
        runs.cast("long").alias("n_runs"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, the texts freed of later copies (a null text stays null)."""
    out = _without_copies(docs, id_col, text_col)
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    return out.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_removed (lines with a word), n_runs (unbroken stretches deleted), longest_run (lines of the longest copy), text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _without_copies(rows, "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", "longest_run", F.col("kept").alias("text"))

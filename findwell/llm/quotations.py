"""Operator 10. Chat formatting by quotation linking.

A message's lines are parsed into quote levels (their leading ``>`` marks, spaces between them
allowed). Consecutive lines of one level are one passage; it is normalised (marks off, lower case,
single spaces), so a quote that was wrapped anew stays the same passage, and hashed as its runs of
``K`` words (a shorter passage: all its words). The same is done with what messages wrote
themselves, by paragraph; there a line of fewer than ``K`` words also counts by itself. Each hashed
run of a quoted passage is joined to the latest earlier message of the conversation that wrote it,
and the passage is linked to the message that most of its runs lead to (ties: the latest). The
message that most runs of a reply's level-1 passages lead to is the reply's parent (ties: the
latest). So a common short line, which is one run, decides nothing against a longer passage.

Each message gets its parent, the first message of its thread and its depth below it. In the order
of conversation, thread and turn every reply comes after what it answers. Own text is what is left
without quoted lines and the "... wrote:" lines that introduce them.

The join is an as-of window over (conversation, run, range of ``TURNS`` turns), with the latest
source of earlier ranges carried in, and fed only with runs that are quoted at all: a run that
everyone writes or quotes makes a row each time, never a pair, and no window grows with the length
of a conversation. Threads are resolved by pointer doubling: n replies in a row take log n rounds.

Defined cases: null text is empty; a message without quotes, or whose quotes match nothing, starts
a thread; a null conv_id or turn takes no part in linking and has no thread; rows repeated with one
(conv_id, turn) are one message for linking and all come out; a very long text is read whole; an
empty table gives no rows; other columns than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.llm.common import Scratch

K = 5
#: Turns that share a window.
TURNS = 512
_MARKS = r"^((?:[ \t]*>)+)"
_INTRODUCES = r"(?i)^.*\bwrote:\s*$"


def _strip(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parsed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines: array of (level, body). A line that introduces a quoted passage
    has level -1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def line(x):
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", "")).cast("int")
        return F.struct(level.alias("level"), F.when(level > 0, _strip(F.substring(x, F.length(marks) + 1, F.length(x)))).otherwise(x).alias("body"))

    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.transform(F.split(text, r"\r?\n"), line).alias("given"))
    quoted_next = lambda i: F.coalesce(F.get("given", i + 1)["level"] > 0, F.lit(False))
    level = lambda x, i: F.when((x["level"] == 0) & quoted_next(i) & x["body"].rlike(_INTRODUCES), -1).otherwise(x["level"])
    return marked.withColumn("lines", F.transform("given", lambda x, i: F.struct(level(x, i).alias("level"), x["body"].alias("body")))).drop("given")


def own_text(lines):
    """The lines at level 0."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])
    return _strip(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"))


def _words(body: Column) -> Column:
    return F.filter(F.split(F.lower(body), r"\s+"), lambda w: w != "")


def _runs(words: Column) -> Column:
    """Hashes of the runs of K words; of all words, if they are fewer; none of no words."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(1)))
    found = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, K), " ")))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))


def passage_runs(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, passage, run): the distinct runs of each message's passages, those that
    it quotes or those at level 0, which it wrote itself. A passage, known by its words' hash, starts at a line that is not
    blank and has a blank line or another level before it."""
    flat = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    blank = lambda x: _strip(x["body"]) == ""
    before = lambda i: F.get("lines", i - 1)
    starts = lambda x, i: ~blank(x) & ((i == 0) | (before(i)["level"] != x["level"]) | blank(before(i)))
    marked = F.transform("lines", lambda x, i: F.when(F.coalesce(starts(x, i), F.lit(True)), i))
    flat = flat.withColumn("starts", F.filter(marked, lambda i: i.isNotNull()))
    body = lambda s, k: F.array_join(F.transform(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), lambda x: x["body"]), " ")
    whole = F.transform("starts", lambda s, k: F.struct(F.get("lines", s)["level"].alias("level"), _words(body(s, k)).alias("words")))
    own = F.filter(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: F.struct(x["level"].alias("level"), _words(x["body"]).alias("words"))), lambda x: F.size(x["words"]) < K)
    flat = flat.select("conv_id", "turn", F.explode(F.filter(whole, lambda x: x["level"] > 0) if quoted else F.concat(F.filter(whole, lambda x: x["level"] == 0), own)).alias("p"))
    flat = flat.select("conv_id", "turn", "p.level", F.xxhash64(F.array_join("p.words", " ")).alias("passage"), F.col("p.words").alias("words"))
    runs = flat.select("conv_id", "turn", "level", F.when(F.col("level") > 0, F.col("passage")).alias("passage"), F.explode(_runs(F.col("words"))).alias("run"))
    return runs.distinct()


def linked_runs(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, source): each quoted run with the latest earlier turn that
    wrote it. Only messages with a quote, and the conversations that have any, are cut into runs."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    quoting = rows.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quotes = passage_runs(parsed(quoting), True)
    wrote = passage_runs(parsed(rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")), False)
    wrote = wrote.join(quotes.select("conv_id", "run").distinct(), ["conv_id", "run"], "left_semi")
    events = quotes.unionByName(wrote.select(*quotes.columns)).withColumn("stretch", F.floor(F.col("turn") / TURNS)).withColumn("wrote", F.when(F.col("level") == 0, F.col("turn")))
    key = ["conv_id", "run"]
    # at one turn quotes come first, so that a message is no source of itself
    within = Window.partitionBy(*key, "stretch").orderBy("turn", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*key, "stretch").agg(F.max("wrote").alias("top")).withColumn("carried", F.max("top").over(earlier)).drop("top")
    found = events.withColumn("near", F.last("wrote", ignorenulls=True).over(within)).where("level > 0").join(carried, [*key, "stretch"])
    return found.select("conv_id", "turn", "level", "passage", F.coalesce("near", "carried").alias("source")).where("source < turn")


def threads(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, root_turn, depth) for replies (conv_id, turn, parent): each round a reply
    takes over how far the message above it has come."""
    state, step = scratch.keep(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "threads0"), 0
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        step += 1
        new = scratch.keep(joined, f"threads{step}")
        scratch.drop(f"threads{step - 1}")
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def linked(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per message: conv_id, turn, role, parent_turn, root_turn, depth, quoted_turns, n_quoted (lines),
    text."""
    scratch = scratch or Scratch(rows.sparkSession, "quotations")
    messages = parsed(rows)
    links = scratch.keep(linked_runs(rows).groupBy("conv_id", "turn", "level", "passage", "source").agg(F.count("*").alias("n")), "links")
    votes = links.where("level = 1").groupBy("conv_id", "turn", "source").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", "source")).alias("best")
    parents = scratch.keep(votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.source").alias("parent_turn")), "parents")
    sources = links.groupBy("conv_id", "turn", "level", "passage").agg(best).select("conv_id", "turn", F.col("best.source").alias("source"))
    quoted = sources.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set("source")).alias("quoted_turns"))
    found = quoted.join(parents, ["conv_id", "turn"], "left").join(threads(parents.withColumnRenamed("parent_turn", "parent"), scratch), ["conv_id", "turn"], "left")
    n_quoted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["body"] != ""))).cast("long")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return messages.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.when(known, F.coalesce("root_turn", "turn")).alias("root_turn"), F.when(known, F.coalesce("depth", F.lit(0))).cast("long").alias("depth"),
        F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"), n_quoted.alias("n_quoted"), own_text(F.col("lines")).alias("text"),
    )


def in_reply_order(messages: DataFrame) -> DataFrame:
    """The messages sorted by conversation, thread and turn, over range partitions."""
    return messages.repartitionByRange("conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn")


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_reply_order(linked(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

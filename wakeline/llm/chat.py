"""Chat formatting by quotation linking, in DataFrame operations only.

A quoted line starts with one or more ">" marks; their number is its level. A run of lines of one level without an empty
line is a passage; level 0 is the message's own. Passages are normalised (marks removed, lower case, white space and line
ends squeezed) and hashed, and a quoted passage is linked to the latest earlier message of its conversation that holds the
same passage of its own, so re-wrapped quotations are found: an as-of join on (conversation, hash, text) by turn. A line
of a passage that is found nowhere as a whole is linked by itself in the same way. Texts are compared, not only hashes. A
message answers the message that most of its first-level lines come from, the later one on a tie. Deeper levels are
linked in the same way and counted, but don't decide: what they quote, the quoted message quotes itself. Threads are the trees of answers;
a thread's messages in order of turn have every answer after what it answers. Quoted lines, and the line before a passage
that only announces it ("... wrote:"), are left out of the formatted text.

A passage that is frequent in a conversation is never paired with all its places: places are reduced to one message a
turn, cut into ranges of RANGE_TURNS turns, and what a range inherits from those before it is one value. Places within
a thread are counted by the same ranges, and a conversation is given in parts of PART_MESSAGES.

Defined results: an empty table gives no rows; null and empty texts quote nothing and are formatted as empty; a null
conversation or turn is never linked and has place 0; messages of one turn never answer each other, and among those of
one turn the one of greatest digest stands for them; repeated rows are formatted one by one; very long messages are
handled whole, as one group of lines; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import written

RANGE_TURNS = 512
PART_MESSAGES = 256
MOST_DEPTH = 64
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_ANNOUNCES = r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,40}:\s*$"
_UNIT = ["conv_id", "hash", "text"]


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def numbered(conversations: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, text, digest); written, so that row numbers are the same each time it is read."""
    digest = F.md5(F.concat(F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    return written(conversations.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", digest.alias("digest")), "messages")


def passages(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, digest, level, passage, at, text): lines that are not empty, and the passage each is in."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    split = known.select("row", "conv_id", "turn", "digest", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    lines = split.select("row", "conv_id", "turn", "digest", "at", F.length(F.regexp_replace(F.regexp_extract("line", _MARKS, 1), "[^>]", "")).alias("level"), normalised(F.col("line")).alias("text"))
    before = W.partitionBy("row").orderBy("at")
    new = (F.col("text") == "") | (F.lag("text").over(before) == "") | (F.lag("level").over(before) != F.col("level"))
    lines = lines.withColumn("new", F.when(new, 1).otherwise(0))
    return lines.withColumn("passage", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0))).where("text <> ''").drop("new")


def _latest(quotes: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, hash, text, turn, original) of quotes: the latest earlier place of the same text, or null."""
    of_range = F.floor(F.col("turn") / RANGE_TURNS).alias("range")
    quotes = quotes.select(*_UNIT, "turn").distinct()
    places = places.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    place = F.struct("turn", "digest", "row")
    none = F.lit(None).cast("struct<turn: bigint, digest: string, row: bigint>")
    places = places.groupBy(*_UNIT, "turn").agg(F.max(place).alias("own"))
    # the latest place of the ranges before
    both = quotes.select(*_UNIT, of_range).distinct().withColumn("last", none).union(places.groupBy(*_UNIT, of_range).agg(F.max("own").alias("last")))
    by_range = both.groupBy(*_UNIT, "range").agg(F.max("last").alias("last"))
    earlier = W.partitionBy(*_UNIT).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = by_range.withColumn("carried", F.max("last").over(earlier)).drop("last")
    # the latest earlier place of the same range
    turns = quotes.select(*_UNIT, "turn").withColumn("own", none).union(places.select(*_UNIT, "turn", "own")).groupBy(*_UNIT, "turn").agg(F.max("own").alias("own"))
    turns = turns.withColumn("range", F.floor(F.col("turn") / RANGE_TURNS))
    within = W.partitionBy(*_UNIT, "range").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    found = turns.withColumn("near", F.max("own").over(within)).join(carried, [*_UNIT, "range"])
    return quotes.join(found.select(*_UNIT, "turn", F.coalesce("near", "carried").alias("original")), [*_UNIT, "turn"])


def quoted_lines(lines: DataFrame) -> DataFrame:
    """(row, turn, level, original) of each quoted line of passages()."""
    hashed = F.xxhash64("text").alias("hash")
    whole = lines.groupBy("row", "conv_id", "turn", "digest", "level", "passage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    whole = written(whole.select("*", hashed), "passages")
    found = _latest(whole.where("level > 0"), whole.where("level = 0"))
    by_passage = whole.where("level > 0").join(found, [*_UNIT, "turn"]).select("row", "passage", F.col("original").alias("whole"))
    quotes = written(lines.where("level > 0").join(by_passage, ["row", "passage"]).select("row", "conv_id", "turn", "level", "at", "text", hashed, "whole"), "quotes")
    single = _latest(quotes.where("whole is null"), lines.where("level = 0").select("row", "conv_id", "turn", "digest", "text", hashed))
    return quotes.join(single, [*_UNIT, "turn"], "left").select("row", "turn", "level", F.coalesce("whole", "original").alias("original"))


def _answers(quotes: DataFrame) -> DataFrame:
    """(row, answered, reply_to, n_quoted, n_linked): answered is the row that a message answers, reply_to its turn."""
    votes = quotes.groupBy("row", "original").agg(F.count_if(F.col("level") == 1).alias("votes"), F.count("*").alias("lines"))
    best = F.max(F.when(F.col("original").isNotNull() & (F.col("votes") > 0), F.struct("votes", "original")))["original"]
    return votes.groupBy("row").agg(best["row"].alias("answered"), best["turn"].alias("reply_to"), F.sum("lines").alias("n_quoted"), F.sum(F.when(F.col("original").isNotNull(), F.col("lines")).otherwise(0)).alias("n_linked"))


def _roots(answers: DataFrame) -> DataFrame:
    """(row, root): the first message of the thread of each message that answers another, by pointer doubling."""
    now = written(answers.where("answered is not null").select("row", F.col("answered").alias("root")), "threads")
    for _ in range(MOST_DEPTH):
        above = now.select(F.col("row").alias("root"), F.col("root").alias("above"))
        if not now.join(above, "root", "left_semi").head(1):
            return now
        now = written(now.join(above, "root", "left").select("row", F.coalesce("above", "root").alias("root")), "threads")
    raise RuntimeError("threads deeper than 2 ** MOST_DEPTH")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their place, from 0, in their thread by turn; only messages of one range of turns are sorted together."""
    rows = rows.withColumn("range", F.floor(F.col("turn") / RANGE_TURNS))
    counts = rows.groupBy("root", "range").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("root").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = W.partitionBy("root", "range").orderBy("turn", "digest", "row")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(counts.select(F.col("root").alias("__root"), F.col("range").alias("__range"), "ahead"), F.col("root").eqNullSafe(F.col("__root")) & F.col("range").eqNullSafe(F.col("__range")), "left")
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    return placed.withColumn("place", F.when(alone, F.lit(0)).otherwise(F.col("ahead") + F.col("place")).cast("long")).drop("range", "ahead", "__root", "__range")


def unquoted(text: Column) -> Column:
    """The text without quoted lines and without lines that announce a quotation."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: ~x.rlike(_MARKS) & ~(x.rlike(_ANNOUNCES) & F.coalesce(F.get(lines, i + 1).rlike(_MARKS), F.lit(False))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+\z", "")


def _formatted(conversations: DataFrame, template: str) -> DataFrame:
    messages = numbered(conversations)
    answers = written(_answers(quoted_lines(passages(messages))), "answers")
    threads = _roots(answers)
    own = messages.select("row", "conv_id", "turn", "digest").join(answers, "row", "left").join(threads, "row", "left").withColumn("root", F.coalesce("root", "row"))
    first = messages.select(F.col("row").alias("root"), F.col("turn").alias("thread"))
    # rows that answer nothing are their own thread
    linked = _placed(own).join(first.join(threads.select("root").distinct(), "root", "left_semi"), "root", "left")
    texts = messages.select("row", "role", unquoted(F.col("text")).alias("text"))
    head, middle, tail = template.split("%s")
    formatted = F.concat(F.lit(head), F.coalesce("role", F.lit("user")), F.lit(middle), "text", F.lit(tail))
    zero = F.lit(0).cast("long")
    return linked.join(texts, "row").select("root", "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), "place", F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), "text", formatted.alias("formatted"))


TEMPLATE = "<|%s|>\n%s\n<|end|>"


def format_chat(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per message: what it answers, its thread (the first message's turn) and place there, and its text without
    quotes, plain and in the chat template (role, text)."""
    return _formatted(conversations, template).drop("root")


def chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, thread, part, messages, chat): reply-ordered conversations without quotes, PART_MESSAGES in a part."""
    part = F.floor(F.col("place") / PART_MESSAGES).alias("part")
    rows = _formatted(conversations, template).groupBy("root", "conv_id", "thread", part).agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "reply_to", "text", "formatted"))).alias("messages"))
    return rows.select("conv_id", "thread", "part", "messages", F.array_join(F.transform("messages", lambda m: m["formatted"]), "\n").alias("chat"))


def with_quotations(conversations: DataFrame) -> DataFrame:
    """conversations in which each message quotes the one before it, in one of four manners by turn: whole and
    re-wrapped, whole with what that one follows as a second level, its last line alone, or not at all. For tests of
    linking on tables that quote nothing."""
    turn = F.col("turn").cast("long")
    before = conversations.where("text is not null").groupBy(F.col("conv_id").alias("__conv"), (turn + 1).alias("__turn")).agg(F.max("text").alias("__before"))
    older = before.select(F.col("__conv").alias("__conv2"), (F.col("__turn") + 1).alias("__turn2"), F.col("__before").alias("__older"))
    own = conversations.join(before, (F.col("conv_id") == F.col("__conv")) & (turn == F.col("__turn")), "left").join(older, (F.col("conv_id") == F.col("__conv2")) & (turn == F.col("__turn2")), "left")
    newline = F.lit("\n")
    quote = F.concat(F.lit("> "), F.replace("__before", newline, F.lit("\n> ")))
    wrapped = F.concat(F.lit("> "), F.replace(F.replace("__before", newline, F.lit("\n> ")), F.lit(". "), F.lit(".\n> ")))
    deep = F.coalesce(F.concat(F.lit(">> "), F.replace("__older", newline, F.lit("\n>> ")), newline), F.lit(""))
    last = F.concat(F.lit("> "), F.substring_index("__before", "\n", -1))
    head = F.when(turn % 4 == 1, wrapped).when(turn % 4 == 2, F.concat(deep, quote)).when(turn % 4 == 3, last)
    return own.withColumn("text", F.coalesce(F.concat(head, newline, F.coalesce("text", F.lit(""))), "text")).select(conversations.columns)

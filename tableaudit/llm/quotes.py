"""Quotation linking: who replies to whom, read off what messages quote.

A line's quote level is the number of its leading ``>`` marks, and one more for each
"Original Message" rule above it (mail programs that put one quote all that follows);
consecutive lines of one level are a passage. Quoted passages, their paragraphs and their lines are normalised (marks off,
white space as one space, lower case) and hashed. The first earlier message of the
conversation that says the same in its own words (as its whole text, a passage, a
paragraph or a line) is their original. A message replies to the original of which it
quotes most words at its lowest linked quote level, and else to the message before it.
Replies are ordered by their distance from the start of their thread, found by
pointer doubling. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableaudit.llm.common import stash

#: A line's marks: ``>`` with blanks before, between and one after. (A loop over one class of characters: a repeated group would recurse for each mark.)
MARKS = r"^[ \t>]*>[ \t]?"
#: Verbs of lines that announce a quotation.
_WROTE = r"(?:wrote|writes|schrieb|schreibt|escribió|escribe|a écrit|écrit|ha scritto|scrive|schreef)"
_DATED = r"(?:on|am|le|el|il|op)[ \t]"
#: Announcements with blank lines up to the quotation, which a ``>`` stands for. In this order: two or three lines that begin like a date and
#: have a digit in the first or a mail address in the last; a line of any length with a mail address; a shorter line; a line whose verb stands before the name.
ANNOUNCES = (r"(?imdu)^[ \t]*(?:"
             rf"{_DATED}[^\n]{{1,200}}(?<![.!?:\s])[ \t]*\n(?:[^\n]{{1,200}}(?<![.!?:\s])[ \t]*\n)?(?=[^\n]*\S@\S)(?:[^\n]{{0,200}}[ \t>])?{_WROTE}"
             rf"|{_DATED}(?=[^\n]*\d)[^\n]{{1,200}}(?<![.!?:\s])[ \t]*\n(?:[^\n]{{0,200}}[ \t>])?{_WROTE}"
             rf"|(?=[^\n]*\S@\S)[^\n]*[ \t]{_WROTE}"
             rf"|[^\n]{{1,200}}[ \t]{_WROTE}"
             rf"|(?:am|den)[ \t][^\n]{{1,200}}[ \t](?:schrieb|schreibt)[ \t][^\n]{{1,200}}"
             r")[ \t]?:\s*\n(?=>$)")
#: A rule over a whole message, and the header lines below it.
RULE = (r"(?imdu)^[ \t]*-{2,20}[ \t]*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|mensaje original|message d'origine|message original|messaggio originale)[ \t]*-{2,20}[ \t]*$"
        r"(?:\n[ \t]*(?:from|sent|date|to|cc|bcc|reply-to|subject|von|gesendet|datum|an|betreff|de|enviado|fecha|para|asunto|envoyé|à|objet|da|inviato|oggetto)[ \t]?:[^\n]*){0,16}\n?")
#: Words that a single quoted line must have to be linked by itself; shorter ones count beside another unit of their original.
LINE_WORDS = 3
#: Turns of one conversation that a window orders at once.
CHUNK = 4096
_START, _END = "\x1e", "\x1d"


def lines_of(text: Column) -> Column:
    """Array of (level, body) of a text's lines; rules and their headers are left out."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), RULE)
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    line = lambda x, i: F.struct((F.length(F.regexp_replace(marks(x), "[^>]", "")) + i).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))
    return F.flatten(F.transform(parts, lambda part, i: F.transform(F.split(part, "\n"), lambda x: line(x, i))))


def passages_of(lines: Column) -> Column:
    """Array of (level, body) of the runs of lines of one level."""
    def line(x, i):
        starts = F.coalesce(F.get(lines, i - 1)["level"], F.lit(-1)) != x["level"]
        return F.concat(F.when(starts, F.concat(F.lit(_START), x["level"].cast("string"), F.lit(_END))).otherwise("\n"), F.translate(x["body"], _START + _END, "  "))

    runs = F.filter(F.split(F.array_join(F.transform(lines, line), ""), _START), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(F.substring_index(x, _END, 1).cast("int").alias("level"), F.substring_index(x, _END, -1).alias("body")))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _unit(text: Column) -> Column:
    plain = normalised(text)
    return F.struct(F.when(plain != "", F.xxhash64(plain)).alias("hash"), F.size(F.split(plain, " ")).alias("n"))


def own_text(lines: Column, text: Column) -> Column:
    """What is left without quoted lines and what announces them; unquoted texts stay as they are. A quoted line is
    stood for by a ``>``, which no other line begins with."""
    joined = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == 0, x["body"]).otherwise(">")), "\n")
    own = F.regexp_replace(F.regexp_replace(joined, ANNOUNCES, ""), r"(?md)^>$\n?", "")
    plain = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.exists(lines, lambda x: x["level"] > 0), plain).otherwise(F.coalesce(text, F.lit("")))


def originals(parsed: DataFrame) -> DataFrame:
    """(conv_id, hash, original): the first turn of each conversation that says a unit in its own words."""
    passages = F.filter("passages", lambda x: x["level"] == 0)
    paragraphs = F.flatten(F.transform(passages, lambda x: F.split(x["body"], r"\n[ \t]*\n")))
    lines = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    said = F.concat(F.array("own"), F.transform(passages, lambda x: x["body"]), paragraphs, lines)
    hashes = F.array_distinct(F.transform(said, lambda x: _unit(x)["hash"]))
    return (parsed.select("conv_id", "turn", F.explode(hashes).alias("hash")).filter(F.col("hash").isNotNull())
            .groupBy("conv_id", "hash").agg(F.min("turn").alias("original")))


def quoted(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, n, short) of every quoted passage and, where a passage has several, paragraph and line.
    A paragraph of one line is that line; ``short`` lines don't link by themselves."""
    def units(x, texts, line):
        return F.transform(texts, lambda y: F.struct(x["level"].alias("level"), _unit(y).alias("unit"), F.lit(line).alias("line")))

    trimmed = lambda y: F.regexp_replace(y, r"^\s+|\s+$", "")
    passages = F.filter("passages", lambda x: x["level"] > 0)
    whole = F.flatten(F.transform(passages, lambda x: units(x, F.array(x["body"]), False)))
    several = F.filter(passages, lambda x: x["body"].contains("\n"))
    parts = lambda x: F.filter(F.transform(F.split(trimmed(x["body"]), r"\n[ \t]*\n"), trimmed), lambda y: y.contains("\n"))
    paragraphs = F.flatten(F.transform(F.filter(several, lambda x: trimmed(x["body"]).rlike(r"\n[ \t]*\n")), lambda x: units(x, parts(x), False)))
    lines = F.flatten(F.transform(several, lambda x: units(x, F.split(x["body"], "\n"), True)))
    return (parsed.filter(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", F.explode(F.concat(whole, paragraphs, lines)).alias("q"))
            .select("conv_id", "turn", "q.level", "q.unit.hash", "q.unit.n", (F.col("q.line") & (F.col("q.unit.n") < LINE_WORDS)).alias("short")).filter(F.col("hash").isNotNull()))


def previous_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, previous) of distinct (conv_id, turn): windows over CHUNK turns, and over the chunks of a conversation."""
    chunk = F.floor(F.col("turn") / CHUNK)
    rows = turns.withColumn("chunk", chunk)
    last = rows.groupBy("conv_id", "chunk").agg(F.max("turn").alias("last"))
    before = last.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("chunk"))).drop("last")
    near = rows.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "chunk").orderBy("turn")))
    return near.join(before, ["conv_id", "chunk"]).select("conv_id", "turn", F.coalesce("near", "before").alias("previous"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent_turn) by pointer doubling; parents are earlier turns."""
    state = stash(parents.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), F.when(F.col("parent_turn").isNull(), 0).otherwise(1).alias("far"),
                                 F.col("parent_turn").isNull().alias("done")), "thread0")
    i = 0
    while not state.filter("NOT done").isEmpty():
        i += 1
        above = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = (state.filter("NOT done").join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")))
                 .select("conv_id", "turn", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")))
        state = stash(state.filter("done").union(moved), f"thread{i}")
    return state.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("far").alias("depth"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, n_linked, parent_turn, link, root_turn, depth) of every row of ``messages``.

    ``text`` is the message without quotations and what announces them (``ANNOUNCES``, ``RULE``: nothing below such a rule is
    the message's own), ``n_quoted`` its quoted lines, ``n_linked``
    its quoted passages, paragraphs and lines whose original was found, ``link`` how its parent was (``quote``,
    ``previous``; ``first`` has none), ``depth`` its distance from ``root_turn``.
    (root_turn, depth, turn) is the reply order: each message follows what it answers.
    Null and empty texts quote nothing. Rows without conv_id or turn stand alone
    (``first``, depth 0). Rows that share conv_id and turn are one message in several
    parts: their quotations count together and all are returned. An empty table gives
    an empty result; other columns are not looked at.
    """
    rows = messages.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    parsed = rows.withColumn("lines", lines_of(F.col("text"))).withColumn("passages", passages_of(F.col("lines"))).withColumn("own", own_text(F.col("lines"), F.col("text")))
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = stash(quoted(known), "quoted")
    # Only conversations in which something is quoted need their originals hashed.
    quoting = stash(asked.select("conv_id").distinct(), "quoting")
    found = (asked.join(originals(known.join(quoting, "conv_id", "left_semi")), ["conv_id", "hash"]).filter(F.col("original") < F.col("turn"))
             .groupBy("conv_id", "turn", "level", "original").agg(F.sum("n").alias("n"), F.count("*").alias("units"), F.count_if(~F.col("short")).alias("long")).filter("long > 0"))
    parent = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "original")).alias("best"), F.sum("units").alias("n_linked"))
    turns = previous_turns(known.select("conv_id", "turn").distinct())
    linked = (turns.join(parent, ["conv_id", "turn"], "left")
              .select("conv_id", "turn", F.coalesce("best.original", "previous").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                      F.when(F.col("best").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous").otherwise("first").alias("link")))
    linked = stash(linked, "linked")
    placed = linked.join(threads(linked), ["conv_id", "turn"])
    out = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("bigint").alias("n_quoted"))
    return (out.join(placed, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "parent_turn",
                    F.coalesce("link", F.lit("first")).alias("link"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages, each conversation in reply order. The sort deals rows out by
    ranges of the whole key, so one conversation may be spread over tasks."""
    return link(messages).orderBy("conv_id", "root_turn", "depth", "turn")

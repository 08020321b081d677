"""Chat formatting of reply trees, with DataFrame functions alone.

``paths`` enumerates the root-to-leaf paths of reply trees by self-joins that double their reach
each round, and ranks them by the score of their branches; ``formatted`` writes each chosen path as one
conversation with a loss mask over the assistant's texts; ``parsed`` reads it back.

The template marks a turn as ``### role: text</turn>`` and a line feed.  Inside texts and roles a
backslash becomes ``\\b``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e`` and, in roles, a
colon becomes ``\\c``.  Every backslash of escaped text is thus followed by one of these letters,
no control string is left, and the text comes back exactly.

Edge cases: a null text or role is empty; rows that repeat a turn all count, ordered by (turn, role,
text); a null conv_id is a conversation of its own name; messages whose parent is missing are
roots; those on or under a cycle belong to no path; ties of score go to the smaller leaf; an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._util import written

# The control strings, and what stands for them inside texts.
BACKSLASH, OPEN, END, COLON = "\\", "###", "</turn>", ":"
IN_TEXT = ((BACKSLASH, "\\b"), (OPEN, "\\h"), (END, "\\e"))
IN_ROLE = (*IN_TEXT, (COLON, "\\c"))
TURN_END = END + "\n"


def escaped(text: Column, table=IN_TEXT) -> Column:
    for raw, safe in table:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, table=IN_TEXT) -> Column:
    for raw, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def chained(rows: DataFrame) -> DataFrame:
    """Messages of a table of turns: each turn replies to the one before it."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    return own.withColumn("msg", seq.cast("long")).select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _named(conv_id) -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit("~"))


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """conv_id, leaf, score, rank, back, msg: the messages of each root-to-leaf path, ``back`` steps from its leaf.

    Self-joins double the reach of every message's link to an ancestor, so a tree of depth d takes
    about log2(d) rounds.  Leaves then walk the links of each reach to their root, adding up the
    scores; in each conversation they are ranked, and only paths of rank up to ``top`` (None: all)
    are enumerated.
    """
    links = messages.select(_named("conv_id").alias("conv"), "conv_id", "msg", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    links = written(links, "links")
    here = links.select("conv", F.col("msg").alias("parent")).distinct()
    up = links.join(here, ["conv", "parent"], "left_semi").select("conv", F.col("msg").alias("node"), F.col("parent").alias("above"), F.col("score").alias("sum"))
    reach, most = [written(up, "reach")], links.count()
    while not reach[-1].isEmpty() and 1 << len(reach) - 1 <= most:
        near, far = reach[-1], reach[-1].select("conv", F.col("node").alias("above"), F.col("above").alias("further"), F.col("sum").alias("more"))
        reach.append(written(near.join(far, ["conv", "above"]).select("conv", "node", F.col("further").alias("above"), (F.col("sum") + F.col("more")).alias("sum")), "reach"))
    endless = reach.pop()  # of messages on or under a cycle, for nothing else reaches so far
    parents = reach[0].select("conv", F.col("above").alias("msg")).distinct() if reach else endless.select("conv", F.col("above").alias("msg"))
    leaves = links.join(parents, ["conv", "msg"], "left_anti").select("conv", "conv_id", F.col("msg").alias("leaf"), F.col("msg").alias("node"), F.lit(0.0).alias("score"))
    leaves = leaves.join(endless.select("conv", "node").distinct(), ["conv", "node"], "left_anti").select(leaves.columns)
    for step in reversed(reach):
        leaves = leaves.join(step, ["conv", "node"], "left").select("conv", "conv_id", "leaf", F.coalesce("above", "node").alias("node"), (F.col("score") + F.coalesce("sum", F.lit(0.0))).alias("score"))
    roots = links.groupBy("conv", F.col("msg").alias("node")).agg(F.max("score").alias("own"))
    best = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    ranked = leaves.join(roots, ["conv", "node"]).select("conv", "conv_id", "leaf", (F.col("score") + F.col("own")).alias("score")).withColumn("rank", best)
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    found = written(ranked.withColumns({"back": F.lit(0).cast("long"), "node": F.col("leaf")}), "steps")
    for k in range(len(reach) - 1, -1, -1):
        further = found.join(reach[k], ["conv", "node"]).select("conv", "conv_id", "leaf", "score", "rank", (F.col("back") + (1 << k)).alias("back"), F.col("above").alias("node"))
        found = written(found.select(further.columns).unionByName(further), "steps")
    return found.withColumnRenamed("node", "msg")


def formatted(messages: DataFrame, steps: DataFrame, learner: str = "assistant") -> DataFrame:
    """conv_id, leaf, text and mask: the (start, length) in code points of the learner's escaped texts."""
    said = messages.select(_named("conv_id").alias("conv"), "msg", "role", "text")
    head = F.concat(F.lit(OPEN + " "), escaped(F.col("role"), IN_ROLE), F.lit(": "))
    turns = steps.join(said, ["conv", "msg"]).select("conv", "conv_id", "leaf", (-F.col("back")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learner).alias("learn"))
    size = F.length("head") + F.length("body") + len(TURN_END)
    before = F.sum(size).over(Window.partitionBy("conv", "leaf").orderBy("at")) - size + F.length("head")
    span = F.when(F.col("learn"), F.struct(before.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = turns.select("conv", "conv_id", "leaf", "at", F.concat("head", "body", F.lit(TURN_END)).alias("turn"), span.alias("span"))
    whole = turns.groupBy("conv", "conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"), F.array_sort(F.collect_list("span")).alias("mask"))
    return whole.select("conv_id", "leaf", F.array_join(F.col("turns.turn"), "").alias("text"), "mask")


def parsed(conversations: DataFrame) -> DataFrame:
    """conv_id, text, mask, and read back from these: turns (role, text) and loss (what the mask covers, unescaped)."""
    pieces = F.split("text", r"</turn>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x):
        colon = F.instr(x, ": ")
        role = F.substring(x, F.lit(len(OPEN) + 2), colon - len(OPEN) - 2)
        return F.struct(unescaped(role, IN_ROLE).alias("role"), unescaped(F.substring(x, colon + 2, F.length(x))).alias("text"))

    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return conversations.select("conv_id", "leaf", "text", "mask", F.transform(turns, turn).alias("turns"), loss.alias("loss"))


def digests(read_back: DataFrame) -> DataFrame:
    """What the query returns of conversations that were read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


def best_conversations(messages: DataFrame) -> DataFrame:
    """Each conversation's best path, written to the shared folder in the template."""
    messages = written(messages, "messages")
    return written(formatted(messages, paths(messages, top=1)), "conversations")

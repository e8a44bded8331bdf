"""Chat formatting: reply trees to conversations, in DataFrame operations alone.

A message points to its parent. Iterative self-joins double each message's ancestor pointer, and carry the score
and length of the way passed, until every pointer is at a root: about log2(depth) rounds, not depth rounds. Branches
(root-to-leaf paths) are ranked per conversation by score; only the messages of chosen branches are then enumerated,
by the stored pointers from the longest jump to the shortest, so the work follows the output.

The template writes a turn as ``### role: text</turn>\\n``. Inside a text or role a backslash is put before each
backslash, after the first ``#`` of ``###`` and after the ``<`` of ``</turn>``; in roles also ``:`` becomes ``\\c``.
So control strings appear only as control, and dropping the backslashes restores the text.

Defined results: null text or role is empty; a parent that isn't there makes a root; repeated (conv_id, msg_id) keep
the row that sorts first by parent, role, text; messages that hang on a cycle have no root and yield no path; a null
conv_id or msg_id yields none; null scores count 0; equal branch scores are ordered by greater length, then leaf id.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

HEAD, END = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?=\\)|(?<=#)(?=##)|(?<=<)(?=/turn>)", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    # ``\c`` stands for a colon only where its backslash isn't itself escaped
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\c", "$1:"), r"(?s)\\([^c])", "$1")


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, still escaped, without their end marks."""
    parts = F.split(formatted, "</turn>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(HEAD) + 1))
        at = F.instr(body, ": ")
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 2)).alias("text")
        )

    return F.transform(pieces(formatted), turn)


def reply_tree(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as a tree: each row answers the one before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    n = F.row_number().over(w).cast("long")
    return rows.select("conv_id", n.alias("msg_id"), role.alias("role"), text.alias("text")).select(
        "conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def format_conversations(messages: DataFrame, top_k: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, msg_id, parent_id, role, text, score. One row per chosen branch.

    Returns conv_id, leaf_id, branch_rank, branch_score, n_turns, formatted, and turn_spans: for each turn its start
    and length in ``formatted``, its text's start (1 is the turn's first) and length, and whether it bears loss; all in
    code points.
    """
    empty = F.lit("")
    nodes = cut(
        messages.where(F.col("conv_id").isNotNull() & F.col("msg_id").isNotNull())
        .groupBy("conv_id", "msg_id")
        .agg(F.min(F.struct(
            "parent_id", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )).alias("m"))
        .select("conv_id", "msg_id", "m.*")
    )
    key = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    step = cut(
        nodes.select("conv_id", "msg_id", "parent_id", "score").join(key, ["conv_id", "parent_id"], "left")
        .select("conv_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), "score", F.lit(1).cast("long").alias("n"))
    )
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    jumps: list[DataFrame] = []
    done: DataFrame = step.where(F.col("up").isNull())
    # a round joins only pointers that aren't at a root yet
    while len(jumps) <= int(largest).bit_length() and not (open_ := step.where(F.col("up").isNotNull())).isEmpty():
        jumps.append(open_.select("conv_id", F.col("msg_id").alias("node"), "up"))
        over = open_.unionByName(done).select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("n").alias("n2"))
        step = cut(
            open_.join(over, ["conv_id", "up"])
            .select("conv_id", "msg_id", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("n") + F.col("n2")).alias("n"))
        )
        done = done.unionByName(step.where(F.col("up").isNull()))
    parents = nodes.select("conv_id", F.col("parent_id").alias("msg_id")).where(F.col("msg_id").isNotNull())
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("n").desc(), "msg_id")
    chosen = (
        done.join(parents, ["conv_id", "msg_id"], "left_anti")
        .withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= top_k)
        .select("conv_id", F.col("msg_id").alias("leaf_id"), F.col("msg_id").alias("node"), F.lit(0).cast("long").alias("back"),
                "branch_rank", F.col("score").alias("branch_score"))
    )
    for k in reversed(range(len(jumps))):
        here = F.struct("node", "back")
        there = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        chosen = (
            chosen.join(jumps[k], ["conv_id", "node"], "left")
            .select("conv_id", "leaf_id", "branch_rank", "branch_score", F.explode(F.array_compact(F.array(here, there))).alias("at"))
            .select("conv_id", "leaf_id", "branch_rank", "branch_score", "at.node", "at.back")
        )
    said = nodes.select("conv_id", F.col("msg_id").alias("node"), escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), F.col("role").isin(*loss_roles).alias("loss"))
    path = Window.partitionBy("conv_id", "leaf_id").orderBy(F.col("back").desc())
    turn = F.concat(F.lit(HEAD), "r", F.lit(": "), "t", F.lit(END))
    return (
        chosen.join(said, ["conv_id", "node"])
        .withColumn("turn", turn).withColumn("length", F.char_length("turn").cast("long"))
        .withColumn("start", F.sum("length").over(path) - F.col("length"))
        .groupBy("conv_id", "leaf_id")
        .agg(
            F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"),
            F.sort_array(F.collect_list(F.struct(
                "start", "length", (F.char_length("r") + len(HEAD) + 3).cast("long").alias("text_start"),
                F.char_length("t").cast("long").alias("text_length"), "loss", "turn",
            ))).alias("turns"),
        )
        .select(
            "conv_id", "leaf_id", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.col("turns.turn"), "").alias("formatted"),
            F.transform("turns", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["text_start"].alias("text_start"), x["text_length"].alias("text_length"), x["loss"].alias("loss"))).alias("turn_spans"),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.zip_with(pieces(formatted), spans, lambda p, s: F.when(s["loss"], unescape(F.substring(p, s["text_start"].cast("int"), s["text_length"].cast("int")))).otherwise(F.lit(""))), ""
    )

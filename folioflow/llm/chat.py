"""Chat formatting: reply trees to conversations with a loss mask.

Self-joins that double their reach enumerate root-to-leaf paths: a path of length d takes log2(d) joins, and what
a message carries meanwhile (an ancestor, a count and a sum) does not grow with its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Text -> escaped text, in this order; all control strings begin with < or [. Fixed values.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def _escape(c: Column, head: bool = False) -> Column:
    for sign, name in ESCAPES if head else ESCAPES[:-1]:
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _unescape(c: Column) -> Column:
    for sign, name in ESCAPES[::-1]:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def as_replies(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, msg, parent, role, text, score): a table of turns as reply trees of one branch each. Rows of one
    turn come by role, then text; null roles and texts are empty."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(first: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """From ``first`` (conv, msg, up, n, total, low): one step up. The messages that have reached their root, with their depth
    and sum; the others after 1, 2, 4, ... steps; and those that are still on their way after more steps than there are
    messages, with the least message that they have passed (None: there are none)."""
    done, now, jumps = first.where("up is null"), first.where("up is not null"), []
    most = max(1, first.count())
    while now.limit(1).count():  # only messages that haven't reached their root go on
        if 2 ** len(jumps) > most:
            return done, jumps, now
        jumps.append(now)
        far = done.unionByName(now).select(F.col("conv").alias("p_conv"), F.col("msg").alias("p_msg"), F.col("up").alias("p_up"), F.col("n").alias("p_n"), F.col("total").alias("p_total"), F.col("low").alias("p_low"))
        step = now.join(far, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("up") == F.col("p_msg")))
        step = written(step.select("conv", "msg", F.col("p_up").alias("up"), (F.col("n") + F.col("p_n")).alias("n"), (F.col("total") + F.col("p_total")).alias("total"), F.least("low", "p_low").alias("low")), "jump")
        done, now = done.unionByName(step.where("up is null")), step.where("up is not null")
    return done, jumps, None


def branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(conv, leaf, depth, total, rank, msg, pos): the messages of the ``per_tree`` best root-to-leaf paths of each
    conversation, by the sum of their scores, then the smaller leaf; pos counts from the root, from 0.

    ``messages`` (conv, msg, parent, score): msg is unique in its conversation, in any order. A parent that is missing is
    ignored (its reply is a root), and so is that of a cycle's smallest message. Null scores count 0.
    """
    nodes = messages.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = nodes.select(F.col("conv").alias("p_conv"), F.col("msg").alias("p_msg"))
    nodes = nodes.join(there, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_msg")), "left")
    first = written(nodes.select("conv", "msg", F.col("p_msg").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"), F.least("msg", "p_msg").alias("low")), "jump")
    done, jumps, stuck = _jumps(first)
    if stuck is not None:  # what is reached from there by as many steps as there are messages lies on a cycle
        ends = stuck.select(F.col("conv").alias("p_conv"), F.col("up").alias("p_msg")).distinct()
        heads = stuck.where("msg = low").join(ends, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")), "left_semi").select(F.col("conv").alias("p_conv"), F.col("msg").alias("p_msg"), F.lit(True).alias("head"))
        opened = first.join(heads, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")), "left")
        first = written(opened.select("conv", "msg", F.when(F.col("head").isNull(), F.col("up")).alias("up"), "n", "total", "low"), "jump")
        done, jumps, _ = _jumps(first)
    parents = first.where("up is not null").select(F.col("conv").alias("p_conv"), F.col("up").alias("p_msg")).distinct()
    leaves = done.join(parents, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), "msg"))).where(F.col("rank") <= per_tree)
    paths = ranked.select("conv", F.col("msg").alias("leaf"), F.col("n").alias("depth"), "total", "rank", "msg", (F.col("n") - 1).alias("pos"))
    for r, jump in enumerate(jumps):
        far = jump.select(F.col("conv").alias("p_conv"), F.col("msg").alias("p_msg"), "up")
        above = paths.join(far, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")))
        paths = written(paths.unionByName(above.select("conv", "leaf", "depth", "total", "rank", F.col("up").alias("msg"), (F.col("pos") - 2**r).alias("pos"))), "paths")
    return paths


def format_chats(messages: DataFrame, per_tree: int = 1, learn_from: str = "assistant") -> DataFrame:
    """(conv, leaf, rank, total, formatted, loss array<struct<start, end>>): one text for each chosen branch.

    A turn is START role newline text END newline. In roles and texts, the signs with which control strings begin
    are escaped, reversibly. ``loss`` has the code points (end exclusive) of the texts of ``learn_from``.
    An empty table gives no rows; a null conversation id is a conversation of its own.
    """
    paths = branches(messages, per_tree)
    said = messages.select(F.col("conv").alias("m_conv"), F.col("msg").alias("m_msg"), "role", "text")
    turns = paths.join(said, F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("msg") == F.col("m_msg")))
    turns = turns.select("conv", "leaf", "rank", "total", "pos", "role", F.concat(F.lit(START), _escape(F.col("role"), head=True), F.lit("\n")).alias("head"), _escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("conv", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.withColumn("end", upto - len(END) - 1).withColumn("start", F.col("end") - F.length("body"))
    whole = turns.groupBy("conv", "leaf", "rank", "total").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "role", "start", "end"))).alias("t"))
    return whole.select("conv", "leaf", "rank", "total", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform(F.filter("t", lambda x: x["role"] == learn_from), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with turns array<struct<role, text>> and the texts under the loss mask, both from ``formatted``."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.struct(_unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"), _unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))
    learned = F.transform("loss", lambda s: _unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chats.withColumn("turns", turns).withColumn("learned", learned)

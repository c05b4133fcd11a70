"""Chat formatting of reply trees, in DataFrame functions alone.

Messages form trees by parent. Self-joins double each message's pointer until
it reaches its root, carrying depth and the sum of scores; so a path of n
messages needs about log2(n) joins. Leaves are ranked by the mean score of
their path, and the same doubled pointers, taken from the longest to the
shortest, mark the messages on each chosen path. A path is formatted as one
conversation with a loss mask over the assistant's texts, and can be read back.

The template writes a turn as ``### role: text </turn>`` and a line feed.
Inside roles and texts the escape sign and whatever could start a control
string are written as a backslash and a letter, so that every text comes back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardline.llm import textops as X
from wardline.operators import spans as S

OPEN = "### "
SPLIT = ": "
CLOSE = " </turn>\n"
LEARNED = "assistant"
EXTRA = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    """No backslash but as the escape sign, no ``###`` and no ``</turn>``."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, "#(?=##)", "\\\\h")
    return F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    for sign, letter in (("#", "h"), ("<", "l"), (":", "c"), ("\\", "b")):
        text = F.replace(text, F.lit(f"\\{letter}"), F.lit(sign))
    return text


def _doubled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables at distance 1, 2, 4, ... and, per message that has a root, its depth and score sum; messages at their root join no more."""
    live = X.cut(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).alias("depth"), "score"))
    jumps, settled = [], [live.where("up is null")]
    live = live.where("up is not null")
    while not live.limit(1).isEmpty():
        jumps.append(live.select("tree", "node", "up"))
        far = reduce(DataFrame.union, [*settled, live]).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        moved = live.join(far, ["tree", "up"])
        moved = X.cut(moved.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score")))
        settled.append(moved.where("up is null"))
        live = moved.where("up is not null")
        if len(jumps) > 40:  # deeper than any path can be: what is left runs in circles
            break
    return jumps, reduce(DataFrame.union, settled)


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path_rank, position, node) of the ``top`` best root-to-leaf paths of each tree.

    messages: tree, node, parent, score. A parent that is null, missing or the
    message itself makes a root; a null score counts as 0; rows that repeat a
    (tree, node) are one message (the smallest parent, then score). Paths rank
    by mean score, then length (longer first), then leaf. A tree may have
    several roots. Messages in a cycle reach no root and have no path.
    """
    nodes = messages.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
    nodes = nodes.select("tree", "node", F.when(F.col("m.parent") != F.col("node"), F.col("m.parent")).alias("parent"), F.col("m.score").alias("score"))
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    nodes = nodes.join(there, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")
    jumps, ends = _doubled(nodes)
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else nodes.limit(0).select("tree", "node")
    leaves = ends.join(inner, ["tree", "node"], "left_anti").withColumn("mean", F.col("score") / F.col("depth"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("depth"), "node")
    on_path = leaves.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= top).select("tree", "path_rank", "node", F.lit(0).alias("above"))
    on_path = X.cut(on_path)
    for k in range(len(jumps) - 1, -1, -1):
        up = on_path.join(jumps[k], ["tree", "node"]).select("tree", "path_rank", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        on_path = X.cut(on_path.union(up))
    depth = ends.select("tree", "node", "depth")
    return on_path.join(depth, ["tree", "node"]).select("tree", "path_rank", F.col("depth").alias("position"), "node")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per (tree, path_rank): formatted text, loss spans and the number of turns.

    turns: tree, path_rank, position, node, role, text; in that order a path's turns are joined.
    loss_spans holds (start, length) in characters of the formatted text.
    """
    turn = F.struct("position", "node", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.coalesce("role", F.lit("")) == LEARNED).alias("learned"))
    paths = turns.groupBy("tree", "path_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SPLIT))
    written = F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE)))
    size = lambda t: len(OPEN) + len(SPLIT) + len(CLOSE) + F.length(t["role"]) + F.length(t["text"])
    begin = lambda at, t: at + len(OPEN) + len(SPLIT) + F.length(t["role"])
    span = lambda at, t: F.when(t["learned"], F.struct(begin(at, t).alias("start"), F.length(t["text"]).alias("length")))
    spans = F.filter(S.running(F.col("turns"), F.lit(0), lambda at, t: at + size(t), span, "struct<start:int,length:int>"), lambda s: s.isNotNull())
    return paths.select("tree", "path_rank", F.concat_ws("", written).alias("formatted"), spans.alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with its turns parsed again (role, text) and the unescaped text under the loss mask."""
    parts = F.filter(F.split("formatted", "</turn>\n", -1), lambda p: F.length(p) > 0)
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - 1))
    turn = F.transform(body, lambda b: F.struct(unescape(F.substring_index(b, SPLIT, 1)).alias("role"), unescape(F.substr(b, F.locate(SPLIT, b) + len(SPLIT))).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", turn).withColumn("loss_text", F.concat_ws("", masked))


def conversation_tree(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each replies to the one before.

    Rows stand by turn, then role, then text; null turns come first. Rows
    without a conv_id take no part; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.where("conv_id is not null").select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted output.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn),
    loss_chars and loss_sha256 (of the assistant's texts in order),
    formatted_chars. Null texts and roles count as empty; other columns are
    ignored; an empty table gives no rows.
    """
    messages = X.cut(conversation_tree(rows.select("conv_id", "turn", "role", "text")))
    path = chosen_paths(messages.select("tree", "node", "parent", "score"))
    turns = path.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    back = read_back(format_turns(turns))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def extra_conversation(like: DataFrame) -> DataFrame:
    """Conversation -7: both rows hold the template's own control strings."""
    rows = [(EXTRA, 0, "user", EXTRA_TEXT), (EXTRA, 1, LEARNED, EXTRA_TEXT)]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return like.select("conv_id", "turn", "role", "text").union(like.sparkSession.createDataFrame(rows, schema))

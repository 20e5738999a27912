"""Chat formatting (operator 5): reply trees to training conversations, with DataFrame operations only.

A forest is a table of messages (tree, node, parent, role, text, score). Unbranched runs of replies are first joined
into segments: each message points at its parent, and iterative self-joins double the pointers until all reach the
head of their run, so a run of n replies takes log2(n) joins of narrow rows. A second loop of self-joins walks the much
smaller tree of segments from the roots down and so enumerates every root-to-leaf path. Paths are ranked in their tree by mean
score, and each chosen one is formatted as one conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In texts and roles every `<`, backslashes, `|` gets one
more backslash, so that `<|` never stands in them and the change can be undone; in roles `%` and line ends are
percent-encoded. loss_spans are the places (code points) of the escaped texts whose role is in loss_roles.

Defined results: null texts and roles are empty; a message whose parent is absent is a root; a null tree id is a tree;
messages that repeat a node id are kept side by side, ordered by role and text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent) with distinct nodes -> (tree, node, head, depth): the head of each message's unbranched run and
    its distance from it, by pointers that double. Messages on a cycle of parents, which no root reaches, are left out."""
    kids = nodes.groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    known = nodes.select("tree", F.col("node").alias("parent")).join(kids.withColumnRenamed("node", "parent"), ["tree", "parent"])
    up = nodes.join(known, ["tree", "parent"], "left")
    state = common.written(up.select("tree", "node", F.when(F.col("kids") == 1, F.col("parent")).otherwise(F.col("node")).alias("head"), F.when(F.col("kids") == 1, 1).otherwise(0).cast("long").alias("depth")), "reply-runs")
    moving = state.where("head != node").count()
    while moving:
        higher = state.select("tree", F.col("node").alias("head"), F.col("head").alias("next"), F.col("depth").alias("more"))
        doubled = state.join(higher, ["tree", "head"]).select("tree", "node", F.col("next").alias("head"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        after = common.written(doubled, "reply-runs")
        left = after.where("moved").count()
        common.discard(state)
        state = after.drop("moved")
        if left == moving:  # only cycles still move
            break
        moving = left
    heads = state.where("head = node").select("tree", F.col("head"))
    return state.join(heads, ["tree", "head"], "left_semi")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, node, parent, role, text, score) -> (tree, path, rank, place, role, text): the messages of each root-to-leaf
    path in order; path is the leaf's node id; rank 1 is the branch of the highest mean score (ties: smaller leaf id).
    best keeps that many branches of each tree (None: all)."""
    spark = messages.sparkSession
    tree = F.struct(F.col("tree").isNull().alias("n"), F.coalesce(F.col("tree"), F.lit(0)).alias("v"))
    rows = messages.withColumn("tree", tree)
    nodes = rows.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    nodes = common.written(nodes, "reply-nodes")
    runs = common.written(segments(nodes), "reply-segments")
    inner = nodes.join(runs, ["tree", "node"])
    weight = inner.groupBy("tree", "head").agg(F.sum("score").alias("score"), F.sum("n").alias("n"), F.max("depth").alias("last"), F.max_by("node", "depth").alias("leaf"))
    parent = inner.where("depth = 0").select("tree", "head", F.col("parent").alias("node")).join(runs.select("tree", "node", F.col("head").alias("above")), ["tree", "node"], "left")
    run = common.written(weight.join(parent, ["tree", "head"]).select("tree", "head", "score", "n", "last", "leaf", "above"), "reply-runs")
    front = run.where("above is null").select("tree", "head", "leaf", "score", "n", F.col("last").alias("end"), F.array(F.struct(F.col("head").alias("head"), F.lit(0).cast("long").alias("from"))).alias("way"))
    done = None
    children = run.select("tree", F.col("above").alias("head"), F.col("head").alias("kid"), F.col("leaf").alias("kid_leaf"), F.col("score").alias("kid_score"), F.col("n").alias("kid_n"), F.col("last").alias("kid_last")).where("head is not null")
    parents = children.select("tree", "head").distinct()
    while True:
        front = common.written(front, "reply-paths")
        ended = front.join(parents, ["tree", "head"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        more = front.join(children, ["tree", "head"])
        front = more.select("tree", F.col("kid").alias("head"), F.col("kid_leaf").alias("leaf"), (F.col("score") + F.col("kid_score")).alias("score"), (F.col("n") + F.col("kid_n")).alias("n"), (F.col("end") + 1 + F.col("kid_last")).alias("end"), F.concat("way", F.array(F.struct(F.col("kid").alias("head"), (F.col("end") + 1).alias("from")))).alias("way"))
        if front.isEmpty():
            break
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("n")), "leaf")
    chosen = done.withColumn("rank", F.row_number().over(order)).withColumnRenamed("leaf", "path")
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    steps = chosen.select("tree", "path", "rank", F.explode("way").alias("step")).select("tree", "path", "rank", F.col("step.head").alias("head"), F.col("step.from").alias("from"))
    members = steps.join(runs, ["tree", "head"]).select("tree", "path", "rank", "node", (F.col("from") + F.col("depth")).alias("place"))
    said = rows.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = members.join(said, ["tree", "node"])
    return full.select(F.when(~F.col("tree.n"), F.col("tree.v")).alias("tree"), "path", "rank", "place", "role", "text")


def format_paths(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows of paths() -> (tree, path, rank, n_turns, formatted, loss_spans array<struct<start,stop>>)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    said = escape(F.col("text"))
    blocks = turns.select("tree", "path", "rank", "place", "role", "text", F.concat(head, said, F.lit(END + "\n")).alias("block"), F.length(head).alias("a"), F.length(said).alias("b"), F.col("role").isin(*loss_roles).alias("loss"))
    before = Window.partitionBy("tree", "path").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = blocks.withColumns({"end": F.sum(F.length("block").cast("long")).over(before), "i": F.row_number().over(before)})
    start = F.col("end") - F.length("block") + F.col("a")
    numbered = numbered.select("tree", "path", "rank", F.struct("i", "block", "loss", start.alias("start"), (start + F.col("b")).alias("stop")).alias("t"))
    grouped = numbered.groupBy("tree", "path", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return grouped.select("tree", "path", "rank", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["block"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array<struct<role,text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")

    def turn(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(blocks, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as reply trees: each row answers the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))

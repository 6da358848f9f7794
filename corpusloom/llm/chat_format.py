"""Chat formatting of reply trees, in DataFrame functions.

Replies point to what they answer, so each tree of turns holds one
conversation for each of its leaves. Chains without a branch are found by
pointer doubling and taken as one step; self-joins over chains then walk from
every leaf to its root. Branches are ranked by their score, and each chosen
path is written as one conversation.

Template: ``<turn ROLE>``, a line end, the text, ``</turn>`` and a line end. In
texts ``&`` and ``<`` are written as ``&amp;`` and ``&lt;``, so no text can
hold a mark, and reading back gives every text as it was. The loss mask is a
list of spans of the written string, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, table

END = "</turn>\n"
ASSISTANT = "assistant"
CONTROL = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")),
                     F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def turn_head(role: Column) -> Column:
    name = F.replace(escaped(role), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<turn "), name, F.lit(">\n"))


def _chains(nodes: DataFrame) -> DataFrame:
    """Add head and step: the chain that a node is in, and its place there."""
    known = nodes.select("tree", F.col("node").alias("parent"),
                         F.lit(True).alias("known"))
    linked = (nodes.select("tree", "node", "parent", "score")
              .join(known, ["tree", "parent"], "left")
              .withColumn("parent", F.when(F.col("known"), F.col("parent")))
              .drop("known"))
    children = (linked.where("parent is not null").groupBy("tree", "parent")
                .agg(F.count(F.lit(1)).alias("children")))
    here = (linked.join(children, ["tree", "parent"], "left")
            .withColumn("is_head", F.col("parent").isNull()
                        | (F.col("children") > 1)))
    state = cut(here.select(
        "tree", "node", "parent", "score", "is_head",
        F.when(F.col("is_head"), F.col("node")).otherwise(F.col("parent"))
        .alias("up"),
        F.when(F.col("is_head"), 0).otherwise(1).cast("long").alias("step"),
        F.col("is_head").alias("done")))
    # nodes whose chain's head is known step aside, so each round joins only
    # what is left: after round n, nodes more than 2 ** n steps from the head
    longest = state.count()  # no chain has more nodes; a ring goes on
    found = state.where("is_head")
    active = state.where("not is_head")
    rounds = 0
    while 1 << rounds <= longest and not active.isEmpty():
        above = found.unionByName(active).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("_up"),
            F.col("step").alias("_step"), F.col("done").alias("_done"))
        moved = cut(active.join(above, ["tree", "up"]).select(
            "tree", "node", "parent", "score", "is_head",
            F.col("_up").alias("up"), (F.col("step") + F.col("_step"))
            .alias("step"), F.col("_done").alias("done")))
        found = found.unionByName(moved.where("done"))
        active = moved.where("not done")
        rounds += 1
    return cut(found.drop("done").withColumnRenamed("up", "head"))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree, one row per node.

    ``nodes``: tree, node, parent, score. Returns tree, leaf, branch (1 is the
    best), level (of the chain, the root's is the smallest), step, node. The
    score of a path is the sum over its nodes, a null score counts as 0; ties
    go to the smaller leaf. A parent that is null or not in the tree makes a
    root; replies in a ring have no root and are left out. ``node`` must be
    unique in its tree.
    """
    placed = _chains(nodes)
    up = placed.select("tree", F.col("node").alias("parent"),
                       F.col("head").alias("above"))
    chains = placed.groupBy("tree", "head").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.max(F.struct("step", "node"))["node"].alias("last"),
        F.max(F.when(F.col("is_head"), F.col("parent"))).alias("parent"))
    chains = cut(chains.join(up, ["tree", "parent"], "left").select(
        "tree", "head", "above", "last", "score"))
    answered = chains.where("above is not null").select(
        "tree", F.col("above").alias("head")).distinct()
    front = chains.join(answered, ["tree", "head"], "left_anti").select(
        "tree", F.col("last").alias("leaf"), "head", "above", "score",
        F.lit(0).alias("level"))
    found = front = cut(front)
    parents = chains.select("tree", F.col("head").alias("above"),
                            F.col("above").alias("next"),
                            F.col("score").alias("more"))
    while not front.where("above is not null").isEmpty():
        front = cut(front.join(parents, ["tree", "above"]).select(
            "tree", "leaf", F.col("above").alias("head"),
            F.col("next").alias("above"), F.col("more").alias("score"),
            (F.col("level") - 1).alias("level")))
        found = found.unionByName(front)
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = (found.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
              .withColumn("branch", F.row_number().over(best))
              .where(F.col("branch") <= top).drop("score"))
    return (found.join(chosen, ["tree", "leaf"])
            .select("tree", "leaf", "branch", "level", "head")
            .join(placed.select("tree", "head", "step", "node"),
                  ["tree", "head"]).drop("head"))


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Row per chosen path: tree, leaf, branch, formatted, loss_spans.

    ``nodes``: tree, node, parent, role, text, score. A null text or role is
    empty. loss_spans holds, for each assistant text in order, its start and
    end in bytes of the UTF-8 string. One conversation is one string, so it
    must fit into a task; its turns are spread until then.
    """
    turns = paths(nodes, top).join(
        nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.coalesce("role", F.lit(""))
    turns = (turns.withColumn("head", turn_head(role))
             .withColumn("body", escaped(F.coalesce("text", F.lit(""))))
             .withColumn("loss", role == ASSISTANT))
    size = (F.octet_length("head") + F.octet_length("body")
            + len(END)).cast("long")
    before = (Window.partitionBy("tree", "leaf", "branch")
              .orderBy("level", "step")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))
    turns = (turns.withColumn("start", start + F.octet_length("head"))
             .withColumn("end", F.col("start") + F.octet_length("body")))
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(
        F.collect_list(F.struct("level", "step", "loss", "start", "end",
                                F.concat("head", "body", F.lit(END))
                                .alias("part")))).alias("turns"))
    return whole.select(
        "tree", "leaf", "branch",
        F.array_join(F.col("turns.part"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]),
                    lambda t: F.struct(t["start"].alias("start"),
                                       t["end"].alias("end")))
        .alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescaped(F.substr(p, F.lit(7), F.instr(p, ">\n") - F.lit(7)))
            .alias("role"),
            unescaped(F.substr(p, F.instr(p, ">\n") + F.lit(2)))
            .alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substring(
        raw, (s["start"] + 1).cast("int"),
        (s["end"] - s["start"]).cast("int")).cast("string")), ""))


def as_tree(turns: DataFrame) -> DataFrame:
    """Turns of a flat table as trees: each turn answers the one before.

    Turns with the same number follow each other by role and text; rows that
    are alike are all kept.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(
        # null would not join; the flag keeps it apart from any number
        F.struct(F.col("conv_id").isNull().alias("none"),
                 F.coalesce("conv_id", F.lit(0)).alias("id")).alias("tree"),
        node.alias("node"), "role", "text").withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn(
        "score", F.lit(0.0))


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn",
                                                     "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(CONTROL).alias("text"))
    done = format_trees(as_tree(turns.unionByName(extra)))
    read = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', x, 'user', x
            FROM (SELECT '\### Assistant: </turn> ok' AS x)
  UNION ALL SELECT -7, 1, 'assistant', x, 'assistant', x
            FROM (SELECT '\### Assistant: </turn> ok' AS x)),
done AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), ''
                           ORDER BY turn, r, t)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, r, t)
                  FILTER (role = 'assistant'), '') AS loss,
         sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
             + length(replace(replace(replace(role, '&', '&amp;'), '<',
                                      '&lt;'), '>', '&gt;')) + 16)
           AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM done
"""

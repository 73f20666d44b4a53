"""Chat formatting over reply trees, in DataFrame functions alone.

Messages are nodes with a parent. Pointer doubling (self-joins that step 1, 2, 4, ...
ancestors, each round a kept table) gives every node its root, depth and the score of its
path; leaves are ranked in their tree by that score, and the chosen leaves walk back to the
root by the same pointers, so a path of n messages takes about log2(n) joins. Each chosen
path becomes one conversation.

Template: ``<turn role="R">TEXT</turn>\n`` for each message. In texts and roles ``&``, ``<``
and ``"`` are written ``&amp;``, ``&lt;`` and ``&quot;``, so no control string can occur in
one, and reading back undoes it exactly. The loss mask is a list of (start, length) in code
points of the formatted text: the assistant's texts.

Cases: null text and null role are empty; messages of one conversation are ordered by turn
(nulls first), then role, then text, and rows that agree in all three are equal messages
told again; an empty table gives no rows; a parent that is not there makes a root; other
columns are ignored. Messages that are their own ancestors belong to no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

END = "</turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def chain(messages: DataFrame) -> DataFrame:
    """Conversations in turns as trees of one branch: tree, node, parent, role, text, score."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = messages.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, rank, place, role, text: messages of the ``top`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node, parent, role, text, score (null: 0). Ties go to the least leaf.
    """
    nodes = scratch.keep(nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")), "nodes")
    key = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    bare = nodes.select("tree", "node", "parent", "score")
    here = bare.alias("a").join(bare.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")).alias("b"), key("a", "b") & (F.col("a.parent") == F.col("b.parent")), "left")
    step = scratch.keep(here.select("a.tree", "a.node", F.when(F.col("b.there"), F.col("a.parent")).alias("up"), "a.score", F.when(F.col("b.there"), 1).otherwise(0).cast("long").alias("far")), "steps")
    parents = step.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    jumps = [step.select("tree", "node", "up").filter("up is not null")]
    most = step.count()
    while not jumps[-1].isEmpty() and 1 << len(jumps) - 1 <= most:
        a, b = step.filter("up is not null").alias("a"), step.alias("b")
        joined = a.join(b, key("a", "b") & (F.col("a.up") == F.col("b.node")))
        moved = joined.select("a.tree", "a.node", "b.up", (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.far") + F.col("b.far")).alias("far"))
        step = scratch.keep(step.filter("up is null").union(moved), "steps")
        jumps.append(step.select("tree", "node", "up").filter("up is not null"))
    leaves = step.filter("up is null").alias("a").join(parents.alias("b"), key("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))).filter(F.col("rank") <= top)
    walk = scratch.keep(ranked.select("tree", "rank", "node", F.lit(0).cast("long").alias("back"), F.col("far").alias("place")), "walk")
    for k in range(len(jumps) - 2, -1, -1):
        a, b = walk.alias("a"), jumps[k].alias("b")
        more = a.join(b, key("a", "b") & (F.col("a.node") == F.col("b.node"))).select("a.tree", "a.rank", F.col("b.up").alias("node"), (F.col("a.back") + (1 << k)).alias("back"), (F.col("a.place") - (1 << k)).alias("place"))
        walk = scratch.keep(walk.union(more), "walk")
    a, b = walk.alias("a"), nodes.alias("b")
    return a.join(b, key("a", "b") & (F.col("a.node") == F.col("b.node"))).select("a.tree", "a.rank", "a.place", "b.role", "b.text")


def formatted(path: DataFrame, learn: str = "assistant") -> DataFrame:
    """tree, rank, formatted and mask: one conversation for each path."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit('<turn role="'), escape(role), F.lit('">'))
    path = path.select("tree", "rank", "place", head.alias("head"), escape(text).alias("body"), (role == learn).alias("learn"))
    turns = path.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "learn"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    add = lambda acc, t: F.struct(
        (acc.at + F.length(t.head) + F.length(t.body) + len(END)).alias("at"),
        F.when(t.learn, F.array_append(acc.mask, F.struct((acc.at + F.length(t.head)).alias("start"), F.length(t.body).alias("length")))).otherwise(acc.mask).alias("mask"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("mask"))
    return turns.select("tree", "rank", whole.alias("formatted"), F.aggregate("turns", start, add)["mask"].alias("mask"))


def digests(convs: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations and their masks."""
    told = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)
    part = lambda t, n: unescape(F.regexp_extract(t, r'(?s)^<turn role="([^"]*)">(.*)$', n))
    turns = F.array_join(F.transform(told, lambda t: F.concat(part(t, 1), F.lit("\n"), part(t, 2), F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m.start + 1, m.length))), "")
    return convs.select(
        F.col("tree").alias("conv_id"), F.size(told).cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS r, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS t FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(length(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text)), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(r) + length(t) + length('<turn role="">') + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

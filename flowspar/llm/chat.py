"""Chat formatting of reply trees.

Messages with parents form trees. Root-to-leaf paths are enumerated by iterative self-joins: going up, a table of each
message's 2**k-th ancestor is joined with itself until all have passed their roots; going down, each leaf's path is
filled in by halves from those tables. So the number of joins is twice the logarithm of the depth, and only leaves have
paths. Branches of a tree are ranked by score, and each is written as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspar.llm.shared import forget, table

TEMPLATE = ("<|", "|>\n", "\n")  # before the role, before the text, after the text


def reply_parents(turns: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text) from (conv_id, turn, role, text): the messages of a conversation are numbered from
    1 by (turn, role, text), and each answers the latest earlier message of another role, so that successive messages of
    one role, or of one turn, are alternatives. The first ones are roots. Equal rows count once; a null turn comes last;
    rows without conv_id have no tree and are left out; null roles and texts are empty."""
    one = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = one.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_last("turn"), "role", "text")).cast("long"))
    ordered = Window.partitionBy("tree").orderBy("node")
    changed = rows.withColumn("before", F.lag("node").over(ordered)).withColumn("other", F.lag("role").over(ordered))
    last = F.last(F.when(F.col("role") != F.col("other"), F.col("before")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return changed.select("tree", "node", last.alias("parent"), "role", "text")


def threaded(messages: DataFrame) -> DataFrame:
    """messages (of ``reply_parents``) with side threads, for want of a parent column in the tables: where the MD5 of
    'tree:node' begins with 0 to 3 (a quarter of them), a message answers the one before the one before its parent, which
    in turn-taking has its parent's role. Messages without so many before them stay where they are."""
    aside = F.substring(F.md5(F.concat_ws(":", "tree", "node")), 1, 1) < "4"
    return messages.withColumn("parent", F.when(aside & (F.col("parent") > 2), F.col("parent") - 2).otherwise(F.col("parent")))


def steps(messages: DataFrame) -> DataFrame:
    """(tree, leaf, up, node): every message on the way from each leaf of messages(tree, node, parent) to its root, with
    its distance from the leaf. A parent that doesn't exist makes a root; messages on a cycle, or that hang on one, are on
    no path. Equal (tree, node) rows count once, with the smallest parent; null trees or nodes are left out."""
    m = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("held"))
    m = table(m.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("held"), F.col("parent")).alias("up")), "messages")
    most = m.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = [m]
    while not levels[-1].where("up is not null").isEmpty():
        if 1 << (len(levels) - 1) >= most:  # more steps than a tree has messages: what still goes up is in a cycle
            break
        last = levels[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        levels.append(table(last.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "ancestors"))
    inner = m.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = m.join(inner, ["tree", "node"], "left_anti").select("tree", "node")
    held = leaves.join(levels[-1].where("up is not null").select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.lit(0).alias("far"), "node")
    for k in range(len(levels) - 2, -1, -1):
        higher = held.join(levels[k].where("up is not null"), ["tree", "node"]).select("tree", "leaf", (F.col("far") + (1 << k)).alias("far"), F.col("up").alias("node"))
        nearer = table(held.unionByName(higher), "paths")
        if k < len(levels) - 2:
            forget(held)
        held = nearer
    return held.select("tree", "leaf", F.col("far").alias("up"), "node")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path): the nodes from the root to each leaf; see ``steps``."""
    one = steps(messages).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("up"), "node"))).alias("p"))
    return one.select("tree", "leaf", F.transform("p", lambda x: x["node"]).alias("path"))


def reply_paths(messages: DataFrame, score: Column | None = None, branches: int | None = None, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """One row for each chosen root-to-leaf path of messages(tree, node, parent, role, text, ...):
    (tree, leaf, branch, score, messages, conversation).

    A path's score is the mean of its messages' scores (default: characters of the text), branch ranks the paths of a
    tree by falling score (ties: smaller leaf), and ``branches`` keeps so many a tree (default: all; a top-k choice). The
    conversation is each message in turn as '<|role|>', line, text, line. Of equal (tree, node) rows the one with the
    smallest (role, text) counts; empty tables give no rows; null roles and texts are empty; other columns are ignored."""
    spark_score = score if score is not None else F.length("text").cast("double")
    said = F.concat(F.lit(template[0]), F.coalesce("role", F.lit("")), F.lit(template[1]), F.coalesce("text", F.lit("")), F.lit(template[2]))
    body = messages.groupBy("tree", "node").agg(F.min_by(F.struct(F.coalesce(spark_score, F.lit(0.0)).alias("_s"), said.alias("_t")), F.struct("role", "text")).alias("_b")).select("tree", "node", "_b._s", "_b._t")
    scored = steps(messages).join(body, ["tree", "node"])
    one = scored.groupBy("tree", "leaf").agg(F.avg("_s").alias("score"), F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("pos"), "_t"))).alias("_m"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = one.withColumn("branch", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    return ranked.select("tree", "leaf", "branch", "score", "messages", F.concat_ws("", F.transform("_m", lambda x: x["_t"])).alias("conversation"))


def sql(conversations: str = "conversations") -> str:
    """``reply_paths(threaded(reply_parents(conversations)))`` in DuckDB's SQL."""
    return f"""
    WITH RECURSIVE n AS (SELECT conv_id AS tree, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS node, role, text
          FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL)),
    m AS (SELECT *, lag(node) OVER w AS before, lag(role) OVER w AS other FROM n WINDOW w AS (PARTITION BY tree ORDER BY node)),
    a AS (SELECT tree, node, role, text, last_value(CASE WHEN role <> other THEN before END IGNORE NULLS) OVER (PARTITION BY tree ORDER BY node ROWS UNBOUNDED PRECEDING) AS parent FROM m),
    t AS (SELECT tree, node, role, text, CASE WHEN substr(md5(tree || ':' || node), 1, 1) < '4' AND parent > 2 THEN parent - 2 ELSE parent END AS parent FROM a),
    p AS (SELECT tree, node, 1 AS messages, length(text)::DOUBLE AS total, '<|' || role || '|>' || chr(10) || text || chr(10) AS conversation FROM t WHERE parent IS NULL
          UNION ALL SELECT t.tree, t.node, p.messages + 1, p.total + length(t.text), p.conversation || '<|' || t.role || '|>' || chr(10) || t.text || chr(10) FROM p JOIN t ON t.tree = p.tree AND t.parent = p.node)
    SELECT tree, node AS leaf, row_number() OVER (PARTITION BY tree ORDER BY total / messages DESC, node)::INT AS branch, total / messages AS score, messages::BIGINT AS messages, conversation
    FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tree = p.tree AND t.parent = p.node)"""

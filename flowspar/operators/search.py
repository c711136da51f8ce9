"""Graph search on node and edge tables, one level of the search a step.

Order is explicit: a node's edges are taken by ``seq``, and a node's place in the queue is its rank. So results are those
of a queue-based breadth-first search, whatever the partitioning. Each level is a written table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspar.schema import CALLS, DATA_FLOW, MAX_NODES, PER_PAIR
from flowspar.sources.durable import durable, place, unsent


def adjacency(edges: DataFrame, types: tuple[str, ...] = (DATA_FLOW, CALLS)) -> DataFrame:
    """(src, dst, pos, etype): parallel edges collapse to the first."""
    held = edges.where(F.col("edge_type").isin(*types))
    return held.groupBy("src", "dst").agg(F.min("seq").alias("pos"), F.min_by("edge_type", "seq").alias("etype"))


def _levels(starts: DataFrame, adj: DataFrame, sinks: DataFrame, max_nodes: int, stop_at_sinks: bool, owners: DataFrame | None = None) -> list[DataFrame]:
    """starts(source, node, rank). Level tables (source, node, rank, path, etypes, fresh, sink, parent_rank, pos); fresh
    rows are those that enter the queue, the others are sinks that were seen before. With owners(node, owner), a source
    doesn't enter a node whose owner is smaller."""
    marks = durable(sinks.select(F.col("node_id").alias("node"), F.lit(True).alias("sink")).distinct(), "sinks")
    adj = durable(adj, "adjacency")  # every level reads them; their own plans run once
    first = starts.join(marks, "node", "left").select(
        "source", "node", "rank", F.array("node").alias("path"), F.array().cast("array<string>").alias("etypes"), F.lit(True).alias("fresh"),
        F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(-1).cast("bigint").alias("parent_rank"), F.lit(-1).cast("bigint").alias("pos"),
    )
    held = place(starts.sparkSession, "levels")

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{held}/level={k}")
        return unsent(starts.sparkSession.read.schema(df.schema).parquet(f"{held}/level={k}"))

    levels = [keep(first, 0)]
    whole = "source string, node string, fresh boolean, level int"
    out = adj.select(F.col("src").alias("node"), F.col("dst"), F.col("pos").alias("_pos"), "etype")
    for k in range(1, max_nodes + 1):
        last = levels[-1].where("fresh")
        seen = unsent(starts.sparkSession.read.schema(whole).parquet(held)).where("fresh").select("source", "node")
        if stop_at_sinks:
            last = last.where("not sink or node = source")
        by = Window.partitionBy("source", "node").orderBy("parent_rank", "pos", "before")
        ahead = last.where(F.size("path") <= max_nodes).join(out, "node").select(
            "source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("etypes", F.array("etype")).alias("etypes"),
            F.col("rank").cast("bigint").alias("parent_rank"), F.col("_pos").cast("bigint").alias("pos"), F.col("node").alias("before"),
        )
        if owners is not None:
            ahead = ahead.join(owners, "node", "left").where("owner is null or owner >= source").drop("owner")
        ahead = ahead.withColumn("_first", F.row_number().over(by)).join(seen.withColumn("_seen", F.lit(True)), ["source", "node"], "left").join(marks, "node", "left")
        ahead = ahead.withColumn("fresh", (F.col("_first") == 1) & F.col("_seen").isNull()).withColumn("sink", F.coalesce("sink", F.lit(False))).where("fresh or (sink and node <> source)")
        rank = F.row_number().over(Window.partitionBy("source", "fresh").orderBy("parent_rank", "pos", "node")).cast("int")
        level = keep(ahead.select("source", "node", rank.alias("rank"), "path", "etypes", "fresh", "sink", "parent_rank", "pos"), k)
        levels.append(level)
        if level.where("fresh").isEmpty():
            break
    return levels


def taint_paths(sources: DataFrame, sinks: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, per_pair: int = PER_PAIR) -> DataFrame:
    """(source, sink, path, etypes, hops, event): up to ``per_pair`` paths for each pair of sources(node_id) and
    sinks(node_id), in the order in which a breadth-first search from that source finds them.

    Search goes on behind a sink, and a sink that is met again by another edge is recorded again. A path has at most
    max_nodes nodes when popped, and one more when met again."""
    starts = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(1).alias("rank")).distinct()
    levels = _levels(starts, adjacency(edges), sinks, max_nodes, False)
    events = None
    for k, level in enumerate(levels):
        hit = level.where("sink and node <> source and (not fresh or size(path) <= %d)" % max_nodes)
        # a fresh one counts when it is popped, one seen before while its parent's edges are looked at
        event = F.struct(F.when(F.col("fresh"), k).otherwise(k - 1).alias("level"), F.when(F.col("fresh"), F.col("rank")).otherwise(F.col("parent_rank")).cast("bigint").alias("rank"), F.when(F.col("fresh"), -1).otherwise(F.col("pos")).cast("bigint").alias("pos"))
        one = hit.select("source", F.col("node").alias("sink"), "path", "etypes", event.alias("event"))
        events = one if events is None else events.unionByName(one)
    by = Window.partitionBy("source", "sink").orderBy("event")
    return events.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_pair).withColumn("hops", F.size("path") - 1)


def taint_paths_within(sources: DataFrame, sinks: DataFrame, edges: DataFrame, within: str, max_nodes: int = MAX_NODES, per_pair: int = PER_PAIR) -> DataFrame:
    """``taint_paths`` (without the event column, with nth in the order of finding) where no edge leaves its group: sources,
    sinks and edges all have the column ``within``. Each group's edges meet in one task, which searches from each of its
    sources; so there is one shuffle instead of some for each level, and paths are written only where they are found."""
    held = edges.where(F.col("edge_type").isin(DATA_FLOW, CALLS)).groupBy(within, "src", "dst").agg(F.min("seq").alias("pos"), F.min_by("edge_type", "seq").alias("etype"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    node = lambda df, kind: df.select(within, F.lit(kind).alias("kind"), F.col("node_id").alias("src"), none("dst", "string"), none("pos", "bigint"), none("etype", "string")).distinct()
    every = held.select(within, F.lit(0).alias("kind"), "src", "dst", F.col("pos").cast("bigint").alias("pos"), "etype").unionByName(node(sinks, 1)).unionByName(node(sources, 2))
    tasks = 4 * sources.sparkSession.sparkContext.defaultParallelism  # by number, since few bytes of edges may mean many paths
    rows = every.repartition(tasks, within).sortWithinPartitions(within, "kind", "src", "pos", "dst")
    return rows.mapInArrow(_grouped(max_nodes, per_pair), "source string, sink string, path array<string>, etypes array<string>, nth int").withColumn("hops", F.size("path") - 1)


_NONE_YET = object()


def _grouped(max_nodes: int, per_pair: int):
    """Rows (group, kind, src, dst, pos, etype) in the order of group, kind (0: edge, 1: sink, 2: source), src and pos to the
    paths found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, succ, sinks, made = _NONE_YET, {}, set(), []
        names = ["source", "sink", "path", "etypes", "nth"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]

        def out() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for at, kind, src, dst, _, etype in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    group, succ, sinks = at, {}, set()
                if kind == 0:
                    succ.setdefault(src, []).append((dst, etype))
                elif kind == 1:
                    sinks.add(src)
                else:
                    made.extend(_search(src, succ, sinks, max_nodes, per_pair))
                    if len(made) > 10_000:
                        yield out()
                        made.clear()
        yield out()

    return run


def _search(source: str, succ: dict[str, list[tuple[str, str]]], sinks: set[str], max_nodes: int, per_pair: int) -> Iterator[tuple]:
    """The paths that a queue-based breadth-first search from source finds: (source, sink, path, etypes, nth)."""
    parent: dict[str, tuple[str, str] | None] = {source: None}
    count: dict[str, int] = {}

    def path(node: str) -> tuple[list[str], list[str]]:
        nodes, types = [node], []
        while parent[node] is not None:
            node, etype = parent[node]
            nodes.append(node)
            types.append(etype)
        return nodes[::-1], types[::-1]

    queue = deque([(source, 1)])
    while queue:
        node, size = queue.popleft()
        if size > max_nodes:
            continue
        if node in sinks and node != source and count.get(node, 0) < per_pair:
            count[node] = count.get(node, 0) + 1
            yield source, node, *path(node), count[node]
        for dst, etype in succ.get(node, ()):
            if dst not in parent:
                parent[dst] = (node, etype)
                queue.append((dst, size + 1))
            elif dst in sinks and dst != source and count.get(dst, 0) < per_pair:
                count[dst] = count.get(dst, 0) + 1
                nodes, types = path(node)
                yield source, dst, [*nodes, dst], [*types, etype], count[dst]


def find_path(sources: DataFrame, sinks: DataFrame, edges: DataFrame, max_depth: int = MAX_NODES, limit: int = 20) -> DataFrame:
    """(source, sink, path, etypes, hops): the first ``limit`` paths of at most max_depth nodes, shortest first.

    Sources are searched in the order of their ids with one visited set: what a source has entered no later one enters.
    Search ends at sinks. To search them side by side, every node gets the first source that enters it as its owner, and
    all are searched again, kept off what others own, until the owners stay the same. Each round settles at least
    the next source, and the result is that of the search one after the other."""
    starts = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(1).alias("rank")).distinct()
    adj = durable(adjacency(edges), "adjacency")
    owners, before = None, None
    while True:
        levels = _levels(starts, adj, sinks, max_depth, True, owners)
        entered = None
        for level in levels:
            one = level.where("fresh").select("source", "node")
            entered = one if entered is None else entered.unionByName(one)
        owners = durable(entered.groupBy("node").agg(F.min("source").alias("owner")), "owners")
        now = tuple(owners.agg(F.count("*"), F.sum(F.xxhash64("node", "owner").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = None
    for k, level in enumerate(levels):
        one = level.where(f"fresh and sink and node <> source and size(path) <= {max_depth}").select("source", F.col("node").alias("sink"), "path", "etypes", F.lit(k).alias("_level"), "rank")
        found = one if found is None else found.unionByName(one)
    first = found.orderBy("source", "_level", "rank").limit(limit)
    return first.withColumn("hops", F.size("path") - 1).orderBy("hops", "source", "_level", "rank").select("source", "sink", "path", "etypes", "hops")


def trace(starts: DataFrame, edges: DataFrame, depth: int = 15, backward: bool = False, types: tuple[str, ...] = (DATA_FLOW, CALLS)) -> DataFrame:
    """(node_id, depth): all nodes within ``depth`` edges of starts(node_id), forward or backward, with their least depth."""
    spark = starts.sparkSession
    step = edges.where(F.col("edge_type").isin(*types)).select(*((F.col("src"), F.col("dst")) if not backward else (F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()
    adj = durable(step, "adjacency")
    held = place(spark, "trace")
    read = lambda path: spark.read.schema("node_id string, depth int").parquet(path)
    starts.select(F.col("node_id").cast("string").alias("node_id"), F.lit(0).alias("depth")).distinct().write.parquet(f"{held}/level=0")
    for d in range(1, depth + 1):
        ahead = read(f"{held}/level={d - 1}").join(adj, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id"), F.lit(d).alias("depth")).distinct()
        ahead.join(read(held), "node_id", "left_anti").write.parquet(f"{held}/level={d}")
        if read(f"{held}/level={d}").isEmpty():
            break
    return read(held)


def call_chain(start: str, end: str, edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """The first path by CALLS edges from one node to another: (path, hops); no rows if there is none."""
    spark = edges.sparkSession
    one = lambda n: spark.createDataFrame([(n,)], "node_id string")
    calls = edges.where(F.col("edge_type") == CALLS)
    return taint_paths(one(start), one(end), calls, max_depth, 1).select("path", "hops")

"""Interval joins, tiered joins and first-by picks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspar.sources.durable import durable, unsent


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group (rank 1 of a window, so the whole order is explicit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def earliest(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The value of each key's first row by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name))


def last_wins(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """One row for each key, with the values of its last row by ``order`` (ties: the largest values)."""
    simple = [c for c in values if not dict(df.dtypes)[c].startswith("map")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order, *simple)).alias("_v"))
    return best.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


WIDER, LEVELS = 4, 16


def _leveled(spans: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    """spans with _level and _bucket: a row for each of the at most two buckets that a span lies in at its level."""
    span = F.col(end) - F.col(start)
    level = F.coalesce(*(F.when(span <= float(bucket * WIDER**k), k) for k in range(LEVELS - 1)), F.lit(LEVELS - 1))
    cut = lambda c: _cut(c, bucket)
    return spans.where(F.col(end) >= F.col(start)).withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(cut(start), cut(end))))


def _cut(c: str, bucket: int) -> Column:
    return F.floor(F.col(c) / (F.lit(float(bucket)) * F.pow(F.lit(float(WIDER)), F.col("_level")))).cast("bigint")


def in_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, bucket: int | None = None) -> DataFrame:
    """points joined with the spans of the same keys that hold them (start <= point <= end).

    With ``bucket``, the join is on keys and bucket, which keeps a key with very many spans from being one task's
    quadratic work. Buckets of level k are bucket * WIDER ** k units wide; a span is filed at the first level at which it
    lies in at most two of them, and a point is looked up at each level. So neither grows with a span's width."""
    held = F.col(point).between(F.col(start), F.col(end))
    if bucket is None:
        return points.join(spans, keys).where(held)
    each = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("_bucket", _cut(point, bucket))
    return each.join(_leveled(spans, start, end, bucket), [*keys, "_level", "_bucket"]).where(held).drop("_level", "_bucket")


def smallest_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, ties: list[str], point_keys: list[str], bucket: int | None = None, apart: tuple[str, str] | None = None) -> DataFrame:
    """For each point (told by point_keys) the narrowest span that holds it; ties by the given columns. With ``apart``, the
    span's column of that name must differ from the point's (a null differs from nothing).

    No pairs are made: points and span starts of a key (and bucket, see ``in_span``) are read in their order, with the open
    spans in a heap. So the work is that of sorting, however many spans hold a point."""
    at = ["_level", "_bucket"]
    if bucket is None:
        zero = lambda df: df.withColumn("_level", F.lit(0)).withColumn("_bucket", F.lit(0).cast("bigint"))
        filed, each = zero(spans.where(F.col(end) >= F.col(start))), zero(points)
    else:
        filed = _leveled(spans, start, end, bucket)
        levels = sorted(r[0] for r in filed.select("_level").distinct().collect())  # LEVELS at most
        each = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", _cut(point, bucket))
    own, other = apart or (None, None)
    span = F.struct(*(c for c in spans.columns if c not in keys))
    place = F.struct(*points.columns)
    order = F.struct((F.col(end) - F.col(start)).alias("_w"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)))
    rows = filed.select(*keys, *at, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"), order.alias("_order"), span.alias("_span"), F.lit(None).cast(each.select(place.alias("x")).schema["x"].dataType).alias("_point"))
    shape = rows.schema
    asked = each.where(F.col(point).isNotNull()).select(*keys, *at, F.col(point).alias("_at"), F.lit(1).alias("_kind"), *(F.lit(None).cast(shape[c].dataType).alias(c) for c in ("_end", "_order", "_span")), place.alias("_point"))
    every = rows.unionByName(asked)
    for k in keys:
        every = every.where(F.col(k).isNotNull())
    group = [*keys, *at]
    sorted_rows = every.repartition(*group).sortWithinPartitions(*group, "_at", "_kind")
    found = sorted_rows.select(*group, "_at", "_kind", "_end", "_order", "_span", "_point").mapInArrow(_sweep(len(group), own, other), T.StructType([shape["_order"], shape["_span"], T.StructField("_point", shape["_point"].dataType)]))
    best = found.groupBy(*(F.col(f"_point.{c}").alias(f"_k{i}") for i, c in enumerate(point_keys))).agg(F.min_by(F.struct("_span", "_point"), F.struct("_order.*")).alias("_b"))
    return best.select(*(F.col(f"_b._point.{c}").alias(c) for c in points.columns), *(F.col(f"_b._span.{c}").alias(c) for c in spans.columns if c not in keys))


def _sweep(width: int, own: str | None, other: str | None):
    """Rows of groups (the first ``width`` columns) in order to (_order, _span, _point): each point's first open span."""
    sortable = lambda o: tuple((v is not None, v) for v in o.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heap, live, n = None, [], 0, 0
        for batch in batches:
            made = []
            kept = [c.to_pylist() for c in batch.columns]
            for *g, at, kind, end, order, span, point in zip(*kept):
                if g != group:
                    group, heap, live = g, [], 0
                if kind == 0:
                    n += 1  # so that equal spans need no comparison of what follows
                    heapq.heappush(heap, (sortable(order), n, end, order, span))
                    if len(heap) > 2 * live + 1000:
                        heap = [x for x in heap if x[2] >= at]
                        heapq.heapify(heap)
                        live = len(heap)
                    continue
                aside = []
                while heap and (heap[0][2] < at or (own is not None and (heap[0][4][own] is None or point[other] is None or heap[0][4][own] == point[other]))):
                    x = heapq.heappop(heap)
                    if x[2] >= at:
                        aside.append(x)
                if heap:
                    made.append({"_order": heap[0][3], "_span": heap[0][4], "_point": point})
                for x in aside:
                    heapq.heappush(heap, x)
            schema = pa.schema([batch.schema.field(c) for c in ("_order", "_span", "_point")])
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


#: Pairs that a task of ``tiers`` makes on average, and rows of one key that are handed on together.
PAIRS, PIECE = 16_000_000, 1024


def tiers(left: DataFrame, right: DataFrame, left_key: list[str], conditions: list[tuple[str, list[Column], list[Column]]], columns: list[str]) -> DataFrame:
    """Cascading equi-joins: a left row takes all matches of the first condition that has any for its left_key.
    ``conditions`` are (tier, keys of left, keys of right); the result is left_key, columns of right and tier.

    A tier is known from the right rows' keys alone, so only left rows are written, not pairs. The number of pairs grows
    with the square of a key's rows: rows of a key are put together in pieces of some PIECE rows, each two pieces that meet
    are a unit of at most about PIECE ** 2 pairs, and units are dealt out to as many tasks as there are PAIRS pairs."""
    keys = [[f"_k{t}_{i}" for i in range(len(on))] for t, (_, on, _) in enumerate(conditions)]
    named = lambda side: [c.alias(k) for ks, x in zip(keys, conditions) for c, k in zip(x[side], ks)]
    other = durable(right.select(F.struct(*columns).alias("_right"), *named(2)), "tier_right")
    counts = [unsent(other.groupBy(*ks).agg(F.count("*").alias(f"_n{t}"))) for t, ks in enumerate(keys)]
    own = left.select(F.struct(*left_key).alias("_left"), *named(1))
    for ks, count in zip(keys, counts):
        own = own.join(count, ks, "left")
    own = own.withColumn("_tier", F.coalesce(*(F.when(F.col(f"_n{t}").isNotNull(), t) for t in range(len(keys))))).withColumn("_pairs", F.coalesce(*(f"_n{t}" for t in range(len(keys)))))
    first = F.min("_tier").over(Window.partitionBy(*(F.col(f"_left.{c}") for c in left_key)))
    own = durable(own.withColumn("_first", first).where("_tier = _first").select("_left", *sum(keys, []), "_tier", "_pairs"), "tier_left")
    total = own.agg(F.sum("_pairs")).first()[0] or 0
    units = None
    for t, ((tier, _, _), ks, count) in enumerate(zip(conditions, keys, counts)):
        mine = own.where(F.col("_tier") == t)
        some = _pieces(mine, "_left", ks, mine.groupBy(*ks).agg(F.count("*").alias("_rows")))
        unit = some.join(unsent(_pieces(other, "_right", ks, count.withColumnRenamed(f"_n{t}", "_rows"))), ks).select(_bare("_left", left_key), _bare("_right", columns), F.lit(tier).alias("tier"))
        units = unit if units is None else units.unionByName(unit)
    tasks = max(-(-total // PAIRS), left.sparkSession.sparkContext.defaultParallelism)
    rows = units.repartition(tasks).select(F.explode("_left").alias("_left"), "_right", "tier").select("_left", F.explode("_right").alias("_right"), "tier")
    fields = lambda name, held: [F.col(name if len(held) == 1 else f"{name}.{c}").alias(c) for c in held]
    return rows.select(*fields("_left", left_key), *fields("_right", columns), "tier")


def _bare(name: str, fields: list[str]) -> Column:
    """An array of structs; where they have one field, of its values, which are taken apart without an object for each."""
    return F.col(name if len(fields) > 1 else f"{name}.{fields[0]}").alias(name)


def _pieces(df: DataFrame, value: str, keys: list[str], counts: DataFrame) -> DataFrame:
    """keys and arrays of some PIECE values with these keys; ``counts`` has the _rows of each key."""
    piece = F.pmod(F.xxhash64(value), F.ceil(F.col("_rows") / PIECE))
    return df.join(unsent(counts), keys).groupBy(*keys, piece.alias("_piece")).agg(F.collect_list(value).alias(value))


def exact_or_first(left: DataFrame, right: DataFrame, left_key: list[str], exact: list[str], group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Left join in tiers: the first right row (by ``order``) with the same ``exact`` keys, else the first of the same
    ``group``, else none; ``match`` says which ('exact', 'group', 'none'). Right rows are ranked before they are joined, so
    a large group costs no pairs."""
    pick = F.struct(*columns)
    best = lambda keys: right.groupBy(*keys).agg(F.min_by(pick, F.struct(*order)).alias("_" + keys[-1]))
    one, two = best(exact).withColumnRenamed("_" + exact[-1], "_one"), best(group).withColumnRenamed("_" + group[-1], "_two")
    rows = left.join(one, exact, "left").join(two, group, "left")
    chosen = F.coalesce("_one", "_two")
    kind = F.when(F.col("_one").isNotNull(), "exact").when(F.col("_two").isNotNull(), "group").otherwise("none")
    return rows.select(*left.columns, *(chosen[c].alias(c) for c in columns if c not in left.columns), kind.alias("match"))


def symmetric_difference(a: DataFrame, b: DataFrame, side: str = "side") -> DataFrame:
    """Rows that only one of the two has, and which."""
    return a.exceptAll(b).withColumn(side, F.lit("a")).unionByName(b.exceptAll(a).withColumn(side, F.lit("b")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to three places, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 3))


def folded(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """df without rows whose label is the same as that of the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_before", F.lag(label).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(label))).drop("_before", "_first")

"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspar.llm.shared import table, uniform

BROADCAST_BYTES = 32 << 20


def rates(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(source, rate): mean number of copies of each document, so that the expected documents of a source are its
    share of ``weights`` (source, weight; default: every source the same) of ``budget`` (default: as many as docs)."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        held = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").cast("string").alias("_source")).agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"))
        held = sizes.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    held = table(held, "sizes")
    total, weight = held.agg(F.sum("n"), F.sum("weight")).first()
    goal = float(budget if budget is not None else total or 0)
    return held.select("source", (F.lit(goal) * F.col("weight") / (weight or 1.0) / F.col("n")).alias("rate"))


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, weight): target weights by the labels of quality: of each source's labelled documents the good ones for
    each bad one (with one bad one added, so that the weight is finite). A document labelled both ways is good; labels of
    unknown documents, null ids and null labels don't count; a source without labels has no weight."""
    per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    of = docs.where("doc_id is not null").select("doc_id", F.col("source").cast("string").alias("source")).distinct().join(per, "doc_id")
    return of.groupBy("source").agg((F.count_if(F.col("_good") == 1) / (F.count_if(F.col("_good") != 1) + 1)).alias("weight"))


def _inverses(rate: DataFrame) -> DataFrame:
    """(source, cdf): the Poisson distribution function at 0, 1, ... to where it is 1 in double precision."""
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int"))).alias("k")
    up = Window.partitionBy("source").orderBy("k")
    steps = rate.where("rate > 0").select("source", "rate", k)
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(up))
    steps = steps.select("source", "k", mass.alias("mass")).select("source", "k", F.sum("mass").over(up).alias("below"))
    return steps.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda x: x["below"]).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: str = "mix") -> DataFrame:
    """Every document as many times as a Poisson number says, in a globally shuffled order.

    The number is the inverse of the Poisson distribution with the source's mean ``rates`` at a uniform number hashed
    from seed and doc_id, so it is the same in every run and on every retry. Result: the columns of docs, ``copy``
    (1, 2, ...) and ``shuffle_key`` (uniform in (0, 1), hashed from doc_id and copy). The rows are dealt to partitions
    by that key and sorted by it in each, which read one after the other is a random order of all rows.

    A null source is a source of its own; a source without a weight gets none and is left out. Null doc_ids hash like
    an empty string; rows with equal doc_ids get equal numbers if their sources do. Null or empty texts are
    documents like others. Columns of docs named copy or shuffle_key are replaced."""
    cdfs = table(_inverses(rates(docs, weights, budget)), "cdf").select(F.col("source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"))
    size = cdfs.agg(F.sum(F.size("_mix_cdf") * 8 + 64)).first()[0] or 0
    keep = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    joined = docs.select(keep).join(F.broadcast(cdfs) if size <= BROADCAST_BYTES else cdfs, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")))
    u = uniform(seed, "doc_id")
    copies = joined.withColumn("_mix_u", u).withColumn("_mix_n", F.expr("size(filter(_mix_cdf, c -> c < _mix_u))")).where("_mix_n > 0")
    rows = copies.select(*keep, F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("copy"))
    rows = rows.withColumn("shuffle_key", uniform(seed + "-order", "doc_id", "copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def sql(seed: str = "mix", columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars", docs: str = "documents", labels: str = "labels") -> str:
    """``poisson_mix(docs, quality_weights(docs, labels))`` in DuckDB's SQL."""
    u = "(('0x' || substr(md5('{0}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496"
    return f"""
    WITH sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
    marked AS (SELECT doc_id, max(quality) AS good FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    weights AS (SELECT source, count(*) FILTER (good = 1)::DOUBLE / (count(*) FILTER (good <> 1) + 1) AS weight FROM (SELECT DISTINCT doc_id, source FROM {docs}) JOIN marked USING (doc_id) GROUP BY source),
    held AS (SELECT sizes.source, n, coalesce(weight, 0) AS weight FROM sizes LEFT JOIN weights ON sizes.source IS NOT DISTINCT FROM weights.source),
    rates AS (SELECT source, (SELECT sum(n) FROM held)::DOUBLE * weight / (SELECT sum(weight) FROM held) / n AS rate FROM held),
    steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rates WHERE rate > 0),
    mass AS (SELECT source, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k)) AS mass FROM steps),
    cdf AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS below FROM mass),
    d AS (SELECT *, {u.format(f"{seed}|' || coalesce(doc_id::VARCHAR, '') || '")} AS u FROM {docs}),
    n AS (SELECT d.doc_id, d.source, count(*) AS n FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.below < d.u GROUP BY ALL),
    c AS (SELECT doc_id, source, unnest(range(1, n + 1))::INT AS copy FROM n)
    SELECT {columns}, c.copy, {u.format(f"{seed}-order|' || coalesce(c.doc_id::VARCHAR, '') || '|' || c.copy::VARCHAR || '")} AS shuffle_key
    FROM c JOIN {docs} d ON d.doc_id = c.doc_id"""

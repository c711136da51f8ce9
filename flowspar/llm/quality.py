"""Quality classifier by importance resampling.

Two hashed n-gram models (bags of words and word pairs in 10,000 buckets), one of the target texts and one of all raw
texts, give each document the logarithm of its importance weight: the sum over its n-grams of log p_target - log p_raw.
Documents are then sampled without replacement in proportion to their weights: the k largest of weight plus Gumbel
noise, where the noise is hashed from the doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.shared import numbered, table, top_k, uniform

BUCKETS, MAX_LABELLED = 10_000, 20_000

TOKEN = tx.GRAPHIC  # punctuation glued to words says much about quality, so words are runs of non-white-space


def buckets(data: np.ndarray, offsets: np.ndarray, n: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of every word and word pair, where each row's begin)."""
    for first, end, part, off in tx.chunks(data, offsets):
        hashes, rows = tx.word_hashes(part, off, TOKEN)
        at, pairs = tx.gram_rows(rows, 2)
        two = tx.grams(hashes, 2)[at] if len(at) else np.zeros(0, np.uint64)
        row = np.concatenate([np.repeat(np.arange(end - first), np.diff(rows)), np.repeat(np.arange(end - first), np.diff(pairs))])
        order = np.argsort(row, kind="stable")
        both = (np.concatenate([hashes, two]) % np.uint64(n)).astype(np.int64)[order]
        yield first, end, both, rows + pairs


def _count(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, n), np.int64)
        for batch in batches:
            target = np.array(batch.column(1).to_pylist(), bool)
            for first, end, both, begin in buckets(*tx.strings(batch.column(0), lower=False), n):
                held[0] += np.bincount(both, minlength=n)
                wanted = np.repeat(target[first:end], np.diff(begin))
                held[1] += np.bincount(both[wanted], minlength=n)
        yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(held[0]), pa.array(held[1])], names=["bucket", "raw", "target"])

    return scan


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to every count."""
    p = lambda c: np.log(c + 1.0) - np.log(c.sum() + len(c))
    return p(target) - p(raw)


def _score(ratios: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, end, both, begin in buckets(*tx.strings(batch.column(1)), len(ratios)):
                weight[first:end] = tx.by_row(ratios[both], begin)
                count[first:end] = np.diff(begin)
            yield pa.record_batch([batch.column(0), pa.array(count), pa.array(weight)], names=["doc_id", "grams", "log_weight"])

    return scan


def importance_scores(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, max_labelled: int = MAX_LABELLED, seed: str = "quality") -> DataFrame:
    """(doc_id, grams, log_weight) of every document. The raw model counts all documents. The target model counts the
    documents labelled quality = 1, of which at most ``max_labelled`` are drawn by hash; so the list of their ids is
    bounded and can be sent to all executors. With no labelled document every weight is the same for equal lengths."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("q")).where("q = 1 and _id is not null")
    drawn = good.orderBy(uniform(seed, "_id"), "_id").limit(max_labelled).select("_id", F.lit(True).alias("_target"))
    marked = numbered(docs).select(F.col("doc_id").cast("long").alias("_doc"), "text").join(F.broadcast(drawn), F.col("_doc") == F.col("_id"), "left")
    marked = marked.select("text", F.coalesce("_target", F.lit(False)).alias("_target"))
    sums = marked.mapInArrow(_count(n), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    held = np.zeros((2, n))
    for bucket, raw, target in sums:
        held[:, bucket] = raw, target
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(log_ratios(*held)), "doc_id long, grams long, log_weight double")


def importance_resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: str = "quality", **how) -> DataFrame:
    """The sampled documents: (doc_id, grams, log_weight, sample_key), the k with the largest sample_key.

    k is ``keep`` times the number of documents with words; by default ``keep`` is the share of quality = 1 among the
    labelled documents (all of them counted). Ties go to the smaller doc_id. Null, empty and white-space texts have no
    n-grams and are never sampled. Rows count one by one: repeated rows have equal keys. A null doc_id hashes like an
    empty string. Labels of unknown documents count for the share only; a document labelled both ways counts as good.
    Other columns are ignored. Without labels everything with words is kept."""
    if keep is None:
        per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
        keep = per.agg(F.avg("q")).first()[0]
        keep = 1.0 if keep is None else keep
    scores = importance_scores(docs, labels, seed=seed, **how).where("grams > 0")
    keyed = table(scores.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform(seed + "-gumbel", "doc_id")))), "scores")
    return top_k(keyed, "sample_key", ["doc_id"], round(keep * keyed.count()))

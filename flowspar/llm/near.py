"""MinHash near-duplicates by an LSH forest.

1. One pass over the texts gives every document a digest and a signature of 128 MinHash values (16 bits kept of each)
   over its lower-cased word pairs. Equal digests are exact copies and collapse to one node.
2. Eight trees each order all nodes by their own 16 signature values (a tree's label). Nodes that agree on the first
   ``depth`` values of a label lie side by side. A region, a run with a longest common prefix of ``depth`` values, is
   split at the next value as long as it holds more than ``region`` nodes: the depth adapts to how dense the region is.
3. Inside a region every pair is compared by the estimated Jaccard similarity of the signatures. Then the forest is
   ascended again: in a run that was split, every node is compared with all those of the run (down to ``depth``
   values) that aren't in its group yet. So splitting only saves comparisons; it parts no pair.
4. Verified pairs are closed to groups; each group keeps its row with the smallest doc_id.

Signatures are compared by their low bytes (b-bit MinHash), with chance agreement taken out of the estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.shared import BLANK, components, numbered, table

VALUES, TREES, LEVELS = 128, 8, 16
SHINGLE, SIMILARITY, DEPTH, REGION = 2, 0.6, 2, 64

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def signatures(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 128 uint16, shingles per row). A text of fewer words than a shingle has one shingle: all its words."""
    rows = len(offsets) - 1
    out = np.zeros((rows, VALUES), np.uint16)
    count = np.zeros(rows, np.int64)
    for first, end, part, off in tx.chunks(data, offsets):
        hashes, begin = tx.word_hashes(part, off, tx.WORD)
        if not len(hashes):
            continue
        at, _ = tx.gram_rows(begin, shingle)
        size = np.diff(begin)
        n = np.where(size >= shingle, size - shingle + 1, (size > 0).astype(np.int64))
        values = np.empty(int(n.sum()), np.uint64)
        where = np.concatenate([[0], np.cumsum(n)])
        long = np.repeat(size >= shingle, n)
        if len(at):
            values[long] = tx.grams(hashes, shingle)[at]
        for r in np.flatnonzero((size > 0) & (size < shingle)):
            h = np.uint64(0)
            for x in hashes[begin[r] : begin[r + 1]]:
                h = tx.mix(np.array([h ^ x], np.uint64))[0]
            values[where[r]] = h
        some = np.flatnonzero(n)
        count[first:end] = n
        heads = where[:-1][some]
        for v in range(VALUES):
            low = np.minimum.reduceat(values * _MUL[v] + _ADD[v], heads)
            out[first + some, v] = (tx.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out, count


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain, plain_off = tx.strings(batch.column(1))
        buf = memoryview(np.ascontiguousarray(plain))
        digests = [hashlib.md5(buf[a:b]).digest() for a, b in zip(plain_off[:-1].tolist(), plain_off[1:].tolist())]
        sig, count = signatures(*tx.strings(batch.column(1), lower=True))
        raw = sig.astype(">u2").tobytes()
        width = VALUES * 2
        yield pa.record_batch(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), pa.array(count)],
            names=["doc_id", "digest", "sig", "shingles"],
        )


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of signature bytes."""
    chance = 1 / 256
    eights = (a == b).view(np.uint64).sum(axis=1)  # of each eighth of the bytes how many are equal, in a byte
    equal = eights * np.uint64(0x0101010101010101) >> np.uint64(56)
    return (equal / VALUES - chance) / (1 - chance)


def _join_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the smallest reachable index into parent, for edges a-b."""
    while True:
        low = np.minimum(parent[a], parent[b])
        old = parent.copy()
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        parent[:] = parent[parent]
        if np.array_equal(old, parent):
            return


def _ascend(first: int, end: int, sig: np.ndarray, parent: np.ndarray, least: float) -> None:
    """All-pairs closure of the run from first to end, whose groups so far are in parent: each row is compared with the
    later rows of other groups, and groups with a pair that matches become one."""
    own = sig[first:end]
    group = parent[first:end] - first
    for i in range(len(own) - 1):
        other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(other):
            if (group == group[0]).all():
                break
            continue
        hit = other[agreement(own[other], own[i]) >= least]
        if len(hit):
            into = np.arange(len(own))
            joined = np.append(group[hit], group[i])
            into[joined] = joined.min()
            group = into[group]
    parent[first:end] = group + first


def forest_pairs(labels: np.ndarray, sig: np.ndarray, depth: int, region: int, least: float) -> np.ndarray:
    """labels: sorted (rows x levels); the result gives each row the smallest row of its verified group."""
    n = len(labels)
    parent = np.arange(n)
    if n < 2:
        return parent
    same = labels[1:] == labels[:-1]
    lcp = np.concatenate([[-1], np.where(same.all(axis=1), labels.shape[1], same.argmin(axis=1))])
    cut = lcp < depth
    runs = np.append(np.flatnonzero(cut), n)
    for level in range(depth + 1, labels.shape[1] + 1):
        run = np.cumsum(cut) - 1
        large = np.bincount(run)[run] > region
        if not large.any():
            break
        cut |= large & (lcp < level)
    run = np.cumsum(cut) - 1
    size = np.bincount(run)
    large = size[run] > region
    step = 1
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    active = np.flatnonzero((size[run] > 1) & ~large)
    while len(active):
        active = active[active + step < n]
        active = active[run[active + step] == run[active]]
        for k in range(0, len(active), 1 << 16):
            i = active[k : k + (1 << 16)]
            hit = agreement(sig[i], sig[i + step]) >= least
            left.append(i[hit])
            right.append(i[hit] + step)
        step += 1
    if left:
        _join_labels(parent, np.concatenate(left), np.concatenate(right))
    for r in np.flatnonzero(np.diff(runs) > region).tolist():
        _ascend(int(runs[r]), int(runs[r + 1]), sig, parent, least)
    return parent


def _scan_trees(depth: int, region: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            fixed = lambda c, w, kind: np.frombuffer(tx.strings(t.column(c))[0], kind).reshape(-1, w)
            labels = np.concatenate([t.column("tree").to_numpy()[:, None].astype(np.uint16), fixed("label", LEVELS, ">u2")], axis=1)
            parent = forest_pairs(labels, fixed("low", VALUES, np.uint8), depth + 1, region, least)
            rows = np.flatnonzero(parent != np.arange(len(parent)))
            digest = t.column("digest").combine_chunks()
            a, b = digest.take(pa.array(rows)), digest.take(pa.array(parent[rows]))
            return pa.RecordBatch.from_arrays([pa.chunked_array(a).combine_chunks() if isinstance(a, list) else a, b], names=["a", "b"])

        for batch in batches:
            both = pa.Table.from_batches([batch])
            held = both if held is None else pa.concat_tables([held, both])
            if held.num_rows < 20_000:
                continue
            held = held.combine_chunks()
            label, _ = tx.strings(held.column("label"))
            head = label.reshape(-1, LEVELS * 2)[:, : depth * 2]
            key = np.concatenate([held.column("tree").to_numpy()[:, None].astype(np.uint8), head], axis=1)
            open_from = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(open_from):
                cut = int(open_from[-1]) + 1
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held)

    return scan


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sig, shingles) of every document."""
    return table(numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id long, digest binary, sig binary, shingles long"), "sketch")


def groups(sketches: DataFrame, similarity: float = SIMILARITY, depth: int = DEPTH, region: int = REGION) -> DataFrame:
    """(digest, root): the group of every text that resembles another text; root is the smallest digest."""
    spark = sketches.sparkSession
    nodes = sketches.where("shingles > 0").groupBy("digest").agg(F.min("sig").alias("sig"))
    low = F.expr(f"sig").alias("sig")
    trees = nodes.select("digest", low, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("digest", "tree", F.expr(f"substring(sig, tree * {2 * LEVELS} + 1, {2 * LEVELS})").alias("label"), "sig")
    trees = trees.mapInArrow(_low_bytes, "digest binary, tree int, label binary, low binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = trees.repartition(parts, "tree", F.expr(f"substring(label, 1, {2 * depth})")).sortWithinPartitions("tree", "label", "digest")
    return components(rows.mapInArrow(_scan_trees(depth, region, similarity), "a binary, b binary"))


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, _ = tx.strings(batch.column(3))
        low = np.ascontiguousarray(sig.reshape(-1, VALUES * 2)[:, 1::2]).tobytes()
        values = pa.array([low[i : i + VALUES] for i in range(0, len(low), VALUES)], pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), values], names=["digest", "tree", "label", "low"])


def _members(sketches: DataFrame, **how) -> DataFrame:
    """(doc_id, digest, root) of each distinct (doc_id, digest) that has words or an exact copy."""
    of = groups(sketches, **how)
    rows = sketches.select("doc_id", "digest", "shingles").distinct()
    return rows.join(of.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row (doc_id, keeper_id) for every document that repeats another one.

    ``keeper_id`` is the smallest doc_id of the group (groups are closed: a row may resemble its keeper through
    others). Pairs with an estimated Jaccard similarity of word pairs of at least 0.6 are linked. Null, empty and
    white-space texts (blanks, tabs, line breaks) are no copies of anything; texts of punctuation alone have exact copies only. Rows that are
    equal in doc_id and text count as one document. A null doc_id sorts last. Other columns are ignored."""
    rows = _members(sketch(docs.where(f"not ({BLANK})")), **how)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(best, "root").where("not (digest = first.digest and doc_id <=> first.doc_id)").select("doc_id", F.col("first.doc_id").alias("keeper_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that ``near_duplicates`` reports, and with one of rows that are equal in doc_id and
    text; all columns stay. Documents whose text is null or white space stay as they are."""
    named = docs.where(f"not ({BLANK})")
    rows = _members(sketch(named), **how)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    keep = rows.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.digest").alias("_near_digest"), F.coalesce(F.col("first.doc_id"), F.lit(-(1 << 63))).alias("_near_key"))
    keyed = named.withColumn("_near_digest", F.unhex(F.md5("text"))).withColumn("_near_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    kept = keyed.join(keep, ["_near_digest", "_near_key"]).dropDuplicates(["_near_digest", "_near_key"]).drop("_near_digest", "_near_key")
    return kept.select(docs.columns).unionByName(docs.where(BLANK))

"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are the 13-word windows of the benchmark items (a shorter item is one test string), lower-cased, with
single spaces for whatever is no letter or digit. The search slides a window as long as the shortest test string of a
length class over the equally normalised documents: the last block of the window is looked up in a shift table, which
tells how far the window may move; where the shift is zero, the bucket of that block's hash holds the test strings to
compare, first by their first bytes, then in full. Many stretches of text advance side by side as numpy lanes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.shared import numbered, small_batches

WORDS, PATTERNS_A_PASS, BYTES_A_PASS = 13, 1_000_000, 128 << 20
TOLD_WORDS = 5  # items of fewer words are common phrases: they are reported, but no reason to drop a document
_BITS, _BLOCK, _LANE = 20, 8, 1024


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ' word word ... word ' (lower-cased bytes in, 8 spare bytes at the end), and their offsets."""
    starts, ends, rows = tx.words(data, offsets, tx.WORD)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    length = ends - starts
    word = np.repeat(np.arange(len(starts)), length)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    spare = np.arange(len(at)) + word + 1 + row[word] if len(at) else at
    total = np.concatenate([[0], np.cumsum(length)])[rows] + rows + np.arange(len(rows))
    out = np.full(int(total[-1]) + _BLOCK, 32, np.uint8)
    out[spare] = data[at]
    return out, total


def normal_words(text: str | None) -> list[bytes]:
    """The words of one text, normalised as documents are."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    out, _ = normal(data, np.array([0, len(data)]))
    return out.tobytes().split()


def test_strings(items: list[tuple[int | None, str | None]], n: int = WORDS, least: int = 1) -> dict[bytes, set]:
    """Test string -> item_ids, of the items of at least ``least`` words."""
    of: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        w = normal_words(text)
        if len(w) >= least:
            for i in range(max(1, len(w) - n + 1)):
                of[b" " + b" ".join(w[i : i + n]) + b" "].add(item)
    return of


class WuManber:
    """The tables of one length class."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.m = min(map(len, patterns))
        self.block = min(_BLOCK, max(2, self.m // 2))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.shift = np.full(1 << _BITS, self.m - self.block + 1, np.uint16 if self.m < 60_000 else np.uint32)
        head = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        padded = np.concatenate([head, np.zeros((len(head), _BLOCK), np.uint8)], axis=1)
        for end in range(self.block, self.m + 1):
            h = self.hash(np.ascontiguousarray(padded[:, end - self.block : end - self.block + _BLOCK]).view(np.uint64).ravel())
            np.minimum.at(self.shift, h, self.m - end)
        first = np.ascontiguousarray(padded[:, :_BLOCK]).view(np.uint64).ravel() & self.mask
        self.buckets: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        for a, b, p in zip(h.tolist(), first.tolist(), patterns):
            self.buckets[a, b].append(p)
        self.keys = np.unique(tx.mix(first ^ tx.mix(h.astype(np.uint64))))

    def hash(self, v: np.ndarray) -> np.ndarray:
        return ((v & self.mask) * tx.MULT >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(position, test string) of every occurrence; data as from ``normal``."""
        eight = np.lib.stride_tricks.as_strided(data, (len(data) - _BLOCK + 1, _BLOCK), (1, 1))
        load = lambda i: eight[i].view(np.uint64).ravel()
        size = np.diff(offsets)
        lanes = np.maximum(size - self.m, -1) // _LANE + 1
        row = np.repeat(np.arange(len(size)), lanes)
        at = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _LANE
        stop = np.minimum(at + _LANE, offsets[row + 1] - self.m + 1)
        found = []
        while len(at):
            h = self.hash(load(at + (self.m - self.block)))
            step = self.shift[h].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                place = at[zero]
                first = load(place) & self.mask
                key = tx.mix(first ^ tx.mix(h[zero].astype(np.uint64)))
                ok = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                found += zip(place[ok].tolist(), h[zero][ok].tolist(), first[ok].tolist())
                step[zero] = 1
            at = at + step
            go = at < stop
            at, stop = at[go], stop[go]
        raw = memoryview(data)
        for place, h, first in found:
            for p in self.buckets.get((h, first), ()):
                if raw[place : place + len(p)] == p:
                    yield place, p


def searchers(patterns: list[bytes]) -> list[WuManber]:
    """One searcher for each class of lengths (a class spans a factor of two), so that a short one slows no long one."""
    classes: dict[int, list[bytes]] = defaultdict(list)
    for p in patterns:
        classes[len(p).bit_length()].append(p)
    return [WuManber(c) for c in classes.values()]


def _hits(column: pa.Array, find: list[WuManber]) -> Iterator[tuple[int, bytes]]:
    """(row, test string) of every occurrence in a text column."""
    data, offsets = tx.strings(column, lower=True)
    for first, _, part, off in tx.chunks(data, offsets, 1 << 20):
        flat, total = normal(part, off)
        for f in find:
            for place, p in f.find(flat, total):
                row = int(np.searchsorted(total, place, "right")) - 1
                if place + len(p) <= total[row + 1]:
                    yield first + row, p


def _strings_of(n: int, least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(test_strings([(item, text)], n, least))
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.record_batch([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.int64())], names=["string", "item_id"])

    return cut


def _passes(benchmark: DataFrame, n: int, least: int) -> Iterator[dict[bytes, set]]:
    """The test strings in order, in passes of at most PATTERNS_A_PASS strings and BYTES_A_PASS bytes, so that what goes to
    the executors is bounded; each string, with all its items, is in one pass. The last may be empty."""
    small_batches(benchmark.sparkSession)
    rows = numbered(benchmark, "item_id").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_strings_of(n, least), "string binary, item_id long")
    held: dict[bytes, set] = {}
    size = 0
    for string, item in rows.distinct().orderBy("string", F.asc_nulls_first("item_id")).toLocalIterator():
        string = bytes(string)
        if string not in held:
            if len(held) >= PATTERNS_A_PASS or size + len(string) > BYTES_A_PASS:
                yield held
                held, size = {}, 0
            held[string] = set()
            size += len(string)
        held[string].add(item)
    yield held


_made: list = [None, None]


def _made_once(shared) -> list[WuManber]:
    """The tables of a broadcast set of strings, built once in each worker process (the last set's are kept)."""
    if _made[0] is not shared.value:
        _made[:] = [shared.value, searchers(list(shared.value))]
    return _made[1]


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, least: int = 1) -> DataFrame:
    """(doc_id, item_id, strings): documents that hold test strings of an item, and how many different ones.

    An item's test strings are its windows of ``n`` words; an item of ``least`` to n - 1 words is one string, a
    shorter one none. Null and empty texts, on either side, hold nothing. Rows of docs count one by one (repeated
    rows give repeated results); items that repeat a text are each reported; other columns are ignored. No text is
    shuffled; each pass over docs searches up to a million strings at once, and of several passes only the results
    are brought together."""

    def scan(of: dict[bytes, set], told: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(of)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, find = shared.value, _made_once(shared)
            for batch in batches:
                held: dict[tuple, set] = defaultdict(set)
                for row, p in _hits(batch.column(1), find):
                    for item in items[p]:
                        held[row, item].add(p)
                ids = batch.column(0).to_pylist() if held else []
                columns = [pa.array([ids[r] for r, _ in held], pa.int64()), pa.array([i for _, i in held], pa.int64()), pa.array([len(v) for v in held.values()], pa.int64())]
                names = ["doc_id", "item_id", "strings"]
                if told:
                    columns.append(pa.array([hashlib.md5(batch.column(1)[r].as_py().encode()).digest() for r, _ in held], pa.binary()))
                    names.append("digest")
                yield pa.record_batch(columns, names=names)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, strings long" + (", digest binary" if told else ""))

    numbered(docs)
    passes = _passes(benchmark, n, least)
    first, second = next(passes), next(passes, None)
    if second is None:
        return scan(first, False)
    out = None
    for k, of in enumerate(chain([first, second], passes)):
        # rows equal in doc_id and text give equal results in every pass: counted in each, added up over all
        one = scan(of, True).groupBy("doc_id", "digest", "item_id").agg(F.count("*").alias("rows"), F.max("strings").alias("strings")).withColumn("pass", F.lit(k))
        out = one if out is None else out.unionByName(one)
    total = out.groupBy("doc_id", "digest", "item_id").agg(F.sum("strings").alias("strings"), F.max("rows").alias("rows"))
    return total.select("doc_id", "item_id", "strings", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, least: int = TOLD_WORDS) -> DataFrame:
    """docs without the documents that hold any test string of an item of at least ``least`` words (see ``leaks``); the
    rest, and all columns, unchanged."""
    at = docs.columns.index("text")
    for of in _passes(benchmark, n, least):
        shared = docs.sparkSession.sparkContext.broadcast(dict.fromkeys(of))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _made_once(shared)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _ in _hits(batch.column(at), find):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def sql(docs: str = "documents", n: int = WORDS, least: int = 1) -> str:
    """``leaks`` in DuckDB's SQL."""
    plain = r"trim(regexp_replace(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    return f"""
    WITH b AS (SELECT item_id, string_split({plain.format("text")}, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM b WHERE len(w) >= {least} AND w[1] <> ''),
    g AS (SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(w, i, i + {n - 1}), ' ') || ' ' AS g FROM p),
    d AS (SELECT doc_id, ' ' || {plain.format("text")} || ' ' AS t FROM {docs} WHERE text IS NOT NULL)
    SELECT doc_id, item_id, count(*) AS strings FROM d JOIN g ON contains(t, g) GROUP BY doc_id, item_id"""

"""Exact dedup of long repeated passages by suffix arrays, built in two stages.

A *window* is ``length`` successive words (runs of non-white-space, compared as they stand). A window is repeated if it
occurs more than once in all documents. The corpus is cut into pieces that can be sorted on their own:

1. Each window has a minimizer, the smallest hash among its runs of five words, and is filed under the hash of all the
   words that the windows with the minimizer in their first half (or in their second) have in common. Equal windows
   are filed alike, so only keys that occur at least twice can hold repeats. Exact copies of a text collapse first.
2. For those, the words around (just the windows filed there) are gathered by key; equal ones collapse. Each piece
   gets a suffix array by two-stage sorting: suffixes smaller than their successors are sorted directly (three words a
   round, ties only), all others are induced by one scan over the buckets. Adjacent suffixes with a common prefix of at
   least ``length`` words are repeats.
3. The windows found are merged to runs of words for each document. The first occurrence (smallest doc_id, then text
   digest, then place) is told from the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.shared import numbered, table

LENGTH, RUN = 50, 5
_PART, _BATCH = 1 << 19, 60_000
_NONE = (1 << 63) - 1


def minimizers(hashes: np.ndarray, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window) of every stretch of windows that are filed under the same key, in one text."""
    out = []
    half = (length - run) // 2
    for begin in range(0, max(len(hashes) - length + 1, 0), _PART):
        part = hashes[begin : begin + _PART + length - 1]
        g = tx.grams(part, run)
        key = g >> np.uint64(20) << np.uint64(20) | np.arange(len(g), dtype=np.uint64)
        width, low, have = length - run + 1, key, 1
        while have < width:
            step = min(have, width - have)
            low, have = np.minimum(low[:-step], low[step:]), have + step
        cut = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([cut[1:], [len(low)]]) - 1
        at = (low[cut] & np.uint64((1 << 20) - 1)).astype(np.int64)
        up, down = tx.powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * up[: len(part)])])
        common = lambda a, b: tx.mix((sums[b] - sums[a]) * down[a])  # noqa: E731, B023
        late = cut < at - half  # windows that begin so early have the minimizer in their second half
        early = last >= at - half
        p = at[early]
        out.append((common(p, p + length - half), np.maximum(cut[early], p - half) + begin, last[early] + begin))
        p = at[late]
        out.append((~common(p - half - 1, p + run), cut[late] + begin, np.minimum(last[late], p - half - 1) + begin))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            raw = memoryview(np.ascontiguousarray(data))
            digest = [hashlib.md5(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            n, parts, counts = [], [], []
            for _, _, part, off in tx.chunks(data, offsets):
                hashes, rows = tx.word_hashes(part, off, tx.GRAPHIC)
                n += np.diff(rows).tolist()
                for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                    found = minimizers(hashes[a:b], length)
                    parts.append(found)
                    counts.append(len(found[0]))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            flat = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (flat[0].view(np.int64), flat[1].astype(np.int32), flat[2].astype(np.int32))]
            yield pa.record_batch([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), *lists], names=["doc_id", "digest", "words", "h", "lo", "hi"])

    return scan


def _contexts(length: int):
    """(digest, order, text, spots) -> (h, order, digest, lo, context): the words that windows lo ... hi reach over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, order = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = tx.strings(batch.column(2))
            spots = batch.column(3)
            ends = spots.offsets.to_numpy()
            h, lo, hi = (spots.values.field(i).to_numpy() for i in range(3))
            for first, end, part, off in tx.chunks(data, offsets):
                hashes, rows = tx.word_hashes(part, off, tx.GRAPHIC)
                short = hashes.astype(np.uint32)
                out: list[list] = [[], [], [], [], []]
                for r in range(first, end):
                    own = short[rows[r - first] : rows[r - first + 1]]
                    for i in range(ends[r], ends[r + 1]):
                        for v, x in zip(out, (int(h[i]), order[r], digest[r], int(lo[i]), own[lo[i] : hi[i] + length].tobytes())):
                            v.append(x)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["h", "ord", "digest", "lo", "context"])

    return cut


def two_stage(ranks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ranks (1, 2, ...), in order up to ``depth`` words, and which adjacent pairs share ``depth``.

    Stage one sorts the suffixes that are smaller than their successors; stage two scans the array and puts before
    each suffix found the one that starts a word earlier, if that is larger than its successor."""
    n = len(ranks)
    pad = np.concatenate([ranks, np.zeros(depth + 3, ranks.dtype)]).astype(np.uint64)
    if int(ranks.max()) < 1 << 21:
        three = pad[:-2] << np.uint64(42) | pad[1:-1] << np.uint64(21) | pad[2:]
    else:  # ranks of pairs keep three words in 64 bits
        pair = np.unique(pad[:-2] << np.uint64(32) | pad[1:-1], return_inverse=True)[1].astype(np.uint64)
        three = pair << np.uint64(32) | pad[2:]
    step = np.sign(np.diff(np.concatenate([ranks, [0]]).astype(np.int64))).astype(np.int8)
    flat = np.flatnonzero(step)
    step = step[flat[np.searchsorted(flat, np.arange(n))]]  # equal neighbours go by the next change
    small = np.flatnonzero(step > 0)

    order = small[np.argsort(three[small], kind="stable")]
    key = three[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1])]))
    at = 3
    while at < depth and len(order):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub, g = order[tied], group[tied]
        k = three[np.minimum(sub + at, n)]
        by = np.lexsort((k, g))
        order[tied] = sub[by]
        k, g = k[by], g[by]
        new = np.concatenate([[False], (k[1:] != k[:-1]) & (g[1:] == g[:-1])])
        bump = np.zeros(len(order), np.int64)
        bump[tied] = new
        edge = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(np.maximum(edge, bump))
        at += 3

    count = np.bincount(ranks, minlength=int(ranks.max()) + 2)
    end = np.cumsum(count)
    head = (end - count).tolist()
    sa = np.full(n, -1, np.int64)
    # the small ones fill their buckets' ends, in order
    c = ranks[order]
    of = np.bincount(c, minlength=len(count))
    sa[end[c] - of[c] + np.arange(len(c)) - (np.cumsum(of) - of)[c]] = order
    place, word, large = memoryview(sa), memoryview(ranks.astype(np.int64)), memoryview((step < 0).view(np.uint8))
    place[head[word[n - 1]]] = n - 1
    head[word[n - 1]] += 1
    for i in range(n):
        j = place[i] - 1
        if j >= 0 and large[j]:
            w = word[j]
            place[head[w]] = j
            head[w] += 1

    alike = np.zeros(n, bool)
    live = np.arange(1, n)
    for off in [*range(0, depth - 2, 3), depth - 3]:
        a, b = sa[live - 1] + off, sa[live] + off
        live = live[three[np.minimum(a, n)] == three[np.minimum(b, n)]]
    alike[live] = True
    return sa, alike


def repeats(contexts: list[np.ndarray], length: int = LENGTH, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window in it, run) of every window that occurs at least twice; equal windows share a run. times: how
    often each context occurs (default: once)."""
    size = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(size)])
    ranks = np.unique(np.concatenate(contexts), return_inverse=True)[1] + 1
    sa, alike = two_stage(ranks, length)
    of = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(ranks)) - begin[of] <= size[of] - length
    run = np.cumsum(~alike)
    keep = inside[sa]
    sa, run = sa[keep], run[keep]
    many = np.bincount(run, None if times is None else times[of[sa]])[run] > 1 if len(run) else np.zeros(0, bool)
    sa, run = sa[many], run[many]
    return of[sa], sa - begin[of[sa]], run


def _sort_pieces(length: int):
    """(h, ord, digest, lo, context), by h -> (digest, start, end, again): runs of repeated words."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        order = rows.column("ord").to_numpy()
        lo = rows.column("lo").to_numpy()
        digest = rows.column("digest").to_pylist()
        coded = rows.column("context").combine_chunks().dictionary_encode()
        _, first, times = np.unique(coded.indices.to_numpy(), return_index=True, return_counts=True)
        contexts = [np.frombuffer(x, np.uint32) for x in coded.dictionary.to_pylist()]
        rest = np.ones(len(lo), bool)
        rest[first] = False  # rows are in order: the first of equal ones comes first, and all its windows recur in the others
        if rest.any():
            size = np.array([len(x) for x in contexts])[coded.indices.to_numpy()[rest]]
            others = np.flatnonzero(rest)
            yield pa.record_batch(
                [pa.array([digest[c] for c in others], pa.binary()), pa.array(lo[others].astype(np.int32)), pa.array((lo[others] + size).astype(np.int32)), pa.array(np.ones(len(others), bool))],
                names=["digest", "start", "end", "again"],
            )
        context, at, run = repeats(contexts, length, times)
        if not len(context):
            return
        context = first[context]
        place = lo[context] + at
        rank = np.unique(np.array(digest, dtype="S16").view("S16"), return_inverse=True)[1]
        by = np.lexsort((place, rank[context], order[context], run))
        again = np.zeros(len(run), bool)
        again[by[1:]] = run[by[1:]] == run[by[:-1]]
        by = np.lexsort((at, context))
        context, place, again = context[by], place[by], again[by]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1) | (again[1:] != again[:-1])])
        cut = np.flatnonzero(new)
        last = np.concatenate([cut[1:], [len(place)]]) - 1
        yield pa.record_batch(
            [pa.array([digest[c] for c in context[cut]], pa.binary()), pa.array(place[cut].astype(np.int32)), pa.array((place[last] + length).astype(np.int32)), pa.array(again[cut])],
            names=["digest", "start", "end", "again"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, enough = [], 0, _BATCH
        for batch in batches:
            held.append(batch)
            words += len(tx.strings(batch.column(4))[0]) // 4
            if words < enough:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            size = np.diff(tx.strings(rows.column("context"))[1]) // 4
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sums = np.concatenate([[0], np.cumsum(size)])
            first = 0
            for e in edges[1:].tolist():  # the last minimizer may go on in the next batch
                if sums[e] - sums[first] >= _BATCH or e == edges[-1]:
                    yield from solve(rows.slice(first, e - first))
                    first = e
            rest = rows.slice(first)
            held, words = rest.to_batches(), int(sums[-1] - sums[first])
            enough = max(_BATCH, 2 * words)  # a hot key is looked through again only when it has doubled
        if held:
            yield from solve(pa.Table.from_batches(held))

    return scan


_ROWS = "array<struct<start:int,end:int,again:boolean>>"


def _merge(spans: list[dict]) -> list[tuple[int, int, bool]]:
    """Maximal runs of words: again (some window there has an earlier occurrence), or first (it is the first)."""
    cuts: dict[int, list[int]] = {}
    for s in spans:
        cuts.setdefault(s["start"], [0, 0])[s["again"]] += 1
        cuts.setdefault(s["end"], [0, 0])[s["again"]] -= 1
    out: list[list] = []
    first = again = 0
    since = 0
    for at in sorted(cuts):
        kind = True if again else False if first else None
        if kind is not None and at > since:
            if out and out[-1][1] == since and out[-1][2] == kind:
                out[-1][1] = at
            else:
                out.append([since, at, kind])
        first += cuts[at][0]
        again += cuts[at][1]
        since = at
    return [tuple(x) for x in out]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("again", pa.bool_())]))
    for batch in batches:
        spans = [[{"start": a, "end": b, "again": c} for a, b, c in _merge(x)] for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["digest", "spans"])


def _key(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(_NONE))


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, key, spans) of every distinct (doc_id, text) that holds repeated windows. A written table."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = table(named.mapInArrow(_anchors(length), "doc_id long, digest binary, words long, h array<long>, lo array<int>, hi array<int>").where(f"words >= {length}"), "anchors")

    members = found.select("doc_id", "digest", "words").distinct()
    texts = members.groupBy("digest").agg(F.min(_key()).alias("key"), F.count("*").alias("n"), F.first("words").alias("words"))
    spots = found.withColumn("key", _key()).join(texts.select("digest", "key"), ["digest", "key"]).select("digest", "key", F.explode(F.arrays_zip("h", "lo", "hi")).alias("s"))
    spots = spots.select("digest", "key", "s.h", "s.lo", "s.hi")
    shared = spots.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    wanted = shared.groupBy("digest", "key").agg(F.collect_set(F.struct("h", "lo", "hi")).alias("spots"))
    texted = named.withColumn("key", _key()).withColumn("digest", F.unhex(F.md5("text")))
    joined = texted.join(wanted, ["digest", "key"]).dropDuplicates(["digest", "key"]).select("digest", "key", "text", "spots")
    pieces = joined.mapInArrow(_contexts(length), "h long, ord long, digest binary, lo int, context binary")
    pieces = pieces.repartition(parts, "h").sortWithinPartitions("h", "ord", "digest", "lo")
    runs = pieces.mapInArrow(_sort_pieces(length), "digest binary, start int, end int, again boolean")

    copied = texts.where("n > 1")
    copies = copied.select("digest", F.lit(0).alias("start"), F.col("words").cast("int").alias("end"), F.lit(False).alias("again"))
    merged = runs.unionByName(copies).groupBy("digest").agg(F.collect_list(F.struct("start", "end", "again")).alias("spans"))
    merged = merged.mapInArrow(_merged, f"digest binary, spans {_ROWS}")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").cast("int").alias("end"), F.lit(True).alias("again"))).cast(_ROWS)
    rows = members.withColumn("own", _key()).join(texts.select("digest", "key"), "digest").join(merged, "digest")
    return table(rows.select("doc_id", "digest", F.col("own").alias("key"), F.when(F.col("own") == F.col("key"), F.col("spans")).otherwise(whole).alias("spans")), "spans")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word, again): the maximal runs of words that repeated windows cover.

    ``again`` holds where some window there has an earlier occurrence (smaller doc_id, then text digest, then place);
    the other runs are first occurrences. end_word is exclusive. Repeats count across documents and within one. Null
    texts and texts of fewer than ``length`` words have no window. Rows equal in doc_id and text count as one
    document; a null doc_id comes last. Other columns are ignored."""
    spans = _spans(docs, length).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.again").alias("again"))


def _cutter(at: int, spans_at: int, count_at: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, keep = batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), np.ones(batch.num_rows, bool)
            columns = batch.columns
            lengths = columns[count_at].to_pylist() if count_at is not None else None
            for i, (t, s) in enumerate(zip(texts, spans)):
                again = [x for x in s or () if x["again"]]
                if not again:
                    continue
                data = np.frombuffer(t.encode(), np.uint8)
                starts, _, _ = tx.words(data, np.array([0, len(data)]), tx.GRAPHIC)
                edge = np.append(starts, len(data)).tolist()
                out, since = [], 0
                for x in again:
                    out.append(data[since : edge[x["start"]]])
                    since = edge[x["end"]]
                out.append(data[since:])
                texts[i] = b"".join(p.tobytes() for p in out).decode().rstrip()
                keep[i] = bool(texts[i].strip())
                if lengths is not None:
                    lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if lengths is not None:
                columns[count_at] = pa.array(lengths, columns[count_at].type)
            columns.pop(spans_at)
            names = [n for i, n in enumerate(batch.schema.names) if i != spans_at]
            yield pa.record_batch(columns, names=names).filter(pa.array(keep))

    return cut


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every run that ``repeated_spans`` reports as ``again`` cut out of its text; n_chars, where there is such
    a column, follows. A document of which nothing is left is dropped. Other documents and columns stay as they are."""
    spans = _spans(docs, length).where("exists(spans, x -> x.again)").select(F.col("digest").alias("_suffix_digest"), F.col("key").alias("_suffix_key"), F.col("spans").alias("_suffix_spans"))
    keyed = docs.withColumn("_suffix_digest", F.unhex(F.md5("text"))).withColumn("_suffix_key", _key())
    rows = keyed.join(spans, ["_suffix_digest", "_suffix_key"], "left").select(*docs.columns, "_suffix_spans")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return rows.mapInArrow(_cutter(docs.columns.index("text"), len(docs.columns), count), docs.schema)


def sql(length: int = LENGTH, docs: str = "documents") -> str:
    """``repeated_spans`` in DuckDB's SQL, for distinct doc_ids."""
    return f"""
    WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f]+', ' ', 'g')), ' ') AS w, md5(text) AS digest FROM {docs} WHERE text IS NOT NULL),
    win AS (SELECT doc_id, digest, i, md5(array_to_string(list_slice(w, i, i + {length - 1}), ' ')) AS h
            FROM (SELECT *, unnest(range(1, len(w) - {length} + 2)) AS i FROM d WHERE len(w) >= {length})),
    r AS (SELECT doc_id, i - 1 AS i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, digest, i) > 1 AS again FROM win),
    word AS (SELECT doc_id, p, bool_or(again) AS again FROM (SELECT doc_id, again, unnest(range(i, i + {length})) AS p FROM r WHERE n > 1) GROUP BY doc_id, p),
    run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, again ORDER BY p) AS g FROM word)
    SELECT doc_id, min(p)::INT AS start_word, (max(p) + 1)::INT AS end_word, again FROM run GROUP BY doc_id, again, g"""

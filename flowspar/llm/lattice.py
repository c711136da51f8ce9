"""Subword lattice likelihood: the marginal probability of a text over all its segmentations into vocabulary pieces.

The pieces and their scores come from an existing sentencepiece vocabulary (its path is a parameter; nothing is
trained). Scores of a unigram vocabulary are log-probabilities and used as they are. A BPE vocabulary (the model
file says which it is) has merge ranks instead (score = -rank); they are read as Zipf ranks, p ~ 1 / (rank + 2), and normalised. Byte pieces get the weight
after the last rank, so every text can be segmented.

A text is a sequence of words (runs of non-white-space), each written as the word mark and its bytes; pieces don't
cross words, as in the vocabulary itself. For one word, with a[0] = 0, a[i] = log sum over pieces w that end at byte i
of exp(a[i - len(w)] + score(w)), and a[n] is the log of the sum over all segmentations. A text's log-probability is the
sum over its words. Each piece of text (some MB) evaluates its distinct words once, all words in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.shared import numbered, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG, BLOCK = 96, 8192


UNIGRAM = 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message: numbers and byte strings; fixed-width values are skipped."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            at += 8 if tag & 7 == 1 else 4


def model_type(proto: bytes) -> int:
    """What a model file says it is (trainer_spec.model_type): 1 unigram, 2 BPE, 3 words, 4 characters."""
    for number, trainer in _fields(proto):
        if number == 2:
            return next((int(v) for n, v in _fields(trainer) if n == 3), UNIGRAM)
    return UNIGRAM


class Lattice:
    """A vocabulary with log-probabilities, for the forward recursion."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            pieces[model.id_to_piece(i).encode()] = model.get_score(i)
        self._weigh(pieces, model_type(model.serialized_model_proto()) != UNIGRAM)

    @classmethod
    def of(cls, pieces: dict[bytes, float], ranked: bool = False) -> Lattice:
        """A vocabulary given directly: log-probabilities, or merge ranks (negative) if ``ranked``."""
        self = cls.__new__(cls)
        self._weigh(dict(pieces), ranked)
        return self

    def _weigh(self, pieces: dict[bytes, float], ranked: bool) -> None:
        proper = {k: v for k, v in pieces.items() if v > -1e8}  # -1e9 marks pieces that are never to be used
        if ranked and proper:
            ranks = {k: r for r, k in enumerate(sorted(proper, key=lambda k: (-proper[k], k)))}
            norm = np.log(sum(1 / (r + 2) for r in range(len(ranks) + 256)))
            proper = {k: float(-np.log(r + 2) - norm) for k, r in ranks.items()}
            floor = float(-np.log(len(ranks) + 2) - norm)
        else:
            floor = min(proper.values(), default=0.0) - 10.0  # as the library gives to unknown characters
        for b in range(256):
            proper.setdefault(bytes([b]), floor)
        self.pieces = proper
        self.longest = max(map(len, proper))
        names = sorted(proper)
        joined = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(k) for k in names])
        hashes = tx.spans(tx.prefix(joined), ends - [len(k) for k in names], ends)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([proper[k] for k in names])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def word(self, word: bytes) -> float:
        """The forward recursion for one word (used for very long ones, and as the plain form of ``words``)."""
        a = [0.0] + [-np.inf] * len(word)
        for i in range(1, len(word) + 1):
            terms = [a[j] + s for j in range(max(0, i - self.longest), i) if (s := self.pieces.get(word[j:i])) is not None]
            top = max(terms)
            a[i] = top + float(np.log(np.sum(np.exp(np.array(terms) - top))))
        return a[-1]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """a[n] of every span of data."""
        out = np.zeros(len(starts))
        size = ends - starts
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.word(data[starts[i] : ends[i]].tobytes())
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        sums = tx.prefix(data)
        for k in range(0, len(order), BLOCK):
            some = order[k : k + BLOCK]
            out[some] = self._block(sums, starts[some], size[some])
        return out

    def _block(self, sums: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """a[n] of words sorted by falling size, one byte position at a time for all of them."""
        a = np.full((int(size[0]) + 1, len(size)), -np.inf)
        a[0] = 0
        reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right")  # words of at least that many bytes
        for i in range(1, int(size[0]) + 1):
            n = reach[i]
            end = starts[:n] + i
            total = a[i, :n]
            for j in range(max(0, i - self.longest), i):
                h = tx.spans(sums, starts[:n] + j, end)
                some = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[some]
                some, at = some[hit], at[hit]
                total[some] = np.logaddexp(total[some], a[j, some] + self.scores[at])
        return a[size, np.arange(len(size))]


_held: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _held:
        _held[path] = Lattice(path)
    return _held[path]


def score_texts(model: Lattice, column: pa.Array, size: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probability, words, bytes of the words) of each text."""
    data, offsets = tx.strings(column)
    rows = len(offsets) - 1
    total, count, weight = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for first, end, part, off in tx.chunks(data, offsets, size):
        starts, ends, begin = tx.words(part, off, tx.GRAPHIC)
        if not len(starts):
            continue
        _, one, back = np.unique(tx.spans(tx.prefix(part), starts, ends), return_index=True, return_inverse=True)
        length = ends[one] - starts[one] + len(MARK)
        stop = np.cumsum(length)
        marked = np.empty(int(stop[-1]), np.uint8)
        head = stop - length
        for i, b in enumerate(MARK):
            marked[head + i] = b
        body = np.ones(len(marked), bool)
        for i in range(len(MARK)):
            body[head + i] = False
        n = length - len(MARK)
        marked[body] = part[np.repeat(starts[one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        score = model.words(marked, head, stop)
        total[first:end] = tx.by_row(score[back], begin)
        count[first:end] = np.diff(begin)
        weight[first:end] = tx.by_row(ends - starts, begin)
    return total, count, weight


def _scan(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _lattice(path)
        for batch in batches:
            total, count, weight = score_texts(model, batch.column(2))
            per = pa.array(np.where(weight > 0, total / np.maximum(weight, 1), 0.0), mask=count == 0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(count), pa.array(total, mask=count == 0), per], names=["doc_id", "lang", "words", "log_prob", "log_prob_per_byte"])

    return scan


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang, words, log_prob, log_prob_per_byte) of every row of docs.

    Null, empty and white-space texts have 0 words and null scores. A null lang stays null. Rows count one by one;
    other columns are ignored; a missing lang column is null."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(_scan(vocabulary), "doc_id long, lang string, words long, log_prob double, log_prob_per_byte double")


def lattice_ranks(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``lattice_scores`` with each document's place among all documents of its language: lang_rank (1 = most likely for
    its bytes; ties by doc_id, then log_prob), lang_docs, and third ('head', 'middle', 'tail').

    Ranks are exact and count the whole corpus: rows are range-partitioned by language and score, counted for each
    partition and language, and numbered within. Documents without words have no rank, and third is null."""
    spark = docs.sparkSession
    scores = table(lattice_scores(docs, vocabulary), "scores")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("log_prob_per_byte"), F.asc("doc_id"), F.asc("log_prob")]
    ranged = scores.where("words > 0").repartitionByRange(parts, F.asc("lang"), *order).withColumn("_part", F.spark_partition_id())
    ranged = table(ranged, "ranged")
    counts = table(ranged.groupBy("lang", "_part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("lang").alias("_lang"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(Window.partitionBy("lang")).alias("lang_docs"))
    local = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    ranked = ranged.withColumn("_n", local).join(offsets, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("lang_rank", F.col("_n") + F.col("_before"))
    third = F.when(F.col("lang_rank") * 3 <= F.col("lang_docs"), "head").when(F.col("lang_rank") * 3 <= F.col("lang_docs") * 2, "middle").otherwise("tail")
    columns = [*scores.columns, "lang_rank", "lang_docs"]
    rest = scores.where("words = 0").select(*scores.columns, F.lit(None).cast("long").alias("lang_rank"), F.lit(None).cast("long").alias("lang_docs"), F.lit(None).cast("string").alias("third"))
    return ranked.select(*columns, third.alias("third")).unionByName(rest)

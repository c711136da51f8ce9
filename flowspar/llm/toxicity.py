"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel compares strings by their common subsequences of three letters, each weighted by ``DECAY`` to the length it
spans, so letters put in between cost a little and don't hide a word. It is normalised: k(x, x) = 1. The strings are the
words of a sentence, each after a mark for its beginning: letters in lower case (digits that stand for letters as
those), punctuation left out, runs of three or more single letters taken together ('i d i o t').

Training (``fit``) is on sentences of labelled documents. Positive words are those found in far more toxic documents
than others; with one letter inserted they are positive, too. Negatives are words of the other documents' sentences: a
sample drawn by hash and those most like the positive ones. Landmarks are positive words and their closest negatives; a
Newton method solves the squared-hinge SVM in the Nystroem space. As the kernel has explicit features, the machine
folds into one weight for each letter triple, so scoring a word takes no landmark at all.

A passage's evidence is the log-likelihood ratio of its number of toxic words, as a Poisson number with the rate of
toxic or of other documents; a document's evidence is that of its best passage of successive words (a scan statistic).
So clean words before, after or between never clear a document of what a part of it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspar.llm import text as tx
from flowspar.llm.near import drop_near_duplicates
from flowspar.llm.shared import numbered, table, uniform

DECAY, LETTERS, WIDTH = 0.7, 28, 24
MAX_TOXIC, MAX_OTHER, LANDMARKS, NEGATIVES, HARD = 5_000, 10_000, 128, 10_000, 4_000
EVIDENCE, TRAINING, FALSE_ALARMS = 15.0, 0.7, 0.002
LIMITS = [x / 10 for x in range(21)]

CODE = np.zeros(256, np.uint8)
CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
for _digit, _letter in zip("013457@", "oieasta"):
    CODE[ord(_digit)] = ord(_letter) - 96
CODE[128:] = 27
_ASCII = bytes([0, *range(97, 123), 35])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words to score: (codes, start of each word in codes, its end, its row). Words of more than WIDTH letters
    become pieces of WIDTH letters that overlap by half; words of fewer than three are left out."""
    starts, ends, rows = tx.words(data, offsets, tx.GRAPHIC)
    code = CODE[data]
    at = np.flatnonzero(code)
    codes = code[at]
    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    some = b > a
    a, b, row = a[some], b[some], row[some]
    single = (b - a == 1).astype(np.int8)
    if len(single):
        new = np.concatenate([[True], (single[1:] != single[:-1]) | (row[1:] != row[:-1])])
        cut = np.flatnonzero(new)
        last = np.concatenate([cut[1:], [len(single)]]) - 1
        spelt = (single[cut] == 1) & (last - cut >= 2)
        alone = single == 0
        a, b, row = np.concatenate([a[alone], a[cut[spelt]]]), np.concatenate([b[alone], b[last[spelt]]]), np.concatenate([row[alone], row[cut[spelt]]])
    long = b - a > WIDTH
    if long.any():
        la, lb, lr = a[long], b[long], row[long]
        n = (lb - la - WIDTH + WIDTH // 2 - 1) // (WIDTH // 2) + 1
        pa_ = np.repeat(la, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * (WIDTH // 2)
        pb = np.minimum(pa_ + WIDTH, np.repeat(lb, n))
        a, b, row = np.concatenate([a[~long], pa_]), np.concatenate([b[~long], pb]), np.concatenate([row[~long], np.repeat(lr, n)])
    ok = b - a >= 3
    return codes, a[ok], b[ok], row[ok]


def by_length(codes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of the words, their letters as columns, after a 0 for the beginning) for words of the same length."""
    size = b - a
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for some in np.split(order, cut):
        for k in range(0, len(some), block):
            part = some[k : k + block]
            if len(part):
                yield part, np.stack([np.zeros(len(part), np.uint8), *(codes[a[part] + i] for i in range(int(size[part[0]])))])


def weighted(letters: np.ndarray, table_: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Sum over all triples of places of decay ** span times the weight of their letters."""
    n = len(letters)
    wide = letters.astype(np.int32)
    high, mid = wide * LETTERS * LETTERS, wide * LETTERS
    out = np.zeros(letters.shape[1])
    for i, k in combinations(range(n), 2):
        if k - i < 2:
            continue
        ends = high[i] + wide[k]
        part = table_[ends + mid[i + 1]]
        for j in range(i + 2, k):
            part = part + table_[ends + mid[j]]
        out += decay ** (k - i + 1) * part
    return out


def self_kernel(letters: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """k(x, x) before normalising, by the usual recursion over prefixes."""
    n, u = letters.shape
    same = letters[:, None, :] == letters[None, :, :]
    prev = np.ones((n + 1, n + 1, u))
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, u))
        for i in range(1, n + 1):
            run = np.zeros(u)
            for j in range(1, n + 1):
                run = decay * run + decay * decay * same[i - 1, j - 1] * prev[i - 1, j - 1]
                now[i, j] = decay * now[i - 1, j] + run
        prev = now
    return decay * decay * (same * prev[:n, :n]).sum(axis=(0, 1))


def least_norms(decay: float = DECAY) -> np.ndarray:
    """A lower bound of the norm of a word of each length (exact if no triple repeats)."""
    return np.array([np.sqrt(sum((n - s) * (s - 1) * decay ** (2 * (s + 1)) for s in range(2, n))) if n > 2 else 0.0 for n in range(WIDTH + 2)])


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts and ends of words (already of a to z and '#')."""
    data = np.frombuffer("".join(words).encode().replace(b"#", b"\xff"), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
    return CODE[data], ends - [len(w) for w in words], ends


def features(word: str) -> np.ndarray:
    """The explicit features of one word, normalised."""
    out = np.zeros(LETTERS**3)
    c = [0, *(int(x) for x in encode([word])[0])]
    for i, j, k in combinations(range(len(c)), 3):
        out[(c[i] * LETTERS + c[j]) * LETTERS + c[k]] += DECAY ** (k - i + 1)
    return out / max(np.linalg.norm(out), 1e-12)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel matrix."""
    codes, a, b = encode(words)
    out = np.zeros((len(words), len(landmarks)))
    tables = np.array([features(z) for z in landmarks]).reshape(len(landmarks), LETTERS**3)
    for some, letters in by_length(codes, a, b, 256):
        wide, own = letters.astype(np.int64), np.zeros((letters.shape[1], LETTERS**3))
        row = np.arange(len(own))
        for i, j, k in combinations(range(len(letters)), 3):
            own[row, (wide[i] * LETTERS + wide[j]) * LETTERS + wide[k]] += DECAY ** (k - i + 1)
        out[some] = own @ tables.T / np.maximum(np.sqrt((own * own).sum(axis=1)), 1e-12)[:, None]
    return out


def solve_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton's method; the bias is a feature of its own."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(50):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], c * weight[active]
        new = np.linalg.solve(np.diag(ridge) + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


class Machine:
    """The folded machine: a word's score is weighted(word, table) / norm(word) + bias, and it is toxic above ``limit``. A
    document is toxic if it has a passage, of h toxic words among n, for which h * gain - n * cost is above ``needed``."""

    def __init__(self, table_: np.ndarray, bias: float) -> None:
        self.table, self.bias, self.limit = table_, bias, 0.0
        self.gain, self.cost, self.needed = 1.0, 0.0, 0.0
        self.norms = least_norms()

    def score(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Scores; -inf where they are at most ``least`` (told by the bound on the norm, so most words need none)."""
        out = np.full(len(a), -np.inf)
        for some, letters in by_length(codes, a, b):
            total = weighted(letters, self.table)
            most = np.where(total > 0, total / self.norms[len(letters)], total)
            likely = np.flatnonzero(most + self.bias > least) if least > self.bias else np.arange(len(some))
            if len(likely):
                value = total[likely] / np.sqrt(self_kernel(letters[:, likely])) + self.bias
                out[some[likely]] = np.where(value > least, value, -np.inf)
        return out


def train(seeds: list[str], negatives: list[str], size: int = LANDMARKS) -> Machine:
    """Fits the machine on words, with at most ``size`` landmarks of each kind; see ``fit``."""
    known = set(seeds)
    near = kernel(negatives, seeds).max(axis=1) if negatives else np.zeros(0)
    closest = [negatives[i] for i in np.argsort(-near, kind="stable")[:size]]
    landmarks = seeds[:size] + closest
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    inserted = [w[:i] + alphabet[(i * 7 + k * 5 + len(w)) % 26] + w[i:] for w in seeds for i in range(1, len(w)) for k in range(3)]
    bad = set(negatives)
    positives = seeds + [w for w in dict.fromkeys(inserted) if w not in bad]
    gram = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    words = positives + [w for w in negatives if w not in known]
    y = np.array([1.0] * len(positives) + [-1.0] * (len(words) - len(positives)))
    weight = np.where(y > 0, len(words) / (2 * len(positives)), len(words) / (2 * max(1, len(words) - len(positives)))) / len(words) * 1000
    w, bias = solve_svm(kernel(words, landmarks) @ root, y, weight)
    return Machine(sum(g * features(z) for g, z in zip(root @ w, landmarks)), bias)


_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, doc, text) -> (toxic, word, places where the document has it); words are those of its sentences."""
    for batch in batches:
        toxic, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        for k in range(0, len(texts), 256):
            parts, of = [], []
            for i, t in enumerate(texts[k : k + 256], k):
                own = [s for s in _SENTENCE.split((t or "").encode()) if s]
                parts += own
                of += [i] * len(own)
            if not parts:
                continue
            data = np.frombuffer(b"".join(parts), np.uint8)
            codes, a, b, row = units(data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            if not len(a):
                continue
            word = np.unique(tx.spans(tx.prefix(codes), a, b), return_inverse=True)[1]
            _, one, count = np.unique(word * len(texts) + np.array(of)[row], return_index=True, return_counts=True)
            raw = codes.tobytes().translate(_ASCII + bytes(256 - len(_ASCII)))
            words = [raw[x:y].decode() for x, y in zip(a[one].tolist(), b[one].tolist())]
            yield pa.record_batch([pa.array(toxic[np.array(of)[row[one]]].astype(np.int32)), pa.array(words), pa.array(count)], names=["toxic", "word", "places"])


def fit(docs: DataFrame, labels: DataFrame, seed: str = "toxic", max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER, landmarks: int = LANDMARKS, negatives: int = NEGATIVES, hard_negatives: int = HARD) -> Machine | None:
    """Trains on at most ``max_toxic`` toxic and ``max_other`` other labelled documents, drawn by hash of the doc_id and
    freed of near-duplicates; only their ids, and then lists of their words, leave the executors. Every word with enough
    evidence is a positive. Of the words of other documents ``negatives`` are drawn by hash, and the ``hard_negatives``
    most like the positive ones are added. ``landmarks`` is the number of Nystroem landmarks of each kind. A document labelled both ways
    counts as toxic. Returns None where no word tells toxic documents from others.

    Of these documents TRAINING train the machine; the others set its limits (see ``_calibrate``). A positive word is found
    in toxic documents at least 20 times as often as in others, with evidence (a Chernoff bound) of at least EVIDENCE."""
    per = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null")
    draw = lambda y, n: per.where(F.col("toxic") == y).orderBy(uniform(seed, "_id"), "_id").limit(n)
    drawn = draw(1, max_toxic).unionByName(draw(0, max_other)).withColumn("training", uniform(seed + "-training", "_id") < TRAINING)
    rows = numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", "training")
    rows = table(drop_near_duplicates(table(rows, "labelled")), "single")
    found = rows.where("training").select("toxic", "doc_id", "text").mapInArrow(_sentence_words, "toxic int, word string, places long")
    is_toxic = F.col("toxic") == 1
    counts = [F.count_if(is_toxic).alias("toxic"), F.count_if(~is_toxic).alias("other"), F.sum(F.when(is_toxic, F.col("places")).otherwise(0)).alias("in_toxic"), F.sum(F.when(is_toxic, 0).otherwise(F.col("places"))).alias("in_other")]
    words = table(found.groupBy("word").agg(*counts), "words")
    toxic, other = words.agg(F.sum("toxic"), F.sum("other")).first()
    share = F.lit(max(toxic or 0, 1) / max((toxic or 0) + (other or 0), 2))
    t, o = F.col("toxic").cast("double"), F.col("other").cast("double")
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + o) * p))).otherwise(0.0)
    strength = part(t, share) + part(o, 1 - share)
    seeds = [r["word"] for r in words.where("toxic > 20 * other and length(word) >= 4").where(strength >= EVIDENCE).orderBy(F.desc(strength), "word").collect()]
    if not seeds:
        return None
    others = words.where("other > 0").join(docs.sparkSession.createDataFrame([(w,) for w in seeds], "word string"), "word", "left_anti")
    plain = [r["word"] for r in others.orderBy(uniform(seed + "-words", "word"), "word").limit(negatives).select("word").collect()]
    near = sum(features(z) for z in seeds)
    first = Machine(near, 0.0)
    hard = [r["word"] for r in others.mapInArrow(_scored(first, -np.inf), _SCORED).orderBy(F.desc("score"), "word").limit(hard_negatives).select("word").collect()]
    machine = train(seeds, sorted({*plain, *hard}), landmarks)

    machine.seeds = seeds
    held = rows.where("not training").select("toxic", "text")
    counts = [tuple(r) for r in held.mapInArrow(_counted(machine), "toxic int, words long, hits array<long>").collect()]
    rates = _rates(counts)
    best = [tuple(r) for r in held.mapInArrow(_judged(machine, rates), "toxic int, evidence array<double>").collect()]
    return machine if _calibrate(machine, rates, best) else None


def _counted(machine: Machine):
    """(toxic, text) -> (toxic, words, those above each of LIMITS)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            n, hits = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(LIMITS)), np.int64)
            for first, end, part, off in tx.chunks(data, offsets):
                codes, a, b, row = units(part, off)
                value = machine.score(codes, a, b, LIMITS[0])
                n[first:end] = np.bincount(row, minlength=end - first)
                for i, limit in enumerate(LIMITS):
                    hits[first:end, i] = np.bincount(row[value > limit], minlength=end - first)
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(n), pa.array(hits.tolist(), pa.list_(pa.int64()))], names=["toxic", "words", "hits"])

    return scan


def _rates(counts: list[tuple[int, int, list[int]]]) -> list[tuple[float, float] | None]:
    """(gain, cost) for each of LIMITS, from (toxic, words, hits) of documents; None if the toxic ones have no more hits."""
    y = np.array([c[0] for c in counts], int)
    n = np.array([c[1] for c in counts], float)
    hits = np.array([c[2] for c in counts], float).reshape(len(counts), len(LIMITS))
    out: list[tuple[float, float] | None] = []
    for i in range(len(LIMITS)):
        high = (hits[y == 1, i].sum() + 0.5) / (n[y == 1].sum() + 1)
        low = (hits[y == 0, i].sum() + 0.5) / (n[y == 0].sum() + 1)
        out.append((float(np.log(high / low)), float(high - low)) if high > low else None)
    return out


def best_passages(a: np.ndarray, row: np.ndarray, hit: np.ndarray, rows: int, gain: float, cost: float) -> np.ndarray:
    """For each row the largest h * gain - n * cost over its passages of n successive words with h hits, -inf without a
    hit. a: where each word begins (in any order), row: its row, hit: whether it is a hit."""
    out = np.full(rows, -np.inf)
    if not hit.any():
        return out
    order = np.argsort(a, kind="stable")
    place = np.flatnonzero(hit[order])
    of = row[order][place]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    for r, at in zip(of[cut].tolist(), np.split(place, cut[1:])):
        value = np.arange(len(at)) * gain - at * cost  # of the words before each hit; a best passage begins and ends with one
        out[r] = (value - np.minimum.accumulate(value)).max() + gain - cost
    return out


def _judged(machine: Machine, rates: list[tuple[float, float] | None]):
    """(toxic, text) -> (toxic, evidence of the best passage at each of LIMITS)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            best = np.full((batch.num_rows, len(LIMITS)), -np.inf)
            for first, end, part, off in tx.chunks(data, offsets):
                codes, a, b, row = units(part, off)
                value = machine.score(codes, a, b, LIMITS[0])
                for i, (limit, rate) in enumerate(zip(LIMITS, rates)):
                    if rate:
                        best[first:end, i] = best_passages(a, row, value > limit, end - first, *rate)
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(best.tolist(), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    return scan


def _calibrate(machine: Machine, rates: list[tuple[float, float] | None], judged: list[tuple[int, list[float]]]) -> bool:
    """Sets limit, gain, cost and needed by documents that weren't trained on: of all limits the one that finds most
    toxic documents when at most FALSE_ALARMS of the others are taken for toxic (ties: the higher limit)."""
    y = np.array([j[0] for j in judged], int)
    every = np.array([j[1] for j in judged], float).reshape(len(judged), len(LIMITS))
    best = -1
    for i, (limit, rate) in enumerate(zip(LIMITS, rates)):
        if rate is None:
            continue
        evidence = every[:, i]
        others = np.sort(evidence[y == 0])[::-1]
        allowed = int(FALSE_ALARMS * len(others))
        needed = max(0.0, float(np.log(max(len(others), 1) / max((y == 1).sum(), 1))), others[allowed] if allowed < len(others) else 0.0)
        found = int((evidence[y == 1] > needed).sum())
        if found >= best:
            best, machine.limit, machine.needed = found, limit, needed
            machine.gain, machine.cost = rate
    return best > 0


_SCORED = "word string, in_toxic long, in_other long, score double"


def _scored(machine: Machine, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            value = machine.score(*encode(batch.column(at["word"]).to_pylist()), least)
            some = pa.array(np.isfinite(value))
            yield pa.record_batch([*(batch.column(at[n]).filter(some) for n in ("word", "in_toxic", "in_other")), pa.array(value).filter(some)], names=["word", "in_toxic", "in_other", "score"])

    return scan


def _flags(machine: Machine, column: pa.Array, rows: int) -> np.ndarray:
    """Each text's evidence less what is needed."""
    out = np.full(rows, -np.inf)
    data, offsets = tx.strings(column)
    for first, end, part, off in tx.chunks(data, offsets, 1 << 20):
        codes, a, b, row = units(part, off)
        if not len(a):
            continue
        _, one, back = np.unique(tx.spans(tx.prefix(codes), a, b), return_index=True, return_inverse=True)
        hit = np.isfinite(machine.score(codes, a[one], b[one], machine.limit))[back]
        out[first:end] = best_passages(a, row, hit, end - first, machine.gain, machine.cost) - machine.needed
    return out


def toxic_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, score): the rows of docs whose evidence is above what is needed; score is the surplus.

    Null and empty texts, and texts without a word of three letters, are never toxic. Rows count one by one, so repeated
    rows repeat in the result; a null doc_id stays null. Without toxic labels nothing is. Other columns are ignored."""
    machine = fit(docs, labels, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if machine is None:
        return rows.select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _flags(machine, batch.column(1), batch.num_rows)
            hit = pa.array(score > 0)
            yield pa.record_batch([batch.column(0).filter(hit), pa.array(score).filter(hit)], names=["doc_id", "score"])

    return rows.mapInArrow(scan, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the rows that ``toxic_documents`` reports; all columns stay."""
    machine = fit(docs, labels, **how)
    if machine is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_flags(machine, batch.column(at), batch.num_rows) <= 0))

    return docs.mapInArrow(keep, docs.schema)

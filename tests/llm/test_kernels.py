"""The plain-Python kernels against brute force; no Spark."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowspar.llm import decontaminate, lattice, near, ogg, suffix, toxicity
from flowspar.llm import text as tx


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(3, 8))
def test_two_stage_sorts_suffixes_to_depth(word, depth):
    ranks = np.unique(np.array(word), return_inverse=True)[1] + 1
    sa, alike = suffix.two_stage(ranks, depth)
    cut = [tuple(ranks[i : i + depth]) for i in sa]
    assert sorted(sa) == list(range(len(ranks)))
    assert cut == sorted(cut)
    padded = [c + (0,) * (depth - len(c)) for c in cut]
    assert alike.tolist() == [False] + [a == b for a, b in zip(padded, padded[1:])]


def test_two_stage_with_more_ranks_than_fit_in_21_bits():
    ranks = np.array([1 << 22, 5, 1 << 22, 5, 7, 1 << 22, 5, 7])
    dense = np.unique(ranks, return_inverse=True)[1] + 1
    assert suffix.two_stage(ranks, 3)[0].tolist() == suffix.two_stage(dense, 3)[0].tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=80))
def test_minimizers_file_every_window_once_and_equal_ones_alike(word):
    hashes = tx.mix(np.array(word, np.uint64) + np.uint64(99))
    key, lo, hi = suffix.minimizers(hashes, 8, 3)
    filed = {w: int(k) for k, a, b in zip(key, lo, hi) for w in range(a, b + 1)}
    assert sum(b - a + 1 for a, b in zip(lo, hi)) == len(filed) == len(word) - 7
    for a, b in combinations(filed, 2):
        if word[a : a + 8] == word[b : b + 8]:
            assert filed[a] == filed[b]


@given(st.lists(st.text("ab ", min_size=0, max_size=30), min_size=1, max_size=4), st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_wu_manber_finds_what_naive_search_finds(texts, patterns):
    wanted = sorted({f" {p} ".encode() for p in patterns})
    found = Counter(decontaminate._hits(pa.array(texts), decontaminate.searchers(wanted)))
    flat = [" " + " ".join(t.split()) + " " for t in texts]
    naive = Counter((i, p) for i, t in enumerate(flat) for p in wanted for k in range(len(t)) if t.encode().startswith(p, k))
    assert found == naive


def segmentations(word, pieces):
    if not word:
        yield 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield pieces[word[:n]] + rest


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=4))
def test_lattice_sums_all_segmentations(words):
    mark = lattice.MARK
    model = lattice.Lattice.of({mark: np.log(0.2), mark + b"a": np.log(0.2), b"a": np.log(0.2), b"ab": np.log(0.2), b"b": np.log(0.1), b"ba": np.log(0.1)})
    total, count, weight = lattice.score_texts(model, pa.array([" ".join(words), None, ""]))
    brute = sum(np.logaddexp.reduce(list(segmentations(mark + w.encode(), model.pieces))) for w in words)
    assert total[0] == pytest.approx(brute)
    assert count.tolist() == [len(words), 0, 0] and weight[0] == sum(map(len, words))
    assert model.word(mark + words[0].encode()) == pytest.approx(np.logaddexp.reduce(list(segmentations(mark + words[0].encode(), model.pieces))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=700), min_size=1, max_size=4), min_size=1, max_size=3), st.booleans())
def test_ogg_round_trip(streams, each):
    pages = [ogg.stream_pages(i, [(p, 10 * (k + 1)) for k, p in enumerate(packets)], each) for i, packets in enumerate(streams)]
    found = list(ogg.packets(ogg.interleave(pages)))
    for i, packets in enumerate(streams):
        assert [f[2] for f in found if f[0] == i] == packets
    if each:
        assert all(end == 10 * (n + 1) and start == 10 * n for _, n, _, start, end in found)


def test_ogg_damage_costs_only_the_damaged_packet():
    pages = ogg.stream_pages(1, [(b"one", 1), (b"two", 2), (b"three", 3)])
    pages[1] = pages[1][:-1] + b"?"
    assert [p[2] for p in ogg.packets(b"junk" + b"".join(pages))] == [b"one", b"three"]
    long = ogg.stream_pages(1, [(b"x" * 70_000, 1), (b"end", 2)], each=False)
    assert [p[2] for p in ogg.packets(b"".join(long[1:]))] == [b"end"]
    assert list(ogg.packets(None)) == list(ogg.packets(b"OggS")) == []


def test_ogg_checksum_by_long_division():
    def plain(data):
        value = 0
        for byte in data:
            value ^= byte << 24
            for _ in range(8):
                value = (value << 1 ^ 0x04C11DB7 if value >> 31 else value << 1) & 0xFFFFFFFF
        return value

    assert ogg.crc(b"any bytes \x00\xff") == plain(b"any bytes \x00\xff")


def kernel(a, b):
    def subsequences(word):
        c = "^" + word
        out = Counter()
        for i, j, k in combinations(range(len(c)), 3):
            out[c[i] + c[j] + c[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = subsequences(a), subsequences(b)
    return sum(v * y[s] for s, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_string_kernel_by_enumeration():
    words, landmarks = ["idiot", "idxiot", "banana", "cat", "tactic"], ["idiot", "banana"]
    brute = [[kernel(w, z) for z in landmarks] for w in words]
    assert np.allclose(toxicity.kernel(words, landmarks), brute)
    assert brute[1][0] > 0.5 > brute[3][0]


def test_machine_tolerates_inserted_letters():
    seeds = ["grumblort", "snarfwick", "plonkhead"]
    negatives = ["grumble", "snare", "plank", "headline", "orchard", "wicker", "number", "forth", "candle", "simple", "garden", "planet"]
    machine = toxicity.train(seeds, negatives)
    score = lambda words: machine.score(*toxicity.encode(words), -np.inf)
    assert (score(["grumxblort", "snarfwqick", "plonkhzead"]) > 0).all()
    assert (score(["marble", "window", "number", "gardens"]) < 0).all()


def test_signature_agreement_estimates_jaccard():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(4000)])
    base = rng.choice(words, 400)
    texts = []
    for share in (0.0, 0.05, 0.1, 0.3):
        other = base.copy()
        at = rng.random(400) < share
        other[at] = rng.choice(words, at.sum())
        texts.append(" ".join(other))
    sig, _ = near.signatures(*tx.strings(pa.array(texts)))
    low = sig.astype(np.uint8)
    pairs = [set(zip(t.split(), t.split()[1:])) for t in texts]
    for i in range(1, 4):
        exact = len(pairs[0] & pairs[i]) / len(pairs[0] | pairs[i])
        assert abs(near.agreement(low[:1], low[i : i + 1])[0] - exact) < 0.17


def test_hot_region_parts_no_pair():
    """1,500 copies that resemble their original at 0.63 to 0.73, and each other less: more than a region holds. Every run of
    two values must be closed as by brute force. Measured: 0.955 of the copies find the original (0.555 before); the
    signatures' estimate is below 0.6 for the other 0.04."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(300)]
    texts, jaccard = [" ".join(base)], []
    for k in range(1, 1501):
        words = list(base)
        for at in rng.choice(300, int(rng.integers(27, 34)), replace=False):
            words[at] = f"edit{k}x{at}"
        a, b = set(zip(base, base[1:])), set(zip(words, words[1:]))
        jaccard.append(len(a & b) / len(a | b))
        texts.append(" ".join(words))
    assert min(jaccard) >= 0.6
    sig, _ = near.signatures(*tx.strings(pa.array(texts)))
    low = (sig & 0xFF).astype(np.uint8)
    found = np.zeros(len(texts), bool)
    for tree in range(near.TREES):
        label = sig[:, tree * near.LEVELS : (tree + 1) * near.LEVELS]
        order = np.lexsort(label.T[::-1])
        parent = near.forest_pairs(label[order], low[order], near.DEPTH, near.REGION, near.SIMILARITY)
        found[order] |= parent == parent[np.flatnonzero(order == 0)[0]]
        own = np.flatnonzero((label[order, :2] == label[0, :2]).all(axis=1))  # the original's run
        assert len(own) > near.REGION
        a, b = np.triu_indices(len(own), 1)
        hit = np.concatenate([near.agreement(low[order[own[a[k : k + 65536]]]], low[order[own[b[k : k + 65536]]]]) >= near.SIMILARITY for k in range(0, len(a), 65536)])
        brute = np.arange(len(own))
        near._join_labels(brute, a[hit], b[hit])
        assert (parent[own] == own[brute]).all()
    assert found[1:].mean() >= 0.94


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=40), st.floats(0.1, 5), st.floats(0.01, 2))
def test_best_passages_by_brute_force(words, gain, cost):
    row = np.array(sorted(r for r, _ in words), int)
    hit = np.array([h for _, h in words], bool)
    mixed = np.random.default_rng(len(words)).permutation(len(words))
    got = toxicity.best_passages(np.arange(len(words))[mixed] * 3, row[mixed], hit[mixed], 5, gain, cost)
    for r in range(5):
        own = hit[row == r].tolist()
        brute = max((sum(own[i:j]) * gain - (j - i) * cost for i in range(len(own)) for j in range(i + 1, len(own) + 1)), default=-np.inf)
        assert got[r] == pytest.approx(brute) if any(own) else got[r] == -np.inf


def test_clean_words_clear_no_document():
    machine = toxicity.train(["idiot", "moron"], ["house", "garden", "people", "window"])
    machine.limit, machine.gain, machine.cost, machine.needed = 0.5, 9.5, 0.017, 2.1  # about those of sf0.1
    insults, clean = "you idiot and moron ", "the house in a garden has people at a window "
    texts = [insults, insults + clean * 3000, clean * 1500 + insults + clean * 1500, clean * 3000]
    got = toxicity._flags(machine, pa.array(texts), len(texts))
    assert got[0] > 0 and np.allclose(got[:3], got[0]) and got[3] == -np.inf


def test_groups_that_meet_in_a_member_join_whole():
    """A run of equal labels: two groups of 40 whose leaders don't resemble each other, joined by one pair of members."""
    rng = np.random.default_rng(2)
    chain = [rng.integers(0, 256, near.VALUES)]
    for k in range(3):  # each resembles the next by 88 of 128 values, and no other
        step = chain[-1].copy()
        step[40 * k : 40 * k + 40] = rng.integers(0, 256, 40)
        chain.append(step)
    order = [0] * 39 + [3] * 39 + [1, 2]  # leaders first; 1 goes to 0, and 2 to 3
    sig = np.array([chain[k] for k in order]).astype(np.uint8)
    labels = np.zeros((80, near.LEVELS), np.uint16)
    a, b = np.triu_indices(80, 1)
    hit = near.agreement(sig[a], sig[b]) >= near.SIMILARITY
    brute = np.arange(80)
    near._join_labels(brute, a[hit], b[hit])
    assert (near.forest_pairs(labels, sig, near.DEPTH, near.REGION, near.SIMILARITY) == brute).all()

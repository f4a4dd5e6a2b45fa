"""Similarity join against brute force."""

import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from gridwave.llm import jaccard
from gridwave.llm.jaccard import Prefixes, ngram_jaccard_join

from .fixtures import corpus, frame, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("extra", [False, True])
def test_equals_brute_force(spark, extra):
    rows = corpus()
    assert found(ngram_jaccard_join(frame(spark, rows, extra))) == brute(rows)


def test_many_near_copies_in_blocks(spark, monkeypatch):
    """A family wide enough for several blocks, with hot shingles in every chunk."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1500)
    r = random.Random(5)
    base = prose(r, 80).split()
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(80)] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(r, 60)) for i in range(30)]
    got = found(ngram_jaccard_join(frame(spark, rows).repartition(5)))
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert found(ngram_jaccard_join(frame(spark, []))) == []
    text = prose(random.Random(1), 30)
    got = ngram_jaccard_join(frame(spark, [(None, text), (4, text), (None, "alone here now then ever")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (4, 4), (None, None)}


def test_rows_without_ids_link(spark):
    """A near copy without an id joins two documents that are not alike themselves."""
    words = prose(random.Random(3), 100).split()
    edit = lambda a, b: " ".join(f"e{i}" if a <= i < b else w for i, w in enumerate(words))
    left, middle, right = edit(0, 9), " ".join(words), edit(91, 100)
    assert not 100 * len(shingles(left) & shingles(right)) >= 80 * len(shingles(left) | shingles(right))
    got = ngram_jaccard_join(frame(spark, [(5, left), (None, middle), (None, middle), (9, right), (None, "some few words")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (0, 5), (5, 5), (9, 5)]


def _components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("two_sided", [False, True])
def test_forest_of_a_star_equals_all_pairs(two_sided):
    r = np.random.default_rng(8)
    pre = Prefixes(r.integers(0, 50, 1 << jaccard.SKETCH_BITS).astype(np.uint32), 80)
    for k in range(25):
        bases = [np.unique(r.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(60):
            base = bases[int(r.integers(0, 4))]
            keep = base[r.random(len(base)) > r.choice([0.0, 0.05, 0.12, 0.2])]
            sets.append(np.unique(np.concatenate((keep, r.integers(0, 2**63, int(r.integers(0, 8))).astype(np.uint64)))))
        side = r.integers(0, 2, 60) if two_sided else np.full(60, 2)
        every = [(a, b) for a, b in combinations(range(60), 2) if (not two_sided or side[a] != side[b]) and jaccard._similar(sets[a], sets[b], 80)]
        links = list(jaccard.links_of(sets, side, pre, 80))
        assert set(links) <= set(every) and len(links) < 60
        assert _components(60, links) == _components(60, every)


def test_large_stars_take_no_squares():
    r = np.random.default_rng(4)
    pre = Prefixes(np.ones(1 << jaccard.SKETCH_BITS, np.uint32), 80)
    apart = [np.unique(r.integers(0, 2**63, 65).astype(np.uint64)) for _ in range(8000)]
    base = np.unique(r.integers(0, 2**63, 65).astype(np.uint64))
    copies = [np.unique(np.append(base, r.integers(0, 2**63, 2).astype(np.uint64))) for _ in range(8000)]
    for sets, links in ((apart, 0), (copies, 7999)):
        began = time.perf_counter()
        assert len(list(jaccard.links_of(sets, np.full(8000, 2), pre, 80))) == links
        assert time.perf_counter() - began < 5


def test_sketch_added_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    rows = corpus(30)
    assert found(ngram_jaccard_join(frame(spark, rows).repartition(7))) == brute(rows)


def test_prefixes_keep_every_link():
    """Any two sets over the threshold share min(l, l') shingles of their prefixes."""
    r = np.random.default_rng(2)
    sketch = r.integers(0, 50, 1 << jaccard.SKETCH_BITS).astype(np.uint32)
    pre = Prefixes(sketch, 80)
    for _ in range(300):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        keep = a[r.random(len(a)) > 0.1]
        b = np.unique(np.concatenate((keep, r.integers(0, 2**63, int(r.integers(0, max(1, n // 10)))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            (x, k), (y, m) = pre(a), pre(b)
            assert len(np.intersect1d(x, y)) >= min(k, m)

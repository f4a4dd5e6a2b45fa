"""Suffix-array matches against brute force."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwave.llm.decontaminate import benchmark_overlap, remove_contaminated, suffix_array

from .fixtures import frame, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    for i, text in rows:
        w, hit, own, best = words(text), set(), set(), 0
        for name, t in items:
            v = words(t)
            k = min(10, len(v))
            for a in range(len(v) - k + 1 if v and name is not None else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit |= set(range(p, p + k))
                        own.add(str(name))
            for a in range(len(v) if name is not None else 0):
                for p in range(len(w)):
                    n = 0
                    while a + n < len(v) and p + n < len(w) and v[a + n] == w[p + n]:
                        n += 1
                    best = max(best, n)
        out.append((i, len(w), len(hit), sorted(own), best))
    return sorted(out, key=str)


def case(seed=1):
    r = random.Random(seed)
    items = [(k, prose(r, r.choice((3, 9, 10, 11, 30)))) for k in range(12)] + [(20, None), (21, "... !"), (22, ""), (None, prose(r, 12))]
    rows = []
    for i in range(60):
        w = prose(r, r.randint(0, 60)).split()
        if i % 3 == 0:
            t = items[r.randrange(12)][1].split()
            a = r.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in t[a : a + r.randint(5, 30)]]
        rows.append((i, " ".join(w)))
    return rows + [(70, None), (71, ""), (72, items[4][1]), (72, items[4][1])], items


def test_equals_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_overlap(frame(spark, rows, extra=True), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.longest_match) for r in got), key=str) == brute(rows, items)
    for r in got:  # the location holds the match
        if r.longest_match:
            v = words(dict((str(i), t) for i, t in items)[r.longest_item])
            w = words(dict(rows)[r.doc_id])[r.longest_at : r.longest_at + r.longest_match]
            assert any(v[a : a + len(w)] == w for a in range(len(v)))


def test_removal_keeps_clean_rows_as_they_were(spark):
    rows, items = case(2)
    df = frame(spark, rows, extra=True)
    kept = remove_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.schema == df.schema
    clean = {i for i, _, n, *_ in brute(rows, items) if n == 0}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.doc_id in clean)


def test_several_blocks_give_one_result(spark, monkeypatch):
    rows, items = case(3)
    monkeypatch.setattr("gridwave.llm.decontaminate.BLOCK_BYTES", 150)
    got = benchmark_overlap(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.longest_match) for r in got), key=str) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_overlap(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert all(r.n_hit == 0 for r in benchmark_overlap(frame(spark, rows), none).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(ids):
    want = sorted(range(len(ids)), key=lambda i: ids[i:])
    assert suffix_array(np.array(ids, np.int64)).tolist() == want


def test_items_that_share_a_passage(spark):
    """The cost follows the passages, not items times documents; every item is named."""
    r = random.Random(5)
    passage = prose(r, 30)
    items = [(k, f"{prose(r, 4)} {passage} {prose(r, 4)}") for k in range(400)] + [(3, passage)]
    rows = [(i, f"{prose(r, 20)} {passage} {prose(r, 20)}") for i in range(300)]
    got = benchmark_overlap(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 300 and all(r["items"] == sorted(str(k) for k in range(400)) and r.n_hit >= 30 and r.longest_match >= 30 for r in got)


def test_very_long_text(spark):
    r = random.Random(6)
    passage = prose(r, 12)
    rows = [(1, "a " * 300_000 + passage + " b" * 300_000), (2, "a" * 1_000_000)]
    got = {x.doc_id: x for x in benchmark_overlap(frame(spark, rows), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].longest_match, got[1].longest_at) == (600_012, 12, 12, 300_000) and got[2].n_words == 1

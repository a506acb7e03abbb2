import random
import re
from itertools import combinations

import numpy as np
import pytest
from samples import ODD, prose
from netloom.llm import minhash


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if None in (a, b) or not x or not y or 100 * len(x & y) < percent * len(x | y):
            continue
        p, q = sorted((find(a), find(b)))
        label[q] = p
    return sorted((i, len(s), find(i) if i is not None else None, i is not None and find(i) == i) for i, s in sets if i is not None)


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    shared = prose(99, 60)
    texts = [edited(prose(k % 6, 90), rng, k % 5) for k in range(60)]
    texts += [f"{shared} {prose(200 + k, 40)}" for k in range(70)]  # a passage in more documents than a list takes
    chain = prose(7, 150)
    for _ in range(80):  # near copies that drift apart
        chain = edited(chain, rng, 2)
        texts.append(chain)
    texts += [texts[0]] * 30 + [t or "" for t in ODD[:6]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        got = minhash.near_duplicates(docs, width=width).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, width, 80)


def test_odd_rows(spark, odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[9].component_id == 8 and not by[9].kept
    assert by[None].component_id is None and not by[None].kept
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 9").count() == 0


def test_ids_that_repeat_unite_their_sets(spark):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (2, prose(2, 50)), (3, prose(2, 50)), (4, prose(4, 50))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_without_an_id_stay(spark):
    rows = [(1, prose(1, 50), "a"), (None, prose(1, 50), "b"), (None, prose(2, 50), "c"), (None, prose(2, 50), "c"), (None, prose(3, 50), "d")]
    rows += [(None, prose(3, 50) + " end", "d"), (None, "", "e"), (None, None, "f"), (None, " ", "e")]
    got = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"), width=5).collect()
    assert sorted((r.doc_id or 0, r.source) for r in got) == [(0, "c"), (0, "d"), (0, "e"), (0, "e"), (0, "f"), (1, "a")]


def test_extracts_are_linked_in_long_lists(spark):
    rows = []
    for family in range(12):  # 80 of 100 shingles
        whole = [f"f{family}w{k}" for k in range(103)]
        rows += [(2 * family, " ".join(whole)), (2 * family + 1, " ".join(whole[:83]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # every list is a long one here
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, list_limit=1).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_short_texts_in_a_large_group_are_linked(spark):
    words = prose(1, 9)
    rows = [(k, f"{words} extra{k}" if k else words) for k in range(61)] + [(100 + k, prose(100 + k, 12)) for k in range(5)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 61 else i for i, _ in rows}


@pytest.mark.parametrize("parts", [1, 2])
def test_tiles_join_what_a_whole_cell_joins(monkeypatch, parts):
    rng = np.random.default_rng(parts)
    base = [np.unique(rng.integers(0, 1 << 63, 30, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[: len(b) - rng.integers(0, 4)], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)])) for b in (base[k] for k in rng.integers(0, 12, 150))]
    nodes, groups, sides = np.arange(1000, 1150), np.arange(1000, 1150), rng.integers(0, parts, 150)

    def joined(links):
        head = {int(n): int(n) for n in nodes}

        def find(x):
            while head[x] != x:
                x = head[x]
            return x

        for a, b in links:
            head[find(a)] = find(b)
        return sorted(sorted(n for n in head if find(n) == r) for r in {find(n) for n in head})

    whole = joined(minhash.cell_links(nodes, groups, sides, sets, 64, 80))
    for side in (1, 7, 50, 1000):
        monkeypatch.setattr(minhash, "SIDE", side)
        assert joined(minhash.tiled_links(nodes, groups, sides, sets, 64, 80)) == whole
    assert len(whole) < 60


def test_many_short_texts_of_a_list_in_little_memory():
    """Templated texts of five shingles with two in common: as one matrix of pairs they would take a gigabyte."""
    import tracemalloc

    common = np.array([1, 2], np.uint64)
    sets = [np.concatenate([common, np.array([10, 11, 12], np.uint64) + np.uint64(4 * k)]) for k in range(6_000)]
    nodes = np.arange(len(sets))
    tracemalloc.start()
    assert minhash.tiled_links(nodes, nodes, np.zeros(len(sets), int), sets, 64, 80) == []
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()

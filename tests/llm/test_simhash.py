"""SimHash fingerprints and their links against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from samples import ODD, prose

from netloom.llm import simhash


def plain(text):
    """A fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def by_rules(rows, bits=4):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if None not in (rows[a][0], rows[b][0]) and ((prints[a] ^ prints[b]).bit_count() <= bits or rows[a][0] == rows[b][0]):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, f"{p:016x}", None if i is None else low[find(k)]) for k, (i, p) in enumerate(zip((r[0] for r in rows), prints))), key=repr)


def test_every_four_positions_hold_a_triple():
    made = simhash.covers(4)
    assert len(made) == 20
    assert all(any(set(t) <= set(four) for t in made) for four in combinations(range(8), 4))
    assert len(simhash.covers(2)) == 28


def test_near_counts_bytes_and_bits():
    rng = random.Random(5)
    x = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for _ in range(2000)], np.uint64)
    want = [sum((int(v) >> 8 * p) & 255 == 0 for p in range(8)) for v in x]
    assert simhash.shared_bytes(x).tolist() == want
    assert simhash.near(x, 4).tolist() == [k for k, v in enumerate(x) if int(v).bit_count() <= 4]


@pytest.mark.parametrize("spread", [3, 9, 40])
def test_forest_connects_what_is_connected(spread):
    rng = random.Random(spread)
    base = [rng.getrandbits(64) for _ in range(4)]
    nodes = np.array(sorted({rng.choice(base) ^ sum({1 << rng.randrange(spread) for _ in range(rng.randrange(7))}) for _ in range(300)}), np.uint64)
    a, b = simhash.forest(nodes, 4)

    def parts(pairs):
        root = {int(n): int(n) for n in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for p, q in pairs:
            root[find(p)] = find(q)
        out = {}
        for n in root:
            out.setdefault(find(n), set()).add(n)
        return sorted(map(sorted, out.values()))

    links = list(zip(a.tolist(), b.tolist()))
    assert all((p ^ q).bit_count() <= 4 for p, q in links)
    assert parts(links) == parts((int(p), int(q)) for p, q in combinations(nodes.tolist(), 2) if (p ^ q).bit_count() <= 4)


def texts():
    rng, rows = random.Random(8), []
    for group in range(6):
        words = prose(group, 60 + 40 * group).split()
        for _ in range(25):
            mine = list(words)
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(mine).title() if rng.random() < 0.3 else "\t".join(mine)))
    rows += [(2000 + k, t) for k, t in enumerate(ODD)]
    rows += [(None, rows[0][1]), (2003, rows[30][1]), (5, rows[0][1]), (5, rows[0][1])]
    return rows


def test_equals_brute_force(spark):
    rows = texts()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int").repartition(5)
    assert sorted(map(tuple, simhash.near_duplicates(table).collect()), key=repr) == by_rules(rows)
    sizes = [g for g in by_rules(rows) if g[2] is not None and g[2] != g[0]]
    assert len(sizes) > 60


def test_long_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 40)
    rows = texts()
    assert sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == by_rules(rows)


def test_lists_cut_by_batches():
    rng = random.Random(2)
    keys = sorted(rng.randrange(30) for _ in range(400))
    nodes = [7 << 40 ^ k << 8 ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(8)) for k in keys]
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], ["key", "fp"])

    def joined(size):
        out = set()
        for made in simhash._sorted_lists((whole.slice(k, size) for k in range(0, 400, size)), 4):
            out |= {frozenset((a, b)) for a, b in zip(*(c.to_pylist() for c in made.columns)) if a != b}
        return out

    assert joined(1) == joined(7) == joined(400) and joined(400)


def test_nothing(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(empty, bits=8)

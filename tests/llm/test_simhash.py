from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.simhash import fingerprint, forest, links, near_duplicates


def groups(fps, radius):
    n, parent = len(fps), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_by_hand(spark):
    t = "The CAT sat on É mat"
    w = [x if x == "É" else x.lower() for x in t.split()]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert fingerprint(t.encode()) == want
    assert fingerprint(b"") == fingerprint(None) == fingerprint(b" \n") == 0
    assert fingerprint(b"one two") == xxhash.xxh64_intdigest("one two", 42)
    assert spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] % 2**64 == fingerprint(b"one two")


def _nodes(spark, x):
    return spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")


def test_links_by_bands_and_by_tiles(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for _ in range(6):  # chains of near copies
        x = np.concatenate([x, x[rng.integers(0, len(x), 40)] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))])
    x = np.unique(x)
    want = groups(x, 2)
    name = dict(zip(x.view(np.int64).tolist(), want))
    sizes = len(set(want))
    for rows in (8192, 1):  # whole buckets; tile pairs of every bucket
        got = {r.u: r.root for r in components(links(_nodes(spark, x), 2, tile_rows=rows)).collect()}
        root = {v: got.get(v, v) for v in name}
        assert len(set(root.values())) == sizes
        assert all(len({name[v] for v in root if root[v] == r}) == 1 for r in set(root.values()))
    pairs = forest(x, 2)
    assert len(pairs) == len(x) - sizes  # a spanning forest


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(1000, 999)], "u long, v long")
    got = {r.u: r.root for r in components(e).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[1000] == 999
    assert components(e.where("u < 0")).count() == 0


def test_hubs_meet_in_no_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, 7) for k in range(100, 180)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(179, 205), (5, 7)]
    e = spark.createDataFrame(pairs, "u long, v long")
    a, b = (sorted((r.u, r.root) for r in components(e, hub).collect()) for hub in (100_000, 4))
    assert a == b and dict(a)[7] == 5


def test_against_brute_force(spark, docs):
    rows = sorted((r.doc_id, fingerprint((r.text or "").encode())) for r in docs.collect())
    want = groups(np.array([f for _, f in rows], np.uint64), 2)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [got[d] for d, _ in rows] == [rows[g][0] for g in want]


def test_edges(spark, edge, nothing):
    got = near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert by[0] == {1}  # no words: linked like any other, the null id aside
    assert near_duplicates(nothing).count() == 0

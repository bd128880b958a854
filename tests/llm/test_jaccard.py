"""The pipeline's near duplicates against brute force over sets of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from conftest import SF
from llm.conftest import SCHEMA, rows_of

from gridloom.llm import jaccard


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def index(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def text(r, n):
    return [f"w{int(r.paretovariate(0.7))}" if r.random() < 0.7 else f"v{r.randrange(5000)}" for _ in range(n)]


def edited(r, w, kind, share):
    k = max(1, int(share * len(w)))
    if kind == "appended":
        return w + text(r, k)
    if kind == "replaced":
        a = (len(w) - k) // 2
        return w[:a] + text(r, k) + w[a + k :]
    out = list(w)
    for i in r.sample(range(len(w)), max(1, k // 5)):
        out[i] = f"x{r.randrange(10**6)}"
    return out


def pairs_of_edits(n=40):
    """Texts in pairs, by kind of edit; some have an index of 0.8 or more, some just less."""
    r, out = random.Random(4), []
    for kind in ("appended", "replaced", "swapped"):
        for size in (100, 300):
            for k in range(n):
                w = text(r, size)
                out.append((kind, " ".join(w), " ".join(edited(r, w, kind, (0.03, 0.08, 0.1, 0.13, 0.2, 0.26)[k % 6]))))
    return out


def kept(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()


def test_pairs_by_kind_of_edit(spark):
    cases = pairs_of_edits()
    rows = rows_of([(2 * k + s, c[1 + s], "en", "a") for k, c in enumerate(cases) for s in (0, 1)])
    left = {r.doc_id for r in kept(spark, rows)}
    near = [index(shingle_set(a), shingle_set(b)) >= 0.8 for _, a, b in cases]
    for kind in ("appended", "replaced", "swapped"):
        assert 20 < sum(n for n, c in zip(near, cases) if c[0] == kind) < 75
        assert [k for k, c in enumerate(cases) if c[0] == kind and (2 * k + 1 not in left) != near[k]] == []
    assert all(2 * k in left for k in range(len(cases)))


def test_repeated_blocks_are_compared_as_sets(spark):
    r = random.Random(9)
    one, block, other = text(r, 150), text(r, 40), text(r, 150)
    often = " ".join(one + block * 20)  # the block again adds no shingle but at its seam
    alike = " ".join(one + block)
    unlike = " ".join(other + block * 20)  # most shingles shared if counted, few as sets
    assert index(shingle_set(often), shingle_set(alike)) >= 0.8 > index(shingle_set(often), shingle_set(unlike))
    assert {x.doc_id for x in kept(spark, rows_of([(1, often, "en", "a"), (2, alike, "en", "a"), (3, unlike, "en", "a")]))} == {1, 3}


def test_null_and_repeated_ids_lose_only_members_of_a_group(spark):
    r = random.Random(1)
    a, b, c, d = (" ".join(text(r, 120)) for _ in range(4))
    rows = rows_of([(None, a, "en", "a"), (None, b, "en", "a"), (None, b + " end", "en", "a"), (15, c, "en", "a"), (15, d, "en", "a"), (16, c, "en", "a"), (None, d + " more", "en", "a"), (17, a + " too", "en", "b"), (15, c, "en", "a")])
    got = sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in kept(spark, rows))
    assert len(got) == 4 and got[:3] == sorted([(False, 15, c), (False, 15, d), (False, 17, a + " too")])
    assert got[3][:2] == (True, 0) and got[3][2] in (b, b + " end")


def test_components_against_brute_force(spark):
    """A group of near copies that are not all near each other, in whole buckets and dealt as tiles."""
    r = random.Random(2)
    base = text(r, 120)
    texts = [" ".join(edited(r, base, r.choice(("appended", "replaced", "swapped")), r.choice((0.05, 0.1, 0.16)))) for _ in range(150)] + [" ".join(text(r, 60)) for _ in range(20)] + ["", "one two", "One  two", None, " \n"]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if index(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    df = spark.createDataFrame(rows_of([(k, t, "en", "a") for k, t in enumerate(texts)]), SCHEMA)
    for rows in (4096, 16):
        got = {x.doc_id: x.root for x in jaccard.near_duplicates(df, tile_rows=rows).collect()}
        assert [len({(root[i], got[i]) for i in got}), len(set(root))] == [len(set(got.values()))] * 2


def test_fingerprints_link_without_least_hashes(spark, monkeypatch):
    """The SimHash operator finds near copies by itself, where buckets of least hashes give no pair."""
    monkeypatch.setattr(jaccard, "_by_bucket", lambda *_: spark.createDataFrame([], "u long, v long"))
    r = random.Random(6)
    base = [text(r, 400) for _ in range(12)]
    rows = rows_of([(2 * k + s, " ".join(w[s:]), "en", "a") for k, w in enumerate(base) for s in (0, 1)])
    sets = {row[0]: shingle_set(row[1]) for row in rows}
    assert all(index(sets[2 * k], sets[2 * k + 1]) > 0.99 for k in range(12))
    found, at = jaccard.shingles([row[1].encode() for row in rows])
    print_ = [int(jaccard.majority(found[i:j, None])[0]) for i, j in zip(at, at[1:])]
    near = [(print_[2 * k] ^ print_[2 * k + 1]).bit_count() <= jaccard.RADIUS for k in range(12)]
    assert sum(near) > 8
    assert {x.doc_id for x in kept(spark, rows)} == {row[0] for row in rows} - {2 * k + 1 for k in range(12) if near[k]}


def test_least_hashes_agree_as_often_as_sets():
    rng, hit = np.random.default_rng(0), 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 225, dtype=np.uint64)
        sets = np.concatenate((np.sort(x[:200]), np.sort(x[25:])))  # 175 of 225 shared
        keys = jaccard.band_keys(sets, np.array([0, 200, 400]))
        hit += int((keys[0] == keys[1]).sum())
    assert abs(hit / (300 * jaccard.BANDS) - (175 / 225) ** jaccard.ROWS) < 0.03

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridloom.llm import substring
from gridloom.llm.substring import COVERS, remove_repeats
from gridloom.llm.words import window_hashes, word_hashes


def brute(rows, width=20):
    """kept words of (id, text) rows in order of their ids."""
    seen, out = set(), []
    for _, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_covers_meet_every_shift():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_window_hash_is_position_free():
    h, starts = word_hashes([b"a b c d e", b"x b c d", None])
    assert starts.tolist() == [0, 5, 9, 9]
    w = window_hashes(h, 3)
    assert w[1] == w[6] and len(set(w.tolist())) == len(w) - 1


def test_against_brute_force(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, joined=True).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


def test_small_flushes_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 500)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs, joined=True, size_mb=0.01).select("doc_id", "n_removed").collect()}
    assert [got[d] for d, _ in rows] == [x[1] for x in brute(rows)]


def test_a_task_hashes_a_slice_of_its_words_at_a_time(monkeypatch):
    texts = [" ".join(f"w{(k * 37 + i) % 900}" for i in range(300)) for k in range(40)]
    docs = pa.table({"doc_id": range(40), "text": texts})
    ids, th = np.arange(40), substring._texthash([t.encode() for t in texts])
    doc = np.repeat(np.arange(40), 6)
    marks = pa.table({"blob": [substring._places(ids, th, doc, np.tile([0, 1, 3, 150, 151, 285], 40))]})
    held = []

    def hashes(values):
        held.append(sum(map(len, values)))
        return word_hashes(values)

    monkeypatch.setattr(substring, "word_hashes", hashes)
    run = substring._windows(20, 8, 4)
    whole = run((pa.scalar(0),), docs, marks).to_pylist()
    assert len(held) == 1
    monkeypatch.setattr(substring, "SLICE", 5000)
    assert run((pa.scalar(0),), docs, marks).to_pylist() == whole and len(whole) > 1
    assert max(held[1:]) <= 5000 and sum(held[1:]) == held[0]


def test_edges(spark, edge, edge_rows):
    out = remove_repeats(edge, joined=True)
    assert out.columns[:10] == edge.columns
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    # a null id sorts first; equal rows count as one document; rows of equal id have an order of their own
    once = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows})
    want = {k: v for k, v in zip(once, brute([(k[1], k[2]) for k in once]))}
    for key, *result in got:
        assert tuple(r if r is not None else "" for r in result) == want[key]
    kept = {(r.doc_id, r.text): r.kept_text for r in remove_repeats(edge).collect()}
    assert kept[6, next(t for d, t, *_ in edge_rows if d == 6)] == "Start. end of it".replace("Start. end", "Start. end")
    assert kept[2, None] is None


def test_empty_table(nothing):
    assert remove_repeats(nothing).count() == 0


def test_digest_matches_sql(spark, duck):
    from conftest import SF

    from gridloom.llm.queries import op10_substring

    got = sorted(tuple(r) for r in op10_substring(spark, SF).collect())
    assert got == sorted(duck.execute(substring.sql()).fetchall()) and sum(r[2] for r in got) > 0

"""Packing and binary output, and the encoder beneath them."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridloom.llm import packing, streamvbyte  # noqa: E402
from gridloom.llm.tokens import WordEncoder, encoder  # noqa: E402

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", " ", "a  b", " a b ", "x\n y", "x \ny z", "it's 's", "é ́a b", "a b c", "<|endoftext|> a <|endoftext|>", "a\x1c b", "ΑΣ Σ", "1 2  3\t4 ", "İ Ⅷ ﬁ", "a\x01 b \x01", "A.\nB,\n\nC", "\n", "don't DON'T", "😀 x😀", None]


@lru_cache
def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library(path, spaced, docs):
    texts = ODD + [r.text for r in docs.select("text").limit(150).collect()]
    ids = plain(path)
    for e in (encoder(path, spaced), WordEncoder(path, spaced, limit=50)):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é'\n\t.,1ßΣ́  xyz")), max_size=40))
def test_encoder_on_any_text(text):
    for path, spaced in ((BYTE, True), (WORD, False)):
        assert np.frombuffer(own_encoder(path, spaced).encode([text])[0], "<u4").tolist() == plain(path)(text)


def test_words_are_learnt_without_the_marks_after_them(monkeypatch):
    texts = ["Zxqwort, zxqwort. (zxqwort) ZXQWORT... éxqwort, it's it's, a1. x.y, #tag @at! zxqwort\u2019, \u00aa. \u00b2, \u01c5."]
    e, seen, joint = WordEncoder(WORD, False), [], WordEncoder._joint
    monkeypatch.setattr(WordEncoder, "_joint", lambda self, tok, bar, bar_id, pieces, *a, **k: seen.extend(pieces) or joint(self, tok, bar, bar_id, pieces, *a, **k))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [plain(WORD)(t) for t in texts]
    assert {",", ".", "..."} <= set(seen) and not [p for p in seen if p in ("zxqwort,", "zxqwort.", "zxqwort...")]


@lru_cache
def own_encoder(path, spaced):
    return WordEncoder(path, spaced)


# -- packing


def sequential(lengths, capacity, weights=(1.0, 0.05, 0.05)):
    """Best fit by the residual norm, one piece at a time."""
    cap, bins = np.array(capacity, float), []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        can = [(float((np.array(weights) * ((b - need) / cap) ** 2).sum()), k) for k, b in enumerate(bins) if (b >= need).all()]
        if can:
            bins[min(can)[1]] = bins[min(can)[1]] - need
        else:
            bins.append(np.array(capacity) - need)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([(64, 64, 4096), (64, 3, 4096), (64, 64, 4096 // 2 + 2048), (64, 4, 5000)]))
def test_plan_is_valid_and_as_good_as_sequential(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    for score in ("norm", "dot"):
        rows, made = packing.best_fit(histogram, capacity, score=score)
        content: dict[int, list[tuple[int, int]]] = {}
        done: dict[int, int] = {}
        for length, first, last, seq, per, offset in sorted(rows):
            assert done.get(length, 0) == first
            done[length] = last
            for r in range(first, last):
                content.setdefault(seq + (r - first) // per, []).append((offset + (r - first) % per * length, length))
        assert done == histogram and len(content) == made
        for c in content.values():
            at = 0
            for offset, length in sorted(c):
                assert offset == at
                at += length
            assert at <= capacity[0] and len(c) <= capacity[1] and sum(n * n for _, n in c) <= capacity[2]
        if score == "norm":
            assert made == sequential(lengths, capacity)


def check_packed(rows, texts, limit):
    ids = plain(BYTE)
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for doc, t in texts:
        want, at = [*ids(t), 0], 0
        for k, r in enumerate(sorted(by[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == limit)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(seq)


def test_packing_of_documents(spark, docs):
    rows = packing.packed(docs, BYTE, max_tokens=512).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 512)
    assert n <= 1.01 * sum(r.length for r in rows) / 512 + 1


def test_packing_edges(spark, edge, edge_rows, nothing):
    rows = packing.packed(edge, BYTE, max_tokens=256).collect()
    assert len({r.sequence_id for r in rows}) and sum(r.doc_id is None for r in rows) >= 2
    total = sum(len(plain(BYTE)(r[1])) + 1 for r in edge_rows)
    assert sum(r.length for r in rows) == total
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(spans, spans[1:]):
        assert o2 == (o + n if s == s2 else 0)
    assert packing.packed(nothing, BYTE).count() == 0


def test_capacities_and_sequences(spark, docs):
    placed = packing.packed(docs, BYTE, max_tokens=512, with_ids=True, max_documents=3, max_attention=512 * 512).cache()
    for r in packing.sequences(placed).collect():
        assert len(r.lengths) <= 3 and sum(n * n for n in r.lengths) <= 512 * 512 and len(r.ids) == 4 * sum(r.lengths)


# -- binary output


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=20), max_size=12))
def test_image_round_trip(docs_ranks):
    counts = np.array([len(d) for d in docs_ranks], np.int64)
    ranks = np.array([x for d in docs_ranks for x in d], "<u4")
    control, data, size = streamvbyte.encode(counts, ranks)
    assert int(size.sum()) == len(data) and len(control) == int((-(-counts // 4)).sum())
    ids, n, back = streamvbyte.decode_image(streamvbyte.image(np.arange(len(counts)) - 3, counts, control.tobytes(), data.tobytes()))
    assert ids.tolist() == list(range(-3, len(counts) - 3)) and n.tolist() == counts.tolist() and back.tolist() == ranks.tolist()


def test_broken_images_are_refused():
    counts = np.array([5])
    control, data, _ = streamvbyte.encode(counts, np.arange(5))
    good = streamvbyte.image(np.zeros(1), counts, control.tobytes(), data.tobytes())
    with pytest.raises(ValueError):
        streamvbyte.decode_image(b"XXXX" + good[4:])
    with pytest.raises(ValueError):
        streamvbyte.decode_image(good[:-1])


def test_files_round_trip(spark, docs):
    ids, at = plain(WORD), 0
    got = {r.doc_id: r for r in streamvbyte.round_trip(docs, WORD, ids=True).collect()}
    for r in docs.orderBy("doc_id").collect():
        want = np.array([*ids(r.text), 1], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes())) and bytes(g.ids) == want.tobytes()
        at += len(want)


def test_images_ascend_and_ranks_follow_frequency(spark, docs, tmp_path):
    streamvbyte.write_ids(docs, str(tmp_path), WORD, image_tokens=500)
    rows = spark.read.parquet(str(tmp_path / "images")).orderBy("part", "image").collect()
    seen = np.concatenate([streamvbyte.decode_image(r.image_bytes)[0] for r in rows])
    assert (np.diff(seen) > 0).all() and len(rows) > 10
    ranks = np.concatenate([streamvbyte.decode_image(r.image_bytes)[2] for r in rows])
    assert (np.diff(np.bincount(ranks)) <= 0).all()


def test_files_edges(spark, edge, nothing):
    got = streamvbyte.round_trip(edge, WORD).collect()
    assert len(got) == edge.count()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is None for r in got][:2] == [True, True]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    assert streamvbyte.round_trip(nothing, WORD).count() == 0

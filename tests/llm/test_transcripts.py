"""Transcripts: Viterbi against enumeration, and renderings against one reading of whole conversations."""

from __future__ import annotations

import itertools
import random

import pytest
from conftest import SF

from gridloom.llm import transcripts as t
from gridloom.llm.common import stored


def best_by_enumeration(lines):
    e = t.EMIT[t.kinds(lines)]
    score = lambda s: t.START[s[0]] + e[0][s[0]] + sum(t.MOVE[a, b] + e[k + 1][b] for k, (a, b) in enumerate(zip(s, s[1:])))
    return list(max(itertools.product(range(6), repeat=len(lines)), key=score))


@pytest.mark.parametrize("lines", [["Human: hello?", "more of it", "[ASSISTANT] yes", "", "and so on"], ["plain", "", "other", "AI: x"], ["", ""], ["System: a", "q: b?", "c " * 200]])
def test_viterbi_by_enumeration(lines):
    assert t.viterbi(lines) == best_by_enumeration(lines)


@pytest.mark.parametrize(("line", "role"), [("User: hi", "user"), ("### Assistant:", "assistant"), ("[SYSTEM] be kind", "system"), ("<|im_start|>user", "user"), ("**Bot**: x", "assistant"), ("Note: x", None), ("plain", None)])
def test_markers(line, role):
    assert t.marker(line)[0] == role


def rendered_whole(texts):
    """A conversation read at once by the plain rules: (roles, text)."""
    lines = [x for text in texts for x in (text or "").split("\n") if not t._END.match(x)]
    out, roles = "", ""
    for k, s in enumerate(t.viterbi(lines) if lines else []):
        role, first = t.STATES[s]
        line = lines[k]
        if first or not k:
            out += ("<|end|>\n" if k else "") + f"<|{role}|>\n"
            roles += role[0].upper()
            line = line[t.marker(line)[1] :]
        out += line + "\n" if line.strip() else ""
    return roles, out + ("<|end|>\n" if lines else "")


def joined(spark, raw, **sizes):
    got = {}
    for r in t.render(t.parse(raw, **sizes)).orderBy("conv_id", "block").collect():
        a = got.get(r.conv_id, ("", "", 0, 0))
        got[r.conv_id] = a[0] + r.roles, a[1] + r.rendered, a[2] + r.n_lines, a[3] + r.n_turns
    return got


def test_renderings_are_those_of_whole_conversations(spark):
    r = random.Random(3)
    pool = ["User: hello?", "more of it", "AI: said so", "Assistant: fine", "a line", "", "another line\nwith more\n", "User: thanks", "bye", "<|im_end|>", "<|im_start|>system\nbe kind", None, "x " * 150]
    chats = {c: [r.choice(pool) for _ in range(n)] for c, n in ((1, 300), (2, 9), (None, 40), (4, 1), (5, 17))} | {6: ["<|im_end|>"] * 4, 7: [None], 8: ["<|end|>"], 9: ["hi", "<|end|>"]}
    rows = [(c, k, text, 7) for c, texts in chats.items() for k, text in enumerate(texts)]
    r.shuffle(rows)
    raw = stored(spark.createDataFrame(rows, "conv_id long, turn long, text string, block int"), "raw")
    want = {c: rendered_whole(texts) for c, texts in chats.items()}
    for sizes in ({}, {"block": 64, "mb": 0.001}, {"block": 3, "mb": 0.0003}, {"block": 1}):
        got = joined(spark, raw, **sizes)
        assert {c: g[:2] for c, g in got.items()} == want
        assert all(g[2] == sum(not t._END.match(x) for text in chats[c] for x in (text or "").split("\n")) and g[3] == len(g[0]) for c, g in got.items())
    assert t.render(t.parse(raw)).count() == len(chats)  # one row a conversation


def test_repeated_and_null_positions(spark):
    rows = [(1, None, "b", 1)] * 3 + [(1, 2, "User: hello?\nmore", 1)] + [(1, 2, "<|im_start|>assistant\nfine", 1)] * 2 + [(None, None, None, 1)]
    raw = stored(spark.createDataFrame(rows, "conv_id long, turn long, text string, part int"), "raw")
    want = {1: rendered_whole(["b"] * 3 + ["<|im_start|>assistant\nfine"] * 2 + ["User: hello?\nmore"]), None: rendered_whole([None])}
    for mb in (16.0, 1e-4):
        assert {c: g[:2] for c, g in joined(spark, raw, mb=mb).items()} == want
    assert t.render(t.parse(raw.where("conv_id > 5"))).count() == 0


def test_roles_are_recovered(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    true = {}
    for r in c.orderBy("conv_id", "turn").collect():
        true[r.conv_id] = true.get(r.conv_id, "") + r.role[0].upper()
    got = joined(spark, t.transcripts(c))
    assert sum(got[k][0] == v for k, v in true.items()) >= 0.9 * len(true)

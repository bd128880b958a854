"""Transcript parsing: roles of lines by a hidden Markov model, and canonical rendering of the turns.

Hidden states are (role, is this the first line of a turn). What a line shows is its speaker marker, if any (a name
before a colon, a bracketed or a tagged name), and features of the line: its length class or that it is blank, whether
it ends with a question mark, and whether the line before it is blank. Nothing tells the model where a turn begins: the
rows of a conversation are lines one after the other, however they are cut into rows. Emissions are products of the
features' probabilities, in a table by kind of line, as whole millionths of a logarithm; the best path is Viterbi's.

Rows are dealt out by ranges of (conversation, position, text), so a conversation with a third of all rows spreads
over as many tasks as its size asks for. What a range's lines do to any path is a matrix in the (max, +) algebra; a
range reports those of its first and last conversation, no more. From them the driver finds the best state at each
border (two small rows a range), and each range then finds its own paths, all its conversations step by step together.

Result: one row for each conversation and block of `block` of its rows, so one row a conversation unless it is longer
than that. Rendering: markers are taken off, blank lines are left out, and each turn becomes `<|role|>`, its lines and
`<|end|>`, each with a newline. The end marker stands where the next turn begins or the conversation ends, so the
blocks of a conversation in order, joined, are its canonical text whatever the size of a block or range.

Nulls and ties: a null conv_id is a conversation of its own, null positions come first, a null text is an empty line;
rows of equal position are ordered by their first 32 characters, then by a hash of the text. A line that only ends a
turn (`<|im_end|>` and the like) is left out; a conversation of such lines alone has no turns and an empty rendering.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import parts, stored

#: Roles, and the speaker names that mark them.
NAMES = {
    "system": ["system", "instructions"],
    "user": ["user", "human", "customer", "question", "prompter", "q", "me"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "gpt", "model", "a"],
}
ROLES = list(NAMES)
_OF = {n: r for r, names in NAMES.items() for n in names}
_MARK = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(?P<tag>[A-Za-z]+)(?:\|>)?|\[(?P<box>[A-Za-z]+)\]|#{1,4}\s*(?P<head>[A-Za-z]+)\s*:?\s*$|\**(?P<name>[A-Za-z]{1,12})\**\s*:)[ \t]*")
_END = re.compile(r"^\s*<\|(?:im_end|end|eot_id)\|>\s*$")
#: Probabilities, all documented here: that a first line shows its own role's marker, another's; that a later line shows any.
_MARKED, _WRONG, _INSIDE = 0.8, 0.002, 0.01
#: Length classes of lines by role: short, middle, long (limits in characters); that a first, a later line is blank.
_LENGTHS = {"system": (0.3, 0.5, 0.2), "user": (0.42, 0.38, 0.2), "assistant": (0.24, 0.36, 0.4)}
_LIMITS = (80, 260)
_BLANK = (0.005, 0.1)
_QUESTION = {"system": 0.02, "user": 0.12, "assistant": 0.04}
#: That the line before a first, a later line is blank.
_GAP = (0.3, 0.02)
#: P(next turn's role | role).
_NEXT = {"system": (0.02, 0.9, 0.08), "user": (0.02, 0.06, 0.92), "assistant": (0.01, 0.94, 0.05)}
STATES = [(r, first) for r in ROLES for first in (True, False)]
_N = len(STATES)
_UNIT = 1e6


def _whole(p) -> np.ndarray:
    return np.rint(np.log(np.array(p)) * _UNIT).astype(np.int64)


def _kind(mark: int, size: int, question: bool, gap: bool) -> int:
    """The kind of a line: mark 0 (none) or 1 + its role, size 0 to 2 or 3 (blank)."""
    return ((mark * 4 + size) * 2 + question) * 2 + gap


def _emission(mark: int, size: int, question: bool, gap: bool) -> list[float]:
    out = []
    for r, first in STATES:
        if first:
            p = 1 - _MARKED if not mark else _MARKED if ROLES[mark - 1] == r else _WRONG
        else:
            p = _INSIDE if mark else 1 - _INSIDE
        blank, before = _BLANK[not first], _GAP[not first]
        p *= blank if size == 3 else (1 - blank) * _LENGTHS[r][size]
        p *= (_QUESTION[r] if question else 1 - _QUESTION[r]) * (before if gap else 1 - before)
        out.append(p)
    return out


#: Log probabilities of each kind of line by state, of the first state, and of each step from state to state.
EMIT = _whole([_emission(m, s, bool(q), bool(g)) for m in range(4) for s in range(4) for q in (0, 1) for g in (0, 1)])
START = _whole([{"system": 0.2, "user": 0.75, "assistant": 0.05}[r] if first else 1e-12 for r, first in STATES])
MOVE = _whole([[_NEXT[a][ROLES.index(b)] if first else (1.0 if a == b else 1e-12) for b, first in STATES] for a, _ in STATES])


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's marker names, and where the rest of the line begins."""
    m = _MARK.match(line)
    name = m and next(g for g in m.groups() if g)
    role = _OF.get(name.lower()) if name else None
    return (role, m.end()) if role else (None, 0)


def kinds(lines: list[str], gap: bool = False) -> np.ndarray:
    """The kind of each line; gap: whether the line before the first is blank."""
    out = []
    for line in lines:
        bare = line.strip()
        role = marker(line)[0] if bare else None
        size = 3 if not bare else 0 if len(line) < _LIMITS[0] else 1 if len(line) < _LIMITS[1] else 2
        out.append(_kind(1 + ROLES.index(role) if role else 0, size, bare.endswith("?"), gap))
        gap = not bare
    return np.array(out, np.int64)


def product(kind: np.ndarray) -> np.ndarray:
    """The best score from each state before lines to each state at their last."""
    m = np.full((_N, _N), np.iinfo(np.int64).min // 4)
    np.fill_diagonal(m, 0)
    for row in EMIT[kind]:
        m = (m[:, :, None] + MOVE[None]).max(1) + row
    return m


def paths(pieces: list[np.ndarray], before: list[int | None], last: list[int | None]) -> list[np.ndarray]:
    """The best states of the lines of each piece, from the state before it (or a conversation's start) to its last, if given."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    size = np.array([len(k) for k in pieces], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    n = size[order]
    base, flat = np.cumsum(n) - n, np.concatenate([pieces[i] for i in order])
    live = np.searchsorted(-n, -np.arange(n[0]), side="left")
    score = np.stack([START if before[i] is None else MOVE[before[i]] for i in order]) + EMIT[flat[base]]
    back = [np.zeros((len(n), _N), np.int8)]
    for t in range(1, int(n[0])):
        k = live[t]
        step = score[:k, :, None] + MOVE
        back.append(step.argmax(1).astype(np.int8))
        score[:k] = step.max(1) + EMIT[flat[base[:k] + t]]
    state = np.array([score[r].argmax() if last[i] is None else last[i] for r, i in enumerate(order)])
    found = np.zeros(len(flat), np.int64)
    for t in range(int(n[0]) - 1, -1, -1):
        k = live[t]
        found[base[:k] + t] = state[:k]
        if t:
            state[:k] = back[t][np.arange(k), state[:k]]
    for r, i in enumerate(order):
        out[i] = found[base[r] : base[r] + n[r]]
    return out


def viterbi(lines: list[str]) -> list[int]:
    return paths([kinds(lines)], [None], [None])[0].tolist()


def _segments(convs: list[int | None], texts: list[str | None]) -> list[tuple[int | None, list[tuple[int, str]], int]]:
    """(conversation, its lines with their row, rows) of runs of rows of one conversation."""
    out: list[tuple[int | None, list[tuple[int, str]], int]] = []
    for conv, text in zip(convs, texts):
        if not out or out[-1][0] != conv:
            out.append((conv, [], 0))
        at, lines, rows = out[-1]
        lines += [(rows, x) for x in (text or "").split("\n") if not _END.match(x)]
        out[-1] = (at, lines, rows + 1)
    return out


_EDGE = "struct<conv: bigint, rows: bigint, lines: bigint, blank: boolean, first: int, rest: array<bigint>>"


def _edge(segment: tuple[int | None, list[tuple[int, str]], int]) -> dict:
    """What a segment does to paths: the kind of its first line (if no blank line is before it) and the matrix of the rest."""
    conv, rows, n = segment
    lines = [x for _, x in rows]
    kind = kinds(lines)
    blank = bool(lines) and not lines[-1].strip()
    return {"conv": conv, "rows": n, "lines": len(lines), "blank": blank, "first": int(kind[0]) if lines else -1, "rest": product(kind[1:]).ravel().tolist()}


def _ranges(rows: DataFrame, mb: float) -> DataFrame:
    """One row a range: (part, conv_ids, texts, head, tail), rows in order, with the edges of its first and last conversation."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
    keyed = plain.withColumns({"begin": F.substring("text", 1, 32), "hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "begin", "hash", "tie"]  # the last keeps equal rows from gathering in one range
    dealt = keyed.repartitionByRange(parts(plain, mb), *keys).sortWithinPartitions(*keys)
    schema = pa.schema([("part", pa.int64()), ("conv_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), *((e, pa.struct([("conv", pa.int64()), ("rows", pa.int64()), ("lines", pa.int64()), ("blank", pa.bool_()), ("first", pa.int32()), ("rest", pa.list_(pa.int64()))])) for e in ("head", "tail"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, convs, texts = 0, [], []
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                convs += b.column(1).to_pylist()
                texts += b.column(2).to_pylist()
        if convs:
            first = next((i for i, c in enumerate(convs) if c != convs[0]), len(convs))
            last = next((i for i in range(len(convs), 0, -1) if convs[i - 1] != convs[-1]), 0)
            head = _edge(_segments(convs[:first], texts[:first])[0])
            tail = head if first == len(convs) else _edge(_segments(convs[last:], texts[last:])[0])
            yield pa.RecordBatch.from_pylist([{"part": part, "conv_ids": convs, "texts": texts, "head": head, "tail": tail}], schema)

    packed = dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "text")
    return stored(packed.mapInArrow(run, f"part bigint, conv_ids array<bigint>, texts array<string>, head {_EDGE}, tail {_EDGE}"), "ranges")


#: What a segment is told: state before it, its last state, a blank line before it, rows and lines before it, does the conversation end with it.
_Known = tuple[int | None, int | None, bool, int, int, bool]
_ALONE: _Known = (None, None, False, 0, 0, True)


def _chain(links: list[tuple[int, str, dict]]) -> dict[tuple[int, str], _Known]:
    """What each edge of one conversation that runs over several ranges is told, given its edges in order."""
    score, scores, matrices, told = None, [], [], []
    blank, rows, lines = False, 0, 0
    for _, _, e in links:
        told.append((blank, rows, lines))
        if e["lines"]:
            first = EMIT[e["first"] | int(blank)]
            m = (MOVE + first)[:, :, None] + np.array(e["rest"]).reshape(1, _N, _N)
            m = m.max(1)
            alone = ((START + first)[:, None] + np.array(e["rest"]).reshape(_N, _N)).max(0)
            score = alone if score is None else (score[:, None] + m).max(0)
            blank = e["blank"]
        else:
            m = None
        matrices.append(m)
        scores.append(score)
        rows, lines = rows + e["rows"], lines + e["lines"]
    ends: list[int | None] = [None] * len(links)
    state = None if score is None else int(score.argmax())
    for k in range(len(links) - 1, -1, -1):
        ends[k] = state if scores[k] is not None else None
        if k and scores[k - 1] is not None and matrices[k] is not None:
            state = int((scores[k - 1] + matrices[k][:, state]).argmax())
    return {(p, side): (ends[k - 1] if k else None, ends[k], *told[k], k == len(links) - 1) for k, (p, side, _) in enumerate(links)}


def _known(rows: list) -> dict[tuple[int, str], _Known]:
    """By range and side, what the conversations that run over several ranges are told; rows (part, head, tail, one)."""
    edges = []
    for r in sorted(rows, key=lambda r: r.part):
        edges.append((r.part, "head", r.head.asDict()))
        if not r.one:
            edges.append((r.part, "tail", r.tail.asDict()))
    out, at = {}, 0
    for k in range(1, len(edges) + 1):
        if k == len(edges) or edges[k][2]["conv"] != edges[at][2]["conv"]:
            if k - at > 1:
                out |= _chain(edges[at:k])
            at = k
    return out


def parse(rows: DataFrame, block: int = 1024, mb: float = 16.0) -> DataFrame:
    """(conv_id, block, turns, ends) of the rows (conv_id, turn, text); other columns are left out.

    A row is a conversation's rows block * k to block * (k + 1) - 1. turns are structs (role, opens, closes, n_lines,
    text): opens is False where a block begins inside a turn of the one before; closes tells that another turn is open
    when this one begins. ends: the conversation's last turn ends with this block. mb bounds a range.
    """
    ranges = _ranges(rows, mb)
    one = F.size(F.array_distinct(F.transform("conv_ids", lambda c: F.struct(c)))) == 1
    known = _known(ranges.select("part", "head", "tail", one.alias("one")).collect())  # two small rows a range
    turn = pa.struct([("role", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("n_lines", pa.int64()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("turns", pa.list_(turn)), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, convs, texts in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = _segments(convs, texts)
                told = [known.get((part, "head" if k == 0 else "tail"), _ALONE) if k in (0, len(found) - 1) else _ALONE for k in range(len(found))]
                pieces = [kinds([x for _, x in lines], t[2]) for (_, lines, _), t in zip(found, told)]
                states = paths(pieces, [t[0] for t in told], [t[1] for t in told])
                out = []
                for (conv, lines, n), s, (_, _, _, rows_before, lines_before, last) in zip(found, states, told):
                    first = rows_before // block
                    turns: list[list[dict]] = [[] for _ in range((rows_before + n - 1) // block - first + 1)]
                    going = lines_before > 0
                    for (row, line), state in zip(lines, s.tolist()):
                        here = turns[(rows_before + row) // block - first]
                        role, opens = STATES[state]
                        opens = opens or not going
                        if opens or not here:
                            here.append({"role": role, "opens": opens, "closes": opens and going, "n_lines": 0, "text": []})
                        if opens:
                            line = line[marker(line)[1] :]
                        going = True
                        here[-1]["n_lines"] += 1
                        if line.strip():
                            here[-1]["text"].append(line + "\n")
                    for k, here in enumerate(turns):
                        ends = last and going and k == len(turns) - 1
                        out.append({"conv_id": conv, "block": first + k, "part": part, "turns": [t | {"text": "".join(t["text"])} for t in here], "ends": ends})
                yield pa.RecordBatch.from_pylist(out, schema)

    fields = "conv_id bigint, block bigint, part bigint, turns array<struct<role: string, opens: boolean, closes: boolean, n_lines: bigint, text: string>>, ends boolean"
    pieces = ranges.select("part", "conv_ids", "texts").mapInArrow(run, fields)
    # a block over a border of ranges comes in pieces
    joined = pieces.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("p"), F.max("ends").alias("ends"))
    return joined.select("conv_id", "block", F.flatten("p.turns").alias("turns"), "ends")


def render(parsed: DataFrame) -> DataFrame:
    """(conv_id, block, n_turns, n_lines, roles, rendered): the canonical text of each block, and the initials of its turns' roles."""
    mark = lambda x: F.concat(F.when(x["closes"], "<|end|>\n").otherwise(""), F.when(x["opens"], F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(""), x["text"])
    opened = F.filter("turns", lambda x: x["opens"])
    text = F.concat(F.array_join(F.transform("turns", mark), ""), F.when(F.col("ends"), "<|end|>\n").otherwise(""))
    letters = F.array_join(F.transform(opened, lambda x: F.upper(F.substring(x["role"], 1, 1))), "")
    return parsed.select("conv_id", "block", F.size(opened).alias("n_turns"), F.aggregate("turns.n_lines", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_lines"), letters.alias("roles"), text.alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of conversations whose roles are known: by a hash, a row gets a speaker marker of one of five
    styles, or just a blank line before it, and the role column is dropped. For tests of `parse`, and for its query."""
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    name = F.initcap(F.col("role"))
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(name)
    lead = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(other, F.lit(": "))).when(style == 2, F.concat(F.lit("["), F.upper("role"), F.lit("] "))).when(style == 3, F.concat(F.lit("### "), name, F.lit(":\n"))).when(style == 4, F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"))).otherwise("\n")
    return conversations.select("conv_id", "turn", F.concat(F.coalesce(lead, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))

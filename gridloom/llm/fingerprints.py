"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further after words whose hash says so (one in eight), so prose without line breaks
has paragraphs too. A paragraph that comes again gets its occurrence number into its digest, which makes a text
a set of digests. The sketch adds each digest to three cells of (count, sum of digests, sum of checks); sums
are modulo 2^64. Subtracting two sketches leaves the digests that differ, which peeling recovers one by one
from cells that hold a single digest. Where that stops short, both sketches are made twice as large and peeled
again, until it succeeds. The likeness is the Jaccard index of the two sets, from the recovered digests.

The fingerprint string is the sketch of BASE_CELLS cells and the number of paragraphs, in base64; equal texts
have equal ones. An empty or null text has an empty sketch; two such are alike (1), and unlike any other (0).

Neighbours by doc_id: documents are dealt to ranges of ids, whose first documents also go to the range before.
The bounds are ids that exist, found on the id column alone; each text is shuffled once. Rows with equal
doc_id follow each other in the order of their texts. A null doc_id comes first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounds_table, id_bounds, lean, NULL_ID, range_of, ranges
from gridloom.llm.words import _BASE, _powers, mixed, word_hashes

BASE_CELLS, HASHES = 24, 3
_BREAK = b"\x00P"
_BREAK_HASH = int(word_hashes([_BREAK])[0][0])
#: Pairs of documents that are sketched together.
BLOCK = 128


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts in a row, with the text's index of each; distinct within a text."""
    h, starts = word_hashes([t.replace(b"\n", b" \x00P ") for t in texts])
    mark = h == np.uint64(_BREAK_HASH)
    ends = mark | (h & np.uint64(7) == 0)
    if len(h):
        ends[starts[1:][np.diff(starts) > 0] - 1] = True
    base = _BASE[0]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(np.where(mark, np.uint64(0), mixed(h)) * _powers(base, len(h)), out=total[1:])
    last = np.flatnonzero(ends) + 1
    first = np.concatenate(([0], last[:-1]))[: len(last)].astype(np.int64)
    held = ~((last - first == 1) & mark[last - 1])  # not those of nothing but a line break
    first, last = first[held], last[held]
    d = mixed((total[last] - total[first]) * _powers(pow(base, -1, 2**64), len(h) + 1)[first])
    doc = np.searchsorted(starts, first, side="right") - 1
    order = np.lexsort((d, doc))
    d, doc = d[order], doc[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (doc[1:] != doc[:-1])
    nth = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return np.where(nth > 0, mixed(d + nth.astype(np.uint64) * np.uint64(_BASE[1])), d), doc


def _check(d: np.ndarray) -> np.ndarray:
    return mixed(d ^ np.uint64(_BASE[1]))


def _cells(d: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The HASHES cells of each digest, among HASHES * part cells."""
    return np.stack([(mixed(d + np.uint64(7919 * (j + 1))) % part.astype(np.uint64)).astype(np.int64) + j * part for j in range(HASHES)], 1)


class Sketches:
    """Many sketches in flat arrays; sketch s has HASHES * part[s] cells from base[s] on."""

    def __init__(self, part: np.ndarray):
        self.part = part.astype(np.int64)
        self.base = HASHES * (np.cumsum(self.part) - self.part)
        n = int(HASHES * self.part.sum())
        self.count, self.sum, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, d: np.ndarray, which: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        at = _cells(d, self.part[which]) + self.base[which][:, None]
        sign = np.broadcast_to(np.asarray(sign, np.int64), d.shape)
        times = sign.view(np.uint64) if sign.flags.c_contiguous else sign.astype(np.uint64)
        for j in range(HASHES):
            np.add.at(self.count, at[:, j], sign)
            np.add.at(self.sum, at[:, j], d * times)
            np.add.at(self.check, at[:, j], _check(d) * times)
        return at

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests recovered with a positive and with a negative sign by sketch, and whether nothing is left in it."""
        more, fewer = np.zeros(len(self.part), np.int64), np.zeros(len(self.part), np.int64)
        owner = np.repeat(np.arange(len(self.part)), HASHES * self.part)
        look = np.flatnonzero(self.count)
        while len(look):
            sign = self.count[look]
            one = np.abs(sign) == 1
            look, sign = look[one], sign[one]
            d = self.sum[look] * sign.astype(np.uint64)
            good = self.check[look] * sign.astype(np.uint64) == _check(d)
            look, sign, d = look[good], sign[good], d[good]
            if not len(look):
                break
            s = owner[look]
            order = np.lexsort((d, s))
            s, d, sign = s[order], d[order], sign[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d, sign = s[new], d[new], sign[new]
            np.add.at(more, s[sign > 0], 1)
            np.add.at(fewer, s[sign < 0], 1)
            look = np.unique(self.add(d, s, -sign))
        left = np.zeros(len(self.part), bool)
        left[owner[(self.count != 0) | (self.sum != 0) | (self.check != 0)]] = True
        return more, fewer, ~left


def likeness(d: np.ndarray, doc: np.ndarray, n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The Jaccard index of the texts one[i] and two[i] by subtracting sketches; d and doc as from `digests` of n texts."""
    size = np.bincount(doc, minlength=n)
    start = np.cumsum(size) - size
    a, b = size[one], size[two]
    out = np.where((a == 0) & (b == 0), 1.0, 0.0)
    todo = np.flatnonzero((a > 0) & (b > 0))
    part = np.maximum(BASE_CELLS // HASHES, np.abs(a - b) // 2 + 1)  # that many differ at least
    while len(todo):
        sketch = Sketches(part[todo])
        for text, count, sign in ((one[todo], a[todo], 1), (two[todo], b[todo], -1)):
            which = np.repeat(np.arange(len(todo)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[text], count)
            sketch.add(d[at], which, sign)
        more, fewer, done = sketch.peel()
        t = todo[done]
        out[t] = (a[t] - more[done]) / (a[t] + fewer[done])
        todo = todo[~done]
        part[todo] *= 2
    return out


def strings(d: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """The fingerprint strings of n texts."""
    size = np.bincount(doc, minlength=n)
    s = Sketches(np.full(n, BASE_CELLS // HASHES))
    s.add(d, doc, 1)
    cells = np.zeros((n, BASE_CELLS), [("n", "<i4"), ("sum", "<u8"), ("check", "<u4")])
    cells["n"], cells["sum"], cells["check"] = s.count.reshape(n, -1), s.sum.reshape(n, -1), (s.check >> np.uint64(32)).reshape(n, -1)
    return [base64.b64encode(struct.pack("<I", k) + c.tobytes()).decode() for k, c in zip(size.tolist(), cells)]


def similarity(a: str, b: str) -> float | None:
    """The likeness of two fingerprint strings alone; None if too much differs for their cells."""
    both = []
    for x in (a, b):
        raw = base64.b64decode(x)
        both.append((struct.unpack_from("<I", raw)[0], np.frombuffer(raw, [("n", "<i4"), ("sum", "<u8"), ("check", "<u4")], -1, 4)))
    (n, x), (m, y) = both
    if n == m == 0:
        return 1.0
    count, total, check = x["n"].astype(int) - y["n"], x["sum"] - y["sum"], x["check"].astype(np.int64) - y["check"]
    more = fewer = 0
    part = np.array([BASE_CELLS // HASHES])
    while True:
        for c in np.flatnonzero(np.abs(count) == 1):
            d = total[c : c + 1] * np.uint64(int(count[c]) % 2**64)
            own = int((_check(d) >> np.uint64(32))[0])
            # the checks were cut to 32 bits after summing, so a carry of a few may be lost
            if abs((int(check[c]) * int(count[c]) - own + 2**31) % 2**32 - 2**31) <= max(n, m):
                sign = int(count[c])
                at = _cells(d, part)[0]
                count[at] -= sign
                total[at] -= d * np.uint64(sign % 2**64)
                check[at] -= sign * own
                more, fewer = more + (sign > 0), fewer + (sign < 0)
                break
        else:
            break
    return None if count.any() or total.any() else (n - more) / (n + fewer)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, ahead) dealt and sorted so that each own row is followed by the next document's."""
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = id_bounds(key, ranges(key))
    own = key.withColumn("part", range_of(F.col("doc_id"), bounds))
    last, table = len(bounds) - 1, bounds_table(bounds)
    before = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    places = F.when(F.col("doc_id") == F.get(table, F.col("part")), F.array(F.struct("part", F.lit(0).alias("ahead")), F.struct(before.alias("part"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct("part", F.lit(0).alias("ahead"))))
    dealt = own.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    return dealt.repartition("part").sortWithinPartitions("part", "ahead", "doc_id", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _block(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """Results of rows (doc_id, text, next text)."""
    n = len(rows)
    new = [edited(t, x) for _, t, x in rows]
    # texts, then the edited ones, then the next ones that do not stand beside their row already
    beside = [i + 1 < n and rows[i + 1][1] is rows[i][2] for i in range(n)]
    apart = [i for i in range(n) if not beside[i]]
    raw = [t.encode() for _, t, _ in rows] + [e.encode() for e in new] + [rows[i][2].encode() for i in apart]
    d, doc = digests(raw)
    at = np.arange(1, n + 1)
    at[apart] = 2 * n + np.arange(len(apart))
    own = np.arange(n)
    prints = strings(d[doc < 2 * n], doc[doc < 2 * n], 2 * n)
    near = likeness(d, doc, len(raw), np.concatenate((own, own)), np.concatenate((own + n, at)))
    ids = [None if r[0] == NULL_ID else r[0] for r in rows]
    cols = [ids, [len(r[1]) for r in rows], [hashlib.sha256(x).hexdigest() for x in raw[n : 2 * n]], prints[:n], prints[n:], near[:n], near[n:]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness to the edited and the next text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, part = [], None, None
        for b in batches:
            for doc, text, p, ahead in zip(*(b.column(i).to_pylist() for i in range(4))):
                if p != part:
                    held, part = None, p
                if held is not None:
                    rows.append((*held, text))
                    held = None
                    if len(rows) == BLOCK:
                        yield _block(rows)
                        rows = []
                if not ahead:
                    held = (doc, text)
        if rows:
            yield _block(rows)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_ranges(docs).mapInArrow(lean(run), kinds)

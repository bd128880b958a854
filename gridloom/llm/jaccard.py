"""Near duplicates by the exact Jaccard index of texts' sets of word shingles.

Two texts link if their sets of `WIDTH`-word shingles (A-Z lower-cased) have a Jaccard index of `LEAST` or more. A
text of fewer words is one shingle; texts without words have the empty set and link with each other.

Candidates: rows of equal sets are combined. Each set gets a SimHash fingerprint of 64 bits, and the operator of
`simhash` links those within RADIUS bits, by exclusive-or and bit counts in tiles. That radius reaches the closest
pairs only (at J = 0.8 the mean distance is 9.7 bits), so for the rest each set also gets BANDS keys of ROWS least
hashes; whether two sets share a key depends on their Jaccard index J alone, not on where texts were edited, and fails
with probability (1 - J^ROWS)^BANDS: 2.6e-5 at J = 0.8, 6e-10 at 0.9. Only sets that the fingerprints link or that share
a key are made again, once, from their texts.

Decision: by the sets themselves, in Spark, for links of fingerprints too. Pairs to decide are found in two steps, so
that a large group of near copies does not make all its pairs: first those that fingerprints link, and each set with the
nearest of a few before it in its bucket, by a 256-bit sketch; then, of buckets whose sets are not yet connected, all pairs in different components. The sketch
only leaves out pairs more than FAR bits apart (at J = 0.8 the mean is 38.8, the standard deviation 5.7), as do sizes
that make LEAST impossible. Sets of larger buckets are decided within a task, in pairs of tiles, which return the
links of a spanning forest only; their number of pairs is never that of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, meet, stored
from gridloom.llm.components import components
from gridloom.llm.simhash import links, majority
from gridloom.llm.words import mixed, window_hashes, word_hashes

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits in which fingerprints that link may differ.
RADIUS = 3
#: Lanes of 64 bits of a sketch, and bits beyond which it leaves a pair out.
WIDE, FAR = 4, 80
#: Rows before it, and first rows of its bucket, that a row meets in the first step.
BEFORE, HEADS = 64, 8
_MULTIPLY, _ADD = np.random.default_rng(20).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_MULTIPLY |= np.uint64(1)


def shingles(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, ascending, all in a row, and where each text starts (one more at the end)."""
    h, at = word_hashes([t.lower() if t else t for t in texts])
    w, none = window_hashes(h, width), np.zeros(0, np.uint64)
    sets = [np.unique(w[a : b - width + 1]) if b - a >= width else window_hashes(h[a:b], b - a) if b > a else none for a, b in zip(at.tolist(), at[1:].tolist())]
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return np.concatenate([none, *sets]), starts


def band_keys(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys of each set (n, BANDS)."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, BANDS), np.uint64)
    for b in range(BANDS if len(full) else 0):
        key = np.full(len(full), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key + np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], starts[full]))
        out[full, b] = key
    return out


def text_key() -> Column:
    """Names a row's text; a null text is as an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            yield b, *shingles(b.column(column).to_pylist())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets, starts in _sets(batches, 2):
        node = np.array([xxhash.xxh64_intdigest(sets[i:j].tobytes()) for i, j in zip(starts, starts[1:])], np.uint64).view(np.int64)
        print_ = np.concatenate([majority(sets[i:j, None]) if j > i else np.zeros(1, np.uint64) for i, j in zip(starts, starts[1:])]).view(np.int64)
        keys = band_keys(sets, starts).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(print_), lists], ["doc_id", "text_key", "node", "fp", "keys"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets, starts in _sets(batches, 1):
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))
        wide = [majority(np.stack([mixed(sets[i:j] + np.uint64(k)) for k in range(1, WIDE + 1)], 1)).tobytes() if j > i else bytes(8 * WIDE) for i, j in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(starts)), pa.array(wide, pa.binary()), lists], ["node", "n", "wide", "shingles"])


class _Rows:
    """Columns of rows (key, node, n, wide, root) sorted by key and node."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        self.key, self.node, self.n, self.root = (t.column(c).to_numpy() for c in ("key", "node", "n", "root"))
        self.wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), "<u8").reshape(len(t), WIDE)
        self.start = np.searchsorted(self.key, self.key, side="left")

    def apart(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """The sketches' distance of rows i and j (they broadcast), 999 where the pair need not be decided."""
        d = np.bitwise_count(self.wide[i] ^ self.wide[j]).sum(-1, dtype=np.int16)
        a, b = self.n[i], self.n[j]
        open_ = (self.root[i] != self.root[j]) & (np.minimum(a, b) + 1e-9 >= least * np.maximum(a, b))
        return np.where(open_ & (d <= FAR), d, np.int16(999))


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _nearest(t: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Each row with the nearest of the BEFORE rows before it and of the HEADS first of its bucket."""
    x = _Rows(t)
    at = np.arange(len(x.key))
    best, where = np.full(len(at), 999, np.int16), np.full(len(at), -1)
    for k in [*range(1, BEFORE + 1), *range(-HEADS, 0)]:
        other = at - k if k > 0 else x.start - k - 1
        i = np.flatnonzero((other >= x.start) & (other < at))
        d = x.apart(i, other[i], least)
        i, d = i[d < best[i]], d[d < best[i]]
        best[i], where[i] = d, other[i]
    i = np.flatnonzero(where >= 0)
    yield _pairs(x.node[i], x.node[where[i]])


def _all(t: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """All pairs of the buckets that are still to be decided; a row meets at most BEFORE others of its bucket."""
    x = _Rows(t)
    at = np.arange(len(x.key))
    for d in range(1, BEFORE):
        i = at[d:][x.start[d:] <= at[:-d]]
        if not len(i):
            break
        i = i[x.apart(i, i - d, least) <= FAR]
        yield _pairs(x.node[i], x.node[i - d])


def _tile_links(t: pa.Table, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows (node, n, wide, root, shingles, side) of one or two tiles.

    Each row is compared at once with all after it that are not connected to it yet: its shingles are marked in the
    tile's vocabulary, and the marks under the others' shingles are added up.
    """
    x = _Rows(t)
    sets = t.column("shingles").combine_chunks()
    starts = np.cumsum(x.n) - x.n
    vocabulary, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    side = t.column("side").to_numpy()
    alone = side.min() == side.max()
    label, mark, out = x.root.copy(), np.zeros(len(vocabulary), np.int8), []
    for i in range(len(label) - 1):
        j = np.arange(i + 1, len(label))
        j = j[(label[j] != label[i]) & (alone | (side[j] != side[i]))]
        j = j[x.apart(i, j, least) <= FAR]
        if not len(j):
            continue
        mark[ids[starts[i] : starts[i] + x.n[i]]] = 1
        n = x.n[j]
        begins = np.cumsum(n) - n
        both = np.add.reduceat(mark[ids[np.arange(n.sum()) + np.repeat(starts[j] - begins, n)]], begins, dtype=np.int64)
        mark[ids[starts[i] : starts[i] + x.n[i]]] = 0
        for k in j[both + 1e-9 >= least * (n + x.n[i] - both)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out.append((int(x.node[max(i, k)]), int(x.node[min(i, k)])))
    return out


def _by_bucket(rows: DataFrame, find, least: float) -> DataFrame:
    """Pairs that `find` makes of whole buckets; one that a batch breaks off waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t.column(0).to_numpy()
            end = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
            rest = t.slice(end)
            if end:
                yield from find(t.slice(0, end), least)
        if rest is not None and rest.num_rows:
            yield from find(rest, least)

    return rows.select("key", "node", "n", "wide", "root").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(run), "u long, v long")


def _open_links(rows: DataFrame, sets: DataFrame, least: float, tile_rows: int, tile_mb: float) -> DataFrame:
    """Links that connect what is still apart in the buckets with rows of several roots.

    In buckets of up to BEFORE rows all pairs are listed, so a row makes a bounded number of them; the rows of larger
    ones go to the tasks with their sets, in pairs of tiles of bounded rows and bytes, and only links come back.
    """
    many = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key", "rows", "size")
    rows = stored(rows.join(many, "key"), "open")
    common = decided(_by_bucket(rows.where(F.col("rows") <= BEFORE), _all, least), sets, least)
    m = F.ceil(F.greatest(F.col("rows") / tile_rows, F.col("size") * 8e-6 / tile_mb)).cast("int")
    tile = rows.where(F.col("rows") > BEFORE).withColumn("m", m).withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = tile.join(sets.select("node", "shingles"), "node").withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pairs(*np.array(_tile_links(table, least), np.int64).reshape(-1, 2).T)])

    hot = other.select("key", "node", "n", "wide", "root", "shingles", F.col("s").alias("side"), F.least("s", "s2").alias("one"), F.greatest("s", "s2").alias("two")).groupBy("key", "one", "two").applyInArrow(pair, "u long, v long")
    return common.unionAll(hot)


def decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard index of `least` or more."""
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in ("u", "v"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.distinct().join(a, "u").join(b, "v").withColumn("both", both).where(F.col("both") + 1e-9 >= least * (F.size("u_set") + F.size("v_set") - F.col("both"))).select("u", "v")


def _linked(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of the sets (node, fp) that the SimHash operator links: linked fingerprints' first sets, and each set with the first of its fingerprint."""
    firsts = stored(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("sets")), "firsts")
    at = {k: firsts.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_first")) for k in ("u", "v")}
    apart = links(firsts.select("fp"), RADIUS).join(at["u"], "u").join(at["v"], "v").select(F.greatest("u_first", "v_first").alias("u"), F.least("u_first", "v_first").alias("v"))
    same = meet(prints.select("node", "fp"), firsts.where("sets > 1"), "fp", "sets").where(F.col("node") != F.col("first"))
    return apart.unionAll(same.select(F.col("node").alias("u"), F.col("first").alias("v")))


def near_duplicates(docs: DataFrame, least: float = LEAST, tile_rows: int = 2048, tile_mb: float = 16.0) -> DataFrame:
    """(doc_id, text_key, root) of every row; rows of one root are connected by links."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    rows = stored(text.mapInArrow(lean(_keyed), "doc_id long, text_key long, node long, fp long, keys array<long>"), "band_keys")
    nodes = rows.groupBy("node").agg(F.first("keys").alias("keys"), F.min("text_key").alias("text_key"))
    keys = stored(nodes.select("node", "text_key", F.explode("keys").alias("key")), "buckets")
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key")
    shared = stored(shared, "shared")
    prints = stored(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("text_key").alias("text_key")), "prints")
    linked = stored(_linked(prints), "linked")
    ends = linked.select(F.col("u").alias("node")).unionAll(linked.select(F.col("v").alias("node"))).distinct()
    wanted = shared.select("node", "text_key").unionAll(prints.join(ends, "node").select("node", "text_key")).distinct()
    whole = text.groupBy("text_key").agg(F.first("text").alias("text")).join(wanted, "text_key").select("node", "text")
    sets = stored(whole.mapInArrow(lean(_whole), "node long, n long, wide binary, shingles array<long>"), "sets")
    members = stored(shared.select("key", "node").join(sets.select("node", "n", "wide"), "node"), "members")
    nearest = _by_bucket(members.withColumn("root", F.col("node")), _nearest, least)
    first = stored(decided(linked.unionAll(nearest), sets, least), "links")
    roots = components(first).withColumnRenamed("u", "node")
    at = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = stored(_open_links(at, sets, least, tile_rows, tile_mb), "links")
    roots = components(first.unionAll(rest)).withColumnRenamed("u", "node")
    sized = stored(rows.groupBy("node").agg(F.count("*").alias("copies")).join(roots, "node"), "roots")  # copies are many rows of a node
    return meet(rows.select("doc_id", "text_key", "node"), sized, "node", "copies", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))

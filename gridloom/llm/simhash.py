"""SimHash near-duplicates: exact links within a Hamming radius, found tile by tile.

A fingerprint has 64 bits: bit b is 1 if it is set in more than half of the XXH64 (seed 42) of the text's
word shingles. Two fingerprints link if at most `radius` bits differ.

Equal fingerprints are combined first, so thousands of copies are one row from there on. Distinct ones are sorted by
population count and compared tile by tile with numpy exclusive-or and bit counts; pairs of tiles whose population
counts are further apart than the radius are skipped, as two that link differ by no more. Comparing all tiles of a
corpus would still be quadratic in it (population counts of most fingerprints lie between 24 and 40), so fingerprints
are dealt out before that: cut into `radius + 2` bands, two that link agree in at least two bands, so each goes to the
tiles of one bucket for each pair of bands, and no link is lost. Buckets of up to SMALL fingerprints are one tile each,
compared together; one of over `tile_rows` is dealt out as pairs of tiles by population count and hash, each a task of
bounded size. Every task returns a spanning forest of its links, not the pairs.

No word: fingerprint zero, which links like any other. Null ids: such rows get a component like others, and do
not give it its id unless all its rows are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, meet, stored
from gridloom.llm.components import components

BITS = 64
#: Rows of one comparison tile in numpy.
TILE = 1024
#: Buckets of up to so many fingerprints are compared together.
SMALL = 64


def _grams(text: bytes | None, shingle: int) -> list[bytes]:
    w = text.lower().split() if text else []
    if not w:
        return []
    if len(w) <= shingle:
        return [b" ".join(w)]
    if shingle == 1:
        return w
    if shingle == 3:
        return [b"%b %b %b" % t for t in zip(w, w[1:], w[2:])]
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(shingle)))]


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that more than half of the rows of h (n, lanes) set, as lanes."""
    ones = np.zeros(BITS * h.shape[1], np.int64)
    for at in range(0, len(h), 16384):
        part = np.ascontiguousarray(h[at : at + 16384], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of UTF-8 text; bytes.lower() changes A-Z only."""
    grams, digest = _grams(text, shingle), xxhash.xxh64_intdigest
    return int(majority(np.fromiter((digest(g, 42) for g in grams), "<u8", len(grams))[:, None])[0]) if grams else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: fp the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by tiled exclusive-or."""
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    x, ones = fps[order], ones[order].astype(np.int64)
    parent, out = list(range(len(x))), []
    for a in range(0, len(x), TILE):
        one = x[a : a + TILE]
        for b in range(a, len(x), TILE):
            if ones[b] - ones[min(a + TILE, len(x)) - 1] > radius:
                break  # so are all later tiles
            i, j = np.nonzero(np.bitwise_count(one[:, None] ^ x[b : b + TILE][None, :]) <= radius)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            for u, v in zip(i.tolist(), j.tolist()):
                p, q = _find(parent, u), _find(parent, v)
                if p != q:
                    parent[p] = q
                    out.append((u, v))
    x = x.view(np.int64).tolist()
    return [(x[i], x[j]) for i, j in out]


def _in_buckets(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each bucket of a table (key, fp) sorted by key.

    Buckets of up to SMALL rows are compared all at once, rows with those that follow at distance 1, 2, ... as long as
    their population counts allow; larger ones each in tiles.
    """
    t = t.combine_chunks()
    k, fp = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
    order = np.lexsort((np.bitwise_count(fp), k))
    k, fp = k[order], fp[order]
    cut = np.flatnonzero(np.diff(k)) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
    size = end - start
    out: list[tuple[int, int]] = []
    few = np.flatnonzero(np.repeat(size <= SMALL, size))
    key, x = k[few], fp[few]
    ones, pairs = np.bitwise_count(x).astype(np.int64), []
    for d in range(1, min(SMALL, len(few))):
        same = (key[d:] == key[:-d]) & (ones[d:] - ones[:-d] <= radius)  # counts ascend: beyond it all later ones are too
        if not same.any():
            break
        i = np.flatnonzero(same & (np.bitwise_count(x[d:] ^ x[:-d]) <= radius))
        pairs.append(np.stack((x[i], x[i + d]), 1).view(np.int64))
    if pairs:
        parent: dict[int, int] = {}
        for u, v in np.unique(np.concatenate(pairs), axis=0).tolist():
            p, q = _root(parent, u), _root(parent, v)
            if p != q:
                parent[p] = q
                out.append((u, v))
    for a, b in zip(start[size > SMALL].tolist(), end[size > SMALL].tolist()):
        out += forest(fp[a:b], radius)
    yield _edges(out)


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent[up]
        x = up
    return x


def links(nodes: DataFrame, radius: int = 2, tile_rows: int = 8192) -> DataFrame:
    """Links (u, v) whose transitive closure is that of all pairs of the distinct fingerprints fp within the radius."""
    bands = radius + 2
    edges = [BITS * i // bands for i in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(k), band[i], band[j]) for k, (i, j) in enumerate(combinations(range(bands), 2))]
    sizes = nodes.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).join(sizes.where("n > 1"), "key")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come whole and one after the other; one that a batch breaks off waits for the next."""
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t.column(0).to_numpy()
            end = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
            rest = t.slice(end).combine_chunks()
            if end:
                yield from _in_buckets(t.slice(0, end), radius)
        if rest is not None and rest.num_rows:
            yield from _in_buckets(rest, radius)

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_edges(forest(np.unique(table.column("fp").to_numpy().view(np.uint64)), radius))])

    common = keyed.where(F.col("n") <= tile_rows).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lean(small), "u long, v long")
    # buckets over tile_rows: tiles by population count and hash, sent to every tile pair that they are in
    ones, m = F.bit_count("fp"), F.ceil(F.col("n") / tile_rows).cast("int")
    tile = keyed.where(F.col("n") > tile_rows).select("key", "fp", ones.alias("c"), m.alias("m")).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    other = tile.withColumn("c2", F.explode(F.sequence(F.col("c") - radius, F.col("c") + radius))).withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    own, its = F.struct("c", "s"), F.struct(F.col("c2").alias("c"), F.col("s2").alias("s"))
    hot = other.select("key", "fp", F.least(own, its).alias("one"), F.greatest(own, its).alias("two")).groupBy("key", "one", "two").applyInArrow(pair, "u long, v long")
    return common.unionAll(hot)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that can be reached."""
    fps = stored(fingerprints(docs, shingle), "fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    root = components(links(distinct.select("fp"), radius))
    classes = stored(distinct.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    least = stored(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "least")
    named = stored(meet(classes.select("fp", "root", "copies"), least, "root", "nodes").select("fp", "component_id", "copies"), "named")
    return meet(fps.select("doc_id", "fp"), named, "fp", "copies").select("doc_id", "fp", "component_id")

"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are
placed longest first, each into the open sequence that fits it best: `norm` takes the one whose residual vector
is left with the least weighted norm, `dot` the one whose residual has the greatest weighted dot product with
the piece. Only sequences that can take it in every capacity are candidates.

Pieces of one length are alike, and so are sequences with one residual vector; so the choice is made once for
each kind, on the histogram of lengths, and its multiplicity is carried along. The plan holds a few rows a
length, whatever the number of documents. Then pieces are numbered within their length, salted so that no
length gathers in one task, and look their place up in the plan.

A null text is empty; rows with equal ids are separate documents; every row is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lean, stored
from gridloom.llm.tokens import MEMO, encoder

#: Pieces of one length that a task numbers, about.
NUMBERED = 500_000


def pieces(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 0, max_tokens: int = 2048, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and end_id; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), encoder(path, spaced, memo).encode(b.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % max_tokens + 1, n + 1, max_tokens)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * i : 4 * j]
                        rows.append((doc, k, i, j - i, zlib.crc32(part), *((part,) if with_ids else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(lean(run, keeps=True), kinds)


def best_fit(histogram: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places all pieces of a histogram {length: count}.

    Returns rows (length, first, last, sequence, per, offset), and the number of sequences: pieces numbered
    first to last - 1 of that length go `per` at a time to the sequences from `sequence` on, from `offset` on.
    """
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    room = np.zeros((0, 3), np.int64)  # residuals of each kind of open sequence
    kind = np.zeros((0, 2), np.int64)  # its first sequence, and how many there are
    rows, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > np.array(capacity)).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity of {capacity}")
        while left:
            can = np.flatnonzero((room >= need).all(1))
            if len(can):
                r = room[can] / cap
                rank = (w * (r - need / cap) ** 2).sum(1) if score == "norm" else -(w * r * (need / cap)).sum(1)
                g = int(can[np.lexsort((kind[can, 0], rank))[0]])
                fits = int((room[g] // need).min()) if score == "norm" else 1
            else:
                fits = int((np.array(capacity) // need).min())
                room = np.vstack([room, np.array([capacity], np.int64)])
                kind = np.vstack([kind, [[made, -(-left // fits)]]])
                made += int(kind[-1, 1])
                g = len(kind) - 1
            first, many = (int(x) for x in kind[g])
            for per, used in ((fits, min(many, left // fits)), (left % fits, 1)):
                if per and used and left and many and (per == fits or left < fits):
                    rows.append((length, done, done + per * used, first, per, capacity[0] - int(room[g, 0])))
                    room = np.vstack([room, room[g] - per * need])
                    kind = np.vstack([kind, [[first, used]]])
                    first, many, left, done = first + used, many - used, left - per * used, done + per * used
            kind[g] = first, many
            keep = (kind[:, 1] > 0) & (room[:, 0] > 0) & (room[:, 1] > 0)
            room, kind = room[keep], kind[keep]
    return rows, made


def pack(
    parts: DataFrame, max_tokens: int = 2048, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), scores: tuple[str, ...] = ("norm", "dot"), numbered: int = NUMBERED
) -> DataFrame:
    """parts (with doc_id, piece, ids_crc32 and length, read more than once) with sequence_id and offset.

    Capacities that are not given never bind: max_tokens documents, max_tokens squared cost. Of the scores, the
    one that needs the fewest sequences is kept.
    """
    spark = parts.sparkSession
    # a row a length, so max_tokens rows at most; then a row a length and salt, one more for each NUMBERED pieces
    sizes = dict(parts.groupBy("length").count().collect())
    salts = [max(1, -(-sizes.get(length, 0) // numbered)) for length in range(max_tokens + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(salts), F.col("length").cast("int"))).cast("int")
    parts = parts.withColumn("_salt", salt)
    counts = parts.groupBy("length", "_salt").count().orderBy("length", "_salt").collect()
    histogram: dict[int, int] = {}
    bases = []
    for length, s, n in counts:
        bases.append((length, s, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    plan, _ = min((best_fit(histogram, capacity, weights, s) for s in scores), key=lambda x: x[1])
    base = spark.createDataFrame(bases, "length long, _salt int, _base long")
    place = spark.createDataFrame(plan, "length long, _first long, _last long, _sequence long, _per long, _offset long")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    # both tables are bounded by max_tokens, not by the documents
    ranked = parts.withColumn("_rank", F.row_number().over(own)).join(F.broadcast(base), ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    hit = (ranked["length"] == place["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    nth = F.col("_rank") - F.col("_first")
    out = ranked.join(F.broadcast(place), hit).withColumn("sequence_id", F.expr("_sequence + (_rank - _first) div _per")).withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_per")) * ranked["length"])
    return out.select(*(ranked[c] for c in parts.columns if c != "_salt"), "sequence_id", "offset")


def packed(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 0, max_tokens: int = 2048, with_ids: bool = False, memo: int = MEMO, **limits) -> DataFrame:
    """The pieces of all documents with their places; memo bounds what each worker remembers of words."""
    return pack(stored(pieces(docs, path, spaced, end_id, max_tokens, with_ids, memo), "pieces"), max_tokens, **limits)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of placed pieces that carry ids: little-endian unsigned 32-bit ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    one = placed.groupBy("sequence_id").agg(parts.alias("p"))
    join = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return one.select("sequence_id", join.alias("ids"), F.col("p.length").alias("lengths"))

"""Token ids as frequency ranks in a byte-aligned variable-length code with separate control bytes.

Ids are renumbered by frequency over the whole corpus (ties: smaller id first), so most take one byte. Two
control bits tell how many bytes a rank has; four to a control byte, each document padded to whole ones.
An image holds documents in a row:

    magic "GLV1" | documents u4 | tokens u8 | doc_ids i8[] | counts u4[] | control bytes | data bytes

Images lie in a table (part, image, skipped, tokens, image) beside a table of ranks; part and image ascend with
doc_id, and `skipped` counts the tokens of the part before the image. Spark's writer commits whole files, so a
lost executor leaves no half-written image. Decoding looks the lengths up in a table by control byte.

A null text is empty, a null doc_id sorts first and comes back null; rows of equal doc_id are ordered by
their number of ids, then by their coded bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import _RUN, id_bounds, lean, NULL_ID, range_of, ranges, stored, workspace
from gridloom.llm.tokens import encoder

MAGIC = b"GLV1"
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def encode(counts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents' ranks in a row, and how many data bytes each document has."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    lane = np.arange(len(ranks)) + np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts), counts)
    code = np.zeros(4 * int(quads.sum()), np.uint8)
    code[lane] = size
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    ends = np.cumsum(counts)
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]], counts + total[ends] - total[ends - counts]


def image(doc_ids: np.ndarray, counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    head = MAGIC + struct.pack("<IQ", len(doc_ids), int(counts.sum()))
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + control + data


def decode_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, counts and ranks of an image."""
    if image[:4] != MAGIC:
        raise ValueError("not an image of this format")
    n, tokens = struct.unpack_from("<IQ", image, 4)
    doc_ids = np.frombuffer(image, "<i8", n, 16)
    counts = np.frombuffer(image, "<u4", n, 16 + 8 * n).astype(np.int64)
    quads = -(-counts // 4)
    at = 16 + 12 * n
    control = np.frombuffer(image, np.uint8, int(quads.sum()), at)
    lane = np.arange(tokens) + np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts), counts)
    size = LENGTHS[control].reshape(-1)[lane]
    data = np.frombuffer(image, np.uint8, -1, at + len(control))
    if int(size.sum(dtype=np.int64)) != len(data):
        raise ValueError("an image whose data do not match its control bytes")
    ranks = np.zeros((tokens, 4), np.uint8)
    ranks[np.arange(4) < size[:, None]] = data
    return doc_ids, counts, ranks.view("<u4")[:, 0]


def token_table(docs: DataFrame, path: str, spaced: bool, end_id: int) -> DataFrame:
    """(doc_id, n, ids) of every row: little-endian ids, of 16 bits if the vocabulary allows."""
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = [np.frombuffer(x + end, "<u4").astype(kind) for x in encoder(path, spaced).encode(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text")).mapInArrow(lean(run, keeps=True), "doc_id long, n long, ids binary")


def _array(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends a row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                each = b.slice(at, 512)
                c = np.bincount(_array(b"".join(each.column(1).to_pylist()), sum(each.column(0).to_pylist())))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, path: str, spaced: bool = False, end_id: int = 1, image_tokens: int = 1 << 20) -> None:
    """Encodes every text and writes folder/ranks and folder/images, images in ascending doc_id order."""
    tokens = stored(token_table(docs, path, spaced, end_id), "tokens")
    order = [r.id for r in frequencies(tokens).orderBy(F.desc("n"), "id").select("id").collect()]  # bounded by the vocabulary
    rank = np.zeros(max(order, default=0) + 1, "<u4")
    rank[order] = np.arange(len(order))
    docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order)], "rank long, id long").write.mode("overwrite").parquet(f"{folder}/ranks")

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                n = b.column(1).to_numpy()
                control, data, size = encode(n, rank[_array(b"".join(b.column(2).to_pylist()), int(n.sum()))])
                control, data, q, d = control.tobytes(), data.tobytes(), np.cumsum(-(-n // 4)), np.cumsum(size)
                code = [control[i:j] + data[k:m] for i, j, k, m in zip([0, *q.tolist()], q.tolist(), [0, *d.tolist()], d.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.binary())], ["doc_id", "n", "code"])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, skipped, held = None, 0, 0, []

        def close() -> pa.RecordBatch:
            ids, n, code = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64), [h[2] for h in held]
            q = (-(-n // 4)).tolist()
            blob = image(ids, n, b"".join([x[:k] for x, k in zip(code, q)]), b"".join([x[k:] for x, k in zip(code, q)]))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nth]), pa.array([skipped]), pa.array([int(n.sum())]), pa.array([blob], pa.binary())], ["part", "image", "skipped", "tokens", "image_bytes"])

        total = 0
        for b in batches:
            for p, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (p != part or total >= image_tokens):
                    yield close()
                    nth, skipped, total, held = nth + 1, skipped + total, 0, []
                if p != part:
                    part, nth, skipped = p, 0, 0
                held.append(row)
                total += row[1]
        if held:
            yield close()

    bounds = id_bounds(tokens, ranges(tokens))
    coded = tokens.mapInArrow(lean(recode), "doc_id long, n long, code binary").select(range_of(F.col("doc_id"), bounds).cast("long").alias("part"), "doc_id", "n", "code")
    ordered = coded.repartition("part").sortWithinPartitions("part", "doc_id", "n", "code")
    ordered.mapInArrow(images, "part long, image long, skipped long, tokens long, image_bytes binary").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/images")


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the images of a folder."""
    order = np.array([r.id for r in spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    images = spark.read.schema("part long, image long, skipped long, tokens long, image_bytes binary").parquet(f"{folder}/images")
    totals, base, at = images.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect(), {}, 0  # a row a part
    for r in totals:
        base[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, skipped, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                doc_ids, counts, ranks = decode_image(blob)
                values = order[ranks]
                ends = np.cumsum(counts)
                raw = values.tobytes()
                each = [raw[4 * i : 4 * j] for i, j in zip((ends - counts).tolist(), ends.tolist())]
                out = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base[part] + skipped + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(each, pa.binary())] * ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return images.select("part", "skipped", "image_bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def round_trip(docs: DataFrame, path: str, spaced: bool = False, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Writes docs to a folder of the workspace and reads it back."""
    folder = f"{workspace(docs.sparkSession)}/gridloom/{_RUN}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, spaced, end_id)
    return read_ids(docs.sparkSession, folder, ids)

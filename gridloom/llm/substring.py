"""Removal of repeated word passages, found by difference-cover anchors.

A word is removed if it lies in a window of `width` words that also starts earlier: in a document of smaller
id, or earlier in its own. Windows are judged on the input.

Hashing every window would shuffle as many rows as there are words. Instead, a short anchor of
`width - period + 1` words is hashed only at positions whose remainder modulo the period is in a difference
cover. For any two positions some shift below the period puts both on the cover, so two equal windows share
an aligned anchor. Only windows that hold an anchor met twice are then extended to whole windows and compared.

1. anchors: hashes of cover positions go to hash buckets, after those met twice within a task are combined,
   so a passage that very many documents share sends one row a task;
2. each bucket tells which anchors are shared;
3. documents meet their shared anchors again and send 96-bit hashes of the windows around them, again after
   combining equal windows of the group;
4. each bucket keeps the first window of a kind and names the others;
5. documents meet the named windows and lose those words. The texts are shuffled once; Spark reuses that
   exchange in step 5.

Rows that share doc_id and text count as one document; of rows that share only doc_id, the order is by a text
hash. A null doc_id sorts first, a null text has no words, and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NULL_ID, group_of_ids, lean, narrow, pack, parts, runs, trim, unpack
from gridloom.llm.words import window_hashes, word_hashes, words

#: Perfect difference covers: every difference modulo the period is one of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Anchors that a task gathers before it sends them.
FLUSH = 400_000
#: Bytes of text whose words a task hashes at a time, or one document.
SLICE = 1_000_000
_BLOBS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("blob", pa.binary())])


def _period(width: int) -> int:
    return max(p for p in COVERS if p <= max(3, width // 2 + 3) and p < width)


def _texthash(values: list[bytes | None]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t or b"", 42) & 0xFFFFFFFF for t in values), np.uint32, len(values))


def _groups(ids: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """Groups of documents, by id and text, so that rows of one id (or none) do not gather in one."""
    return group_of_ids(ids.astype(np.int64) ^ (th.astype(np.int64) << 20), n)


def _group(n: int) -> Column:
    """The group of a row, as `_groups` finds it."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).bitwiseXOR(F.shiftleft(th, 20))), F.lit(n)).cast("int")


def _rows(out: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOBS)], schema=_BLOBS)


def _places(ids: np.ndarray, th: np.ndarray, doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> bytes:
    """Places in documents; doc must be ascending."""
    used, inner = np.unique(doc, return_inverse=True)
    step = np.diff(inner, prepend=0)
    return pack(ids[used].astype("<i8"), th[used].astype("<u4"), narrow(step), narrow(pos), *more)


def _open(blob: bytes) -> list[np.ndarray]:
    ids, th, step, pos, *more = unpack(blob)
    return [ids, th, np.cumsum(step, dtype=np.int64), pos.astype(np.int64), *more]


def _gathered(blobs: list[bytes]) -> list[np.ndarray]:
    """Ids, text hashes, document index, position and more of several blobs together."""
    opened, base = [_open(b) for b in blobs], 0
    for x in opened:
        x[2] = x[2] + base
        base += len(x[0])
    return [np.concatenate(c) for c in zip(*opened)]


def _by_group(ids, th, doc, pos, n_groups: int, bucket: int) -> list[tuple[int, int, bytes]]:
    """Blobs of places, one for each group of documents."""
    if not len(doc):
        return []
    used, inner = np.unique(doc, return_inverse=True)
    grp = _groups(ids[used], th[used], n_groups)[inner]
    order = np.lexsort((pos, doc, grp))
    return [(bucket, g, _places(ids, th, doc[order[a:b]], pos[order[a:b]])) for g, a, b in runs(grp[order])]


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (the last is the leading one), whether each of the order opens a run, and the run's length."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return order, new, np.repeat(np.diff(start, append=len(order)), np.diff(start, append=len(order)))


def _bucketed(ids, th, doc, pos, key: np.ndarray, n_buckets: int, *more: np.ndarray) -> list[tuple[int, None, bytes]]:
    """Blobs of places with what is left of their keys, one for each bucket of keys."""
    bucket = (key % np.uint64(n_buckets)).astype(np.int64)
    low = (key // np.uint64(n_buckets)).astype("<u4")
    order = np.lexsort((doc, bucket))
    return [(b, None, _places(ids, th, doc[o], pos[o], low[o], *(m[o] for m in more))) for b, a, e in runs(bucket[order]) for o in (order[a:e],)]


def _anchors(width: int, period: int, n_buckets: int, n_groups: int):
    span, cover = width - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def send(ids, th, doc, pos, key) -> pa.RecordBatch:
        ids, th, doc, pos, key = map(np.concatenate, (ids, th, doc, pos, key))
        order, new, size = _firsts(key)
        twice = np.sort(order[size > 1])
        once = order[new]
        rest = (key // np.uint64(n_buckets) >> np.uint64(32)).astype("<u1")  # with the bucket, 40 bits and more
        return _rows(_bucketed(ids, th, doc[once], pos[once], key[once], n_buckets, rest[once]) + _by_group(ids, th, doc[twice], pos[twice], n_groups, int(xxhash.xxh32_intdigest(ids[:1].tobytes()) % n_buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, n = [[] for _ in range(5)], 0, 0
        for batch in (b.slice(at, 250) for b in batches for at in range(0, b.num_rows, 250)):
            values = batch.column(1).to_pylist()
            h, starts = word_hashes(values)
            size = np.diff(starts)
            doc = np.repeat(np.arange(len(values)), size)
            pos = np.arange(len(h)) - starts[doc]
            ok = cover[pos % period] & (pos + span <= size[doc]) & (size[doc] >= width)
            at = np.flatnonzero(ok[: max(0, len(h) - span + 1)])
            for x, y in zip(held, (batch.column(0).to_numpy(zero_copy_only=False), _texthash(values), doc[at] + base, pos[at], window_hashes(h, span)[at])):
                x.append(y)
            base, n = base + len(values), n + len(at)
            if n >= FLUSH:
                yield send(*held)
                held, base, n = [[] for _ in range(5)], 0, 0
        if n:
            yield send(*held)

    return run


def _shared(n_groups: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp, blobs = table.column("grp").to_pylist(), table.column("blob").to_pylist()
        out = [(0, g, b) for g, b in zip(grp, blobs) if g is not None]
        own = [b for g, b in zip(grp, blobs) if g is None]
        if own:
            ids, th, doc, pos, low, high = _gathered(own)
            order, _, size = _firsts(low, high)
            at = order[size > 1]
            out += _by_group(ids, th, doc[at], pos[at], n_groups, 0)
        return pa.Table.from_batches([_rows(out)])

    return run


def _marked(left_ids, left_th, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the documents and positions that the blobs name; of equal rows, the first."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, th, doc, pos = _gathered(blobs)[:4]
    row = {k: r for r, k in reversed(list(enumerate(zip(left_ids.tolist(), left_th.tolist()))))}
    rows = np.fromiter((row.get(k, -1) for k in zip(ids.tolist(), th.tolist())), np.int64, len(ids))[doc]
    return rows[rows >= 0], pos[rows >= 0]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _texts(table: pa.Table) -> list[bytes | None]:
    return table.column("text").combine_chunks().cast(pa.binary()).to_pylist()


def _around(texts: list[bytes | None], doc: np.ndarray, pos: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, position and both hashes of the windows of texts that hold one of the anchors at (doc, pos), in order."""
    h, starts = word_hashes(texts)
    size = np.diff(starts)
    low, high = np.maximum(pos - (width - span), 0), np.minimum(pos, size[doc] - width) + 1
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, starts[doc] + low, high > low)
    np.add.at(edge, starts[doc] + high, -1 * (high > low))
    at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    one, two = window_hashes(h, width)[at], (window_hashes(h, width, 1)[at] >> np.uint64(32)).astype("<u4")
    doc = np.repeat(np.arange(len(texts)), size)[at]
    return doc, at - starts[doc], one, two


def _windows(width: int, span: int, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, bytes]] = []
        blobs = marks.column("blob").to_pylist()
        if docs.num_rows and blobs:
            values, ids = _texts(docs), _ids(docs)
            th = _texthash(values)
            row, pos = _marked(ids, th, blobs)
            near = np.unique(row)
            near = near[np.lexsort((th[near], ids[near]))]  # from here on documents are in their order
            place = np.zeros(len(values), np.int64)
            place[near] = np.arange(len(near))
            none = np.zeros(0, np.int64)
            found, at = [(none, none, np.zeros(0, np.uint64), np.zeros(0, "<u4"))], 0
            order = np.argsort(place[row], kind="stable")
            d, pos = place[row][order], pos[order]
            while at < len(near):  # few documents' words are hashed at a time
                end, held = at, 0
                while end < len(near) and (end == at or held + len(values[near[end]] or b"") <= SLICE):
                    held += len(values[near[end]] or b"")
                    end += 1
                a, b = np.searchsorted(d, (at, end))
                part = _around([values[r] for r in near[at:end]], d[a:b] - at, pos[a:b], width, span)
                found.append((part[0] + at, *part[1:]))
                at = end
            doc, pos, one, two = map(np.concatenate, zip(*found))
            del found, values
            order, new, _ = _firsts(two, one)  # a stable sort: the first of a run is the earliest
            once, later = np.sort(order[new]), np.sort(order[~new])
            out += _bucketed(ids[near], th[near], doc[once], pos[once], one[once], n_buckets, (one[once] // np.uint64(n_buckets) >> np.uint64(32)).astype("<u4"), two[once])
            if len(later):
                out.append((int(one[later[0]] % np.uint64(n_buckets)), key[0].as_py(), _places(ids[near], th[near], doc[later], pos[later])))
            del one, two, order, new, doc, pos
            trim()
        return pa.Table.from_batches([_rows(out)])

    return run


def _later(n_groups: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp, blobs = table.column("grp").to_pylist(), table.column("blob").to_pylist()
        out = [(0, g, b) for g, b in zip(grp, blobs) if g is not None]
        own = [b for g, b in zip(grp, blobs) if g is None]
        if own:
            ids, th, doc, pos, a, b, c = _gathered(own)
            order = np.lexsort((pos, th[doc], ids[doc], c, b, a))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in (a, b, c)])
            at = order[same]
            out += _by_group(ids, th, doc[at], pos[at], n_groups, 0)
        return pa.Table.from_batches([_rows(out)])

    return run


def _spans(gone: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone, each with the white space before it."""
    out, at = [], 0
    end = 0
    for w, drop in zip(text.split(), gone.tolist()):
        start = text.index(w, at)
        if not drop:
            out.append(text[end : start + len(w)])
        at = end = start + len(w)
    out.append(text[end:])
    return b"".join(out)


def _result(width: int, joined: bool, schema: pa.Schema, helper: str):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        values, ids = _texts(docs), _ids(docs)
        th = _texthash(values)
        row, pos = _marked(ids, th, marks.column("blob").to_pylist())
        order = np.argsort(row, kind="stable")
        named = {k: pos[order[a:b]] for k, a, b in runs(row[order])}
        first = {k: r for r, k in reversed(list(enumerate(zip(ids.tolist(), th.tolist()))))}
        n, lost, spans, kept = [], [], [], []
        for r, text in enumerate(values):
            w = words(text)
            p = named.get(first[ids[r], th[r]])
            n.append(len(w))
            if p is None:
                lost.append(0)
                spans.append([])
                kept.append(b" ".join(w) if joined else text)
                continue
            edge = np.zeros(len(w) + 1, np.int32)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
            lost.append(int(gone.sum()))
            spans.append(_spans(gone))
            kept.append(b" ".join(x for x, g in zip(w, gone.tolist()) if not g) if joined else _cut(text, gone))
        cols = [docs.column(c).cast(schema.field(c).type) for c in docs.column_names if c != helper]
        del values
        trim()
        cols += [pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def remove_repeats(docs: DataFrame, width: int = 20, joined: bool = False, size_mb: float = 8.0) -> DataFrame:
    """docs with n_words, n_removed, removed_spans (word ranges, end exclusive) and kept_text.

    ``joined``: kept_text is the kept words with single spaces; otherwise the text itself with the removed words
    and the white space before them cut out. Columns of docs with these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    period = _period(width)
    span = width - period + 1
    n = parts(docs, size_mb)
    base = docs.drop("n_words", "n_removed", "removed_spans", "kept_text")
    helper = "_grp"
    while helper in base.columns:
        helper += "_"
    flat = base.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blobs = "bucket int, grp int, blob binary"
    sent = flat.mapInArrow(lean(_anchors(width, period, n, n)), blobs)
    shared = sent.groupBy("bucket").applyInArrow(_shared(n), blobs).drop("bucket")
    left = base.withColumn(helper, _group(n)).groupBy(helper)
    probes = left.cogroup(shared.groupBy("grp")).applyInArrow(_windows(width, span, n), blobs)
    named = probes.groupBy("bucket").applyInArrow(_later(n), blobs).drop("bucket")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, n_words long, n_removed long, removed_spans array<array<int>>, kept_text string"
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return left.cogroup(named.groupBy("grp")).applyInArrow(_result(width, joined, arrow, helper), schema)


def sql(width: int = 20) -> str:
    """DuckDB SQL for the digest of remove_repeats(joined=True) over documents, with doc_id unique."""
    return rf"""with d as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] w from documents),
 win as (select doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') g from (select doc_id, w, unnest(range(1, len(w) - {width - 2})) i from d)),
 dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) n from win) where n > 1),
 gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + {width})) p from dup)),
 word as (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from d),
 kept as (select word.doc_id, string_agg(x, ' ' order by word.p) t, count(*) n from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by word.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes in both directions and gives label probabilities at every byte. A document's
score is pooled from all its positions: the mean of their log probabilities, weighed by their number up to EVIDENCE,
goes through a softmax. States are carried over words and lines: a text is cut into cores of CORE bytes, each read
together with EDGE bytes before and after it, so that every position is labelled once, by states that have seen at
least EDGE bytes on either side (or the text's end). Windows of many texts are read together, step by step.

Training: backpropagation through time with Adam on windows of a bounded sample: the `per_language` documents of each
language whose id hash is least, and `per_document` windows of SPAN bytes spread evenly over each of them.
Thresholds come from ids and languages alone, so no text moves. Weights are fixed by the seed and the sample.

A text that is null or has no letter is `und` with score 0, as is everything where nothing could be learned.
Rows with null lang or null doc_id are not learned from. Prediction looks at the text alone. Columns kept that are
called doc_id, lang_pred or score give way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lean, small_side

HIDDEN, CORE, EDGE, SPAN, EVIDENCE = 8, 224, 16, 40, 32
#: Windows that are read together.
BATCH = 2048
Network = dict[str, np.ndarray]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def init(classes: int, seed: int = 1) -> Network:
    """For each direction d and gate g (update z, reset r, candidate m): bytes Wdg, states Udg, offset bdg; labels Vd, c."""
    rng, h = np.random.default_rng(seed), HIDDEN
    one = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {k: v for d in "fb" for g in "zrm" for k, v in ((f"W{d}{g}", one(256, h)), (f"U{d}{g}", one(h, h)), (f"b{d}{g}", np.zeros(h, np.float32)))}
    return p | {"Vf": one(h, classes), "Vb": one(h, classes), "c": np.zeros(classes, np.float32)}


def _live(n: np.ndarray, steps: int) -> np.ndarray:
    """How many rows, sorted by falling length n, have a byte at each step."""
    return np.searchsorted(-n, -np.arange(steps), side="left")


def _scan(p: Network, d: str, ids: np.ndarray, live: np.ndarray, cache: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(step, states of the rows that are live there) of ids (steps, rows), in direction d; states start at zero."""
    w = [p[f"W{d}{g}"] + p[f"b{d}{g}"] for g in "zrm"]
    u = [p[f"U{d}{g}"] for g in "zrm"]
    half, h = w[0].dtype.type(0.5), np.zeros((ids.shape[1], HIDDEN), w[0].dtype)
    for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
        k = live[t]
        i, old = ids[t, :k], h[:k]
        z, r, q = (old @ x for x in u)
        for gate, x in ((z, w[0]), (r, w[1])):
            gate += x.take(i, 0)
            gate *= half
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        m = q * r
        m += w[2].take(i, 0)
        np.tanh(m, out=m)
        new = old - m
        new *= z
        new += m
        if cache is not None:
            cache.append((t, k, old.copy(), z, r, m, q))
        h[:k] = new
        yield t, new


def _unscan(p: Network, d: str, ids: np.ndarray, cache: list, dout: np.ndarray, grad: Network) -> None:
    """Backpropagation through time of `_scan`; dout (steps, rows, HIDDEN) are the gradients of its states."""
    parts: dict[str, list[np.ndarray]] = {g: [] for g in "zrm"}
    seen = []
    u = {g: p[f"U{d}{g}"] for g in "zrm"}
    for g in "zrm":
        grad[f"U{d}{g}"] = np.zeros_like(u[g])
    dh = np.zeros((ids.shape[1], HIDDEN), dout.dtype)
    for t, k, old, z, r, m, q in reversed(cache):
        g = dh[:k] + dout[t, :k]
        dm = g * (1 - z) * (1 - m * m)
        dz = g * (old - m) * z * (1 - z)
        dr = dm * q * r * (1 - r)
        dq = dm * r
        dh[:k] = g * z + dz @ u["z"].T + dr @ u["r"].T + dq @ u["m"].T
        for name, x, y in (("z", dz, dz), ("r", dr, dr), ("m", dm, dq)):
            parts[name].append(x)
            grad[f"U{d}{name}"] += old.T @ y
        seen.append(ids[t, :k])
    at = np.concatenate(seen)
    order = np.argsort(at, kind="stable")
    values, first = np.unique(at[order], return_index=True)
    for g in "zrm":
        x = np.concatenate(parts[g])
        grad[f"W{d}{g}"] = np.zeros_like(p[f"W{d}{g}"])
        grad[f"W{d}{g}"][values] = np.add.reduceat(x[order], first, 0)
        grad[f"b{d}{g}"] = x.sum(0)


def _softmax_log(y: np.ndarray) -> np.ndarray:
    y -= y.max(-1, keepdims=True)
    y -= np.log(np.exp(y).sum(-1, keepdims=True))
    return y


def gradients(p: Network, ids: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy over all positions and its gradients; ids (steps, rows), rows by falling length n."""
    live, cf, cb = _live(n, len(ids)), [], []
    h = {d: np.zeros((*ids.shape, HIDDEN), p["c"].dtype) for d in "fb"}
    for d, cache in (("f", cf), ("b", cb)):
        for t, state in _scan(p, d, ids, live, cache):
            h[d][t, : live[t]] = state
    on = np.arange(len(ids))[:, None] < n
    y = np.exp(_softmax_log(h["f"] @ p["Vf"] + h["b"] @ p["Vb"] + p["c"]))
    own = label[None, :, None]
    loss = -np.log(np.take_along_axis(y, np.broadcast_to(own, (len(ids), len(label), 1)), 2)[..., 0] + 1e-12)[on].mean()
    dy = y - (np.arange(y.shape[2]) == own)
    dy = (dy * (on / on.sum())[..., None]).astype(y.dtype)
    grad = {"c": dy.sum((0, 1))}
    for d, cache in (("f", cf), ("b", cb)):
        grad[f"V{d}"] = np.tensordot(h[d], dy, ((0, 1), (0, 1)))
        _unscan(p, d, ids, cache, dy @ p[f"V{d}"].T, grad)
    return float(loss), grad


def columns(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows sorted by falling length as ids (steps, rows), padded with blanks, and their lengths."""
    n = np.array([len(w) for w in windows])
    ids = np.full((len(windows), int(n.max())), 32, np.uint8)
    ids[np.arange(ids.shape[1]) < n[:, None]] = np.frombuffer(b"".join(windows), np.uint8)
    return np.ascontiguousarray(ids.T), n


def train(windows: list[bytes], label: np.ndarray, classes: int, steps: int = 300, size: int = 192, rate: float = 0.02, seed: int = 1) -> Network:
    """Adam on batches of windows, languages in equal parts."""
    rng, p = np.random.default_rng(seed), init(classes, seed)
    share = 1 / np.bincount(label, minlength=classes)[label]
    share /= share.sum()
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        at = rng.choice(len(windows), size, p=share)
        at = at[np.argsort([-len(windows[i]) for i in at], kind="stable")]
        _, g = gradients(p, *columns([windows[i] for i in at]), label[at])
        lr = rate * min(1, 2 - 2 * t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] ** 2 - v[k])
            p[k] = (p[k] - lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return p


def _read(p: Network, flat: np.ndarray, begin: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of the label log probabilities at positions first to last - 1 of windows (begin, n) of the bytes, by falling n."""
    steps = int(n[0])
    ids = np.ascontiguousarray(flat[np.minimum(begin + np.arange(steps)[:, None], len(flat) - 1)])
    live = _live(n, steps)
    ahead = np.zeros((steps, len(n), p["c"].size), np.float32)
    for t, state in _scan(p, "f", ids, live):
        ahead[t, : len(state)] = state @ p["Vf"]
    out = np.zeros((len(n), p["c"].size), np.float32)
    for t, state in _scan(p, "b", ids, live):
        k = len(state)
        y = state @ p["Vb"]
        y += ahead[t, :k]
        y = _softmax_log(y + p["c"])
        out[:k] += y * ((first[:k] <= t) & (t < last[:k]))[:, None]
    return out


def score(p: Network, texts: list[bytes]) -> np.ndarray:
    """Pooled label probabilities of each text."""
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    cores = -(-size // CORE)
    doc = np.repeat(np.arange(len(texts)), cores)
    core = (np.arange(len(doc)) - np.repeat(np.cumsum(cores) - cores, cores)) * CORE
    base, whole = (np.cumsum(size) - size)[doc], size[doc]
    begin, end = np.maximum(core - EDGE, 0), np.minimum(core + CORE + EDGE, whole)
    order = np.argsort(begin - end, kind="stable")
    total = np.zeros((len(texts), p["c"].size))
    for at in range(0, len(order), BATCH):
        w = order[at : at + BATCH]
        sums = _read(p, flat, (base + begin)[w], (end - begin)[w], (core - begin)[w], (np.minimum(core + CORE, whole) - begin)[w])
        np.add.at(total, doc[w], sums)
    y = total / np.maximum(size, 1)[:, None] * np.minimum(size, EVIDENCE)[:, None]
    y = np.exp(y - y.max(1, keepdims=True))
    return y / y.sum(1, keepdims=True)


def sample(docs: DataFrame, per_language: int, per_document: int) -> DataFrame:
    """(lang, window) of the bounded sample of labelled documents, without the held-out fold."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("lang", F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("binary").alias("text"))
    # four times as many as are wanted, by their share of the hash range, so that few rows meet in a language's task
    part = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.count("*"))
    first = known.groupBy("lang").agg((part * (2.0**64 - 2.0**12) - 2.0**63).cast("long").alias("top"))
    ranked = known.select("lang", "h").join(small_side(first), "lang").where("h <= top").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    limits = ranked.where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                step = max(SPAN, len(text) // per_document)
                rows += [(lang, text[i : i + SPAN]) for i in range(0, max(1, len(text) - SPAN // 2), step)[:per_document]]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "window"])

    chosen = known.where("text is not null").join(small_side(limits), "lang").where("h <= top")
    return chosen.select("lang", "text").mapInArrow(run, "lang string, window binary")


def fit(docs: DataFrame, per_language: int = 300, per_document: int = 12, steps: int = 300) -> tuple[list[str], Network]:
    """The learned languages in order, and the network; no languages where nothing is labelled."""
    rows = sorted(sample(docs, per_language, per_document).collect())  # bounded by the two parameters
    langs = sorted({r.lang for r in rows})
    if not langs:
        return [], {}
    at = {lang: i for i, lang in enumerate(langs)}
    return langs, train([bytes(r.window) for r in rows], np.array([at[r.lang] for r in rows]), len(langs), steps)


def identify(docs: DataFrame, model: tuple[list[str], Network], *keep: str) -> DataFrame:
    """doc_id, lang_pred and score of every row, with the columns kept."""
    langs, p = model
    keep = tuple(k for k in keep if k not in ("doc_id", "lang_pred", "score"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not langs:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                has = b.column(2).to_pylist()
                y = score(p, [t if h else b"" for t, h in zip(b.column(1).to_pylist(), has)])
                best = y.argmax(1)
                pred = [langs[i] if h else "und" for i, h in zip(best, has)]
                value = np.where(has, y[np.arange(len(y)), best], 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(value), *(b.column(3 + i) for i in range(len(keep)))], ["doc_id", "lang_pred", "score", *keep])

    kinds = "doc_id long, lang_pred string, score double" + "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes"), letters.alias("_letters"), *keep).mapInArrow(lean(run), kinds)

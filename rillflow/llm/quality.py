"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded (byte classes, word
shapes, repetition, hashed words; then a learned layer), gated attention learns from
document labels which passages count, and the weighted passage representation is
scored.  Fitted with numpy on the driver on a bounded sample of labelled rows, whole
texts of them, until a part of it that is held back scores no better; scoring is one
scan without a shuffle over every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.words import U, Words, slices

PASSAGE_WORDS = 64
#: Labelled rows that a model is fitted on at most (all passages of each).
FIT_ROWS = 4000
HASHED, SLOTS = 64, 128
#: The decay was chosen by cross-validation on labelled rows that are not held out.
HIDDEN, GATE, RATE, DECAY, SEED = 32, 16, 0.01, 1e-2, 7
#: Passes at most, one bag in so many held back to stop by, and passes without a gain there after which to stop.
EPOCHS, HELD_BACK, PATIENCE = 250, 10, 25

_SINGLE = b" \n.,!?|%*#&$@-:;<>=/"
_CLASS = np.zeros(256, np.int64)
_CLASS[:32] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:192], _CLASS[192:] = 2, 3, 4, 5, 6
for _k, _b in enumerate(_SINGLE):
    _CLASS[_b] = 7 + _k
N_CLASSES = 7 + len(_SINGLE)
N_FEATURES = N_CLASSES + 7 + HASHED


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each text (one more at the end); a text without words is one passage."""
    w = Words(texts)
    per_doc = np.maximum(1, -(-w.count // PASSAGE_WORDS))
    first = np.append(0, np.cumsum(per_doc))
    p = int(first[-1])
    local = np.arange(len(w.start)) - w.first[w.doc]
    of_word = first[w.doc] + local // PASSAGE_WORDS
    begin = np.zeros(p + 1, np.int64)
    begin[first[:-1]] = w.offsets[:-1]
    lead = (local % PASSAGE_WORDS == 0) & (local > 0)
    begin[of_word[lead]] = w.start[lead]
    begin[p] = len(w.data)
    of_byte = np.repeat(np.arange(p), np.diff(begin))
    size = np.maximum(1, np.diff(begin))[:, None]
    classes = np.bincount(of_byte * N_CLASSES + _CLASS[w.data], minlength=p * N_CLASSES).reshape(p, N_CLASSES) / size
    h, length = w.hashes(), (w.end - w.start).astype(np.float64)
    n = np.bincount(of_word, minlength=p).astype(np.float64)
    some = np.maximum(n, 1)
    total = lambda x: np.bincount(of_word, weights=x, minlength=p) / some
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    seen = np.zeros(p * SLOTS, bool)
    seen[of_word * SLOTS + (h >> U(20)).astype(np.int64) % SLOTS] = True
    mean = total(length)
    shape = np.column_stack([n / PASSAGE_WORDS, mean / 8, np.sqrt(np.maximum(total(length**2) - mean**2, 0)) / 4, total(length <= 3), total(length > 12), total(same), seen.reshape(p, SLOTS).sum(axis=1) / some])
    hashed = np.bincount(of_word * HASHED + (h >> U(40)).astype(np.int64) % HASHED, minlength=p * HASHED).reshape(p, HASHED) / some[:, None]
    return np.hstack([np.sqrt(classes), shape, hashed]).astype(np.float32), first


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    v = {"x": (x - m["mean"]) * m["scale"]}
    v["h"] = np.tanh(v["x"] @ m["W"] + m["b"])
    v["t"], v["s"] = np.tanh(v["h"] @ m["V"]), 1 / (1 + np.exp(-(v["h"] @ m["G"])))
    logit = (v["t"] * v["s"]) @ m["a"]
    sizes = np.diff(first)
    e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first[:-1]), sizes))
    v["alpha"] = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
    v["z"] = np.add.reduceat(v["alpha"][:, None] * v["h"], first[:-1], axis=0)
    v["p"] = 1 / (1 + np.exp(-np.clip(v["z"] @ m["c"] + m["d"], -30, 30)))
    return v


def _gradients(m: dict, v: dict, first: np.ndarray, y: np.ndarray) -> dict:
    sizes = np.diff(first)
    err = (v["p"] - y) / len(y)
    dz = np.repeat(err[:, None] * m["c"], sizes, axis=0)
    dalpha = (dz * v["h"]).sum(axis=1)
    inner = np.repeat(np.add.reduceat(dalpha * v["alpha"], first[:-1]), sizes)
    dlogit = v["alpha"] * (dalpha - inner)
    dgate = dlogit[:, None] * m["a"]
    dt, ds = dgate * v["s"] * (1 - v["t"] ** 2), dgate * v["t"] * v["s"] * (1 - v["s"])
    dh = (dz * v["alpha"][:, None] + dt @ m["V"].T + ds @ m["G"].T) * (1 - v["h"] ** 2)
    return {"W": v["x"].T @ dh, "b": dh.sum(axis=0), "V": v["h"].T @ dt, "G": v["h"].T @ ds, "a": (v["t"] * v["s"]).T @ dlogit, "c": v["z"].T @ err, "d": err.sum()}


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(np.where(y > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))))


def fit_bags(bags: list[np.ndarray], y: np.ndarray) -> dict:
    """A model from bags of passages with a label each (Adam, whole batches, fixed seed); the best pass on the bags held back counts."""
    rng = np.random.default_rng(SEED)
    back = rng.permutation(len(y)) % HELD_BACK == 0
    back &= bool(0 < y[~back].sum() < (~back).sum() and back.any())
    stack = lambda use: (np.vstack([bags[i] for i in np.flatnonzero(use)]).astype(np.float32), np.append(0, np.cumsum([len(bags[i]) for i in np.flatnonzero(use)])), y[use].astype(np.float32))
    x, first, labels = stack(~back)
    held = stack(back) if back.any() else None
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    m = {"mean": x.mean(axis=0), "scale": 1 / (x.std(axis=0) + np.float32(1e-2)), "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "G": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.array(np.log(prior / (1 - prior)), np.float32)}
    moments = {k: [np.zeros_like(m[k]), np.zeros_like(m[k])] for k in ("W", "b", "V", "G", "a", "c", "d")}
    best, found, since = dict(m), np.inf, 0
    for t in range(1, EPOCHS + 1):
        g = _gradients(m, _forward(m, x, first), first, labels)
        for k, (one, two) in moments.items():
            grad = g[k] + DECAY * m[k]
            one[...] = 0.9 * one + 0.1 * grad
            two[...] = 0.999 * two + 0.001 * grad**2
            m[k] = (m[k] - RATE * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        if held is None:
            best = dict(m)
            continue
        loss = _loss(_forward(m, *held[:2])["p"], held[2])
        best, found, since = (dict(m), loss, 0) if loss < found - 1e-4 else (best, found, since + 1)
        if since >= PATIENCE:
            break
    return {k: np.asarray(v, np.float64) for k, v in best.items()}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x, first = encode(batch.column("text"))
        bags = [x[a:b].tobytes() for a, b in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> dict | None:
    """A model from at most ``rows`` labelled documents, those with the lowest hashes of their ids; None without both labels.

    Rows held out have to be left out of ``labels`` by the caller.  Null labels and ids
    are ignored, and so is an id with both labels.  Of texts that share an id one counts,
    the same at every run.  A null text is an empty one; other columns are ignored.
    """
    both = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"), F.max(label_col).cast("double").alias("top"))
    chosen = both.where("y = top").drop("top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    bags = texts.select("doc_id", "text", "y").mapInArrow(_bags, "doc_id long, y double, bag binary")
    found = bags.groupBy("doc_id").agg(F.min(F.struct("y", "bag")).alias("b")).select("doc_id", "b.*").collect()
    found.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in found])
    if not 0 < y.sum() < len(y):
        return None
    return fit_bags([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found], y)


def scores_of(model: dict | None, texts: pa.Array) -> np.ndarray:
    """Scores from 0 to 1; 0.5 throughout where there is no model."""
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    x, first = encode(texts)
    return _forward(model, x, first)["p"]


def score(docs: DataFrame, model: dict | None, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out`` (which replaces one of that name): the probability of label 1.

    Null texts count as empty, which is scored like any other; repeated rows get the same
    score; other columns stay as they are; an empty table gives no rows.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.select([f.name for f in kept]).columns, pa.array(scores_of(model, batch.column(text_col)), pa.float64())], [*(f.name for f in kept), out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))

"""Packing by cutting-stock column generation.

Documents are tokenised once, cut at multiples of the sequence length, and only the
remainders need packing.  Their lengths form a histogram of bounded size (classes of
``GRAIN`` tokens); a linear program over patterns of classes is solved by column
generation, where a knapsack dynamic program prices new patterns by the dual values.
Patterns are used as often as the solution rounded down says, what is left of the
histogram is packed by first fit decreasing, and the documents of each class, ranked
without gaps, are dealt to the places that the patterns have for their class.
The driver sees the histogram and the patterns, never documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import cut, gapless
from rillflow.llm.words import slices

SEQUENCE, END_ID = 2048, 1
#: Remainders are rounded up to classes of so many tokens: 256 classes, 3.5 tokens of padding a piece on average.
GRAIN = 8
#: Column generation stops when the solution is proven to be within this of the linear program's optimum.
GAP = 1e-3
#: Entries of a worker's cache of encoded words; a miss beyond it is encoded again.
CACHE = 300_000
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class _Encoder(dict):
    """Word after a space -> its ids as little-endian 32-bit bytes.

    In this vocabulary's pre-tokenisation nothing spans a place where a space follows
    another character that is not white space, so texts can be encoded word by word,
    except where two spaces meet.
    """

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        found = self.whole(" " + word)
        if len(self) < CACHE and len(word) < 40:
            self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def part(self, text: str) -> bytes:
        if "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))

    def text(self, text: str) -> bytes:
        parts = text.split(SPECIAL)
        return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self.part, parts))


def _pieces(path: str, size: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encoder.text(text.as_py() or "") + last
                n = len(ids) // 4
                rows += [(doc, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items (sizes ascending) that fits: its value and how many of each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if fits[w]:
            total = best[w - sizes[: fits[w]]] + value[: fits[w]]
            k = int(total.argmax())
            if total[k] > best[w] + 1e-12:
                best[w], choice[w] = total[k], k
    counts, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[capacity]), counts


def cutting_stock(sizes: list[int], demand: list[int], capacity: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {size: how many}) that cover exactly ``demand[i]`` items of each of the distinct ``sizes``."""
    order = np.argsort(sizes)
    s, n = np.asarray(sizes, np.int64)[order], np.asarray(demand, np.int64)[order]
    m = len(s)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // s[i]) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // s)) if m else np.zeros((0, 0))
    x = inverse @ n
    while m:
        worth, pattern = knapsack(np.maximum(inverse.sum(axis=0), 0), s, capacity)
        if worth <= 1 + gap:
            break
        d = inverse @ pattern
        ok = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / d[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        x = x - step * d
        x[out] = step
        columns[out] = pattern
    used = [(int(t), c) for t, c in zip(np.floor(x + 1e-9), columns) if t >= 1]
    left = n.copy()
    plan = []
    for times, c in used:
        times = min([times, *(left[c > 0] // c[c > 0])])
        if times > 0:
            left -= times * c
            plan.append((int(times), {int(s[i]): int(c[i]) for i in np.flatnonzero(c)}))
    while left.any():  # first fit decreasing over the histogram: the same filling as long as it lasts
        room, fill = capacity, {}
        for i in range(m - 1, -1, -1):
            k = int(min(left[i], room // s[i]))
            if k:
                fill[i] = k
                room -= k * int(s[i])
        times = min(int(left[i]) // k for i, k in fill.items())
        for i, k in fill.items():
            left[i] -= times * k
        plan.append((times, {int(s[i]): k for i, k in fill.items()}))
    return plan


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is the path of a byte-level BPE's rank file.  A document is its
    text's ids, then ``end``; null and empty texts are that one id.  A document longer
    than ``size`` is cut every ``size`` ids; each id is in one piece.  Repeated rows
    are packed each on its own; an empty table gives no rows.  ``size`` is a multiple
    of ``grain``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(vocabulary, size, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    classed = pieces.withColumn("rf_class", F.when(F.col("length") < size, F.ceil(F.col("length") / grain).cast("int")).otherwise(0))
    histogram = {r["rf_class"]: r["n"] for r in classed.groupBy("rf_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, whole = sum(histogram.values()), histogram.pop(0, 0)
    classes = sorted(histogram)
    # of each class the ranks from which a pattern takes over, its first sequence and its places in one
    places, base, ranked = {0: [(0, 0, 1)]}, whole, dict.fromkeys(classes, 0)
    for times, fill in cutting_stock(classes, [histogram[c] for c in classes], size // grain):
        for c, k in fill.items():
            places.setdefault(c, []).append((ranked[c], base, k))
            ranked[c] += times * k
        base += times
    spark = docs.sparkSession
    # one row a class, at most ``size / grain`` of them; patterns have as many entries as classes at most
    table = F.broadcast(spark.createDataFrame([(c, *map(list, zip(*p))) for c, p in places.items()], "rf_class int, rf_from array<long>, rf_base array<long>, rf_each array<long>"))
    rank = gapless(classed, ["rf_class"], ["doc_id", "start"], "rf_rank", total).withColumn("rf_rank", F.col("rf_rank").cast("long"))
    at = F.size(F.filter("rf_from", lambda f: f <= F.col("rf_rank"))) - 1
    placed = rank.join(table, "rf_class").withColumn("rf_at", at)
    placed = placed.withColumn("sequence_id", F.expr("get(rf_base, rf_at) + (rf_rank - get(rf_from, rf_at)) div get(rf_each, rf_at)"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rf_class", "rf_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)

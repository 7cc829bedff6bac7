"""Substring dedup by recompression.

Rounds name runs of equal symbols and pairs of adjacent ones; a pair merges if its
first symbol falls in one half of the alphabet and its second in the other, which a
bit of the symbols' names decides.  A name is a hash of what it stands for, so names
are global without a shuffle, and equal substrings get equal interior symbols in every
document.  Where a 50-word window is cut out of its document, the symbols at its two
ends depend on what stands outside; the others, its interior, on the window alone.

1. One scan gives each document's symbols after the last round, and a digest of its
   words.  Documents of the same words repeat the first of them whole.
2. Spark counts in how many documents each symbol occurs (grouped minimum and maximum
   of ids: combined before the shuffle, whatever the symbol's frequency); those in two
   or more are shared, and lead back to their documents.
3. A window can repeat only if all of its interior symbols are shared (a window
   without an interior always can).  Those windows are verified on their words, by two
   independent 64-bit hashes of each of the 50: among 10^13 windows, some 100 TB of
   text, two different ones are taken for equal with a probability of some 1e-13.  A
   window that begins in a document with a smaller id, too, is removed.

Words without shared symbols (nine in ten on the test tables) never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, filter_bits, join_counted, membership_filter, passing, without
from rillflow.llm.words import U, Words, combine, mix, slices

WINDOW = 50
#: Rounds of pair merging, those before which runs are named, and the words that a merged pair may stand for at most.
ROUNDS, RUN_ROUNDS, LONGEST = 7, (0, 3), 24


def recompress(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the last round and their texts; for each word the first interior symbol of a window that
    begins with it, and the last interior symbol of a window that ends with it."""
    sym, at, span = h, doc, np.ones(len(h), np.int32)
    lefts, rights = [], []

    def level(starts: np.ndarray, past_left: np.ndarray, past_right: np.ndarray) -> None:
        """Where symbols go: to the new one that holds them, and past it if that depends on what is outside."""
        top = len(starts)
        index = np.zeros(len(sym), np.int32)
        index[starts] = 1
        np.cumsum(index, out=index)  # one more than the new symbol's number: 0 and top + 1 are outside
        lefts.append(np.concatenate([[0], index + past_left, [top + 1]]).astype(np.int32))
        rights.append(np.concatenate([[0], index - past_right, [top + 1]]).astype(np.int32))

    for r in range(ROUNDS):
        if r in RUN_ROUNDS and len(sym):
            starts = np.flatnonzero(np.append(True, (sym[1:] != sym[:-1]) | (at[1:] != at[:-1])))
            times = np.diff(np.append(starts, len(sym)))
            always = np.ones(len(sym), np.int32)
            level(starts, always, always)
            sym, at, span = np.where(times > 1, combine(sym[starts], times.astype(U)), sym[starts]), at[starts], np.add.reduceat(span, starts)
        first = (mix(sym + U(r + 1)) >> U(63)) == 0
        merged = np.zeros(len(sym), bool)
        merged[1:] = first[:-1] & ~first[1:] & (at[1:] == at[:-1]) & (span[1:] + span[:-1] <= LONGEST)
        starts = np.flatnonzero(~merged)
        level(starts, ~first, first)
        pair = np.append(merged[1:], False)[starts]
        new = sym[starts]
        new[pair] = combine(new[pair], sym[starts[pair] + 1])
        size = span[starts]
        size[pair] += span[starts[pair] + 1]
        sym, at, span = new, at[starts], size
    return sym, at, _through(lefts), _through(rights)


def _through(levels: list[np.ndarray]) -> np.ndarray:
    """For each word its symbol number after all levels, -1 or their count where it falls outside."""
    here = levels[-1]
    for below in levels[-2::-1]:
        here = here[below]
    return here[1:-1].astype(np.int64) - 1


def _parse(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, m = Words(batch.column("text")), batch.num_rows
            sym, at, left, right = recompress(w.hashes(), w.doc)
            begin = _windows(w, width)
            loose = np.zeros(m, bool)
            loose[w.doc[begin[left[begin] > right[begin + width - 1]]]] = True
            order = np.lexsort((sym, at))
            s, d = sym[order], at[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            new &= w.count[d] >= width
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(d[new], minlength=m))).astype(np.int32), s[new].view(np.int64))
            kept = pa.array([_digest(w, i, None) for i in range(m)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(loose), lists, kept], ["doc_id", "n_words", "loose", "symbols", "kept"])

    return run


def _windows(w: Words, width: int) -> np.ndarray:
    """First words of all windows."""
    i = np.arange(len(w.start))
    return i[i + width <= w.first[w.doc + 1]] if len(i) else i


def _digest(w: Words, i: int, gone: np.ndarray | None) -> bytes:
    """SHA-256 of the text's words, those marked ``gone`` left out, joined by one space."""
    a, b = w.first[i], w.first[i + 1]
    text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
    words = text.split()
    if gone is not None:
        words = [x for x, g in zip(words, gone[a:b]) if not g]
    return hashlib.sha256(b" ".join(words)).digest()


def _names(w: Words, width: int) -> list[np.ndarray]:
    """Names (two hashes of 64 bits) of the ``width`` words from each word on (meaningful where a window begins), by doubling."""
    out = []
    for lane in (0, 1):
        power, level, name, done = 1, w.hashes(lane), None, 0
        shift = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), U)])
        while power <= width:
            if width & power:
                part = shift(level, done)
                name, done = (part if name is None else combine(name, part)), done + power
            level, power = combine(level, shift(level, power)), power * 2
        out.append(name)
    return out


def _candidates(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"))
            sym, at, left, right = recompress(w.hashes(), w.doc)
            lists = batch.column("shared")
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64).view(U)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            lone = ~np.isin(combine(sym, at.astype(U)), combine(flat, owner.astype(U)))
            sums = np.append(0, np.cumsum(lone))
            begin = _windows(w, width)
            lo, hi = left[begin], right[begin + width - 1]
            begin = begin[(lo > hi) | (sums[np.clip(hi + 1, 0, len(sym))] == sums[np.clip(lo, 0, len(sym))])]
            if len(begin):
                one, two = (n[begin].view(np.int64) for n in _names(w, width))
                ids = np.asarray(batch.column("doc_id"), np.int64)[w.doc[begin]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((begin - w.first[w.doc[begin]]).astype(np.int32)), pa.array(one), pa.array(two)], ["doc_id", "at", "w1", "w2"])

    return run


def _removal(width: int, cut_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"))
            gone = np.zeros(len(w.start) + 1, np.int64)
            for i, at in enumerate(batch.column("at").to_pylist()):
                a = w.first[i] + np.asarray(at, np.int64)
                np.add.at(gone, a, 1)
                np.add.at(gone, a + width, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.bincount(w.doc[gone], minlength=batch.num_rows)
            out = [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array([_digest(w, i, gone) for i in range(batch.num_rows)], pa.binary())]
            names = ["doc_id", "n_removed", "cut"]
            if cut_texts:
                texts = []
                for i in range(batch.num_rows):
                    words = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
                    texts.append(b" ".join(x for x, g in zip(words, gone[w.first[i] : w.first[i + 1]]) if not g).decode())
                out, names = [*out, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``, null where nothing is removed).

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  Every word is removed that
    a window of ``width`` words covers which also begins in a document with a smaller
    id; windows are judged on the input.  Kept words are joined by one space.  Null and
    empty texts have no words.  Rows repeated whole (same id and text) stay as many
    rows with the same result; an id must not name two different texts.  A null id is
    neither smaller nor larger than another: its row loses nothing and takes nothing.
    Other columns are ignored; an empty table gives no rows.
    """
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parsed = cut(every.mapInArrow(_parse(width), "doc_id long, n_words long, loose boolean, symbols array<long>, kept binary"))
    texts, long = every.where("doc_id is not null"), parsed.where((F.col("n_words") >= width) & F.col("doc_id").isNotNull())
    n_rows, n_symbols = (int(x or 0) for x in long.agg(F.count(F.lit(1)), F.sum(F.size("symbols"))).first())

    # documents of the same words: the digest of all of them decides
    wholes = cut(long.groupBy("kept").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"))
    copies = cut(join_counted(long.select("doc_id", "kept"), wholes, ["kept"], "n", n_rows).where("doc_id > first").select("doc_id").distinct())

    alone = without(long, "doc_id", copies)
    symbols = alone.select("doc_id", F.explode("symbols").alias("symbol"))
    shared = symbols.groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("symbol", "n")
    shared = cut(shared)
    bits = filter_bits(shared.count())
    likely = passing(symbols, "symbol", membership_filter(shared, "symbol", bits), bits)
    held = join_counted(likely, shared, ["symbol"], "n", n_symbols).select("doc_id", "symbol").unionByName(alone.where("loose").select("doc_id", F.lit(None).cast("long").alias("symbol")))
    held = cut(held.groupBy("doc_id").agg(F.collect_set("symbol").alias("shared")))

    windows = cut(_with(texts, held).mapInArrow(_candidates(width), "doc_id long, at int, w1 long, w2 long"))
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").drop("hi")
    found = join_counted(windows, cut(least), ["w1", "w2"], "n", windows.count()).where("doc_id > lo")
    repeats = cut(found.groupBy("doc_id").agg(F.collect_set("at").alias("at")))
    more = ", kept_text string" if with_text else ""
    cutout = cut(_with(texts, repeats).mapInArrow(_removal(width, with_text), f"doc_id long, n_removed long, cut binary{more}").dropDuplicates(["doc_id"]))

    known = parsed.select("doc_id", "n_words", "kept").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").join(cutout, "doc_id", "left")
    hexed = lambda c: F.lower(F.hex(c))
    cols = [
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(hexed(F.coalesce("cut", "kept"))).alias("kept_sha256"),
    ]
    return known.select(*cols, *([F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


def _with(texts: DataFrame, more: DataFrame) -> DataFrame:
    """The texts that ``more`` (cut, one row an id) has something for, beside it; texts that a bitmap refutes are not shuffled."""
    bits = filter_bits(more.count())
    return passing(texts, "doc_id", membership_filter(more, "doc_id", bits), bits).join(more, "doc_id")

"""Line dedup by pairwise alignment.

Documents overlap if they share a line's hash, or that of a run of shorter lines
which has as many words together.  Every shared line or run leads to its earliest
holder only, rare or common alike, so a line in a million documents makes a million
links, not their square.  Each linked pair is aligned with patience diff over line
hashes, and the aligned blocks are deleted from the later document.  What is deleted
stands, unchanged, in an earlier document: a line's earliest holder never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, filter_bits, fresh, join_counted, membership_filter, passing

#: Lines and runs of lines of fewer words are no evidence of an overlap; nor is a block of fewer words deleted.
LINE_WORDS, BLOCK_WORDS = 5, 5


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions matched by patience diff, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            found.append((p, q))
        if i >= p or j >= q:
            continue
        once = {x for x, n in Counter(a[i:p]).items() if n == 1} & {x for x, n in Counter(b[j:q]).items() if n == 1}
        if not once:
            continue
        where = {x: k for k, x in enumerate(b[j:q], j) if x in once}
        common = [(k, where[x]) for k, x in enumerate(a[i:p], i) if x in once]
        tails, at, back = [], [], [-1] * len(common)
        for k, (_, y) in enumerate(common):
            t = bisect_left(tails, y)
            tails[t:t + 1], at[t:t + 1] = [y], [k]
            back[k] = at[t - 1] if t else -1
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        for x, y in chain[::-1]:
            todo.append((i, x, j, y))
            found.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, p, j, q))
    return sorted(found)


def aligned_blocks(a: list, b: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions in ``b`` of aligned blocks (adjacent in both) that have ``least`` words or more."""
    out, block, last = [], [], None
    for x, y in [*patience(a, b), (-9, -9)]:
        if block and (x, y) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(y)
        last = (x, y)
    return out


#: Pairs whose line lists a worker turns into Python objects at once.
PAIRS = 16


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PAIRS):
            part = batch.slice(k, PAIRS)
            c = part.to_pydict()
            out = [aligned_blocks(a, b, w) for a, b, w in zip(c["ha"], c["hb"], c["wb"])]
            yield pa.RecordBatch.from_arrays([part.column("rk"), pa.array(out, pa.list_(pa.int32()))], ["rk", "gone"])


def _evidence(lines):
    """Hashes of what makes links: each line, with as many after it, or before it, as have ``LINE_WORDS`` words together.

    Any block of so many words holds one of these runs whole, and each of its lines
    with words is in one.  Lines without words don't count.
    """

    def runs(ls):
        def run(i, step):
            n, h, out = F.lit(0), [], None
            for k in range(LINE_WORDS):
                x = F.get(ls, i + step * k)
                n, h = n + x["w"], [*h, x["h"]]
                key = F.xxhash64(*h[::step]) if k else x["h"]
                out = F.when(n >= LINE_WORDS, key) if out is None else out.when(n >= LINE_WORDS, key)
            return out

        return F.array_distinct(F.array_compact(F.flatten(F.transform(ls, lambda x, i: F.when(x["w"] >= LINE_WORDS, F.array(x["h"])).otherwise(F.array(run(i, 1), run(i, -1)))))))

    return F.get(F.transform(F.array(F.filter(lines, lambda x: x["w"] > 0)), runs), F.lit(0))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rk, gone``: for each text that loses lines, its row key and their positions (distinct, from 0)."""
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]++")).alias("w"))
    keyed = docs.where(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc_id"), F.transform(F.split(F.col(text_col), "\n", -1), line).alias("lines"))
    lines = cut(keyed.dropDuplicates(["rk"]).where("lines is not null"))
    held = lines.select("rk", "doc_id", F.explode(_evidence(F.col("lines"))).alias("h"))
    first = cut(held.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("doc_id", "rk")).alias("first")).where("df > 1"))
    total = int(first.agg(F.sum("df")).first()[0] or 0)
    bits = filter_bits(first.count())
    likely = passing(held, "h", membership_filter(first, "h", bits), bits)
    shared = join_counted(likely, first, ["h"], "df", total).where("first.doc_id < doc_id")
    pairs = cut(shared.select("rk", F.col("first.rk").alias("earlier")).distinct())
    later = pairs.join(lines.select("rk", F.col("lines.h").alias("hb"), F.col("lines.w").alias("wb")), "rk")
    both = later.join(lines.select(F.col("rk").alias("earlier"), F.col("lines.h").alias("ha")), "earlier").select("rk", "ha", "hb", "wb")
    found = both.mapInArrow(_align, "rk long, gone array<int>").where(F.size("gone") > 0)
    return found.select("rk", F.explode("gone").alias("g")).groupBy("rk").agg(F.collect_set("g").alias("gone"))


def row_key(id_col: str, text_col: str):
    """A key of id and text: rows that share an id but not a text are different documents."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with the lines removed that an earlier document (smaller id) shares in an aligned block.

    Lines end at "\\n" and are compared whole.  A document that loses all of its
    lines stays with an empty text; null texts and null ids are left alone; rows
    repeated whole are one document and are changed alike, rows that share only an id
    don't overlap.  ``removed_col`` names a further column with the number of removed
    lines, which replaces one of that name; ``n_chars``, if there is one, follows the
    text; other columns stay as they are, whatever their names.  An empty table gives no
    rows.
    """
    rk, lost, n = fresh("rk"), fresh("gone"), fresh("n")
    gone = cut(removed_lines(docs, id_col, text_col).toDF(rk, lost))
    keyed = docs.withColumn(rk, row_key(id_col, text_col))
    bits = filter_bits(gone.count())
    bitmap = membership_filter(gone, rk, bits)
    clear = passing(keyed, rk, bitmap, bits, negate=True).withColumn(n, F.lit(0))
    maybe = passing(keyed, rk, bitmap, bits).join(gone, rk, "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    hit = F.col(lost).isNotNull()
    changed = maybe.withColumn(text_col, F.when(hit, kept).otherwise(F.col(text_col))).withColumn(n, F.coalesce(F.when(hit, F.size(lost)), F.lit(0)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.char_length(text_col).cast("long")).otherwise(F.col("n_chars")))
    out = clear.select(*docs.columns, n).unionByName(changed.select(*docs.columns, n))
    if removed_col is None:
        return out.drop(n)
    return out.select(*[c for c in docs.columns if c != removed_col], F.col(n).alias(removed_col))

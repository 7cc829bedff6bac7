"""MinHash near-dedup with bottom-k sketches from one hash function.

1. One hash per shingle gives every document, in one scan, its set's size, a digest of
   the whole set, its bottom-k sketch and its retained values.
2. Documents with one set (digests of the sorted full sets are equal) form a class with
   a representative; the rest works on representatives, so copies cost nothing further.
3. Inverted lists of retained values generate overlaps.  Sets of up to ``SMALL`` shingles
   are retained whole, and similar ones must share one of their n - ceil(t n) + 1
   rarest values: rarity is a count over a fixed number of buckets, so any order of
   shingles that all share is exact, and no such pair is missed.  A list holds one value
   in one band of set sizes and the next.  Of larger sets the lowest ``DEPTH`` hashes of
   each of ``RUNS`` residue classes are retained, and a list is kept by a class's run of
   them (a list of a single common shingle would be as long as the corpus): sets with a
   similarity s share a run with probability s^DEPTH, all but 0.59^28 (4e-7) of the
   pairs at 0.8 share one or more.
4. First each list links its members to one of them, the first in one of a few orders;
   what is linked is merged into components.  Then only pairs of one list
   in different components are looked at, inside blocks of lists and in numpy: a pair
   becomes a row only if it passes the estimate.
5. The union-sketch estimate drops pairs below the threshold with a wide margin (it is
   exact for sets that a sketch holds whole), and exact Jaccard on full shingle sets
   decides about the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import components, cut, join_counted, narrowed, total, without
from rillflow.llm.words import U, Words, combine, mix, shingles, slices

#: Sets of at most so many shingles are retained whole; those too large for a partner of that size are in lists by runs.
SMALL, RUNS, DEPTH = 160, 28, 4
#: Buckets by which the rarity of a shingle is counted, whatever the number of shingles.
BUCKETS = 1 << 16
#: Values in a sketch.  Of the lowest 192 of a union, 154 are expected to be common at 0.8, and
#: fewer than 0.656 of them (126) come with a probability of 4e-7.
SKETCH, MARGIN = 192, 0.82
#: Links to a list's chosen member are many and narrow: 64 values each, 51 expected, fewer than 36 with a probability of 5e-6;
#: what they miss the last round still looks at.
HUB_SKETCH, HUB_MARGIN = 64, 0.7
#: Members of a list that are looked at together; a longer list is dealt to pairs of blocks, so that it is whole, too.
BLOCK = 1024
#: Pairs whose sketches are compared at once, in arrays of 3 MB each.
STEP = 2048
#: Orders by which lists choose members: near copies share most of their lists, and so they link to about so many of them.
HUB_ROUNDS, HUBS = 2, 4
_PAD = np.uint32(0xFFFFFFFF)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by text, residue class and value; their texts; their classes."""
    w = Words(batch.column("text"), lower=True)
    h, doc = shingles(w, width, w.hashes())
    run = (mix(h ^ U(0x5851F42D4C957F2D)) % U(RUNS)).astype(np.int64)
    group = doc * RUNS + run
    order = np.lexsort((h, group))
    h, group = h[order], group[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    h, group = h[new], group[new]
    return h, group // RUNS, group


def _digests(batch: pa.RecordBatch, width: int) -> list[bytes]:
    """A digest of each text's full set, each shingle by two independent hashes of its words; of nothing for an empty set."""
    w = Words(batch.column("text"), lower=True)
    one, doc = shingles(w, width, w.hashes())
    two, _ = shingles(w, width, w.hashes(1))
    order = np.lexsort((two, one, doc))
    one, two, doc = one[order], two[order], doc[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1])
    both = np.column_stack([one[new], two[new]])
    ends = np.append(0, np.cumsum(np.bincount(doc[new], minlength=batch.num_rows)))
    return [blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]


def _sketch(width: int, percent: int):
    small = lambda n: n <= SMALL
    large = lambda n: n > SMALL * percent // 100
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("whole", pa.binary()), ("low", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, doc, group = _sets(batch, width)
            m = batch.num_rows
            n = np.bincount(doc, minlength=m)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(h) else np.zeros(0, np.int64)
            rank = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
            kept = rank < DEPTH
            weighed = mix(h[kept] + rank[kept].astype(U))
            kept_starts = np.flatnonzero(rank[kept] == 0)
            key, of = np.zeros(0, U), np.zeros(0, np.int64)
            if len(starts):
                key, of = combine(np.add.reduceat(weighed, kept_starts), group[starts].astype(U) % U(RUNS)), doc[starts]
                key, of = key[large(n[of])], of[large(n[of])]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            bounds, whole = np.append(0, np.cumsum(n)), small(n[doc])
            low = (h >> U(32)).astype(np.uint32)
            sketches = [low[a : min(b, a + SKETCH)].tobytes() for a, b in zip(bounds, bounds[1:])]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(_digests(batch, width), pa.binary()), _lists(h[whole], doc[whole], m), _lists(key, of, m), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _lists(values: np.ndarray, owner: np.ndarray, m: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(owner, minlength=m))).astype(np.int32), values.view(np.int64))


def _bucket(v: np.ndarray) -> np.ndarray:
    return (v >> U(20)).astype(np.int64) % BUCKETS


def _rarest(counts: np.ndarray, percent: int):
    """Rows ``x, run, own``: the lists of each small set, by its rarest values, in its own band of sizes and the next."""
    base = np.log(100 / percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low = np.asarray(batch.column("n"), np.int64), batch.column("low")
            v = np.asarray(low.flatten(), np.int64).view(U)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(low.value_lengths(), np.int64))
            order = np.lexsort((v, counts[_bucket(v)], owner))
            v = v[order]
            rank = np.arange(len(v)) - (np.cumsum(n) - n)[owner]
            first = rank < (n - -(-percent * n // 100) + 1)[owner]
            v, owner = v[first], owner[first]
            band = np.floor(np.log(n[owner]) / base).astype(np.int64)
            keys = np.concatenate([combine(v, (band + k).astype(U)) for k in (0, 1)])
            x = np.asarray(batch.column("x"), np.int64)[np.concatenate([owner, owner])]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(keys.view(np.int64)), pa.array(np.arange(len(x)) < len(owner))], ["x", "run", "own"])

    return run


def _buckets_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(_bucket(np.asarray(batch.column("low").flatten(), np.int64).view(U)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["bucket", "n"])


def _list_keys(known: DataFrame, percent: int) -> DataFrame:
    """Distinct ``x, run`` of the lists with two representatives or more, one of them in the list's own band.

    A list without such a one has only pairs that meet in the band below, too.  Most lists
    have one member, so what is left is a small part; a bitmap drops most of the others
    before they are shuffled a second time.
    """
    whole = known.where(F.col("n") <= SMALL).select(F.col("doc_id").alias("x"), "n", "low")
    # at most BUCKETS rows, whatever the input
    rows = whole.select("low").mapInArrow(_buckets_only, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    counts[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    few = whole.mapInArrow(_rarest(counts, percent), "x long, run long, own boolean")
    many = known.select(F.col("doc_id").alias("x"), F.explode("runs").alias("run"), F.lit(True).alias("own"))
    every = cut(few.unionByName(many))
    live = cut(every.groupBy("run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("own").alias("owned")).where("lo < hi and owned").select("run"))
    return narrowed(every, "run", live).join(live, "run").select("x", "run").distinct()


def _matrix(sketches: pa.Array, size: int = SKETCH) -> np.ndarray:
    """Sketches as rows, padded."""
    m = np.full((len(sketches), size), _PAD)
    if len(sketches):
        sketches = sketches.cast(pa.large_binary())
        ends = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1] // 4
        values = np.frombuffer(sketches.buffers()[2] or b"", np.uint32)[ends[0] : ends[-1]]
        row = np.repeat(np.arange(len(sketches)), np.diff(ends))
        m[row, np.arange(len(values)) - (ends[:-1] - ends[0])[row]] = values
    return m


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, margin: float = MARGIN) -> np.ndarray:
    """Which pairs of sketches (rows of a and b, of sets of na and nb shingles) can be similar enough."""
    out, size = np.zeros(len(a), bool), a.shape[1]
    for at in range(0, len(a), STEP):
        k = slice(at, at + STEP)
        x, n1, n2 = np.sort(np.concatenate([a[k], b[k]], axis=1), axis=1), na[k], nb[k]
        whole = (n1 <= size) & (n2 <= size)
        again = (x[:, 1:] == x[:, :-1]) & (x[:, 1:] != _PAD)
        rank = np.cumsum(np.concatenate([x[:, :1] != _PAD, ~again & (x[:, 1:] != _PAD)], axis=1), axis=1, dtype=np.int32)
        limit = np.where(whole, 2 * size, size)
        common = (again & (rank[:, 1:] <= limit[:, None])).sum(axis=1)
        union = np.minimum(rank[:, -1], limit)
        out[k] = 100 * common >= np.where(whole, percent, percent * margin) * union
    return out


def _estimate(percent: int):
    """Pairs of sets near enough in size whose union sketch has enough common values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(k).to_numpy() for k in ("nx", "ny"))
            batch = batch.filter(pa.array(np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent))
            c = {k: batch.column(k) for k in ("sx", "sy", "nx", "ny")}
            ok = likely(_matrix(c["sx"], HUB_SKETCH), _matrix(c["sy"], HUB_SKETCH), c["nx"].to_numpy(), c["ny"].to_numpy(), percent, HUB_MARGIN)
            yield batch.select(["x", "y"]).filter(pa.array(ok))

    return run


def _first_common(rows: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that tells of which pairs of rows the list at hand is the first of those that they share: a pair counts once."""
    run, lists = np.asarray(rows.column("run")), rows.column("keys")
    size = np.asarray(lists.value_lengths(), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    keys = np.full((len(size), int(size.max(initial=0))), np.iinfo(np.int64).max)
    keys[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = np.asarray(lists.flatten(), np.int64)

    def test(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), bool)
        for at in range(0, len(p), STEP // 4):
            k = slice(at, at + STEP // 4)
            a, b = keys[p[k]], keys[q[k]]
            shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
            out[k] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1) == run[p[k]]
        return out

    return test


def _list_pairs(rows: pa.RecordBatch, group: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Likely pairs of the same group (a block, or a pair of blocks, of a list) whose members are in different components.

    A group's rows are sorted by size, so each row meets those after it until they are too large.
    """
    x, label, n, own, bi, bj = (np.asarray(rows.column(k)) for k in ("x", "label", "n", "own", "bi", "bj"))
    sketches, first, k, d = _matrix(rows.column("sketch")), _first_common(rows), np.arange(len(x)), 1
    while len(k):
        k = k[k + d < len(x)]
        k = k[(group[k] == group[k + d]) & (100 * n[k] >= percent * n[k + d])]
        open_ = (label[k] != label[k + d]) & (x[k] != x[k + d]) & ((bi[k] == bj[k]) | (own[k] != own[k + d]))
        p = k[open_]
        p = p[first(p, p + d)]
        p = p[likely(sketches[p], sketches[p + d], n[p], n[p + d], percent)]
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[p], x[p + d])), pa.array(np.maximum(x[p], x[p + d]))], ["x", "y"])
        d += 1


def _blocks(percent: int):
    """Rows sorted by list, block and size: whole groups are looked at, the last of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def groups(batch: pa.RecordBatch) -> np.ndarray:
            key = np.column_stack([batch.column(k).to_numpy() for k in ("run", "bi", "bj")])
            return np.cumsum(np.append(False, (key[1:] != key[:-1]).any(axis=1)))

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            group = groups(batch)
            last = int(np.searchsorted(group, group[-1]))
            yield from _list_pairs(batch.slice(0, last), group[:last], percent)
            held = batch.slice(last)
        if held is not None:
            yield from _list_pairs(held, groups(held), percent)

    return run


def _verify(width: int, percent: int):
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tx"):
            sets = []
            for side in ("tx", "ty"):
                h, doc, _ = _sets(pa.RecordBatch.from_arrays([batch.column(side)], ["text"]), width)
                sets.append(np.split(h, np.flatnonzero(np.diff(doc)) + 1) if len(np.unique(doc)) == batch.num_rows else [h[doc == i] for i in range(batch.num_rows)])
            both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(*sets)]
            ok = [b > 0 and 100 * b >= percent * (len(p) + len(q) - b) for b, p, q in zip(both, *sets)]
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a
    document's set is its distinct ``width``-word shingles, or its whole sequence if
    that is shorter.  Null, empty and blank texts have an empty set and are linked
    with nothing: they are components of their own.  Documents are linked when 100 *
    intersection >= ``percent`` * union.  Ids name documents: rows that share an id
    share a component.  Null ids get a null component.  Other columns are ignored;
    an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(texts.mapInArrow(_sketch(width, percent), "doc_id long, n long, whole binary, low array<long>, runs array<long>, sketch binary"))
    filled = sketched.where("n > 0 and doc_id is not null")
    classes = cut(filled.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("rep < last"))
    member = cut(join_counted(filled.select("doc_id", "whole"), classes, ["whole"], "size", total(sketched)).where("doc_id <> rep").select("doc_id", "whole", "rep").distinct())
    # an id with several texts may stand for one of them and not for another
    row = F.struct("doc_id", "whole").alias("row")
    known = without(filled.select("*", row), "row", cut(member.select(row))).drop("row")
    lists = cut(_list_keys(known, percent))
    sketches = known.select("doc_id", "n", F.substring("sketch", 1, 4 * HUB_SKETCH).alias("sketch"))

    def exact(guessed: DataFrame) -> DataFrame:
        full = narrowed(texts, "doc_id", _ends(guessed))
        found = guessed.join(full.toDF("x", "tx"), "x").join(full.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")
        return cut(found.mapInArrow(_verify(width, percent), "x long, y long").toDF("a", "b"))

    edges, label = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), None
    for turn in range(HUB_ROUNDS):
        at = _labelled(lists, label)
        hubs = at.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct(F.col("x").alias("y"), F.col("label").alias("other")), F.xxhash64(F.pmod("run", F.lit(HUBS)), "x", F.lit(turn))).alias("hub")).where("lo <> hi")
        pairs = at.join(hubs.select("run", "hub.*"), "run").where("label <> other")
        pairs = cut(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        near = narrowed(sketches, "doc_id", _ends(pairs))
        both = pairs.join(near.toDF("x", "nx", "sx"), "x").join(near.toDF("y", "ny", "sy"), "y").select("x", "y", "nx", "ny", "sx", "sy")
        edges = edges.unionByName(exact(cut(both.mapInArrow(_estimate(percent), "x long, y long"))))
        label = components(edges)

    at = _labelled(lists, label)
    open_ = at.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = at.join(open_.select("run", blocks.alias("blocks")), "run").withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("bi"), F.greatest(b, F.col("own")).alias("bj")))
    dealt = cut(members.select("run", "x", "label", "own", F.inline(meets)))
    keys = cut(dealt.groupBy("x").agg(F.collect_set("run").alias("keys")))
    payload = narrowed(known.select(F.col("doc_id").alias("x"), "n", "sketch"), "x", keys).join(keys, "x").dropDuplicates(["x"])
    wide = dealt.join(payload, "x")
    sorted_ = wide.repartition("run", "bi", "bj").sortWithinPartitions("run", "bi", "bj", "n")
    guessed = cut(sorted_.mapInArrow(_blocks(percent), "x long, y long").distinct())
    label = components(edges.unionByName(exact(guessed)))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(label.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids in pairs, written once: the filter and the join that use them both read them."""
    return cut(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())


def _labelled(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """Lists with the component of each member, itself where it has no link."""
    if label is None:
        return lists.withColumn("label", F.col("x"))
    return lists.join(label.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id.  Rows with a null id stay."""
    found = near_components(docs, id_col, text_col, width, percent)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col))
    return without(docs, id_col, cut(gone))

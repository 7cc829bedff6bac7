"""The other operators against brute force, with odd rows and the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rillflow.llm import decontamination, quality, queries, warc
from rillflow.llm.line_dedup import aligned_blocks, line_dedup, patience, removed_lines, row_key
from rillflow.llm.near_dedup import near_components, near_dedup
from rillflow.llm.packing import cutting_stock, pack
from rillflow.llm.substring_dedup import substring_dedup
from rillflow.llm.words import Words

from .odd import TEXTS, none, odd_docs


def word_list(t):
    return (t or "").encode().split()


def test_substring_dedup(spark):
    more = [(50, TEXTS[9] + " and " + TEXTS[15]), (51, "start " + " ".join(TEXTS[9].split()[100:180])), (52, "word " * 300)]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    words = {r.doc_id: word_list(r.text) for r in docs.collect()}
    first, want = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = substring_dedup(docs).collect()
    assert len(got) == docs.count() and all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert substring_dedup(none(spark)).count() == 0


def thue_morse(n):
    """Two words of ``n`` letters on which polynomial hashes modulo a power of two agree."""
    a = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


def test_word_hashes():
    pairs = [thue_morse(64 << k) for k in range(7)] + [("a", "a\0"), ("abcdefgh", "abcdefgi"), ("abcdefghi", "abcdefgh\0"), ("x" * 64, "x" * 65)]
    w = Words(pa.array([" ".join(p) for p in pairs] + ["é É same same", "", None]), lower=False)
    for lane in (0, 1):
        h = w.hashes(lane)
        assert len(set(h.tolist())) == 2 * len(pairs) + 3 and h[-1] == h[-2]
    assert not set(w.hashes(0)[:20].tolist()) & set(w.hashes(1)[:20].tolist())


def test_hard_words(spark):
    a, b = thue_morse(2048)
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b), (5, f"{b} {rest}"), (None, f"{b} {rest}")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == [(0, 50, 0), (1, 50, 0), (2, 50, 0), (3, 1, 0), (4, 1, 0), (5, 50, 50)]
    got = {r.doc_id: r.component_id for r in near_components(docs, width=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, None: None}  # 48 of 50 shingles are common


@pytest.mark.parametrize("width", [2, 5])
def test_near_components_by_size(spark, width):
    rng = np.random.default_rng(3)
    rows = []
    for n in [*range(2, 40), 52, 63, 64, 65, 80, 100, 127, 128, 129, 140, 158, 160, 161, 170, 199, 230, 300, 400]:
        words = ["the", "same", "start", "of", "all"][: n // 8] + [f"w{k}" for k in rng.integers(0, 4000, n)]
        rows += [" ".join(words), " ".join([*words, "end"]), " ".join(words[: max(1, int(len(words) * 0.81))])]
        most = int(len(words) / (9 * width))  # replaced words: a similarity of 0.8 or a little more, and a little less
        for times in {most, most + 1} - {0}:
            other = list(words)
            for k in rng.choice(len(words), times, replace=False):
                other[k] = f"x{k}"
            rows.append(" ".join(other))
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)} for w in (t.split() for t in rows)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = near_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in range(len(rows))}


@pytest.mark.parametrize("width", [2, 5])
def test_near_components(spark, width):
    near = [(60 + i, " ".join(f"q{k}" if k % 40 != i else "x" for k in range(200))) for i in range(6)]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {}
    for r in docs.collect():
        w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_components(docs, width=width).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]) for r in got)
    kept = near_dedup(odd_docs(spark), width=width)
    assert kept.columns == odd_docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(TEXTS)) if root[i] == i}
    assert near_components(none(spark)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = odd_docs(spark).select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    rows = pack(docs, P.path("byte_bpe_50k.tiktoken")).collect()
    covered, seqs = defaultdict(int), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    twice = {5, 9}
    assert all(covered[i] == len(x) * (2 if i in twice else 1) for i, x in ids.items())
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert pack(none(spark), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_encoder():
    """Word by word as the tokenizer has it in one go, on texts rich in white space and special tokens."""
    from rillflow.llm.packing import _Encoder
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), _Encoder(P.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(9)
    bits = [" ", " ", "  ", "\n", "\n \n", "\t", "\u00a0", "\u3000", "the", "'s", " 've", "12", "a", "Été", "ß", "\U0001f600", "...", "-", "<|endoftext|>", "<|endoftext", "\r\n", "\x00", "x" * 50]
    for _ in range(3000):
        text = "".join(rng.choice(bits, rng.integers(0, 12)))
        assert np.frombuffer(own.text(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_cutting_stock():
    plan = cutting_stock([5, 4, 3], [100, 100, 100], 10)
    for size, n in ((5, 100), (4, 100), (3, 100)):
        assert sum(t * f.get(size, 0) for t, f in plan) == n
    assert all(sum(s * k for s, k in f.items()) <= 10 for _, f in plan)
    assert sum(t for t, _ in plan) == 125  # the optimum: two fives, a four and two threes, two fours


def test_quality(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.col("doc_id") % 5 == 0
    model = quality.fit(docs, labels.where(~held))
    got = quality.score(docs, model).join(labels.where(held), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    odd = quality.score(odd_docs(spark), model).collect()
    assert len(odd) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert all(set(r.asDict()) == set(odd_docs(spark).columns) for r in odd)
    assert quality.score(none(spark), model).count() == 0 and quality.fit(docs, labels.where("quality = 1")) is None
    both = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    few = docs.where("doc_id < 4")
    one, two = (quality.fit(few.union(again), both) for again in (few.limit(0), few))
    assert all(np.array_equal(one[k], two[k]) for k in one)  # repeated rows count once, an id with both labels not at all


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, sf).collect()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").collect(), {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = {r.doc_id: r.text or "" for r in docs}
    ids = sorted(i for i in texts if i in labels and not held(i) and labels[i] in (0, 1))
    bags = [quality.encode(pa.array([texts[i]], pa.large_string()))[0] for i in ids]
    model = quality.fit_bags(bags, np.array([float(labels[i]) for i in ids]))
    assert len(ids) <= quality.FIT_ROWS and len(got) == len(docs)
    for r in got:
        want = quality.scores_of(model, pa.array([texts[r.doc_id]], pa.large_string()))[0]
        assert r.held_out == held(r.doc_id) and abs(r.score - want) < 1e-9 and 0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.3 else 0)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert np.mean(right) > 0.85


def test_patience():
    assert patience(list("abcdef"), list("xbcyef")) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert patience([], list("a")) == []


def test_line_dedup(spark):
    line = lambda k: f"this is line number {k} of the text"
    rows = [(1, "\n".join(map(line, range(4)))), (2, "\n".join([line(9), line(1), line(2), "own words stand here too"])), (3, line(1) + "\nshort\n" + line(2)), (4, None), (None, line(1))]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in line_dedup(docs, removed_col="gone").collect()}
    assert got[1].text == rows[0][1] and got[1].gone == 0
    assert got[2].text == line(9) + "\nown words stand here too" and got[2].n_chars == len(got[2].text) and got[2].gone == 2
    assert got[3].text == "short" and got[4].text is None and got[None].text == line(1)
    odd = line_dedup(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns and odd.count() == len(TEXTS) + 2 and line_dedup(none(spark)).count() == 0


def plain_line_dedup(docs):
    """``{id: text}`` of (id, text) rows with distinct ids, none null: each shared line, or run of short ones, followed to its earliest holder."""
    lines = {i: t.split("\n") for i, t in docs if t is not None}
    words = {i: [len(word_list(x)) for x in a] for i, a in lines.items()}
    runs, first = {}, {}
    for i in sorted(lines):
        full = [(x, w) for x, w in zip(lines[i], words[i]) if w]
        spans = [(a, b) for a in range(len(full)) for b in range(a + 1, min(a + 5, len(full)) + 1)]
        enough = lambda a, b: sum(w for _, w in full[a:b]) >= 5
        runs[i] = {tuple(x for x, _ in full[a:b]) for a, b in spans if enough(a, b) and not (enough(a, b - 1) and enough(a + 1, b))}
        for x in runs[i]:
            first.setdefault(x, i)
    out = dict(docs)
    for i, b in lines.items():
        earlier = {first[x] for x in runs[i] if first[x] < i}
        gone = {k for a in earlier for k in aligned_blocks(lines[a], b, words[i])}
        out[i] = "\n".join(x for k, x in enumerate(b) if k not in gone)
    return out


def test_line_dedup_common_lines(spark):
    line = lambda k: f"this is line number {k} of the text"
    own = lambda i, k: f"document {i} has its own line {k} here"
    rows = [(i, "\n".join([own(i, 0), line("a") if i < 30 else own(i, 1), own(i, 2), line("b") if i > 20 else own(i, 3)])) for i in range(1, 60)]
    rows += [(70, "\n".join([own(1, 2), own(70, 0), line("a"), own(70, 1), line("b"), own(70, 2)])), (71, "\n".join([line("a"), own(71, 0), line("b")]))]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[70] == "\n".join(own(70, k) for k in range(3)) and got[71] == own(71, 0) and got == plain_line_dedup(rows)


def test_line_dedup_short_lines(spark):
    verse = "\n".join(f"verse {k}" if k % 3 else "" for k in range(60))
    rows = [(1, verse), (2, "a copy of it\n" + verse), (3, "yes"), (4, "no thanks"), (5, "yes\nno thanks\nyes\nwell"), (6, "this one asks again\n \nyes\nno thanks\nyes\nwell\nis it so"), (7, "\n" * 9 + "nine"), (8, "\n" * 9 + "9")]
    rows += [(9, "a line with many words in it"), (10, "start\na line with many words in it\nthe end"), (11, "other\na line with many words in it\nthe end")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(rows) == dict(rows) | {2: "a copy of it", 6: "this one asks again\n \nis it so", 10: "start\nthe end", 11: "other"}


def test_line_dedup_recall(spark):
    """Against all pairs of documents aligned one by one: what is deleted, and what of that is found."""
    rng = np.random.default_rng(5)
    pool = [[f"block {k} has a line {i}" + " of more words" * int(rng.integers(0, 2)) if rng.random() < 0.7 else f"b{k} {i}" for i in range(rng.integers(1, 6))] for k in range(40)]
    rows = []
    for d in range(80):
        lines = []
        for k in rng.choice(40, rng.integers(1, 7), replace=False):
            lines += pool[k] + [f"own words of {d} stand between {len(lines)}"] * int(rng.integers(0, 2))
        rows.append((d, "\n".join(lines)))
    lines = {d: t.split("\n") for d, t in rows}
    words = {d: [len(x.split()) for x in a] for d, a in lines.items()}
    want = {(b, k) for b in lines for a in range(b) for k in aligned_blocks(lines[a], lines[b], words[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = removed_lines(docs).join(docs.select("doc_id", row_key("doc_id", "text").alias("rk")), "rk").collect()
    got = {(r.doc_id, k) for r in removed for k in r.gone}
    earlier = {}
    for d, a in lines.items():
        for x in a:
            earlier.setdefault(x, d)
    assert all(earlier[lines[b][k]] < b for b, k in got)
    assert len(want) > 300 and len(got & want) / len(want) > 0.97
    assert {r.doc_id: r.text for r in line_dedup(docs).collect()} == plain_line_dedup(rows)


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "short"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " * 500 + item.upper() + " no " * 500), (2, "SHORT"), (3, "a short one"), (4, item.replace("twelve", "x")), (5, " ".join(item.split()[:8])), (6, None)], "doc_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == [(1, 1, 8, 8), (2, 2, 1, 1), (4, 1, 7, 8)]
    decontamination.BROADCAST_ROWS, held = 0, decontamination.BROADCAST_ROWS
    try:
        assert decontamination.contaminated(docs, items).count() == 3
    finally:
        decontamination.BROADCAST_ROWS = held
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).collect()) == [3, 5, 6]
    odd = decontamination.decontaminate(odd_docs(spark), items)
    assert odd.count() == len(TEXTS) + 2 and odd.columns == odd_docs(spark).columns
    assert decontamination.contaminated(none(spark), items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == 6


def test_decontamination_searches_sketches(spark):
    words = [f"w{k}" for k in range(40)]
    sketch = decontamination.item_sketches(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), "item_id", "text", 5, 80)
    marked = {r.h: r.in_sketch for r in sketch.collect()}
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 5])) for k in range(36)], "doc_id long, text string")
    sets = decontamination.shingle_hashes(docs, "doc_id", "text", 5, "doc_id")
    want = {r.doc_id for r in sets.collect() if marked[r.hs[0]]}
    assert 0 < len(want) < 36 and {r.doc_id for r in decontamination.candidates(sets, sketch).collect()} == want


def test_decontamination_texts_of_one_item(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    items = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + a), (2, b + " so"), (3, "neither"), (4, a + " " + b)], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(d, i, 16, 16) for d, i in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2))]


def test_revisits(spark):
    rows = [
        (1, "http://A.com:80/x/?b=1&a=2&utm_source=q#f", 100, 200, {"ETag": '"v"', "Content-Type": "t"}), (2, "https://a.com:443/x?a=2&b=1", 5000, 304, {"etag": 'W/"v"', "Cache-Control": "c", "Content-Type": "no"}),
        (3, "a.com/x?a=2&b=1", 50, 304, {}), (4, "http://a.com/x?a=2&b=1", 9000, 304, {"ETag": "other"}), (5, None, 1, 304, None), (6, "a.com/y", None, 200, None), (7, "a.com/x?a=2&b=1", 9999999, 304, None), (7, "a.com/x?a=2&b=1", 9999999, 304, None), (8, "a.com/q", 5, 404, None),
    ]
    d = spark.createDataFrame(rows, "record_id long, url string, s long, status int, headers map<string,string>").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.record_id: r for r in warc.resolve_revisits(d).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "full", 2: "resolved", 3: "orphan", 4: "stale", 5: "orphan", 6: "full", 7: "resolved", 8: "other"}
    assert got[2].refers_to == 1 and got[2].headers == {"content-type": "t", "etag": 'W/"v"', "cache-control": "c"}
    bodies = spark.createDataFrame([(1, "body")], "record_id long, html string")
    assert warc.with_bodies(warc.resolve_revisits(d), bodies, "html").where("body = 'body'").count() == 4
    assert warc.resolve_revisits(d.limit(0)).count() == 0
    repeated = warc.resolve_revisits(d.where("record_id < 3").union(d.where("record_id = 1"))).collect()
    assert sorted((r.record_id, r.outcome, r.refers_to) for r in repeated if r.record_id == 2) == [(2, "resolved", 1)] and len(repeated) == 3


def test_canonical_url(spark):
    forms = ["http://a.com/x", "https://A.com:443/x/", "a.com:80/x#f", "http://m.a.com/x", "http://www.a.com/x", "http://a.com:443/x", "https://a.com:80/x", None, ""]
    d = spark.createDataFrame(list(enumerate(forms)), "i int, url string")
    got = [r.k for r in d.orderBy("i").select(warc.canonical_url(F.col("url")).alias("k")).collect()]
    assert got == ["a.com/x"] * 3 + ["m.a.com/x", "www.a.com/x", "a.com:443/x", "a.com:80/x", None, ""]

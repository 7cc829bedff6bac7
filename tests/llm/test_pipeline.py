"""corpus_pipeline.run against a plain version of its five stages on a small table."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from rillflow.llm import quality

from .odd import TEXTS
from .test_free_ops import plain_line_dedup, word_list

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join("".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(n))
    junk = lambda n: " ".join(f"{rng.integers(10**6)}%|{rng.integers(99)}$" for _ in range(n))
    texts = {i: "\n".join(prose(int(rng.integers(6, 20))) for _ in range(6)) for i in range(60)}
    texts |= {i: junk(int(rng.integers(20, 90))) for i in range(60, 100)}
    items = [prose(30) for _ in range(4)]
    whole = prose(120)
    hot = "this very common line stands in half of the documents"
    texts |= {i: texts[i] + "\n" + hot for i in range(0, 60, 2)}
    texts |= {100: whole, 101: whole.replace(whole.split()[50], "other", 1), 102: whole, 103: texts[4], 104: None, 105: "", 106: " \n "}
    texts |= {110 + k: prose(20) + " " + item.upper() + " " + prose(20) for k, item in enumerate(items)}
    texts |= {120: texts[6] + "\n" + prose(10), 121: prose(3000), 122: texts[9].split("\n")[2] + "\n" + prose(12)}
    rows = [(i, t, None if i % 3 else "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    rows.append(rows[8])  # repeated whole
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def shingled(text, width=5):
    w = word_list("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def plain_stages(texts, items):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fitted = [i for i in range(100) if not held(i)]
    one = lambda t: pa.array([t or ""], pa.large_string())
    model = quality.fit_bags([quality.encode(one(texts[i]))[0] for i in fitted], np.array([float(i < 60) for i in fitted]))
    docs = {i: t for i, t in texts.items() if quality.scores_of(model, one(t))[0] >= 0.3}
    yield docs
    after = plain_line_dedup([(i, t) for i, t in docs.items() if t is not None]) | {i: None for i, t in docs.items() if t is None}
    docs = {i: t for i, t in after.items() if not (t != docs[i] and not word_list(t))}
    yield docs
    sets, root = {i: shingled(t) for i, t in docs.items()}, {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    docs = {i: t for i, t in docs.items() if root[i] == i}
    yield docs
    bad = [shingled(x) for x in items]
    yield {i: t for i, t in docs.items() if not any(100 * len(shingled(t) & x) >= 80 * len(x) for x in bad)}


def test_run(spark, tables):
    folder, texts, items = tables
    plain = list(plain_stages(texts, items))
    assert [len(p) for p in plain] != [len(texts)] * 4 and all(len(a) > len(b) for a, b in zip(plain, plain[1:]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain):
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert {r.doc_id: r.text for r in got} == want, name
        assert len(got) == len(want) + (8 in want)  # the repeated row
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in plain[-1].items()}
    rows, covered, filled = corpus_pipeline.run(spark, folder).collect(), defaultdict(int), defaultdict(int)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert covered == {i: len(x) * (2 if i == 8 else 1) for i, x in ids.items()} and max(filled.values()) <= 2048


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tables, k):
    """Nulls, empty and long texts, ties, repeats, no rows, columns of clashing names."""
    folder = tables[0]
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(i, t, None, None, None, 1, 0.5, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a text without an id", None, None, None, 1, 0.5, 7)]
    schema = SCHEMA + ", rf_n int, score double, rf_word int"
    got = stage(spark, spark.createDataFrame(rows, schema), folder)
    if name == "packing":
        assert {r.doc_id for r in got.collect()} == {None, *range(len(TEXTS))}
    else:
        assert got.columns == [c.split()[0] for c in schema.split(", ")]
        found = got.collect()
        assert {r.doc_id for r in found} <= {None, *range(len(TEXTS))} and all((r.rf_n, r.score, r.rf_word) == (1, 0.5, 7) for r in found)
        if name != "quality_classifier":
            assert {None, 0, 1, 2} <= {r.doc_id for r in found}
    assert stage(spark, spark.createDataFrame([], schema), folder).count() == 0

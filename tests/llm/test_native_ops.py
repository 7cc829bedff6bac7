import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from rillflow.llm import pii, queries
from rillflow.llm.exact_dedup import exact_dedup
from rillflow.llm.sharding import greedy_cuts, minimax_capacity, shard_by_bytes

from .odd import none, odd_docs

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark, sf):
    for docs in (odd_docs(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        for bits in (6, 22):
            got = exact_dedup(docs, bits=bits, digest="sha").collect()
            assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha) for r in got) == want
    assert exact_dedup(none(spark)).count() == 0


def test_shards(spark, sf):
    for docs in (odd_docs(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = {}
        for r in docs.collect():
            rows.setdefault(r.doc_id, r.text or "")
        got = shard_by_bytes(docs).collect()
        assert len(got) == docs.count()
        shard_of, slots, load = {}, defaultdict(list), defaultdict(int)
        for r in got:
            t = rows[r.doc_id]
            assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
            assert shard_of.setdefault(t, r.shard) == r.shard
            slots[r.shard].append(r.slot)
            load[r.shard] += r.size
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
        sizes = defaultdict(int)
        keys = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
        for r in got:
            sizes[keys[rows[r.doc_id]]] += r.size
        assert max(load.values()) == minimax_capacity([sizes[k] for k in sorted(sizes)], 24)
    assert shard_by_bytes(none(spark)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 5))
def test_minimax_is_least(sizes, shards):
    def best(items, k):
        if k == 1 or len(items) < 2:
            return sum(items)
        return min(max(sum(items[:i]), best(items[i:], k - 1)) for i in range(len(items) + 1))

    assert minimax_capacity(sizes, shards) == best(sizes, shards)
    assert greedy_cuts([0, *__import__("itertools").accumulate(sizes)], minimax_capacity(sizes, shards), shards)


HARD = [
    "a@b.c%d@e.f x@y z@w. q@r@s.t 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.01 1.2.3",
    "+1 (555) 123-4567 +49 30 1234567 ++1 +123 call 4111 1111 1111 1111 or 4111-1111-1111-1112 5-5",
    "4111  1111111111111111 0000000000000000 é 4111111111111111é +1.2.3.4.5.6.7.8.9 1.1.1.1@a.b",
    "a" * 6_000 + "@", "1" * 6_000, "1-" * 20_000, "." * 3000 + "@a.b" * 50, "IBAN DE89 3704 0044 0532 0130 00 and, far away from any word that names such a thing, GB82WEST12345698765432.",
]


def test_pii(spark, sf):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for docs in (odd_docs(spark).select("doc_id", "text").union(extra), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in pii.find_pii(docs).collect():
            got = [(s.start, s.kind, s.end) for s in r.found]
            assert [s for s in got if s[1] < 4] == brute_spans(texts[r.doc_id]), r.doc_id
            assert got == sorted(got)
    ibans = [s for r in pii.find_pii(extra).collect() for s in r.found if s.kind == 4]
    assert len(ibans) == 2 and max(s.score for s in ibans) > min(s.score for s in ibans)
    assert pii.find_pii(none(spark)).count() == 0
    text = pii.redact(extra.where("doc_id = 107")).first().text
    assert text == "IBAN <iban> and, far away from any word that names such a thing, <iban>."


def test_iban_among_upper_case_words(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB82WEST12345698765432 NOW", "REF AB12 CD34 EF56 GH78 DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947 BE71 0961 2345 6769", "DE89 3704 0044 0532 0130 00 Bank", "DE88 3704 0044 0532 0130 00 BIC"]
    got = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["IBAN <iban> BIC COBADEFFXXX", "<iban> NOW", "REF AB12 CD34 EF56 GH78 <iban>", "<iban> <iban>", "<iban> Bank", texts[5]]


def test_pii_query(spark, sf):
    row = queries.op10_pii(spark, sf).where("n_email > 0").first()
    assert row.spans.count("email:") == row.n_email and re.fullmatch("[0-9a-f]{64}", row.base_sha256)

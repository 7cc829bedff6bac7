r"""Personal data: regular expressions propose, checksums confirm, context scores.

DataFrame functions only, one scan, no shuffle.  Spark has no function that gives
the positions of all matches, but ``split`` gives the text between them and
``regexp_extract_all`` the matches, so a match starts after the summed lengths of
what stands before it.  The patterns are written so that Java's matcher works
iteratively and in linear time on long runs: possessive loops, and a match may
begin only at the start of a run of its characters or where the last one ended,
which is where the leftmost match begins anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban"]

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+",
}
#: A cheap test that holds for every text with a match.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
}
#: Words that make a kind likelier when one stands shortly before the span.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: Score of a confirmed span without context, and what a context word adds.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_BONUS, CONTEXT_CHARS = 0.1, 40

#: Lengths of the registered countries' IBANs.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digit_sum(digits: Column, weight) -> Column:
    positions = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(positions, F.lit(0), lambda acc, i: acc + weight(F.length(digits) - i, F.substring(digits, i, F.lit(1)).cast("int")))


def luhn(digits: Column) -> Column:
    doubled = lambda k, d: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return _digit_sum(digits, doubled) % 10 == 0


def mod97(iban: Column) -> Column:
    """The IBAN check: first four characters last, letters as 10 to 35, remainder 1."""
    compact = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    positions = F.sequence(F.lit(1), F.length(turned))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + (c - 55)) % 97).otherwise((acc * 10 + (c - 48)) % 97)

    return F.aggregate(positions, F.lit(0), step) == 1


def _ibans(run: Column) -> Column:
    """``a, b``: where IBANs begin and end in a run of upper-case words, the leftmost first; of those that pass the check the one of its country's length, or else the longest."""

    def of_words(ws: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            w, at = F.get(ws, i), acc["at"]
            heads = F.transform(F.sequence(F.lit(1), F.least(F.size(ws) - i, F.lit(31))), lambda k: F.array_join(F.slice(ws, i + 1, k), " "))
            sized = F.filter(heads, lambda h: F.length(F.regexp_replace(h, " ", "")).between(15, 34))
            good = F.reverse(F.filter(sized, mod97))
            usual = F.filter(good, lambda h: F.lit(IBAN_LENGTHS).contains(F.concat(F.substring(h, 1, 2), F.length(F.regexp_replace(h, " ", "")).cast("string"))))
            best = F.when((at >= acc["free"]) & w.rlike("^[A-Z]{2}[0-9]{2}"), F.coalesce(F.get(usual, F.lit(0)), F.get(good, F.lit(0))))
            after = at + F.length(w) + 1

            def taken(b: Column) -> Column:
                end = at + F.length(b)
                found = F.concat(acc["out"], F.array(F.struct(at.alias("a"), end.alias("b"))))
                return F.struct(after.alias("at"), F.coalesce(end, acc["free"]).alias("free"), F.when(b.isNotNull(), found).otherwise(acc["out"]).alias("out"))

            return F.get(F.transform(F.array(best), taken), F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.size(ws) - 1), start, step, lambda acc: acc["out"])

    return F.get(F.transform(F.array(F.split(run, " ")), of_words), F.lit(0))


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


#: Matches that are folded together: arrays grow by copying, so a text with many matches is folded in blocks.
BLOCK = 256
#: So many matches and the gaps before them have at least ``CONTEXT_CHARS`` code points together (a match has three or more).
LAST = -(-CONTEXT_CHARS // 3)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind as structs (start, kind number, end, score); code points, end exclusive.

    The work is linear in the text: what stands before a match is carried along, not
    looked up from the text's start.
    """
    length = lambda m: F.coalesce(F.length(m), F.lit(0))
    last = lambda t: F.right(t, F.lit(CONTEXT_CHARS))

    def span(before: Column, start: Column, end: Column) -> Column:
        near = F.lower(last(before)).rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})")
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), (F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        begin, before = acc["at"] + F.length(x["g"]), F.concat(acc["tail"], last(x["g"]))
        end = begin + length(x["m"])
        if kind == "iban":
            ok, spans = x["m"].isNotNull(), F.transform(_ibans(x["m"]), lambda r: span(F.concat(before, F.left(x["m"], r["a"])), begin + r["a"], begin + r["b"]))
        else:
            ok, spans = x["m"].isNotNull() & _confirmed(kind, x["m"]), F.array(span(before, begin, end))
        tail = last(F.concat(before, F.coalesce(x["m"], F.lit(""))))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(ok, F.concat(acc["out"], spans)).otherwise(acc["out"]).alias("out"))

    def of_blocks(blocks: Column) -> Column:
        size = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["g"]) + length(x["m"]))
        starts = F.aggregate(F.transform(blocks, size), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        end_of = lambda b: last(F.array_join(F.transform(F.slice(b, -LAST, LAST), lambda x: F.concat(last(x["g"]), F.coalesce(x["m"], F.lit("")))), ""))

        def of_block(b: Column, i: Column, at: Column) -> Column:
            tail = F.when(i > 0, end_of(F.get(blocks, i - 1))).otherwise("")
            start = F.struct(F.get(at, i).alias("at"), tail.alias("tail"), F.array().cast(_SPAN).alias("out"))
            return F.aggregate(b, start, step, lambda acc: acc["out"])

        return _bind(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: of_block(b, i, at))))

    def of_pairs(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return _bind(F.transform(numbers, lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    found = _bind(F.zip_with(F.split(text, PATTERNS[kind], -1), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), of_pairs)
    return F.when(NEEDS[kind](text), found).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] = KINDS) -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of spans by start, then kind.

    A span is ``struct<start, kind, end, score>`` in code points, ``kind`` an index
    into ``KINDS``.  Null and empty texts have no spans; repeated rows give repeated
    results; other columns of ``docs`` are ignored; an empty table gives no rows.
    Matches of one kind don't overlap; a match that its checksum refutes is dropped
    without another try inside it, but IBANs are looked for at every word of a run of
    upper-case words.  The score is the kind's base score plus a bonus
    if a context word stands within forty characters before the span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    per_kind = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", *[_spans(F.col("t"), k).alias(k) for k in kinds])
    return per_kind.select("doc_id", F.array_sort(F.concat(*kinds)).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` with spans scored ``least`` or more replaced by ``<kind>``; overlapping spans count from the first.

    Null texts stay null, empty ones empty; repeated rows are changed alike; other columns
    stay as they are; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(text, k) for k in KINDS]))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def chosen(found: Column) -> Column:
        """Spans that are replaced, in blocks, so that the fold stays linear."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))

        def step(acc: Column, s: Column) -> Column:
            take = (s["start"] >= acc["at"]) & (s["score"] >= least)
            return F.struct(F.when(take, s["end"]).otherwise(acc["at"]).alias("at"), F.when(take, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

        def block(acc: Column, b: Column) -> Column:
            begun = F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
            return _bind(F.aggregate(b, begun, step), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))

    def replaced(kept: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(0)
        parts = F.transform(kept, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.element_at(names, s["kind"] + 1)))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) + 1))

    done = _bind(_bind(spans, chosen), replaced)
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done))

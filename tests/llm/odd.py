"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(9000))
TEXTS = [
    None, "", " \t\n", "a", "A", "same text here and there", "Same Text here AND there", "same text here and there",
    "é É ß     \U0001f600 end", LONG, LONG + " tail", "x" * 70_000, "1 " * 6000, "\n\n\n", "line one is here now\nline two is here now\n" * 3,
    "word " * 400, "<|endoftext|> in the middle <|endoftext|>", "\x00 nul \x1f unit",
]
#: Names that operators might use for columns of their own.
CLASHING = ["rf_word", "rf_mask", "rf_bucket", "rf_n", "rf_gone", "rf_rk", "rf_score", "score", "word", "mask", "bucket", "label", "rep", "n", "hs", "h", "item", "first", "kept", "found"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `shard` int, out double, size string, " + ", ".join(f"{c} int" for c in CLASHING)


def odd_docs(spark):
    rows = [(i, t, None if i % 2 else "en", "s", None, "k", 1, 0.5, "z", *range(len(CLASHING))) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[9]]  # repeated whole
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)

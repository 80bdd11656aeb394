"""Small inputs that every operator and stage must take: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

LONG = "many words stand here and more follow them " * 20_000
TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t",
    "one",
    "one",
    "a b c d e f g h",
    "a b c d e f g h",
    "mail bob@example.org or call +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.255",
    "é ü 漢字 🙂 ▁▁ x y <|endoftext|> \x00 end",
    "x" * 100_000,
    "9" * 50_000,
    "a@" * 20_000,
    LONG,
    LONG + "end",
]
#: Runs of white space over which regular expressions run out of stack. Operators that merge symbols in Python need some minutes for
#: them, so only those take them in tests that cut texts by such expressions.
WIDE = ["a" + " " * 3_000_000 + "b", "\n" * 3_000_000, "\t " * 1_500_000 + "z<|endoftext|>"]
#: Names that operators use for their own columns.
CLASHING = ["id", "text_", "words", "spans", "kept", "label", "quality", "fold", "x", "bucket", "length", "piece", "rank", "copies", "home", "host", "path", "rule", "content"]


def edge_docs(spark):
    """documents with a row of each text, a null key, a repeated key, null columns and extra columns."""
    rows = [(i, t, "en" if i % 2 else None, "web", len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [(None, "keyless text of some more words here", None, None, None), (4, "one", None, None, 3), (7, "other text under one key", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return with_extras(df)


def with_extras(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})


def no_docs(spark):
    return edge_docs(spark).limit(0)


def sample_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df, key="doc_id"):
    """(key, text) of all rows, null texts as empty."""
    return [(r[0], r[1] or "") for r in df.select(key, "text").collect()]

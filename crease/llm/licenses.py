"""Operator 4: license detection by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import read_table
from crease.llm.license_rules import signatures

#: Phrases that are always reported, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Parts of many keywords: the test of a whole text for any keyword looks for these in their stead.
STEMS = ("licen", "gpl", "bsd", "apache", "cc by", "commons", "public domain", "attribution no", "copyright")

#: What is not a word, and the letters that are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Before every match a mark is put, so that the words of a text, counted once, tell where the matches start.
MARK = "\x01"

#: What identifiers of one header start with; those after the first follow OR or AND.
HEADER = "spdx license identifier "


def rules() -> list[tuple[str, str, int, str, float, bool]]:
    """The ordered rules: (keyword, label, priority, expression over words, score, base). Lower priority wins.

    A rule of an identifier in a file header also takes it after others, of up to 100 letters, that OR or AND join to it.
    """
    out = [(phrase, label, 0, phrase, 0.85, True) for phrase, label in BASE_PHRASES.items()]
    found = signatures()
    for i, (label, score, k, e) in enumerate(found, 1):
        if e.startswith(HEADER):
            own = e.removeprefix(HEADER)
            e = f"{e}|(?:{own})(?<={HEADER}[a-z0-9 ]{{2,100}} (?:or|and) (?:{own}))"
        out.append((k, label, i, e, score, False))
    return out


def _positions(words: Column, rule: Column) -> Column:
    """Spans (start, not_end, priority, label, score, base) of a rule's matches; words count from 0, ends are inclusive.

    not_end is the negated end, so that sorted spans have the longest of one start first. The time is linear in the text.
    """
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    marked = F.split(F.regexp_replace(words, rule["pattern"], F.lit(MARK + "$0")), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
    wide = F.transform(found, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    return F.transform(
        F.arrays_zip(starts.alias("start"), wide.alias("wide")),
        lambda x: F.struct(
            x["start"].alias("start"),
            (-(x["start"] + x["wide"])).alias("not_end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["score"].alias("score"),
            rule["base"].alias("base"),
        ),
    )


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licenses stated in each document; one row per document, in place, without a shuffle.

    Returns key, n_words, n_base, first_word, last_word, base_labels, labels, n_found and score. Words are runs of
    lower-cased ASCII letters, digits and non-ASCII characters. Rules run only if their keyword is in the text; a
    span that lies in another's is suppressed, of equal spans the rule of lowest priority stays; partly overlapping
    spans both stay. n_base counts the base phrases' places whether suppressed or not, and base labels always stay.
    labels: distinct, sorted, comma-joined ('' if none); score: the best rule's, 0 if none. A null text is empty; keys
    may be null or repeat; other columns are left out.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = F.trim(F.regexp_replace(lower, NOT_WORD, " "))
    table = rules()
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    literal = F.expr(
        "array("
        + ",".join(
            f"named_struct('keyword',{quoted(k)},'label',{quoted(label)},'priority',{p},"
            f"'pattern',{quoted('(?<![^ ])(?:' + e + ')(?![^ ])')},'score',{s}D,'base',{str(b).lower()})"
            for k, label, p, e, s, b in table
        )
        + ")"
    )
    keywords = {next((stem for stem in STEMS if stem in k), k) for k, *_ in table}
    keywords = sorted(k for k in keywords if not any(x != k and x in k for x in keywords))
    df = docs.select(F.col(key), words.alias("words"))
    # a cheap test of the whole text for any keyword; few texts pass it
    any_of = F.lit(False)
    for k in keywords:
        any_of = any_of | F.contains(F.col("words"), F.lit(k))
    spans = F.when(
        any_of,
        F.array_sort(
            F.flatten(
                F.transform(
                    F.filter(literal, lambda r: F.contains(F.col("words"), r["keyword"])),
                    lambda r: _positions(F.col("words"), r),
                )
            )
        ),
    )
    df = df.withColumn("spans", spans)
    none = F.struct(
        F.lit(-1).alias("reach"), F.lit(0).alias("n"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("labels")
    )

    def keep(acc, x):
        kept = -x["not_end"] > acc["reach"]
        return F.when(
            kept,
            F.struct(
                (-x["not_end"]).alias("reach"),
                (acc["n"] + 1).alias("n"),
                F.greatest(acc["score"], x["score"]).alias("score"),
                F.when(F.array_contains(acc["labels"], x["label"]), acc["labels"]).otherwise(F.array_append(acc["labels"], x["label"])).alias("labels"),
            ),
        ).otherwise(acc)

    found = F.col("spans").isNotNull()
    base = F.filter(F.col("spans"), lambda x: x["base"])
    df = df.withColumn("kept", F.when(found, F.aggregate("spans", none, keep))).withColumn("base", F.when(found, base))
    base_labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    n = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit(""))) + 1
    blank = F.lit("")
    return df.select(
        key,
        F.when(F.col("words") == "", 0).otherwise(n).cast("long").alias("n_words"),
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(base_labels), ","), blank).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(base_labels, "kept.labels")), ","), blank).alias("labels"),
        F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_found"),
        F.coalesce("kept.score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))

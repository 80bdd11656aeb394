"""Operator 2: personal data by proposing expressions, checksum validators and context words."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import map_batches, read_table, texts_of

#: Kinds in the order that breaks ties of equal starts; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "national_phone", "secret"]
BASE_KINDS = KINDS[:4]

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
        "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
        "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
        "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NATIONAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: Keys and tokens of known formats: cloud, source hosting, payment, chat and package services, signed tokens, key files.
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,120}|glpat-[A-Za-z0-9_-]{20}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{24,120}|sk-[A-Za-z0-9_-]{20,200}|xox[abeprs]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{35}"
    r"|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,60}|eyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,2000})(?![A-Za-z0-9])"
    r"|-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----"
)
#: A value given to a name that ends in a context word of secrets; passwords may be shorter.
ASSIGNED = re.compile(
    r"(?:key|token|secret|credential|password|passwd|pwd)[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}([\"']?)([A-Za-z0-9_+/=.~!@#$%^&*-]{8,}+)\1(?![\"'A-Za-z0-9])",
    re.IGNORECASE,
)
PASSWORD = re.compile(r"pass|pwd", re.IGNORECASE)

#: What a span scores before its context, and what a context word of the kind adds within WINDOW characters.
START_SCORE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "national_phone": 0.4, "secret": 0.9}
WINDOW, BONUS, MALUS, KEEP = 48, 0.35, 0.3, 0.6
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "national_phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax"),
    "secret": ("key", "token", "secret", "password"),
}
#: Words that speak against any kind.
AGAINST = ("version", "isbn", "invoice no", "example only", "part number")


def _whole(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words as a word of its own, or its plural."""
    return re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + r")s?(?![a-z0-9])")


_CONTEXT = {kind: _whole(words) for kind, words in CONTEXT.items()}
_AGAINST = _whole(AGAINST)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of international bank account numbers."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: each @ looks back over the run of local-part characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # no local part holds an @, so the run starts after the one before
        run = text[done:at]
        start = len(run.rstrip(LOCAL_PART)) + done
        done = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def find_ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers that pass the checksum, leftmost first.

    Of the ends at word borders, first that of the country's length, then the longest; of other countries all.
    """
    out, at = [], 0
    while m := IBAN.search(text, at):
        start, stop = m.span()
        at = start + 4
        ends, n = [], 0
        for e in range(start, stop):
            n += text[e] != " "
            border = e + 1 == len(text) or not (text[e + 1].isascii() and text[e + 1].isalnum())
            if text[e] != " " and border and n >= 15:
                ends.append((n, e + 1))
        ends.reverse()
        length = IBAN_LENGTHS.get(m[0][:2])
        if length:
            ends = [x for x in ends if x[0] == length] + ends[:1]
        for _, end in ends:
            if mod97(text[start:end].replace(" ", "")):
                out.append((start, end))
                at = end
                break
    return out


def find_secrets(text: str) -> list[tuple[int, int]]:
    """Keys of known formats, and assigned values of 16 characters or more (8 for passwords).

    A quoted value needs two of lower case, upper case and digits; one without quotes a letter and a digit.
    """
    out = {m.span() for m in SECRET.finditer(text)}
    for m in ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        value = m[2]
        if len(value) < 16 and not PASSWORD.match(m[0]):
            continue
        lower, upper, digit = (any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
        if lower + upper + digit >= 2 and (m[1] or (digit and (lower or upper))):
            out.add(m.span(2))
    return sorted(out)


def propose(text: str) -> list[tuple[str, int, int]]:
    """Spans that the expressions propose and the validators confirm."""
    out = [("email", *x) for x in find_emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
        out += [("iban", *x) for x in find_ibans(text)]
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
        out += [("national_phone", *m.span()) for m in NATIONAL_PHONE.finditer(text)]
    out += [("secret", *x) for x in find_secrets(text)]
    return out


def scored(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    score = START_SCORE[kind] + BONUS * bool(_CONTEXT[kind].search(around)) - MALUS * bool(_AGAINST.search(around))
    return max(0.0, min(1.0, score))


def find_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind. Base kinds always stay; the others need a score of KEEP, and room.

    A span of another kind that overlaps a base span is dropped. Offsets are code points, ends exclusive.
    """
    proposed = propose(text)
    spans = [Span(*x, scored(text, *x)) for x in proposed if x[0] in BASE_KINDS]
    more = [x for x in proposed if x[0] not in BASE_KINDS]
    if more:
        taken = covered((s.start, s.end) for s in spans)
        starts, ends = [a for a, _ in taken], [b for _, b in taken]
        for kind, a, b in more:
            free = bisect_right(ends, a) >= bisect_left(starts, b)
            if free and (score := scored(text, kind, a, b)) >= KEEP:
                spans.append(Span(kind, a, b, score))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def covered(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with each found span, or union of overlapping ones, as [KIND] of its first span."""
    if not spans:
        return text
    first = {}
    for s in spans:
        first.setdefault(s.start, s.kind)
    out, at = [], 0
    merged: list[list[int]] = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end])
    for a, b in merged:
        out += [text[at:a], f"[{first[a].upper()}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data: key, spans (kind, start, end, score) by start, redacted text; one row per document.

    A null text is empty (no spans, redacted ''); keys may be null or repeat; other columns are left out. Every
    expression is linear in the text or bounded in its length, so very long texts and runs are safe.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}, redacted string"
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def start():
        def each(batch: pa.RecordBatch):
            texts = texts_of(batch, text)
            spans = [find_spans(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([[s._asdict() for s in x] for x in spans], kind),
                    pa.array([redact(x, s) for x, s in zip(texts, spans, strict=True)], pa.string()),
                ],
                [key, "spans", "redacted"],
            )

        return each

    return map_batches(docs.select(key, text), schema, start)


def mask_pii(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every found span masked and n_chars counted anew where it changed; null texts stay null."""
    names = docs.columns

    def start():
        def each(batch: pa.RecordBatch):
            texts = batch.column(text).to_pylist()
            masked = [x and redact(x, find_spans(x)) for x in texts]
            columns = {c: batch.column(c) for c in names}
            columns[text] = pa.array(masked, pa.string())
            if n_chars in columns:
                old = columns[n_chars].to_pylist()
                columns[n_chars] = pa.array(
                    [n if a == b else len(b) for n, a, b in zip(old, texts, masked, strict=True)], columns[n_chars].type
                )
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return each

    return map_batches(docs, docs.schema, start)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans that find_pii returns."""
    found = find_pii(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kinds = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    base = of_kinds(BASE_KINDS)
    return found.select(
        "doc_id",
        *[F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )

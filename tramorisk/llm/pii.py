"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Native: one narrow projection of built-in functions, without a shuffle. A
pattern is applied twice, by ``regexp_extract_all`` for the matches and by
``split`` for the text between them, so every position follows from lengths.
Repetition of groups is avoided: the JVM's matcher recurses once per repeat
and would exhaust its stack on a long text. Inner separators are marked by a
private character first, after which single character classes are enough.

Defined results: a null or empty text has no spans. Repeated rows are judged
alike, one by one. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.llm.arrays import let, running

MARK, OTHER = "\ue000", "\ue001"
CONTEXT_CHARS = 48
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")


@dataclass(frozen=True)
class Kind:
    """A proposal pattern, the mark it relies on, a cheap test, its prior score and the words that raise it."""

    pattern: str
    hint: str
    prior: float
    context: str
    mark: str | None = None


#: Inner separators that become MARK: (where, for which kinds).
DOTS = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
GAPS = r"(?<=[0-9])[\x20-](?=[0-9])"
LOCAL = rf"[A-Za-z0-9._%+{MARK}-]"

DETECTORS = {
    "email": Kind(rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++", r"@", 0.9, r"mail|contact|write|kontakt|correo", DOTS),
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|server|host|adresse"),
    # Runs are maximal, so those too short for a card need not be matches at all.
    "card": Kind(rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]{{12,}}+", r"[0-9](?:[\x20-]?[0-9]){12}", 0.7, r"card|visa|credit|payment|karte|carte|tarjeta", GAPS),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|tel|call|mobile|fax|telefon"),
    "iban": Kind(rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9{MARK}]{{11,38}}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8,
                 r"iban|bank|account|konto|compte|cuenta", r"(?<=[A-Z0-9])\x20(?=[A-Z0-9])"),
    "ssn": Kind(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", 0.3, r"ssn|social|security"),
    "secret": Kind(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9])(?:(?i:token|secret|password|passwd|api_key|apikey))"
                   r"\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_-]{12,128}+[\x22']?)", r"AKIA|(?i:token|secret|passw|api_?key)", 0.8, r"key|secret|token|login"),
}
#: Scores below this are not reported, for kinds that the method adds.
LEAST = 0.5
BONUS, MALUS = 0.3, 0.2
MALUS_WORDS = r"version|example|order|invoice|isbn|serial"


def found(text: Column, kind: Kind) -> Column:
    """Array of (start, end, value) of all leftmost non-overlapping matches; empty when the cheap test fails."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), kind.mark, MARK) if kind.mark else text

    def placed(body: Column, matches: Column) -> Column:
        between = F.transform(F.slice(F.split(body, kind.pattern, -1), F.lit(1), F.size(matches)), lambda x: F.length(x))
        ends = running(F.zip_with(between, matches, lambda a, m: a + F.length(m)))
        return F.zip_with(ends, matches, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), F.substr(text, end - F.length(m) + 1, F.length(m)).alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    spans = let(marked, lambda body: let(F.regexp_extract_all(body, F.lit(kind.pattern), 0), lambda matches: F.when(
        F.size(matches) > 0, placed(body, matches)).otherwise(none)))
    return F.when(text.rlike(kind.hint), spans).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True when the digits of ``value`` pass the check sum."""
    number = F.split(F.reverse(digits(value)), "(?<=.)(?=.)")
    doubled = F.transform(number, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
                          .otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """True when an account number, rearranged and with letters as numbers, leaves 1."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "(?<=.)(?=.)")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97)
                       .otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The rule that a proposed value of ``kind`` must pass."""
    n = F.length(digits(value))
    if kind == "ip":
        part = r"0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^(?:{part}|0++)\.(?:{part}|0++)\.(?:{part}|0++)\.(?:{part}|0++)$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        size = F.length(F.regexp_replace(value, "[^A-Z0-9]", ""))
        return F.when((size >= 15) & (size <= 34), mod97(value)).otherwise(False)
    return F.lit(True)


def scored(text: Column, kind: str, span: Column) -> Column:
    """The span with its kind and a score from the prior and the words before it."""
    near = F.lower(F.substr(text, F.greatest(F.lit(1), span["start"] + 1 - CONTEXT_CHARS), F.least(span["start"], F.lit(CONTEXT_CHARS))))
    rule = DETECTORS[kind]
    score = rule.prior + F.when(near.rlike(rule.context), BONUS).otherwise(0.0) - F.when(near.rlike(MALUS_WORDS), MALUS).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"),
                    F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, value, score), by kind and then by start. A column of that name is replaced.

    Base kinds keep every confirmed span whatever its score; added kinds keep those of at least ``LEAST``.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def of_kind(kind: str) -> Column:
        spans = F.filter(found(body, DETECTORS[kind]), lambda s: confirmed(kind, s["value"]))
        spans = F.transform(spans, lambda s: scored(body, kind, s))
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST)

    return docs.withColumn(out, F.concat(*[of_kind(kind) for kind in KINDS]))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans go as one, under the kind that starts first."""
    found_in = find_pii(docs, text, "_pii")
    ordered = F.array_sort(F.transform(F.col("_pii"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    first = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    built = F.aggregate(ordered, first, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["parts"], F.array(F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"),
        s["end"].alias("at"))).otherwise(F.struct(a["parts"].alias("parts"), F.greatest(a["at"], s["end"]).alias("at"))))
    masked = let(built, lambda b: F.concat(F.array_join(b["parts"], ""), F.substr(F.col(text), b["at"] + 1)))
    joined = F.when(F.size("_pii") > 0, masked).otherwise(F.col(text))
    return found_in.withColumn(text, joined).drop("_pii").select(*docs.columns)


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    spans = F.col("_pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs.select("doc_id", "text"), out="_pii").select(
        "doc_id", *[count(kind) for kind in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))

"""Personal data by patterns, checksums and context words (operator 4), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import joined, with_matches

# The kinds that the contract names, in its order. A run of characters that begin a match is entered at
# its start or where the last match ended, and repeats give nothing back, so that each pattern takes linear time.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score of a confirmed match, and what a context word in the 40 characters before it adds.
SCORES = {"email": (0.9, 0.05), "ip": (0.7, 0.2), "card": (0.8, 0.15), "phone": (0.6, 0.3), "iban": (0.9, 0.05), "ssn": (0.3, 0.6)}
CONTEXTS = {
    "email": r"mail|contact",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment|konto|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social|security",
}
THRESHOLD = 0.5
FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check of ISO 7064."""
    moved = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    step = lambda r, c: F.when(c < "A", r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, found): one row for each of ``docs`` with its spans, an array of (start, rank, end, kind, score).

    Patterns propose, ``confirmed`` drops what fails its check (nothing is tried again), and the score is that of the
    kind plus its share if a context word stands before. Kinds of ``BASE`` stay whatever the score; others need
    ``threshold``. Positions are code points, ``end`` exclusive; sorted by start, then kind. A null or empty text has
    no spans, rows may repeat, a null id stays null, other columns are unused.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = with_matches(docs, "text", PATTERNS)

    def kind_spans(rank: int, kind: str) -> Column:
        score, more = SCORES[kind]

        def span(s: Column) -> Column:
            context = F.when(s["before"].rlike(CONTEXTS[kind]), more).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), (F.lit(score) + context).alias("score"))

        spans = F.transform(F.filter(kind, lambda s: confirmed(kind, s["match"])), span)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= threshold)

    kinds = [kind_spans(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return docs.select("doc_id", F.sort_array(F.concat(*kinds)).cast(FOUND).alias("found"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find`` as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score)."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return find(docs, id_col, text_col).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.array_max(F.transform("found", lambda s: s["score"])).alias("max_score"))

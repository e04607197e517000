"""PII (operator 5, native): regular expressions propose, checksums confirm, context adjusts the score.

Only DataFrame functions. A pattern is applied twice: ``regexp_extract_all`` gives the matches and
``split`` the texts between them, whose lengths add up to code-point positions. The text between
two matches also holds the context words of the later one.

Each kind has a base score, which a checksum must confirm where there is one; words in the ``NEAR`` characters
before and after the span raise or lower it, and spans of ``CUT`` or more stay. The four base kinds (email, ip,
card, phone) have scores above it whatever is near, once they are valid. Added kinds: IBAN (mod 97), social-security and
national phone numbers, which need context, values with many different characters that a name such as
``token`` or ``password`` is assigned, and keys of public formats.

Patterns are written with possessive parts and look-behinds, which find the same leftmost matches
as the plain ones but don't go over a long run again from each of its characters.

Defined cases: null and empty texts have no spans. Whole texts of any length are read. Repeated
rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import read

NEAR = 40
CUT = 0.5
#: Matches that are gathered at a time.
PART = 128

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    backwards = F.split(F.reverse(digits), "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.transform(F.filter(backwards, lambda c: c != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder one."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


# Names that secrets are assigned to, and public formats of keys.
_NAMES = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token|client[_-]?secret|private[_-]?key"
_KEYS = "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+|-----BEGIN [A-Z ]*+PRIVATE KEY-----"
_LEAD = r"^[A-Za-z_-]+[\"']?\x20?[:=]\x20?[\"']?"


def _random(value: Column) -> Column:
    """Whether a value has many different characters, letters and digits, as keys do and words don't."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    valid: Callable[[Column], Column]
    context: str = ""
    bonus: float = 0.3
    needs: str = ""  # a string without which a text has no match
    against: str = ""  # words nearby that lower the score
    malus: float = 0.1
    lead: str = ""  # what of a match stands before the span


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, lambda m: F.lit(True), "e-?mail|contact|write", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), r"\bip\b|host|server|address", needs=".", against="version|release|section|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){11,}+", 0.6, lambda m: (F.length(_digits(m)) <= 19) & luhn(_digits(m)), "card|visa|credit|karte|carte|tarjeta", against="order|invoice|tracking|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, lambda m: F.length(_digits(m)).between(9, 15), "phone|call|tel|mobil|fax", needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", 0.6, lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), "iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, lambda m: F.lit(True), r"\bssn\b|social security", against="order|invoice|part|isbn"),
    Kind("local_phone", r"(?<![0-9+(])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])", 0.3, lambda m: F.length(_digits(m)).between(9, 12), "phone|call|tel|mobil|fax", against="order|invoice|tracking|version|isbn", malus=0.2),
    Kind("secret", rf"(?i)(?<![a-z0-9])(?:{_NAMES})[\"']?+\x20?+[:=]\x20?+[\"']?+[A-Za-z0-9+/=_.~-]{{8,}}+", 0.6, lambda m: _random(F.regexp_replace(m, _LEAD, "")), "config|env|login|bearer", against="example|placeholder|changeme", malus=0.05, lead=_LEAD),
    Kind("key", rf"(?<![A-Za-z0-9])(?:{_KEYS})", 0.7, lambda m: F.lit(True), "key|token|secret"),
]
BASE = 4

_SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, rank: int, kind: Kind) -> Column:
    """Spans of one kind; positions are code points, end exclusive."""
    pattern = F.lit(kind.pattern)
    none = F.array().cast(f"array<{_SPAN}>")

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["p"])
        end = start + F.length(x["m"])
        if kind.lead:
            start = start + F.length(F.regexp_extract(x["m"], kind.lead, 0))
        near = F.lower(F.concat(F.right(x["p"], F.lit(NEAR)), F.lit("\n"), F.left(F.coalesce(x["q"], F.lit("")), F.lit(NEAR))))
        score = F.lit(kind.score)
        for words, change in ((kind.context, kind.bonus), (kind.against, -kind.malus)):
            if words:
                score = score + F.when(near.rlike(words), F.lit(change)).otherwise(F.lit(0.0))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score")).cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        good = lambda s: F.when(s["score"] >= CUT, kind.valid(x["m"])).otherwise(F.lit(False))
        out = _let(span(acc["at"], x), lambda s: F.when(good(s), F.concat(acc["out"], F.array(s))).otherwise(acc["out"]))
        return F.struct((acc["at"] + F.length(x["p"]) + F.length(x["m"])).cast("int").alias("at"), out.alias("out"))

    # Arrays grow by copying, so spans are gathered in parts of PART matches, and the parts in an array of their own.
    def gathered(zipped: Column) -> Column:
        def part(acc: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(zipped, i * PART + 1, F.lit(PART)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["out"])).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("parts"))
        parts = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / PART).cast("int"))
        return F.aggregate(parts, start, part, lambda acc: F.flatten(acc["parts"]))

    def zipped(x: Column) -> Column:
        n = F.size(x["m"])
        return F.arrays_zip(F.slice(x["b"], F.lit(1), n).alias("p"), x["m"].alias("m"), F.slice(x["b"], F.lit(2), n).alias("q"))

    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("b"))
    spans = _let(cut, lambda x: _let(zipped(x), gathered))
    may = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(may & text.rlike(kind.pattern), spans).otherwise(none)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, an array of spans (start, rank, kind, end, score) by start, then kind as listed."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", *[_found(text, i, k).alias(k.name) for i, k in enumerate(KINDS)])
    return each.select("doc_id", F.array_sort(F.concat(*[F.col(k.name) for k in KINDS])).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digests of the spans, all spans with their scores, and the count of added ones."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["rank"] < BASE)
    added = F.filter("found", lambda x: x["rank"] >= BASE)
    count = lambda i: F.size(F.filter("found", lambda x: x["rank"] == i))
    return found.select(
        "doc_id",
        *[count(i).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS[:BASE])],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", name), ",").alias("spans"),
        F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
        F.size(added).cast("long").alias("n_added"),
        (F.size("found") > 0).alias("private"),
    )


def op5_validated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(read(spark, sf_dir, "documents")))

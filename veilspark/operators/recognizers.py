"""The recognizers: what is looked for in text, grouped in packs. A plan holds expressions for the active entities only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checksums
from veilspark.functions.spans import find_all, no_spans, spans_of

#: Patterns match whatever the case, line by line, the dot any character.
FLAGS = "(?ims)"
#: Raises a match with one of the recognizer's words near it by so much, to no less than the floor; off unless asked for.
CONTEXT_BOOST, CONTEXT_FLOOR, CONTEXT_CHARS = 0.35, 0.4, 60


@dataclass(frozen=True)
class Recognizer:
    """validate: a match scores 1 if true, goes if false; without it the base score stands. end_of: where in a match the value ends."""

    entity: str
    pattern: str
    score: float
    pack: str
    validate: Callable[[Column], Column] | None = None
    end_of: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()


# Country codes of tax numbers and the patterns of the sixteen entities.
VAT_CODES = "ATU|AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK|GB"

RECOGNIZERS = [
    Recognizer("AADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b", 0.85, "india", checksums.is_valid_aadhaar),
    Recognizer("PAN_CARD", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.85, "india"),
    Recognizer("PAN_CARD", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.85, "india", checksums.is_valid_pan),
    Recognizer("VEHICLE_REG", r"\b[A-Z]{2}\s?\d{2}\s?[A-Z]{1,2}\s?\d{4}\b", 0.85, "india"),
    Recognizer("EU_IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}\b", 0.85, "europe", checksums.is_valid_iban),
    Recognizer("EU_VAT", rf"\b(?:{VAT_CODES})(?=[A-Z0-9]*[0-9])[A-Z0-9]{{5,16}}\b", 0.5, "europe", end_of=checksums.vat_prefix_end),
    Recognizer("EU_VAT", rf"\b(?:{VAT_CODES})(?=[A-Z0-9 -]*[0-9])[ -][A-Z0-9]{{1,4}}(?:[ -][A-Z0-9]{{1,4}}){{1,5}}\b", 0.5, "europe", end_of=checksums.vat_prefix_end),
    Recognizer("BR_CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", 0.85, "brazil", checksums.is_valid_cpf),
    Recognizer("BR_CNPJ", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", 0.85, "brazil", checksums.is_valid_cnpj),
    Recognizer("US_ROUTING_NUMBER", r"\b\d{9}\b", 0.5, "usa", checksums.is_valid_routing_number),
    Recognizer("PROVIDER_NPI", r"\b\d{10}\b", 0.4, "healthcare", checksums.is_valid_npi, context=("npi", "provider", "physician", "doctor")),
    Recognizer("MEDICAL_RECORD_NUMBER", r"\b(?:MRN|MR)[- ]?\d{4,9}\b", 0.5, "healthcare", context=("medical record", "mrn", "patient id", "patient")),
    Recognizer("ICD10_CODE", r"\b[A-TV-Z][0-9]{2}(?:\.[0-9]{1,3}[A-Z]?)?\b", 0.3, "healthcare", context=("diagnosis", "icd10", "icd-10", "disease", "condition")),
    Recognizer("HEALTH_PLAN_ID", r"\b(?:HPI|Plan)[- ]?(?=[A-Z0-9]*[0-9])[A-Z0-9]{5,10}\b", 0.4, "healthcare", context=("insurance", "health plan", "hpi", "coverage")),
    # The general ones are our own: a dotted domain for mail; + and country code, or (ddd) ddd-dddd and ddd-ddd-dddd
    # for telephones; issuer digits and Luhn for cards.
    Recognizer("EMAIL_ADDRESS", r"\b[A-Z0-9._%+-]+@[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?(?:\.[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?)*\.[A-Z]{2,}\b", 0.5, "general"),
    Recognizer("PHONE_NUMBER", r"(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,5}(?:[ -]?\d{2,5}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4})\b", 0.4, "general"),
    Recognizer("CREDIT_CARD", r"\b[1-6]\d{3}[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b", 0.3, "general", checksums.is_valid_card),
]

#: Off by default; they run where a policy row names them.
OPTIONAL = [
    Recognizer("US_SSN", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.5, "general"),
    Recognizer("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.6, "general"),
    Recognizer("URL", r"\bhttps?://[^\s\"<>]+", 0.5, "general"),
    Recognizer("DATE_TIME", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 0.6, "general"),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5, "general", checksums.is_valid_iban),
]

PACKS = ["india", "europe", "brazil", "usa", "healthcare", "general"]
PERSON = "PERSON"
DEFAULT_ENTITIES = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "AADHAAR", "PAN_CARD", "VEHICLE_REG", "EU_IBAN", "EU_VAT",
    "US_ROUTING_NUMBER", "BR_CPF", "BR_CNPJ", "PROVIDER_NPI", "MEDICAL_RECORD_NUMBER", "ICD10_CODE", "HEALTH_PLAN_ID",
]


def pack(name: str) -> list[Recognizer]:
    """The recognizers of a pack; of an unknown one, none."""
    return [r for r in RECOGNIZERS if r.pack == name]


def active(entities: list[str], extra: list[Recognizer] = ()) -> list[tuple[int, Recognizer]]:
    """Numbered recognizers of the named entities; the number breaks ties."""
    return [(i, r) for i, r in enumerate([*RECOGNIZERS, *OPTIONAL, *extra]) if r.entity in entities]


def recognize(text: Column, r: Recognizer, src: int = 0, unicode: bool = False, context: bool = False) -> Column:
    """The spans of one recognizer. unicode: \\d, \\s, \\w and \\b of every script, otherwise of ASCII where Java's are."""
    found = find_all(text, ("(?U)" if unicode else "") + FLAGS + r.pattern)
    if r.validate:
        found = F.filter(found, lambda m: r.validate(m["value"]))
    if r.end_of:

        def trimmed(m: Column) -> Column:
            n = r.end_of(m["value"])
            return F.struct(m["start"].alias("start"), (m["start"] + n).alias("end"), m["value"].alias("value"))

        found = F.filter(F.transform(found, trimmed), lambda m: m["end"] > m["start"])
    if not context or not r.context or r.validate:
        return F.coalesce(spans_of(found, r.entity, 1.0 if r.validate or r.end_of else r.score, src), no_spans())
    words = "(?i)" + "|".join(r.context)

    def score(m: Column) -> Column:
        near = F.concat(F.substring(text, F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT_CHARS))), F.substring(text, m["end"] + 1, F.lit(CONTEXT_CHARS)))
        return F.when(near.rlike(words), F.greatest(F.least(F.lit(r.score + CONTEXT_BOOST), F.lit(1.0)), F.lit(CONTEXT_FLOOR))).otherwise(r.score)

    return F.coalesce(spans_of(found, r.entity, r.score, src, score), no_spans())


# The quick preview's names, patterns and levels.
PREVIEW = [
    ("EMAIL", r"(?i)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", "high"),
    ("PHONE", r"\b(\+91[\-\s]?)?[6-9]\d{9}\b|\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "high"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", "critical"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "critical"),
    ("CREDIT CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "critical"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "critical"),
    ("IP ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "medium"),
    ("DATE", r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", "low"),
]


def preview(text: Column) -> Column:
    """array<struct<start, end, rank, name, level>> in order of start; of equal stretches the first rule's."""
    none = F.array().cast("array<struct<start:int,end:int,rank:int,name:string,level:string>>")
    found = [_preview_rule(text, i, *r) for i, r in enumerate(PREVIEW)]
    ordered = F.array_sort(F.concat(*[F.coalesce(f, none) for f in found]))
    start = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("out"))
    same = lambda s, x: (s["a"] == x["start"]) & (s["b"] == x["end"])
    return F.aggregate(ordered, start, lambda s, x: F.when(same(s, x), s).otherwise(F.struct(x["start"].alias("a"), x["end"].alias("b"), F.concat(s["out"], F.array(x)).alias("out"))), lambda s: s["out"])


def _preview_rule(text: Column, rank: int, name: str, pattern: str, level: str) -> Column:
    return F.transform(find_all(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(level).alias("level")))

"""Detect, mask, synthesize, scan and sanitize text columns: each is one projection, without a shuffle or a UDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.checksums import is_valid_iban, luhn_check
from veilspark.functions.language import resolve_language
from veilspark.functions.persons import find_name_spans, verify_person_span
from veilspark.functions.spans import find_all, is_blank, let, mask_token, no_spans, replace_spans, resolve_overlaps, spans_of, types_of
from veilspark.operators.recognizers import DEFAULT_ENTITIES, PERSON, Recognizer, active, recognize

#: Cells of this length or less are left as they are.
SHORT_CELL = 2
#: Sources of ties: recognizers by number, then persons that a model found, custom patterns, names.
SRC_MODEL, SRC_CUSTOM, SRC_NAMES = 500, 600, 1000


@dataclass(frozen=True)
class Policy:
    """What is looked for and how it is masked. custom: (name, pattern), of the case they are written in.

    ner(text, language) may give PERSON candidates as array<struct<start, end>>; they are verified like others.
    """

    entities: Sequence[str] = field(default_factory=lambda: list(DEFAULT_ENTITIES))
    style: str = "LABEL"
    custom: Sequence[tuple[str, str]] = ()
    unicode: bool = False
    context: bool = False
    extra: Sequence[Recognizer] = ()
    names: Sequence[str] | None = None
    ner: Callable[[Column, Column], Column] | None = None


def valid_pattern(pattern: str) -> bool:
    """Both Python and the JVM take it; patterns that don't compile are passed over."""
    from pyspark.sql import SparkSession

    try:
        re.compile(pattern)
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  whichever engine refuses it
        return False
    return True


def detect(text: Column, policy: Policy | None = None, language: Column | None = None, name_lines: Column | None = None) -> Column:
    """The resolved spans of a text; none for null and blank ones."""
    p = policy or Policy()
    parts = [recognize(text, r, i, p.unicode, p.context) for i, r in active(list(p.entities), list(p.extra))]
    if PERSON in p.entities and p.ner:
        found = F.transform(p.ner(text, resolve_language(language, text)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("").alias("value")))
        found = F.filter(found, lambda m: verify_person_span(text, m["start"], m["end"], p.names))
        parts.append(F.coalesce(spans_of(found, PERSON, 0.85, SRC_MODEL), no_spans()))
    for i, (name, pattern) in enumerate(p.custom):
        if valid_pattern(pattern):
            parts.append(F.coalesce(spans_of(find_all(text, pattern), name, 1.0, SRC_CUSTOM + i), no_spans()))
    if PERSON in p.entities:
        parts.append(F.coalesce(find_name_spans(text, name_lines, SRC_NAMES, p.names), no_spans()))
    if not parts:
        return no_spans()
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    # most texts have no span: their arrays are neither sorted nor folded
    return F.when(text.isNull() | is_blank(text), no_spans()).otherwise(_resolved(every))


def _resolved(every: Column) -> Column:
    return let(every, lambda s: F.when(F.size(s) == 0, s).otherwise(resolve_overlaps(s)))


def with_spans(df: DataFrame, text: str, policy: Policy | None = None, language: str | None = None, name_lines: str | None = None, into: str = "spans") -> DataFrame:
    """df with the spans of its text column."""
    return df.withColumn(into, detect(F.col(text), policy, F.col(language) if language else None, F.col(name_lines) if name_lines else None))


def _result(df: DataFrame, text: str, spans: str, redacted: Column) -> DataFrame:
    s = F.col(spans)
    return df.withColumns({"found": F.size(s) > 0, "types": types_of(s), "matches": F.size(s), "redacted": redacted}).drop(spans)


def mask(df: DataFrame, text: str = "text", policy: Policy | None = None, language: str | None = None, name_lines: str | None = None) -> DataFrame:
    """df with found, types, matches and redacted: each span replaced by its token, spans side by side not merged."""
    p = policy or Policy()
    rows = with_spans(df, text, p, language, name_lines, "__spans")
    s = F.col("__spans")
    token = lambda x: mask_token(x["entity_type"], p.style)
    return _result(rows, text, "__spans", F.when(F.size(s) > 0, replace_spans(F.col(text), s, token)).otherwise(F.col(text)))


def scan(df: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """df with action (BLOCK where a span was found, else ALLOW), count and types; no text is rebuilt."""
    rows = with_spans(df, text, policy, into="__spans")
    s = F.col("__spans")
    return rows.withColumns({"action": F.when(F.size(s) > 0, "BLOCK").otherwise("ALLOW"), "count": F.size(s), "types": types_of(s)}).drop("__spans")


# Invented values to draw from, by locale; languages of no table use English.
FAKE_LOCALES = {"en": "en_US", "es": "es_ES", "fr": "fr_FR", "de": "de_DE", "it": "it_IT", "pt": "pt_BR", "ja": "ja_JP", "zh": "zh_CN"}
FAKE_FIRST = {
    "en_US": "Avery Blake Casey Drew Emery Finley Harper Jordan Kendall Logan Morgan Parker Quinn Reese Riley Rowan".split(),
    "es_ES": "Adriana Bruno Celia Dario Elisa Fabio Gema Hugo Irene Julio Lidia Marcos Nuria Oscar Paula Raul".split(),
    "fr_FR": "Agnes Baptiste Camille Denis Elise Florent Gilles Helene Ivan Jules Lea Manon Noel Odile Pascal Romain".split(),
    "de_DE": "Anke Bernd Carsten Dörte Elke Fritz Gerda Heiko Ingrid Jürgen Karin Lutz Monika Norbert Petra Rolf".split(),
    "it_IT": "Alessia Bruno Chiara Dario Elisa Fabio Gaia Ilaria Luca Marco Nadia Paolo Rita Sandro Tina Ugo".split(),
    "pt_BR": "Aline Bruno Caio Dalva Elias Fabiana Gilson Heloisa Igor Jonas Lara Murilo Nair Otavio Paula Renan".split(),
    "ja_JP": "結衣 陽菜 蓮 湊 葵 凛 颯太 美咲".split(),
    "zh_CN": "伟 芳 娜 敏 静 强 磊 洋".split(),
}
FAKE_LAST = {
    "en_US": "Abbott Barlow Carver Dalton Ellery Fenwick Garland Hadley Ingram Kirby Lowell Mercer Norwood Oakley Prescott Stratton".split(),
    "es_ES": "Alarcon Barrios Cano Duran Esteban Ferrer Gallego Heredia Ibarra Lozano Mora Nieto Ochoa Pardo Rubio Soler".split(),
    "fr_FR": "Aubry Barbier Chevalier Delmas Evrard Fournier Garnier Hubert Jacquet Lambert Marchand Noel Olivier Perrin Renard Vidal".split(),
    "de_DE": "Albers Brandt Cordes Dietz Ebert Frings Gerlach Hartwig Jansen Krause Lorenz Menzel Naumann Otte Pohl Reuter".split(),
    "it_IT": "Amato Bassi Caruso Donati Esposito Ferri Gallo Leone Marini Neri Orlando Pace Riva Serra Testa Valli".split(),
    "pt_BR": "Almeida Barros Cardoso Dias Esteves Farias Gomes Leal Macedo Neves Oliveira Pires Queiroz Ramos Siqueira Teles".split(),
    "ja_JP": "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村".split(),
    "zh_CN": "王 李 张 刘 陈 杨 赵 黄".split(),
}
FAKE_STREETS = "Alder Beech Cedar Dogwood Elm Fir Grove Hazel Juniper Laurel Maple Oak Pine Rowan Spruce Willow".split()
FAKE_CITIES = "Ashford Brookdale Clearwater Dunmore Eastfield Fairview Glenwood Highmoor Kingsley Lakeside Millbrook Northam".split()


def _number(seed: Column, slot: int, n: int) -> Column:
    """A number below n from a hexadecimal digest; slots are independent."""
    at = F.md5(F.concat(seed, F.lit(f"/{slot}")))
    return (F.conv(F.substring(at, 1, 12), 16, 10).cast("long") % n).cast("int")


def _pick(values: list[str], seed: Column, slot: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _number(seed, slot, len(values)))


def _digits(seed: Column, slot: int, n: int) -> Column:
    return F.lpad(_number(seed, slot, 10**n if n < 10 else 10**9).cast("string"), n, "0")


def _letters(seed: Column, slot: int, n: int) -> Column:
    return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _number(seed, slot + i, 26) + 1, F.lit(1)) for i in range(n)])


def _luhn_tail(body: Column) -> Column:
    """body and the digit that makes it pass Luhn."""
    options = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
    return F.get(F.filter(options, lambda x: luhn_check(x)), F.lit(0))


def fake_value(entity: Column, seed: Column, language: Column) -> Column:
    """A made-up value of the entity's kind, the same for the same seed; [ENTITY_SYNTHETIC] for kinds without one."""
    first = last = None
    for code, locale in FAKE_LOCALES.items():
        if locale == "en_US":
            continue
        a, b = _pick(FAKE_FIRST[locale], seed, 1), _pick(FAKE_LAST[locale], seed, 2)
        first = F.when(language == code, a) if first is None else first.when(language == code, a)
        last = F.when(language == code, b) if last is None else last.when(language == code, b)
    first, last = first.otherwise(_pick(FAKE_FIRST["en_US"], seed, 1)), last.otherwise(_pick(FAKE_LAST["en_US"], seed, 2))
    mail = F.lower(F.concat(_pick(FAKE_FIRST["en_US"], seed, 1), F.lit("."), _pick(FAKE_LAST["en_US"], seed, 2), _digits(seed, 3, 2), F.lit("@example.com")))
    iban_body = F.concat(_digits(seed, 4, 9), _digits(seed, 5, 9))
    checks = F.transform(F.sequence(F.lit(2), F.lit(98)), lambda c: F.concat(F.lit("DE"), F.lpad(c.cast("string"), 2, "0"), iban_body))
    return (
        F.when(entity == "PERSON", F.concat_ws(" ", first, last))
        .when(entity == "EMAIL_ADDRESS", mail)
        .when(entity == "PHONE_NUMBER", F.concat(F.lit("+1 ("), _digits(seed, 6, 3), F.lit(") 555-"), _digits(seed, 7, 4)))
        .when(entity == "CREDIT_CARD", _luhn_tail(F.concat(F.lit("4"), _digits(seed, 8, 7), _digits(seed, 9, 7))))
        .when(entity.isin("IBAN", "IBAN_CODE"), F.get(F.filter(checks, lambda x: is_valid_iban(x)), F.lit(0)))
        .when(entity == "US_SSN", F.concat(F.lpad((_number(seed, 10, 665) + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((_number(seed, 11, 99) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((_number(seed, 12, 9999) + 1).cast("string"), 4, "0")))
        .when(entity.isin("LOCATION", "ADDRESS"), F.concat((_number(seed, 13, 900) + 1).cast("string"), F.lit(" "), _pick(FAKE_STREETS, seed, 14), F.lit(" Street, "), _pick(FAKE_CITIES, seed, 15)))
        .when(entity == "DATE_TIME", F.date_add(F.lit("1970-01-01").cast("date"), _number(seed, 16, 18000)).cast("string"))
        .when(entity == "PROVIDER_NPI", F.concat((_number(seed, 17, 9) + 1).cast("string"), _digits(seed, 18, 9)))
        .when(entity == "MEDICAL_RECORD_NUMBER", F.concat(F.lit("MRN-"), _digits(seed, 19, 4), F.lit("-"), _letters(seed, 20, 4)))
        .when(entity == "HEALTH_PLAN_ID", F.concat(F.lit("HPI-"), _digits(seed, 24, 6)))
        .when(entity == "ICD10_CODE", F.concat(_letters(seed, 25, 1), _digits(seed, 26, 2), F.lit("."), _digits(seed, 27, 1)))
        .otherwise(F.concat(F.lit("["), entity, F.lit("_SYNTHETIC]")))
    )


def synthetic(text: Column, spans: Column, language: Column, consistent: bool = False) -> Column:
    """text with each span replaced by a made-up value, drawn for its place, or with consistent for its value."""

    def token(s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"]) if consistent else F.concat(F.md5(text), F.lit("/"), s["start"].cast("string"))
        # what the many branches share is worked out once
        parts = F.struct(s["entity_type"].alias("entity"), F.md5(F.concat(own, F.lit("/"), s["entity_type"])).alias("seed"), language.alias("language"))
        return let(parts, lambda v: fake_value(v["entity"], v["seed"], v["language"]))

    return replace_spans(text, spans, token)


def synthesize(df: DataFrame, text: str = "text", policy: Policy | None = None, language: str | None = None, name_lines: str | None = None, consistent: bool = False) -> DataFrame:
    """As mask, with made-up values in place of tokens."""
    rows = with_spans(df, text, policy, language, name_lines, "__spans")
    s, lang = F.col("__spans"), resolve_language(F.col(language) if language else None, F.col(text))
    return _result(rows, text, "__spans", F.when(F.size(s) > 0, synthetic(F.col(text), s, lang, consistent)).otherwise(F.col(text)))


def sanitize(df: DataFrame, policy: Policy | None = None, language: str | None = None, consistent: bool = False) -> DataFrame:
    """df with every string cell over two characters synthesized; other types pass through. language is one for all, or each cell's own is told."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            spans = detect(c, policy)
            lang = resolve_language(F.lit(language) if language else None, c)
            c = F.when(F.length(c) > SHORT_CELL, _sanitized(c, spans, lang, consistent)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _sanitized(c: Column, spans: Column, language: Column, consistent: bool) -> Column:
    return let(spans, lambda s: F.when(F.size(s) > 0, synthetic(c, s, language, consistent)).otherwise(c))

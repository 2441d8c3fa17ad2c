"""The language of a text as a column: given, aliased, or told by common words; English where nothing tells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.spans import let

# Languages supported and codes that stand for one of them.
SUPPORTED = "ca da de el en es fi fr hr it ja ko lt mk nb nl pl pt ro ru sl sv uk zh".split()
ALIASES = {"no": "nb", "zh-cn": "zh", "zh-tw": "zh"}

#: Common words of the languages that the built-in detector tells apart.
COMMON_WORDS = {
    "en": "the and of to in is that for with was on are this",
    "de": "der die und das ist nicht ein eine mit von zu den dem für",
    "fr": "le la les et des est une dans que qui pour pas du sur",
    "es": "el los las y que en una por con para del es se lo",
    "it": "il di che è una per con non sono gli della nel",
    "pt": "o os uma não para com que em do da dos mais",
    "nl": "het een van en is niet dat op te voor met zijn",
    "sv": "och att det som en på är av för med den inte",
}


def detect_by_words(text: Column) -> Column:
    """The language most of whose common words the text has, the first by code of equals; null if none has three."""
    low = F.lower(text)
    counts = [F.struct((-F.regexp_count(low, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(words.split())})(?!\p{{L}})"))).alias("n"), F.lit(code).alias("code")) for code, words in COMMON_WORDS.items()]
    return let(F.array_min(F.array(*counts)), lambda best: F.when(best["n"] <= -3, best["code"]))


def resolve_language(language: Column | None, text: Column, detector: Callable[[Column], Column] = detect_by_words) -> Column:
    """A supported code or alias as given; else what the detector says, if supported; else en. Never null."""

    codes = F.create_map(*[F.lit(x) for k in SUPPORTED for x in (k, k)], *[F.lit(x) for kv in ALIASES.items() for x in kv])

    def clamp(c: Column) -> Column:
        return F.try_element_at(codes, F.lower(F.trim(c)))

    given = clamp(language) if language is not None else F.lit(None).cast("string")
    return F.coalesce(given, F.when(text.rlike(r"(?U)\S"), clamp(detector(text))), F.lit("en"))

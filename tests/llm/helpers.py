"""Small tables that every operator must take: nulls, empty, blank and very long texts, ties, repeated rows, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.9)) % vocabulary}" for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) rows with every kind of trouble."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(n)]
    texts[5] = texts[3]
    texts[6] = texts[3].upper()
    texts += [None, "", "  \t\n ", "Été über 日本語 😀 mañana", "one", prose(rng, 30_000)]
    rows = [(i * 3 + 1, t, "en" if i % 3 else None, f"src{min(i % 5, 2)}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((rows[11][0], "another text of the same id", "de", "src1", 1))
    return rows


def clashing(df, *names):
    """df with more columns, by names that operators might use themselves."""
    from pyspark.sql import functions as F

    for n in names or ("id", "t", "row", "size", "part", "h", "block", "bin", "rank", "target", "fp", "host", "a.b"):
        df = df.withColumn(n, F.lit(n))
    return df

"""Names of persons: only what reads like a name and is known, or stands after a marker that announces one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.checksums import apply_sql, quoted
from veilspark.functions.spans import find_all, no_spans, spans_of

# A curated table of common given and family names, of our own choice.
KNOWN_NAMES = (
    "Aaron Abigail Adam Aisha Alan Albert Alejandro Alexander Alice Amanda Amit Amy Ana Andrea Andrew Angela Anita Anna Anthony Antonio "
    "Arjun Arthur Ashley Barbara Benjamin Betty Brandon Brian Carla Carlos Carol Caroline Catherine Charles Charlotte Chloe Christina "
    "Christopher Claire Daniel David Deborah Deepak Dennis Diana Diego Divya Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric "
    "Ethan Eva Fatima Fernando Frances Frank Gabriel Gary George Gloria Grace Gregory Hannah Harold Heather Helen Henry Ian Ines Isabel "
    "Isabella Ivan Jack Jacob James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Joshua Juan "
    "Judith Julia Julie Justin Karen Katherine Keith Kelly Kenneth Kevin Kimberly Larry Laura Lauren Lewis Linda Lisa Louis Lucas Lucia "
    "Luis Madison Margaret Maria Marie Marilyn Mario Mark Martha Martin Mary Matthew Megan Melissa Michael Michelle Miguel Mohammed Nancy "
    "Natalie Nathan Neha Nicholas Nicole Nikhil Noah Nora Oliver Olivia Omar Pamela Patricia Patrick Paul Pedro Peter Philip Pooja Priya "
    "Rachel Rahul Raj Ralph Ravi Raymond Rebecca Ricardo Richard Robert Roger Rohan Ronald Rosa Roy Russell Ruth Ryan Samantha Samuel Sandra "
    "Sanjay Sara Sarah Scott Sean Sergio Sharon Shirley Simon Sofia Sophia Stephanie Stephen Steven Sunita Susan Teresa Theresa Thomas "
    "Timothy Tyler Vanessa Victor Victoria Vijay Vikram Vincent Virginia Walter Wayne William Zachary Zoe "
    "Adams Ali Allen Anderson Bailey Baker Bennett Brooks Brown Campbell Carter Chen Clark Collins Cook Cooper Cox Cruz Davis Diaz Edwards "
    "Evans Fernandez Fischer Flores Foster Garcia Gomez Gonzalez Gray Green Gupta Hall Harris Hernandez Hill Howard Hughes Iyer Jackson "
    "Jenkins Johnson Jones Kelly Khan Kim King Kumar Lee Lopez Martinez Mehta Meyer Miller Mitchell Moore Morales Morgan Morris Muller "
    "Murphy Myers Nelson Nguyen Ortiz Parker Patel Perez Perry Peterson Phillips Powell Price Ramirez Reddy Reed Reyes Richardson Rivera "
    "Roberts Robinson Rodriguez Rogers Ross Russo Sanchez Sanders Schmidt Schneider Sharma Singh Smith Stewart Sullivan Taylor Thompson "
    "Torres Turner Verma Walker Ward Watson Weber White Williams Wilson Wood Wright Young"
).split()

# Markers before a name, words that open a run, words that never begin a header's name line.
MARKER = (
    r"(?i)(?:^|[\s:;,.!?\-])(?:"
    r"mr|mrs|ms|mx|dr|prof|sir|miss|madam|"
    r"sincerely|regards|best\s+regards|kind\s+regards|warm\s+regards|"
    r"submitted\s+by|written\s+by|prepared\s+by|signed\s+by|authored\s+by|"
    r"known\s+as|aka|names?:|contact:|author:|by:|from:|to:"
    r")\s*[:;,.]?\s*$"
)
SINGLE_WORD_MARKERS = ["name", "names", "mr", "mrs", "ms", "mx", "dr", "prof", "sir", "miss", "madam", "contact", "author", "sincerely", "regards", "aka"]
HEADER_FIRST_WORDS = [
    "dear", "hello", "hi", "hey", "attention", "attn", "to", "from", "re",
    "subject", "regarding", "date", "cc", "bcc", "page", "encl", "attachment",
    "the", "a", "an", "job", "title", "position", "resume", "curriculum", "vitae",
    "cv", "invoice", "report", "proposal", "contract", "statement", "application",
    "welcome", "notice", "summary", "project", "plan", "policy", "memo", "letter",
]
# What a name's token, a run of them and a way to reach a person look like.
TOKEN = r"^[A-Z][A-Za-z]*\z|^[A-Z]\.?\z"
RUN = r"\b(?:[A-Z][A-Za-z]*|[A-Z]\.)(?:\s+(?:[A-Z][A-Za-z]*|[A-Z]\.)){1,3}\b"
CONTACT = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|(?:\+?\d[\d\s\-().]{6,}\d)"
MARKER_WINDOW = 60
END_STOPS = r"\.+$"


def tokens_of(text: Column) -> Column:
    """The runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def is_known(token: Column, names: list[str] | None = None) -> Column:
    """A name of the table, in its case, a full stop at the end aside."""
    return apply_sql(token, f"regexp_replace(s, {quoted(END_STOPS)}, '') IN ({', '.join(quoted(n) for n in names or KNOWN_NAMES)})")


def has_name_marker(text: Column, start: Column) -> Column:
    """A marker ends right before the span, within the characters of the window."""
    window = F.substring(text, F.greatest(start - MARKER_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(MARKER_WINDOW)))
    return window.rlike(MARKER)


def verify_person_span(text: Column, start: Column, end: Column, names: list[str] | None = None) -> Column:
    """Every token is a capitalised word or an initial, and one is a known name or a marker stands before."""
    tokens = tokens_of(F.substring(text, start + 1, end - start))
    shaped = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(TOKEN))
    return shaped & (F.exists(tokens, lambda t: is_known(t, names)) | has_name_marker(text, start))


def name_line_tokens_ok(words: Column) -> Column:
    """Two to four capitalised words, the first none that opens a section, a letter or a memo."""
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
    return F.size(words).between(2, 4) & F.forall(bare, lambda t: t.rlike(TOKEN)) & ~F.lower(F.get(bare, F.lit(0))).isin(HEADER_FIRST_WORDS)


def has_contact(text: Column) -> Column:
    """A mail address or a number of telephone length."""
    return text.rlike(CONTACT)


def find_name_spans(text: Column, name_lines: Column | None = None, src: int = 1000, names: list[str] | None = None) -> Column:
    """PERSON spans: verified runs of two to four capitalised words, and candidate lines (array of start, end) of the right shape.

    A run that opens with a marker word is what follows it, if that has two words or more and a known name.
    """

    def moved(m: Column) -> Column:
        tokens = tokens_of(m["value"])
        first = F.get(tokens, F.lit(0))
        marked = F.lower(F.regexp_replace(first, r"\.+$", "")).isin(SINGLE_WORD_MARKERS)
        rest = F.slice(tokens, 2, 4)
        known = (F.size(rest) >= 2) & F.exists(rest, lambda t: is_known(t, names))
        begin = m["start"] + F.when(marked, F.length(first) + 1).otherwise(0)
        ok = ~marked | known
        return F.struct(begin.alias("start"), m["end"].alias("end"), m["value"].alias("value"), ok.alias("ok"))

    runs = F.filter(F.transform(find_all(text, RUN), moved), lambda m: m["ok"])
    runs = F.filter(runs, lambda m: verify_person_span(text, m["start"], m["end"], names))
    spans = F.coalesce(spans_of(runs, "PERSON", 0.9, src), no_spans())
    if name_lines is None:
        return spans
    good = F.filter(name_lines, lambda x: (x["end"] > x["start"]) & name_line_tokens_ok(tokens_of(F.substring(text, x["start"] + 1, x["end"] - x["start"]))))
    return F.concat(spans, F.coalesce(spans_of(good, "PERSON", 0.9, src + 1), no_spans()))

"""Scalar functions over text, as Column expressions. Lengths count code points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import shared_words

#: English function words that a content query leaves out.
STOPWORDS = (
    "a an the i me my mine we our ours you your yours he him his she her hers it its they them their theirs this that "
    "these those what which who whom whose when where why how am is are was were be been being have has had having do "
    "does did doing will would shall should can could may might must and or but if then else so than too very just "
    "about into over under again further once here there all any both each few more most other some such no nor not "
    "only own same of at by for with to from in on off out up down as also please"
).split()
#: Words of relative time, which windows handle and terms leave out.
TIME_WORDS = (
    "ago last past day days week weeks month months year years yesterday today tonight recently earlier recent "
    "currently now latest ever"
).split()
#: Words without weight in feedback and in summaries.
COMMON_WORDS = (
    "the and for you your with that this have has are was were can could would should will not but all any some there "
    "here what when where how why which from into about also just like they them their user assistant date"
).split()
FEEDBACK_STOPWORDS = [*COMMON_WORDS, *"great sure help recommendations questions information here's".split()]
#: File names that some systems reserve.
RESERVED = ["con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10))]
#: Number words, units in days, and how far "N units ago" may be off.
NUMBERS = dict(zip("a an one two three four five six seven eight nine ten eleven twelve few couple several".split(), [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 3, 2, 3], strict=True))
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
UNIT_PADS = {"day": 1, "week": 3, "month": 7, "year": 30}
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()

HANGUL = r"\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f"
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda t: t != "")


def plain_terms(text: Column) -> Column:
    """Tokens with Latin and Hangul parts of a word apart."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"([a-z0-9])([{HANGUL}])", "$1 $2"), f"([{HANGUL}])([a-z0-9])", "$1 $2")
    return F.filter(F.split(apart, NOT_WORD), lambda t: t != "")


def stem(token: Column) -> Column:
    """Without the first of ing, ed, es, s that the token ends with; null if none, or under three characters stay."""

    def cut(n: int) -> Column:
        return F.when(F.length(token) - n >= 3, token.substr(F.lit(1), F.length(token) - n))

    return reduce(lambda rest, s: F.when(token.endswith(s), cut(len(s))).otherwise(rest), ["s", "es", "ed", "ing"], F.lit(None).cast("string"))


def content_terms(text: Column) -> Column:
    """Distinct terms of a question: no function words, words of time or short words; stems added."""
    skip = [*STOPWORDS, *TIME_WORDS]
    kept = F.filter(plain_terms(text), lambda t: ~t.isin(skip) & ((F.length(t) > 2) | t.rlike("[0-9]")))
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.when(stem(t).isNotNull(), F.array(t, stem(t))).otherwise(F.array(t)))))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; empty and null: 0."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def slug(text: Column, fallback: str = "unnamed", limit: int = 80, reserved: Sequence[str] = tuple(RESERVED)) -> Column:
    """A file name of letters, digits, Hangul syllables, ``_`` and ``-``. One of ``reserved`` gets ``-x`` behind."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^a-zA-Z0-9\uac00-\ud7a3_-]+", "-"), "-+", "-"), "^-|-$", ""))

    def within(name: Column) -> Column:
        cut = F.substring(name, 1, limit)
        return F.when(name == "", fallback).when(F.length(name) > limit, F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), cut)).otherwise(name)

    # Through arrays of one, as else every mention of a name would replace in the whole text again.
    short = F.transform(F.array(name), within)
    return F.transform(short, lambda n: F.when(n.isin(list(reserved)), F.concat(n, F.lit("-x"))).otherwise(n))[0] if reserved else short[0]


def epoch_day(text: Column) -> Column:
    """Days since 1970 of the first YYYY/MM/DD; days past a month's end roll over; null without a date."""
    y, m, d = (F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{4})/(\d{2})/(\d{2})", i), F.lit("")), F.lit("9999")).cast("int") for i in (1, 2, 3))
    first = F.make_date(y + F.floor((m - 1) / 12).cast("int"), (F.pmod(m - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.when(text.rlike(r"\d{4}/\d{2}/\d{2}"), F.unix_date(first) + d - 1)


def body_epoch_day(body: Column) -> Column:
    """The day of a leading ``[date: YYYY/MM/DD``; null otherwise."""
    return F.when(body.rlike(r"^\[date:\s*\d{4}/\d{2}/\d{2}"), epoch_day(body))


def _number(word: Column) -> Column:
    word = F.trim(F.regexp_replace(word, r"\s+of$", ""))
    table = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.when(word.rlike(r"^\d+$"), word.try_cast("int")).otherwise(F.try_element_at(table, word))


def temporal_window(question: Column, ref: Column) -> tuple[Column, Column]:
    """(first day, last day) that a question means, given the epoch day it was asked on; nulls if none."""
    q = F.lower(question)
    count = r"(\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|few|couple(?:\s+of)?|several)"
    unit = r"(day|week|month|year)s?"
    days, pads = (F.create_map(*(F.lit(x) for pair in t.items() for x in pair)) for t in (UNIT_DAYS, UNIT_PADS))

    def extract(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))

    span, ago = rf"(?:past|last|previous)\s+{count}\s+{unit}", rf"{count}\s+{unit}\s+ago"
    n1, u1 = _number(extract(span, 1)), extract(span, 2)
    n2, u2 = _number(extract(ago, 1)), extract(ago, 2)
    weekday = extract(rf"last\s+({'|'.join(WEEKDAYS)})", 1)
    dow = F.pmod(ref + 4, F.lit(7))

    def back_to(day: Column) -> Column:
        back = dow - day
        return ref - F.when(back <= 0, back + 7).otherwise(back)

    named = back_to(F.array_position(F.array(*map(F.lit, WEEKDAYS)), weekday).cast("int") - 1)
    saturday = back_to(F.lit(6))
    rolling = F.try_element_at(days, extract(r"last\s+(week|month|year)\b", 1))
    target, pad = ref - n2 * F.try_element_at(days, u2), F.try_element_at(pads, u2)
    this = extract(r"this\s+(week|month)\b", 1)
    rules = [
        (n1.isNotNull(), ref - n1 * F.try_element_at(days, u1), ref),
        (n2.isNotNull(), target - pad, target + pad),
        (weekday.isNotNull(), named - 1, named + 1),
        (q.rlike(r"last\s+weekend"), saturday - 1, saturday + 2),
        (rolling.isNotNull(), ref - 2 * rolling, ref - F.floor(rolling / 2).cast("int")),
        (q.rlike(r"\byesterday\b"), ref - 2, ref),
        (this.isNotNull(), ref - F.when(this == "week", 7).otherwise(31), ref),
    ]
    none = F.lit(None).cast("int")
    start = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), none)
    end = reduce(lambda rest, r: F.when(r[0], r[2]).otherwise(rest), reversed(rules), none)
    return start.cast("int"), end.cast("int")


def has_temporal_intent(question: Column) -> Column:
    return temporal_window(question, F.lit(10971))[0].isNotNull()


def normalize_answer(text: Column) -> Column:
    """Lower case, marks as blanks, blanks as one. The caller applies NFKC where texts are not in that form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))


def token_f1(answer: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall over normalised words, as multisets; both empty: 1."""
    a, b = (F.filter(F.split(normalize_answer(x), " "), lambda t: t != "") for x in (answer, truth))
    shared = shared_words(F.array_join(a, " "), F.array_join(b, " "))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def split_sentences(text: Column) -> Column:
    """Parts at line ends and after ``.``, ``!`` or ``?`` before a blank; trimmed, none empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])(?U:\s+)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def split_of(identifier: Column) -> Column:
    """dev or test by the parity of an FNV-1a hash: the prime is odd, so only the low bits of characters count."""
    low = F.transform(F.split(identifier, ""), lambda c: F.ascii(c))
    parity = F.aggregate(low, F.lit(1), lambda acc, c: acc.bitwiseXOR(c.bitwiseAND(F.lit(1))))
    return F.when(parity == 0, "dev").otherwise("test")


def claim_ids(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"<!--\s*claim:(cl-[A-Za-z0-9_-]+)\s*-->"), F.lit(1))


def evidence_bullets(body: Column) -> Column:
    """Bullets of the first section whose heading starts with Evidence."""
    section = F.regexp_extract(body, r"(?ms)^##\s+Evidence[^\n]*\n(.*?)(?=^##\s|\z)", 1)
    lines = F.filter(F.split(section, "\n"), lambda s: s.rlike(r"^\s*[-*]\s+\S"))
    return F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^\s*[-*]\s+", "")))


def page_title(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def page_description(body: Column, limit: int = 200) -> Column:
    """First sentence of the Summary section, cut to ``limit`` characters."""
    section = F.trim(F.regexp_extract(body, r"(?ms)^##\s+Summary[^\n]*\n(.*?)(?=^##\s|\z)", 1))
    return F.nullif(F.substring(F.split(section, r"(?<=[.!?])\s+")[0], 1, limit), F.lit(""))


def truncate_bytes(text: Column, limit: int, marker: str = "") -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes, with a marker if anything was cut."""
    data = F.encode(text, "UTF-8")
    # A cut inside a character leaves one replacement character at the end.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, limit).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(marker)))


def safe_json(text: Column, path: str) -> Column:
    """A JSON value by path; null where the text is not JSON."""
    return F.get_json_object(text, path)


def snippet(body: Column, terms: Column, size: int = 12) -> Column:
    """``size`` words from the first that is a term, terms in brackets; ``...`` where words are left out."""
    words = F.filter(F.split(F.coalesce(body, F.lit("")), r"\s+"), lambda w: w != "")

    def is_term(w: Column) -> Column:
        return F.arrays_overlap(tokens(w), terms)

    at = F.coalesce(F.array_position(F.transform(words, is_term), True), F.lit(0))
    shown = F.transform(F.slice(words, F.greatest(at, F.lit(1)).cast("int"), size), lambda w: F.when(is_term(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    out = F.concat(F.when(at > 1, "... ").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) >= at + size, " ...").otherwise(""))
    return F.when(at > 0, out).otherwise(F.substring(F.coalesce(body, F.lit("")), 1, 120))


def content_hash(kind: Column, label: Column) -> Column:
    """SHA-256 of the JSON array of a type and its label in lower case with single blanks. NFKC is the caller's."""
    text = F.trim(F.regexp_replace(F.lower(label), r"(?U)\s+", " "))
    return F.sha2(F.to_json(F.array(kind, text)), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 if either is zero; an error if their lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a) * dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    return F.coalesce(same, F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def session_text(turns: Column, date: Column | None = None) -> Column:
    """``role: content`` lines of an array of (role, content), empty turns left out, with an optional date line."""
    lines = F.transform(F.filter(turns, lambda t: F.trim(F.coalesce(t["content"], F.lit(""))) != ""), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    body = F.array_join(lines, "\n")
    if date is None:
        return body
    full = reduce(lambda c, d: F.regexp_replace(c, rf"\({d[:3].title()}\)", f"({d[:3].title()}) {d.title()}"), WEEKDAYS, date)
    return F.when(date.isNull(), body).otherwise(F.concat(F.lit("[date: "), full, F.lit("]\n"), body))


def session_user_text(turns: Column) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: (t["role"] == "user") & (F.trim(F.coalesce(t["content"], F.lit(""))) != "")), lambda t: t["content"]), "\n")


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(Column.__or__, (text.rlike(p) for p in patterns))

"""Column functions on texts: cleaning, tokens, sentences, overlaps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: A word of at least two letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"
#: Sentence ends, except after initials and abbreviations such as "e.g." or "Dr.".
SENTENCE = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=[.!?…।؟])\s+"
LOSSLESS = r"[^ \t\n\r\f]+[ \t\n\r\f]*"
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,6}|PART\s+[IVXLCDM]+\s+\d+)\z"
BREAK = "<<<PAGE_BREAK>>>"


def normalize(t: Column) -> Column:
    """NUL to blank, LF line ends, no blanks before line ends (NFKC is :func:`nfkc`)."""
    t = F.translate(t, "\x00", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"(?md)[ \t\x0b\f]+$", "")


def nfkc(t: Column) -> Column:
    """Compatibility normal form; not in Spark SQL, hence an Arrow-batched function."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(t)


def dehyphenate(t: Column) -> Column:
    """Joins a line that ends in a hyphen with a next line that starts with a letter; a joined line is not looked at again."""
    return F.regexp_replace(t, r"(?md)^([^\n]*)-\n(\p{L}[^\n]*)$", "$1$2")


def squeeze(t: Column) -> Column:
    """Runs of line feeds and blanks to one; blank lines go as well."""
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\n\r\f\x0b]+\n", "\n"), r"[ \t]+", " ")


def is_page_number(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_NUMBER)


def norm_edge(t: Column) -> Column:
    """Non-joiners to blanks, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.replace(t, F.lit("‌"), F.lit(" ")), r"\s+", " "))


def norm_export(t: Column) -> Column:
    """As :func:`norm_edge`, but non-joiners vanish."""
    return F.trim(F.regexp_replace(F.replace(t, F.lit("‌"), F.lit("")), r"\s+", " "))


def lossless_tokens(t: Column) -> Column:
    """Tokens with the white space after them; their concatenation is the text from its first token on."""
    return F.regexp_extract_all(t, F.lit(LOSSLESS), F.lit(0))


def trim_to_tokens(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), "")


def terms(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))


def words3(t: Column) -> Column:
    """ASCII words of more than two characters, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(t), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2)


def _synonym_map() -> Column:
    pairs = []
    for k, vs in L.SYNONYMS.items():
        split = sorted({p for v in vs for p in v.replace("-", " ").split() if len(p) > 2})
        pairs += [F.lit(k), F.array(*map(F.lit, split))]
    return F.create_map(*pairs)


def expanded(t: Column) -> Column:
    """The distinct words of a text and the words of their synonyms."""
    base = F.array_distinct(words3(t))
    empty = F.array().cast("array<string>")
    more = F.flatten(F.transform(base, lambda x: F.coalesce(F.try_element_at(_synonym_map(), x), empty)))
    return F.array_distinct(F.concat(base, more))


def match_score(concept: Column, target: Column) -> Column:
    """Share of a concept's expanded words that are in ``target``; 0 without words."""
    c = expanded(concept)
    return F.when(F.size(c) == 0, 0.0).otherwise(F.size(F.array_intersect(c, target)) / F.size(c))


def coverage(q: Column, t: Column) -> Column:
    """Share of the distinct words of ``q`` (over two characters) that ``t`` has; 0 without words."""
    qs, ts = (F.array_distinct(F.filter(terms(x), lambda w: F.length(w) > 2)) for x in (q, t))
    return F.when(F.size(qs) == 0, 0.0).otherwise(F.size(F.array_intersect(qs, ts)) / F.size(qs))


def sentences(t: Column) -> Column:
    """Trimmed sentences; lines where there is only one."""
    clean = lambda a: F.filter(F.transform(a, F.trim), lambda x: F.length(x) > 0)
    parts = clean(F.split(t, SENTENCE))
    return F.when(F.size(parts) > 1, parts).otherwise(clean(F.split(t, r"\n+")))


def any_of(t: Column, needles: list[str]) -> Column:
    """Whether ``t`` contains one of the strings."""
    out = F.lit(False)
    for n in needles:
        out = out | t.contains(n)
    return out


def hits(t: Column, needles: list[str]) -> Column:
    """How many of the strings ``t`` contains."""
    return sum((t.contains(n).cast("int") for n in needles), F.lit(0))


def content_role(t: Column) -> Column:
    """definition, procedure, table, example or general: the first that fits."""
    low = F.lower(t)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (
        F.when(any_of(low, L.DEFINITIONAL) | low.rlike(r"\blevel\s+\d+\s+laborator"), "definition")
        .when(any_of(low, L.ROLE_PROCEDURE), "procedure")
        .when((count("\t") > 3) | (count("|") > 3) | ((count("-") > 10) & (count("\n") > 5)), "table")
        .when(any_of(low, L.ROLE_EXAMPLE), "example")
        .otherwise("general")
    )


def bundle_role(t: Column) -> Column:
    """The role that bundling falls back to."""
    low = F.lower(t)
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    by = dict(L.BUNDLE_ROLES)
    return (
        F.when(any_of(low, by["definition"]), "definition")
        .when(any_of(low, by["procedure"]), "procedure")
        .when((lines > 5) | t.contains("|"), "table")
        .when(any_of(low, by["example"]), "example")
        .otherwise("general")
    )


def indicators(t: Column) -> Column:
    """Names of the definition indicators in a text, in their fixed order."""
    low = F.lower(t)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in L.INDICATORS.items()]), lambda x: x.isNotNull())


def evidence(intent: Column, t: Column) -> Column:
    """STRUCT<ok BOOLEAN, reason STRING>: whether a text holds the kind of evidence an intent asks for."""
    low = F.lower(t)
    ok, why = F.lit(True), F.lit("intent not restricted")
    for name, (needles, pattern, reason) in L.EVIDENCE.items():
        fits = any_of(low, needles) if needles else F.lit(False)
        fits = fits | low.rlike(pattern) if pattern else fits
        ok = F.when(intent == name, fits).otherwise(ok)
        why = F.when(intent == name, F.when(fits, reason).otherwise(f"missing {reason}")).otherwise(why)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), why.alias("reason"))


def looks_like_index(t: Column) -> Column:
    """Pages of an index: many digits, more commas than sentences, dashes between page numbers."""
    low = F.lower(t)
    count = lambda p: F.regexp_count(low, F.lit(p))
    return (count("[0-9]") > F.length(low) * 0.15) & low.contains(" ") & (count(",") > count("[.]") * 2) & (low.contains("–") | low.contains("û"))

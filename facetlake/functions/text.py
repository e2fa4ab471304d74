"""Text functions as columns.

``lower`` mode is all built-in expressions. The faithful mode folds by NFKC and
full case folding first, which Spark has no function for: ``fold`` is an Arrow
function for that step alone, everything after it is built in again.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD, WORD2 = r"(?U)\w+", r"(?U)\b\w\w+\b"
#: Name suffixes are part of a concept: "c++" is not "c".
CONCEPT_WORD = r"(?U)\w+(?:[+#]+)?|[+#]+"
SENTENCE_END = r"(?<=[.!?])\s+"


@F.arrow_udf(StringType())
def fold(texts: pa.Array) -> pa.Array:
    """NFKC, then full case folding ("ß" becomes "ss")."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def casefolded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def words(folded: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))


def normalized(folded: Column) -> Column:
    """Words of a folded text, joined by one space."""
    return F.array_join(words(folded), " ")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def label_key(folded: Column) -> Column:
    """A label with its punctuation: only case, width and white space are ignored."""
    return collapsed(folded)


def concept_key(folded: Column) -> Column:
    return F.array_join(words(folded, CONCEPT_WORD), " ")


def tokens(folded: Column) -> Column:
    """Words of two characters or more, for term weights."""
    return words(normalized(folded), WORD2)


def has_term(normalized_text: Column, term: str) -> Column:
    """The normalized term as whole words, with or without a plural s."""
    padded = F.concat(F.lit(" "), normalized_text, F.lit(" "))
    return padded.contains(f" {term} ") | padded.contains(f" {term}s ")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


#: As SENTENCE_END, but neither inside nor right after "e.g.".
EVIDENCE_END = r"(?i)(?<=[.!?])(?<!\be\s{0,9}\.\s{0,9}g\s{0,9}\.)(?!(?<=\be\s{0,9}\.)\s{0,9}g\s{0,9}\.)\s+"


def evidence(title: Column | None, abstract: Column) -> Column:
    """Numbered sources of a text: T0 the title, A0, A1, ... the sentences; "e.g." ends no sentence."""
    numbered = F.transform(F.split(abstract, EVIDENCE_END), lambda s, i: F.struct(F.concat(F.lit("A"), i.cast("string")).alias("evidence_id"), F.lit("abstract").alias("source"), s.alias("evidence")))
    if title is None:
        return numbered
    return F.concat(F.array(F.struct(F.lit("T0").alias("evidence_id"), F.lit("title").alias("source"), title.alias("evidence"))), numbered)


def doi(raw: Column) -> Column:
    """A DOI without its resolver's address or "doi:", in small letters."""
    return F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def numeric_id(raw: Column, low: int = 1000, high: int = 2100) -> Column:
    """An integer made of digits alone and within range, else null (years of publication)."""
    digits = F.when(F.regexp_like(raw.cast("string"), F.lit("^[0-9]{1,9}$")), raw.cast("string").cast("int"))
    return F.when(digits.between(low, high), digits)


def zoned_time(raw: Column) -> Column:
    """An ISO-8601 time; null if it can't be read or names no zone."""
    return F.when(F.regexp_like(raw, F.lit(r"(Z|[+-]\d\d:?\d\d)$")), F.try_to_timestamp(raw))


def iso_utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_path(name: Column) -> Column:
    """A relative path without its first component; null if it is absolute or climbs."""
    clean = F.regexp_replace(name, r"\\", "/")
    parts = F.split(clean, "/")
    bad = F.startswith(clean, F.lit("/")) | F.array_contains(parts, "..") | F.regexp_like(clean, F.lit("^[A-Za-z]:"))
    rest = F.array_join(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & (p != ".")), "/")
    return F.when(~bad & (rest != ""), rest)

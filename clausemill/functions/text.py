"""Scalar text functions as column expressions.

Java's classes are made Unicode-aware by ``(?U)``; the four separators U+001C to
U+001F, which it does not count as blanks, are named.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

BLANK = r"(?U)[\s\x1c-\x1f]"
BLANKS = BLANK + "+"
#: Line separators, a carriage return with line feed first.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Patterns and markers of the identifier classes, in order of replacement.
IDENTIFIERS = (
    ("email", r"(?iuU)\b[A-ZſKİı0-9._%+-]+@[A-ZſKİı0-9.-]+\.[A-ZſKİı]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"(?U)\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
)
# Kinds of line, tried in this order.
EXHIBIT = r"(?iuU)^(?:exhibit|schedule|appendix)\b"
HEADING = (
    r"(?iuU)^(?:#{1,3}\s+.+|article\s+[ivxlcdm0-9]+(?:\s*[.:-].*)?|section\s+[0-9]+(?:\.[0-9]+)*(?:\s*[.:-].*)?"
    r"|(?:exhibit|schedule|appendix)\s+[a-z0-9]+(?:\s*[.:-].*)?|[0-9]+\.(?:[0-9]+(?:\.[0-9]+)*\.?)?\s+[A-Z].+)$"
)


def redact(text: Column) -> Column:
    """Identifiers replaced by their markers, one class after the other."""
    for _, pattern, marker in IDENTIFIERS:
        text = F.regexp_replace(text, pattern, marker)
    return text


def redaction_codes(text: Column) -> Column:
    """Classes that were replaced, in order; each is looked for in what the one before left."""
    flags = []
    for code, pattern, marker in IDENTIFIERS:
        flags.append(F.when(F.regexp_like(text, F.lit(pattern)), F.lit(code)))
        text = F.regexp_replace(text, pattern, marker)
    return F.array_compact(F.array(*flags))


@F.pandas_udf(StringType())
def _compatibility(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None and not t.isascii() else t)


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts of ASCII only stay in the JVM's hands."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only | text.isNull(), text).otherwise(_compatibility(F.when(~ascii_only, text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    return F.split(text, LINES)


def collapse_lines(text: Column) -> Column:
    """Runs of blanks within a line become one, lines are trimmed, outer blank lines go."""
    joined = F.array_join(F.transform(lines(text), lambda x: strip(F.regexp_replace(x, BLANKS, " "))), "\n")
    return strip(joined)


def normalize_whitespace(text: Column) -> Column:
    return collapse_lines(nfkc(text))


def join_pages(pages: Column) -> Column:
    """Texts of pages (array, in order) with a blank line between them; empty pages stay."""
    return strip(F.array_join(F.transform(pages, collapse_lines), "\n\n"))


def words(text: Column) -> Column:
    """Lower-case words between blanks; none for a blank text."""
    bare = strip(F.lower(text))
    return F.when(F.length(bare) > 0, F.split(bare, BLANKS)).otherwise(F.array().cast("array<string>"))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; all words together where there are fewer; none without words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return bound(words(text), of)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """The set of ``shingles`` as sorted 64-bit hashes, without building their strings."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(runs)))

    return bound(words(text), of)


def word_hashes(text: Column) -> Column:
    """The ``words`` as 64-bit hashes, in order."""
    return F.transform(F.filter(F.split(F.lower(text), BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets: 1 where both are empty, 0 where one is."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / union)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def phrases(found: Column) -> Column:
    """Neighbouring tokens in pairs, repeats kept."""

    def of(t: Column) -> Column:
        n = F.size(t)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.element_at(t, i), F.lit(" "), F.try_element_at(t, i + 1)))
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)

    return bound(found, of)


def overlap_score(query: Column, block: Column) -> Column:
    """Share of the query's tokens in the block, a quarter more for each of its phrases, at most 1."""
    q = tokens(query)
    distinct = F.array_distinct(q)
    base = F.size(F.array_intersect(distinct, tokens(block))) / F.size(distinct)
    bonus = bound(F.lower(block), lambda low: F.size(F.filter(phrases(q), lambda p: F.contains(low, p)))) * F.lit(0.25)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + bonus))


def classify_line(line: Column) -> Column:
    """exhibit, table, heading or paragraph."""
    bare = F.regexp_replace(line, r"^[# ]+", "")
    return F.when(F.regexp_like(bare, F.lit(EXHIBIT)), "exhibit").when(F.contains(line, F.lit("|")), "table").when(F.regexp_like(line, F.lit(HEADING)), "heading").otherwise("paragraph")


def heading_text(line: Column, kind: Column) -> Column:
    return F.when(kind.isin("heading", "exhibit"), strip(F.regexp_replace(line, r"^[# ]+", "")))


def family_bucket(family: Column, salt: Column) -> Column:
    """0 to 99 by hash of salt and family."""
    return F.conv(F.substring(F.sha2(F.concat(salt, F.lit(":"), family), 256), 1, 8), 16, 10).cast("bigint") % 100


def assign_split(bucket: Column, train: Column, validation: Column) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def normalize_split(name: Column) -> Column:
    return F.lower(F.trim(F.translate(name, "_-", "  ")))


def combined_source_text(texts: Column) -> Column:
    """Texts of a map in order of their keys, each under its label."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(texts)), lambda e: F.concat(F.lit("["), e["key"], F.lit("]\n"), strip(e["value"]))), "\n\n")


def json_object(text: Column) -> Column:
    """The JSON object in raw or fenced output as text, null where there is none."""
    bare = strip(text)
    fence = F.instr(bare, "```")
    rest = F.substr(bare, fence + 3)
    rest = F.when(F.lower(F.substring(rest, 1, 4)) == "json", F.substr(rest, F.lit(5))).otherwise(rest)
    stop = F.instr(rest, "```")
    fenced = strip(F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest))
    first = F.instr(bare, "{")
    last = F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    braces = F.when((first > 0) & (F.instr(bare, "}") > 0) & (last > first), F.substr(bare, first, last - first + 1))
    good = lambda c: F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)
    return F.coalesce(F.when(fence > 0, good(fenced)), good(braces))


def media_type(path: Column, content: Column | None = None) -> Column:
    """pdf by magic number, else by suffix; null where unknown."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    named = F.when(suffix.isin(".md", ".markdown"), "markdown").when(suffix == ".txt", "text").when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx")
    if content is None:
        return named
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").otherwise(F.when(suffix.isin(".md", ".markdown", ".txt"), named))

"""Column expressions for reply text: fence stripping, record and field splitting,
CSV quoting.  All are built-in regex functions, so they run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One CSV field, with the quote rule of Python's csv reader: a quote opens a
# quoted field only as the field's first character; inside it "" is a quote
# and newlines are data; after the closing quote the rest up to the next
# comma is plain text; a quote never closed runs to the end of the text.
# Elsewhere quotes are ordinary characters.  Possessive quantifiers keep
# matching linear (no backtracking blow-up on long quoted rows).
FIELD = '(?:"(?:[^"]|"")*+(?:"[^,\\r\\n]*+|\\z)|(?:[^,\\r\\n"][^,\\r\\n]*+)?)'
# A record: fields separated by commas, up to a newline outside quotes.
RECORD_RE = FIELD + "(?:," + FIELD + ")*+"
# One field after a leading comma (every match consumes its comma).
FIELD_RE = ",(" + FIELD + ")"
QUOTED_RE = '^"((?:[^"]|"")*+)(?:"(.*))?\\z'
FENCE = "```"
# Fixed value: the characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace as Python's str.strip() does (btrim with
    the explicit character set: no regex per value)."""
    return F.btrim(c, F.lit(PY_WHITESPACE_CHARS))


def strip_fences(c: Column) -> Column:
    """Strip; drop an opening fence line through its first newline (no newline:
    unchanged); if the text ends with a fence, cut it and strip again."""
    t = py_strip(c)
    t = F.when(t.startswith(FENCE) & t.contains("\n"),
               F.regexp_replace(t, "^```[^\\n]*\\n", "")).otherwise(t)
    return F.when(t.endswith(FENCE), py_strip(F.regexp_replace(t, "```\\z", ""))).otherwise(t)


def split_records(c: Column) -> Column:
    """Records separated by newlines outside quotes; blank lines produce nothing."""
    return F.filter(F.regexp_extract_all(c, F.lit(RECORD_RE), 0), lambda r: r != "")


def split_fields(record: Column) -> Column:
    """Fields of one record with CSV unquoting ("" -> ") and stripping."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD_RE), 1)
    return F.transform(raw, lambda f: py_strip(
        F.when(f.startswith('"'),
               F.concat(F.replace(F.regexp_extract(f, QUOTED_RE, 1), F.lit('""'), F.lit('"')),
                        F.regexp_extract(f, QUOTED_RE, 2)))
        .otherwise(f)))


def csv_quote(v: Column) -> Column:
    """Minimal CSV quoting of one text value (quote when it holds , \" CR or LF)."""
    return F.when(v.rlike('[,"\\r\\n]'),
                  F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(cols: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_quote(F.coalesce(c.cast("string"), F.lit(""))) for c in cols])


def py_title(c: Column) -> Column:
    """Python's str.title(): a cased letter is upper-cased when the character before
    it is not a cased letter, every other cased letter is lower-cased ('2nd' ->
    '2Nd', "o'neil" -> "O'Neil").  Per character over the (short) text."""
    chars = F.split(c, "")
    cased = "[\\p{Lu}\\p{Ll}\\p{Lt}]"
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, i).rlike(cased), F.upper(ch)).otherwise(F.lower(ch))), "")

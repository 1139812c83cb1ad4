"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Unicode counts as white space, plus the four information
# separators U+001C..U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def split_lines(col: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    return F.split(F.regexp_replace(col, f"(?:{_LINE_BREAK})\\z", ""), _LINE_BREAK)


def text_snippet(text: Column, target: Column, around: int = 4) -> Column:
    """Lines round the first line containing ``target`` in any letter case, "" if none does."""
    lines = split_lines(text)
    hit = F.array_position(F.transform(lines, lambda s: F.lower(s).contains(F.lower(target))), True)
    first = F.greatest(hit - around, F.lit(1))
    block = F.slice(lines, first.cast("int"), (hit + around - first + 1).cast("int"))
    return F.when(hit == 0, "").otherwise(F.array_join(block, "\n"))


def fix_mojibake(col: Column) -> Column:
    """Undo UTF-8 read as Latin-1; text that cannot be such a misreading stays."""
    latin1 = col.rlike(r"^[\x{00}-\x{FF}]*\z")
    repaired = F.try_validate_utf8(F.encode(col, "ISO-8859-1").cast("string"))
    return F.when(latin1, F.coalesce(repaired, col)).otherwise(col)


def garble(col: Column) -> Column:
    """The misreading ``fix_mojibake`` undoes (used to check it)."""
    return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")


def url_domain(url: Column) -> Column:
    """Authority of a URL with port and user part; "unknown" when there is none."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def escape_markup(col: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out

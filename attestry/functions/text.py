"""Column helpers for text, dates, ids and labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _unchanged() -> str:
    """A character class of some scripts, without what NFKC changes or may join to what stands before."""
    blocks = (range(0x180), range(0x2010, 0x2028), range(0x3000, 0x3100), range(0x4E00, 0xA000), range(0xAC00, 0xD7A4))
    runs: list[list[int]] = []
    for c in (c for block in blocks for c in block if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.category(chr(c)).startswith("M")):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


UNCHANGED = _unchanged()


def ascii_only(text: Column) -> Column:
    """Whether each character is one byte: known by counting, without a pattern."""
    return F.octet_length(text) == F.length(text)


def compatible(text: Column | str) -> Column:
    """NFKC; texts of characters that it leaves alone skip Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = ascii_only(text) | text.rlike(rf"\A{UNCHANGED}*+\z")
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))


def normal(text: Column | str) -> Column:
    """NFKC and lower case."""
    return F.lower(compatible(text))


def assertion_key(text: Column | str) -> Column:
    """For comparing statements: NFKC, no white space, no closing stops at either end; case stays."""
    return F.regexp_replace(F.regexp_replace(compatible(text), r"(?U)\s+", ""), r"^[。.!！]+|[。.!！]+$", "")


def collapsed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_id(*cols: Column | str) -> Column:
    """A digest of ordered fields; nulls are written out, so that fields can't run into each other."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def canonical_date(text: Column | str) -> Column:
    """The date of a text written exactly as YYYY-MM-DD, else null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def escaped_markdown(text: Column | str) -> Column:
    """Text that Markdown shows as it is: entities for &, < and >, a backslash before each mark, a blank for each line end."""
    text = F.col(text) if isinstance(text, str) else text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return F.replace(F.regexp_replace(text, r"([\\`*_{}\[\]#|])", r"\\$1"), F.lit("\n"), F.lit(" "))


def json_size(struct: Column, keys: int | Column, ignore_nulls: bool = False) -> Column:
    """Length of a flat object's JSON with a blank after each comma and colon."""
    return F.length(F.to_json(struct, {"ignoreNullFields": str(ignore_nulls).lower()})) + 2 * keys - 1

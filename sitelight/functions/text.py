"""Word-window chunking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelight import schema as S

# Fixed value: the white space of the text contract. Java's plain \s is ASCII
# only, and its Unicode variant also takes U+0085, so the class is spelled out.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = SPACE + "+"
EDGE_SPACES = f"^{SPACE}+|{SPACE}+$"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(SPACE.replace("[", "[^", 1))


def chunk_words(
    text: Column,
    size: int = S.CHUNK_WORDS,
    overlap: int = S.CHUNK_OVERLAP,
    min_chars: int = S.MIN_CHUNK_CHARS,
) -> Column:
    """Array of overlapping word windows; windows shorter than ``min_chars``
    are dropped before numbering."""
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than chunk size")
    step = size - overlap

    def windows(tokens: Column) -> Column:
        extra = F.ceil((F.size(tokens) - size) / F.lit(float(step))).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), extra) * step, F.lit(step))
        joined = F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, size), " "))
        return F.filter(joined, lambda c: (F.size(tokens) > 0) & (F.length(c) >= min_chars))

    # ``transform`` over a one-element array binds the token array once.
    bound = F.transform(F.array(words(text)), windows)
    return F.coalesce(F.element_at(bound, 1), F.array().cast("array<string>"))

"""Column expressions for the tokeniser. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a word, what is dropped, and how long a word may be.
NEWLINE = "\n"
SPACE = " "
TAB = "\t"
IGNORED = "\r"
MAX_WORD_BYTES = 999


def split_lines(text: Column) -> Column:
    """A document's lines. Only a newline ends a line."""
    return F.split(text, NEWLINE)


def split_words(line: Column) -> Column:
    """Words between spaces and tabs; holds empty strings at runs of separators.

    Carriage returns vanish, also from inside a word; every other character,
    vertical tab or no-break space included, belongs to the word.
    """
    kept = F.replace(line, F.lit(IGNORED), F.lit(""))
    return F.split(F.replace(kept, F.lit(TAB), F.lit(SPACE)), SPACE)


def truncate_word(word: Column, limit: int = MAX_WORD_BYTES) -> Column:
    """The longest prefix of whole characters that fits into ``limit`` bytes."""
    raw = word.cast("binary")
    head = F.length(F.substring(raw, 1, limit).cast("string"))
    # A continuation byte (10xxxxxx) right after the cut: the cut split a character.
    after = F.conv(F.hex(F.substring(raw, limit + 1, 1)), 16, 10).cast("int")
    split_char = F.when(after.between(0x80, 0xBF), 1).otherwise(0)
    return F.when(F.octet_length(word) > limit, F.substr(word, F.lit(1), head - split_char)).otherwise(word)

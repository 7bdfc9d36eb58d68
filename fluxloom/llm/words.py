"""The word rule that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in blocks of about ``size`` bytes that end where a word ends, so that ``bytes.split`` of the blocks
    gives the words of the whole. A longer word stays whole."""
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end


def row_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _text): each row as one struct beside its id as a long and its text.

    So an operator's own columns cannot clash with those of ``docs``; ``select("_row.*")`` brings these back.
    """
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))

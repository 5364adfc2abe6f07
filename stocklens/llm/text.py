"""Column expressions shared by the document operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between words: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_count(text: str) -> Column:
    """Number of words between white space; null counts as empty."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def crc_fold(doc_id: str, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo the number of folds (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds

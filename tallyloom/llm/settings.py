"""Production parameters that the queries and the corpus pipeline share."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token ids of the vocabulary file below 49,408; 16 bits each.
VOCABULARY = 49_408


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


#: A text of this score or more passes as good.
GOOD = 0.3


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5

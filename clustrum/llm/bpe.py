"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before they are encoded: no match of the pre-splitting pattern runs from a
character that is not white space into one that is (white space can only lead a match), so cutting there changes
no match. Ids are decoded to raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Blanks that every engine takes as white space; what is not white space in Python is none for tiktoken.
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, built once for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int):
    """`text` in pieces of about `size` characters, cut only at safe boundaries."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc, size: int = 1 << 16) -> list[int]:
    """Ids of a whole text."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids with keep_ids) of each row of (doc_id, text).

    A null text is empty: no ids, digests of the empty string. The rank file must be readable at the same path on
    every executor, as an installed package is.
    """

    def work(ids, texts):
        enc = encoding(rank_file, pattern)
        n, digests, decoded, kept = [], [], [], []
        for text in texts:
            tokens = encode(text or "", enc)
            n.append(len(tokens))
            digests.append(hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest())
            decoded.append(hashlib.sha256(enc.decode_bytes(tokens)).hexdigest())
            if keep_ids:
                kept.append(np.array(tokens, np.int32))
        return [ids, n, digests, decoded, *([kept] if keep_ids else [])]

    return map_columns(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""), rows=256,
    )


def decode_ids(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes): the raw bytes, whether or not they are valid UTF-8. Null ids give null."""

    def work(ids, lists):
        enc = encoding(rank_file, pattern)
        return [ids, [None if x is None else enc.decode_bytes(x) for x in lists]]

    return map_columns(tokens.select(F.col("doc_id").cast("long"), "ids"), work, "doc_id long, bytes binary")


def op8_query(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from .common import table

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

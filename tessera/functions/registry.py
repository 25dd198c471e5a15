"""Vectorised functions, also under names that SQL can use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T


@F.pandas_udf(T.StringType())
def blake2b_hex(values: pd.Series) -> pd.Series:
    """BLAKE2b with 32 bytes of each binary value, as hexadecimal digits; null stays null."""
    return values.map(lambda v: None if v is None else hashlib.blake2b(v, digest_size=32).hexdigest())


def decoder(charset: str = "utf-8"):
    """A function of binary values to text in ``charset``, bad bytes replaced."""

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode(charset, errors="replace"))

    return decode


#: Characters or ids of which a batch's texts or ids are held at once.
PIECE = 1 << 18


def in_pieces(batches: Iterator[pd.Series], one, limit: int = PIECE) -> Iterator[pd.Series]:
    """``one`` of each value, handed on whenever about ``limit`` of the values' elements are through: what is held does not follow the batches' size."""
    for some in batches:
        done, held = [], 0
        for x in some:
            done.append(one(x))
            held += 0 if x is None else len(x)
            if held >= limit:
                yield pd.Series(done, dtype=object)
                done, held = [], 0
        if done:
            yield pd.Series(done, dtype=object)


def bpe_encoder(tokenizer: str):
    """A function of texts to the ids of a tokenizers file; one tokenizer a process, one text at a time in it."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        yield from in_pieces(texts, lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, np.int32))

    return encode


def bpe_decoder(tokenizer: str, skip_special_tokens: bool = False):
    @F.pandas_udf(T.StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        yield from in_pieces(ids, lambda x: t.decode(np.asarray(x).tolist(), skip_special_tokens=skip_special_tokens))

    return decode


def register_sql(spark: SparkSession) -> None:
    """``blake2b_hex`` and ``decode_utf8`` for SQL."""
    spark.udf.register("blake2b_hex", blake2b_hex)
    spark.udf.register("decode_utf8", decoder())


def canonical_sha256(text: str) -> str:
    """SHA-256 of a JSON text written again with sorted keys and no blanks, so that layout and key order do not count."""
    return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json_digest(texts: pd.Series) -> pd.Series:
    """``canonical_sha256`` of a column; null stays null, and what is no JSON is null."""

    def one(x):
        try:
            return None if x is None else canonical_sha256(x)
        except ValueError:
            return None

    return texts.map(one)

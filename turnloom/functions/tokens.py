"""Token ids by a public byte-pair vocabulary, whose file is a parameter; nothing is learnt here."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how the vocabulary's authors cut a text before pieces are merged.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces of bytes with the rank at which each is merged, from a file of base64 pieces and ranks that the driver can read."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def encoder(spark: SparkSession, path: str) -> Callable[[Column | str], Column]:
    """A function from a text column to its token ids (array<int>); null gives none.

    The driver reads the ranks, some 50,000 pieces, and broadcasts them; a worker builds
    its encoding once. Marks of special tokens are read as ordinary text.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    built: dict = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if "e" not in built:
            import tiktoken

            built["e"] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={})
        return pd.Series([built["e"].encode_ordinary(x or "") for x in texts], dtype=object)

    return encode


def token_counts(df: DataFrame, encode: Callable[[Column | str], Column], texts: dict[str, Column]) -> DataFrame:
    """Adds a number of tokens for each named text."""
    return df.withColumns({name: F.size(encode(text)).cast("long") for name, text in texts.items()})


def merge_plainly(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One piece's ids by the rule itself: of all neighbours the pair of least rank is merged, until none has a rank."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[k] + parts[k + 1], len(ranks)), k) for k in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]

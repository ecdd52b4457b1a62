"""Token counts with a public tokenizer; the vocabulary stays where it is installed and its path is a parameter."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts. Special-token strings are ordinary text."""

    def count(values: pa.Array) -> pa.Array:
        encode = _encoding(vocabulary).encode_ordinary
        return pa.array([len(encode(v)) if v else 0 for v in values.to_pylist()], pa.int64())

    return F.arrow_udf(count, T.LongType())(text)

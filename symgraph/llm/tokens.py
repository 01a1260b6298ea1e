"""Token counts by a public tokenizer."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Folder of the public vocabulary files, and the one used unless another is named.
TOKENIZERS = os.environ.get("SYMGRAPH_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = f"{TOKENIZERS}/byte_bpe_50k.json"


def token_counts(text: str, path: str = TOKENIZER) -> Column:
    """The number of tokens of each whole text by a byte-level BPE vocabulary, 0 for null and empty ones."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        from symgraph.llm.bpe import encoder, groups

        return pd.Series([n for g in groups(texts.tolist()) for n in encoder(path).count(g)], index=texts.index, dtype="int64")

    return count(F.col(text))

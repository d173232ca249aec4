"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = os.environ.get("CAIRN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def token_counts(texts: DataFrame, text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``texts`` without ``text_col`` and with ``tokens`` (BIGINT). A null text has 0; texts are read whole."""
    rest = [c for c in texts.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for pdf in batches:
            sizes: list[int] = []
            texts = pdf[text_col].fillna("").tolist()
            for at in range(0, len(texts), 64):
                sizes += [len(e.ids) for e in tok.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
            yield pdf[rest].assign(tokens=sizes)

    return texts.mapInPandas(count, f"{schema}, tokens bigint")

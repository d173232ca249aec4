"""Subword encoding by a ranked merge table.

Merge tables are read from public tokenizer files; none is trained here. A word starts as its characters; rules apply in rank
order, each in one pass from left to right. What no rule touches stays a single-character token.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("CAIRN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
Merges = list[tuple[str, str]]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level tokenizer file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str = TOKENIZER) -> Merges:
    """The rules of a tokenizer file over whole characters of any script, without markers for spaces. Rules over parts of a
    character have no place here: words start as characters."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)["model"]["merges"]
    pairs = [tuple(r.split(" ")) if isinstance(r, str) else tuple(r) for r in rules]
    byte = byte_alphabet()

    def text(symbol: str) -> str | None:
        try:
            out = bytes(byte[c] for c in symbol).decode()
        except (KeyError, UnicodeDecodeError):
            return None
        return out if out.isprintable() and not any(c.isspace() for c in out) else None

    read = [(text(a), text(b)) for a, b in pairs]
    return [(a, b) for a, b in read if a and b]


def characters(tokens: DataFrame) -> list[str]:
    """Every character of the collection, in order; one row each, so a bounded list."""
    each = tokens.select(F.explode("tokens").alias("w")).distinct().select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").distinct()
    return sorted(r["c"] for r in each.collect())


def merges_table(spark: SparkSession, merges: Merges) -> DataFrame:
    """(rank, left, right, new)."""
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string, new string")


def vocabulary(merges: Merges, chars: Iterable[str] = ()) -> list[str]:
    """Tokens by id: the characters of the rules and of the collection (``chars``) in order, then what each rule makes."""
    chars = sorted({c for a, b in merges for c in a + b} | set(chars))
    return list(dict.fromkeys([*chars, *(a + b for a, b in merges)]))


def vocabulary_table(spark: SparkSession, merges: Merges, chars: Iterable[str] = ()) -> DataFrame:
    """(token, id)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary(merges, chars))], "token string, id int")


def apply_merge(symbols: list[str], left: str, right: str) -> list[str]:
    """Every occurrence of the pair joined, in one pass from left to right."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def encode_word(word: str, ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """All rules in rank order. Passes that would change nothing are skipped: the next rule is the least rank above the last
    one among the pairs that are there."""
    symbols, last = list(word), -1
    while len(symbols) > 1:
        best, pair = None, None
        for p in zip(symbols, symbols[1:]):
            for r in ranks.get(p, ()):
                if r > last and (best is None or r < best):
                    best, pair = r, p
        if pair is None:
            break
        symbols, last = apply_merge(symbols, *pair), best
    return symbols


def rank_of(merges: Merges) -> dict[tuple[str, str], list[int]]:
    ranks: dict[tuple[str, str], list[int]] = {}
    for i, p in enumerate(merges):
        ranks.setdefault(p, []).append(i)
    return ranks


def encode(tokens: DataFrame, merges: Merges, remember: int = 200_000) -> DataFrame:
    """(doc_id, tokens) with every pre-token encoded. Each task remembers the words it has met, so a word is encoded once per
    task and texts never move."""
    ranks = rank_of(merges)
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            out = []
            for words in pdf["tokens"]:
                row: list[str] = []
                for w in words:
                    if w not in known:
                        if len(known) >= remember:
                            known.clear()
                        known[w] = encode_word(w, ranks)
                    row += known[w]
                out.append(row)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": out})

    return tokens.select("doc_id", "tokens").mapInPandas(run, f"doc_id {kind}, tokens array<string>")


def encode_ids(encoded: DataFrame, merges: Merges, chars: Iterable[str] = ()) -> DataFrame:
    """(doc_id, ids): token ids; tokens out of the vocabulary fall back to their characters, unknown ones are dropped."""
    ids = {t: i for i, t in enumerate(vocabulary(merges, chars))}
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[i for t in ts for i in ([ids[t]] if t in ids else [ids[c] for c in t if c in ids])] for ts in pdf["tokens"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": out})

    return encoded.select("doc_id", "tokens").mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, merges: Merges, chars: Iterable[str] = ()) -> DataFrame:
    """(doc_id, text): tokens joined by a space, unknown ids skipped; no space before the first position only, so a skipped
    first id leaves one."""
    tokens = vocabulary(merges, chars)
    kind = dict(ids.dtypes)["doc_id"]

    def text(row: list[int]) -> str:
        return "".join((" " if at else "") + tokens[i] for at, i in enumerate(row) if 0 <= i < len(tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [text(list(r)) for r in pdf["ids"]]})

    return ids.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def pair_frequencies(tokens: DataFrame) -> DataFrame:
    """(left, right, freq): adjacent characters of all words, weighted by the words' frequency."""
    words = tokens.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")
    pairs = words.where(F.length("w") > 1).select("w", "freq", at).select(F.expr("substring(w, i, 1)").alias("left"), F.expr("substring(w, i + 1, 1)").alias("right"), "freq")
    return pairs.groupBy("left", "right").agg(F.sum("freq").alias("freq"))


def best_pair(pairs: DataFrame, min_frequency: int = 2) -> DataFrame:
    """The most frequent pair; ties go to the least concatenation, then the least left part. None below ``min_frequency``."""
    return pairs.where(F.col("freq") >= min_frequency).orderBy(F.desc("freq"), F.concat("left", "right"), "left").limit(1)

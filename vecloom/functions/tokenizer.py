"""The prompt tokenizer: words into grapheme clusters, merged by rank; vocabularies are small parameters."""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vecloom.functions.text import START, STOP, WORD_END
from vecloom.runtime import ship
from vecloom.types import EngineError


def read_merges(lines: list[str]) -> dict[tuple[str, str], int]:
    """Rank of each pair: its line number. Empty lines and lines that begin with # count but hold none."""
    out: dict[tuple[str, str], int] = {}
    for rank, line in enumerate(x for x in lines if x):
        if line.startswith("#"):
            continue
        pair = tuple(line.split(" "))
        if len(pair) != 2:
            raise EngineError("invalidMergeLine", line)
        if pair in out:
            raise EngineError("duplicateMerge", line)
        out[pair] = rank
    return out


def read_vocabulary(text: str) -> dict[str, int]:
    return json.loads(text)


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    tokens = regex.findall(r"\X", word)
    if tokens:
        tokens[-1] += WORD_END
    while len(tokens) > 1:
        best = min((p for p in zip(tokens, tokens[1:]) if p in ranks), key=ranks.__getitem__, default=None)
        if best is None:
            break
        out, skip = [], False
        for a, b in zip(tokens, [*tokens[1:], ""]):
            if skip:
                skip = False
            elif (a, b) == best:
                out.append(a + b)
                skip = True
            else:
                out.append(a)
        tokens = out
    return tokens


def encode_words(words: Column, ranks: dict[tuple[str, str], int]) -> Column:
    """array<string> of words to array<string> of tokens, a batch at a time; distinct words are merged once."""
    ship(SparkSession.active())

    @pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def of(w: str) -> list[str]:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = encode_word(w, ranks)
            return known[w]

        return column.map(lambda ws: [t for w in (ws if ws is not None else []) for t in of(w)])

    return run(words)


def token_ids(tokens: Column, vocabulary: dict[str, int], unknown: int = 0) -> Column:
    """Ids by a literal map (a few entries; a larger vocabulary belongs in :func:`lookup_ids`)."""
    pairs = [x for t, i in sorted(vocabulary.items()) for x in (F.lit(t), F.lit(i))]
    table = F.create_map(*pairs)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))


def lookup_ids(tokens: Column, vocabulary: dict[str, int], unknown: int = 0) -> Column:
    """Ids by a dictionary that travels with the tasks (vocabularies have a fixed size)."""
    ship(SparkSession.active())

    @pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ts: [vocabulary.get(t, unknown) for t in (ts if ts is not None else [])])

    return run(tokens)


def require_specials(vocabulary: dict[str, int]) -> None:
    for t in (START, STOP):
        if t not in vocabulary:
            raise EngineError("missingSpecialToken", t)

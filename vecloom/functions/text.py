"""Prompt cleaning and token arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, STOP, PAD, WORD_END = "<|startoftext|>", "<|endoftext|>", "[PAD]", "</w>"


def basic_clean(s: Column) -> Column:
    """Lower case, each run of Unicode white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def split_words(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs in order of first occurrence."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def with_markers(body: Column) -> Column:
    return F.concat(F.array(F.lit(START)), body, F.array(F.lit(STOP)))


def pad_to(tokens: Column, least: int) -> Column:
    """At least ``least`` tokens, the rest padding; longer ones as they are."""
    return F.concat(tokens, F.array_repeat(F.lit(PAD), F.greatest(F.lit(least) - F.size(tokens), F.lit(0))))


def fixed_context(tokens: Column, length: int) -> Column:
    """Exactly ``length`` tokens; a longer list keeps its start and ends with the stop token."""
    if length < 2:
        raise ValueError("invalidContextLength")
    return F.when(F.size(tokens) > length, F.concat(F.slice(tokens, 1, length - 1), F.array(F.lit(STOP)))).otherwise(pad_to(tokens, length))


def decode(tokens: Column) -> Column:
    joined = F.concat_ws("", tokens)
    return F.replace(F.replace(F.replace(joined, F.lit(WORD_END), F.lit(" ")), F.lit(START), F.lit("")), F.lit(STOP), F.lit(""))


def valid_id(s: Column) -> Column:
    """Not null or empty, at most 65,535 bytes, no line break."""
    return F.coalesce((F.octet_length(s) > 0) & (F.octet_length(s) <= 65535) & ~s.rlike("[\\n\\x0B\\f\\r\\x85\\u2028\\u2029]"), F.lit(False))


def length_prefixed(parts: list[Column]) -> Column:
    """Parts as '<bytes>:<text>', one after another."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])

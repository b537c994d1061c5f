"""Vocabulary files of public tokenizers. Their path is a parameter; the driver reads the file and
broadcasts it (at most a few MB), so executors need no copy."""

from __future__ import annotations

import json
from functools import lru_cache

import regex

BYTE_LEVEL = "byte_bpe_50k.json"
WORD_LEVEL = "word_bpe_49k.json"
#: The pattern that splits text before the byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)}
    return out


@lru_cache(maxsize=2)
def byte_level(data: bytes):
    """The byte-level vocabulary as a merge-rank encoder, with its special tokens by text."""
    import tiktoken

    spec = json.loads(data)
    back = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token in special:
        ranks.pop(token.encode(), None)
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


#: A run of white space this long is left to the vocabulary's own library: the merge-rank encoder's pattern recurs on it.
LONG_RUN = 100_000
BLANKS = regex.compile(r"\s++")


class ByteLevel:
    """Token ids of whole texts; a special token written in a text is that token, as the vocabulary's own library has it."""

    def __init__(self, data: bytes):
        self.coder, self.special = byte_level(data)
        self.data, self.library = data, None

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.data.decode())
            return self.library.encode(text, add_special_tokens=False).ids
        return self.coder.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        for token, i in self.special.items():
            if token in text:
                out: list[int] = []
                for k, part in enumerate(text.split(token)):
                    out += ([i] if k else []) + self.ids(part)
                return out
        return self.plain(text)

"""Public tokenizers inside tasks, with a bounded memory of words already encoded.

A tokenizer that splits text before encoding treats a word alike wherever it
stands, so a worker encodes each word once and then looks it up. Texts in which
word boundaries could matter (a special token's characters, unusual white
space) are encoded whole by the library. The tokenizer's path is a parameter;
files are read where they are installed, on driver and executors alike.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache

# Words remembered by one worker, about 200 bytes each; a full memory starts anew.
MEMORY_WORDS = 1_000_000
# White space beyond the six ASCII characters, and the marks of special tokens.
UNUSUAL = re.compile(r"<\||[^\S \t\n\x0b\x0c\r]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers; for the few of a word an array is quicker than numpy."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Memory(dict):
    """Word to its encoding; missing words are encoded one by one."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = self.encode(word)
        return value


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space between words."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.whole = lambda text: packed_ids(tokenizer.encode(text, add_special_tokens=False).ids)
        self.memory = _Memory(self.whole)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if UNUSUAL.search(text):
            return self.whole(text)
        return b"".join(map(self.memory.__getitem__, text.split()))


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# Text whose words are parted by single spaces or line feeds only.
SINGLE = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")


class SpacedCounter:
    """Numbers of tokens under a byte-level tokenizer that joins a space to the word behind it.

    Between two words parted by one space the boundary lies before the space;
    a line feed is a token of its own. So each word counts the same anywhere,
    with its space or line feed in front.
    """

    def __init__(self, path: str):
        tokenizer = load(path)
        self.whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        self.memory = _Memory(lambda word: self.whole(word if word[0] == "\n" else " " + word))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SINGLE.search(text) or UNUSUAL.search(text):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + sum(map(self.memory.__getitem__, rest))


@cache
def spaced_counter(path: str) -> SpacedCounter:
    return SpacedCounter(path)

"""Byte-level BPE ids of whole texts, one word at a time from a bounded cache."""
from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator

CACHED = 300_000                     # words kept per Python worker; all are forgotten when there are more
STRETCH = 1 << 20                    # characters taken at once
_OTHER_WHITE = re.compile(r"[^\S \n]")
_WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_BREAK = re.compile(r"(?<=\S)[ \n]")


class Cache(dict):
    """Values of a function of a word; forgets all when full."""

    def __init__(self, value: Callable[[str], object], size: int = CACHED):
        super().__init__()
        self.value, self.size = value, size

    def __missing__(self, word: str) -> object:
        if len(self) >= self.size:
            self.clear()
        out = self[word] = self.value(word)
        return out


def added_tokens(json_path: str) -> dict[str, int]:
    """Strings that a tokenizer's file adds to its vocabulary, with their ids."""
    with open(json_path) as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about a million characters, cut before white space that follows a word."""
    begin = 0
    while len(text) - begin > STRETCH:
        cut = _BREAK.search(text, begin + STRETCH)
        if cut is None:
            break
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


class ByteBpe:
    """Ids of a byte-level BPE vocabulary given as ranks, as unsigned little-endian numbers of ``width`` bytes (4, or 2 if all ids fit).

    The vocabulary's pattern never lets a piece run from a character that is not white into white space, so words with the blanks before them are encoded on
    their own; texts with other white space than blanks and line ends are encoded as they are.  Without ``by_word`` all texts are, which is faster where words seldom
    come again, and nothing is kept.  Texts are split at the strings in ``added`` first, each of which is one id."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None, by_word: bool = True, width: int = 4):
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._code = {2: "H", 4: "I"}[width]
        self._cache = Cache(self._plain) if by_word else None
        self._added = {content: int(id_).to_bytes(width, "little") for content, id_ in (added or {}).items()}
        self._split = re.compile("(" + "|".join(re.escape(c) for c in sorted(self._added, key=len, reverse=True)) + ")") if added else None

    def _plain(self, text: str) -> bytes:
        return array(self._code, self._encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if self._split and self._split.search(text):
            return b"".join([self._added[p] if p in self._added else self._between(p) for p in self._split.split(text)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if self._cache is None:
            return b"".join(map(self._plain, stretches(text)))
        if _OTHER_WHITE.search(text):
            return self._plain(text)
        cache = self._cache
        if len(text) <= STRETCH:
            return b"".join([cache[w] for w in _WORD.findall(text)])
        return b"".join(b"".join([cache[w] for w in _WORD.findall(part)]) for part in stretches(text))

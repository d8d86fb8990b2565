"""Tokenizers for chunking: whatever has ``encode`` (text to a list) and ``decode`` (a part of it to text)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

_WORD, _PIECE = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$")


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


@dataclass(frozen=True)
class Words:
    """Words between ASCII white space; a chunk has one blank between words."""

    def encode(self, text: str) -> list[str]:
        return _WORD.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


@dataclass(frozen=True)
class Pieces:
    """Words with the white space before them; a chunk reads as the text does, line breaks included."""

    def encode(self, text: str) -> list[str]:
        return _PIECE.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


@dataclass(frozen=True)
class FromFile:
    """A byte-level tokenizer in a JSON file of the tokenizers library, which has to be installed."""

    path: str

    def _held(self):
        if self.path not in _loaded:
            from tokenizers import Tokenizer as Loaded

            _loaded[self.path] = Loaded.from_file(self.path)
        return _loaded[self.path]

    def encode(self, text: str) -> list[int]:
        return self._held().encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return self._held().decode(tokens, skip_special_tokens=False)


_loaded: dict = {}

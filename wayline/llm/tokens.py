"""Token ids of a public tokenizer file, with a cache of pieces.

The tokenizers library cuts a text into pre-tokens and encodes each on its own, so the ids of
a text are the ids of its pieces one after another, if it is cut between pre-tokens only. Most
pieces repeat: a worker keeps those it met and asks the library's model for new ones only.
Texts that the cuts below may not fit (special tokens, runs of white space) are encoded whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

from tokenizers import Tokenizer  # noqa: E402

#: Pieces in each of a worker's two cache generations, some 150 MB together; of effect on speed only.
CACHED = 300_000

_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Signs that end a word as a pre-token of their own.
_SIGNS = ".,;:!?*#$%&|"
_BEYOND_LATIN = regex.compile(r"[^\x00-ɏ]|İ")

# byte-level vocabularies write a byte as a character: visible Latin-1 as itself, the rest from 256 on
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_CHARACTER = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_CHARACTERS = [chr(_AS_CHARACTER.get(b, b)) for b in range(256)]


def _as_characters(text: str) -> str:
    return "".join(map(_CHARACTERS.__getitem__, text.encode()))


def _spaced(text: str) -> list[str] | None:
    """A word with the space before it, or one line end."""
    if "\n\n" in text or "\x01" in text or "<|" in text:
        return None
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def _spaced_pre_tokens(piece: str) -> list[str] | None:
    rest = piece.removeprefix(" ")
    if piece not in ("", "\n") and (not rest or rest[0].isspace() or rest[-1].isspace()):
        return None
    return _BYTE_LEVEL.findall(piece)


def _worded(text: str) -> list[str] | None:
    """What stands between white space, which the pattern drops."""
    return None if "<|" in text else text.replace("\n", " ").split(" ")


def _word_pre_tokens(piece: str) -> list[str] | None:
    # a normalizer may recompose letters beyond Latin
    return None if _BEYOND_LATIN.search(piece) else _WORDS.findall(piece.lower())


#: File name → cut of a text, and pre-tokens of a piece (None: not certain, encode the whole text).
#: Texts for other files are encoded whole.
CUTS = {"byte_bpe_50k.json": (_spaced, _spaced_pre_tokens), "word_bpe_49k.json": (_worded, _word_pre_tokens)}


class _Pieces(dict):
    """Piece → its ids, made when first met."""

    def __init__(self, make: Callable[[str], bytes | None], old: dict):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes | None:
        ids = self[piece] = self.old[piece] if piece in self.old else self.make(piece)
        return ids


class Encoder:
    """Encodes texts to arrays of ids; one per worker process and file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut, self.pre_tokens = CUTS.get(os.path.basename(path), (lambda text: None, None))
        self.lowers = self.pre_tokens is _word_pre_tokens
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pieces = _Pieces(self._piece, {})
        self.cached = CACHED

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _tokenize(self, characters: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(characters)]
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _piece(self, piece: str) -> bytes | None:
        word = piece.rstrip(_SIGNS)
        if word != piece and word[-1:].isalpha():  # the word itself is likely known
            ids = self.pieces[word]
            return ids if ids is None else ids + self.pieces[piece[len(word) :]]
        if piece.isascii() and piece.isalpha():  # one pre-token
            if self.lowers and not piece.islower():
                return self.pieces[piece.lower()]
            return self._tokenize(piece)
        if not self.lowers:
            rest = piece[1:] if piece[:1] == " " else piece
            if rest.isalpha() and (rest.isascii() or not _BEYOND_LATIN.search(rest)):  # one too, with its space
                return self._tokenize(_as_characters(piece))
        words = self.pre_tokens(piece)
        if words is None:
            return None
        return b"".join([self._tokenize(_as_characters(w)) for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null."""
        if not text:
            return np.empty(0, self.dtype)
        if (pieces := self.cut(text)) is None:
            return self._whole(text)
        if len(self.pieces) > self.cached:
            self.pieces.old = {}  # before the next generation fills: there are two at a time
            self.pieces = _Pieces(self._piece, self.pieces)
        try:
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), self.dtype)
        except TypeError:  # a piece was None
            return self._whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cached: int = CACHED) -> Encoder:
    """The worker's encoder for a file, which keeps so many pieces in a generation from now on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cached = cached
    return _ENCODERS[path]


def forget() -> None:
    """Drop the pieces of all encoders, for other work in this process."""
    for one in _ENCODERS.values():
        one.pieces = _Pieces(one._piece, {})


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

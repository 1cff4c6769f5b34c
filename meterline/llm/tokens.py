"""Encoding of whole texts with a public tokenizer, piece by piece through a cache.

A text is cut where the tokenizer itself never joins: at single spaces for a
byte-level tokenizer, whose pieces keep the space before them, and at ASCII
white space for one that drops white space. The library encodes every distinct
piece once per worker.
"""

from __future__ import annotations

import os
import re
import string
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

from meterline.llm.frames import KEPT

CACHE_PIECES = 600_000
#: Longer pieces (whole texts without a space, data in one run) hardly come again and are not kept.
LONGEST_KEPT = 64
#: Pieces of a text that are looked up before the cache may turn a generation.
RUN_PIECES = 50_000
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ASCII_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
RARE_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


ENDS = "".join(c for c in string.punctuation if c != "'")


def plain_word(word: str) -> bool:
    """Latin letters only, none of which becomes two in lower case."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


class Known(dict):
    """Ids of pieces; `find` tells those of a piece that is not held."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        return self.find(piece)


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit or 32-bit bytes.

    For byte-level BPE, with or without spaces kept. The cache has two generations of at most `cache_pieces` pieces each, none longer
    than `LONGEST_KEPT` characters: a full young one becomes the old one, from which pieces in use come back.
    """

    def __init__(self, name: str, spaced: bool, cache_pieces: int = CACHE_PIECES):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if os.sep not in name else name)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.lead = " " if spaced else ""
        self.cache_pieces = cache_pieces
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.tokenize = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0x80, 0x250)}
        self.mark = level.pre_tokenize_str(" ")[0][0] if spaced else ""
        self.tails: dict[str, bytes] = {}
        self.young, self.old = Known(self.find), Known(self.find)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text.

        If the tokenizer keeps spaces, all pieces but the first follow a space
        that belongs to them or start with a line break that stands alone.
        """
        rare = any(space in text for space in RARE_SPACES)
        if not self.lead:
            return [word for word in ASCII_SPACE.split(text) if word] if rare else text.split()
        if rare or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text != text.strip(" \n"):
            return SAFE_SPACE.split(text)
        return text.replace("\n", " \n").split(" ")

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def alone(self, texts: list[str]) -> list[bytes]:
        return [self.pack(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def modelled(self, word: str) -> bytes:
        """Ids of one plain word straight from the library's model, which sees it as the pre-tokenizer would hand it over."""
        if not self.lead:
            word = unicodedata.normalize("NFC", word).lower()
        if not word.isascii():
            word = word.translate(self.letters)
        if word[0] == "\n":
            return self.ends("\n") + self.pack([token.id for token in self.tokenize(word[1:])])
        return self.pack([token.id for token in self.tokenize(self.mark + word)])

    def find(self, piece: str) -> bytes:
        """Ids of a piece that the young generation lacks; punctuation after a letter is encoded on its own.

        A piece with such an end is only kept if its word was known before.
        """
        ids = self.old.get(piece)
        if ids is not None:
            return self.keep(piece, ids)
        stem = piece.rstrip(ENDS)
        if not plain_word(stem[1:] if stem[:1] == "\n" else stem):
            return self.keep(piece, self.alone([piece if piece[:1] == "\n" else self.lead + piece])[0])
        if len(stem) == len(piece):
            return self.keep(piece, self.modelled(piece))
        tail = self.ends(piece[len(stem) :])
        ids = self.young.get(stem)
        if ids is None:
            return self.keep(stem, self.old.get(stem) or self.modelled(stem)) + tail
        return self.keep(piece, ids + tail)

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST_KEPT:
            self.young[piece] = ids
        return ids

    def ends(self, tail: str) -> bytes:
        if tail in self.tails:
            return self.tails[tail]
        ids = self.alone([tail])[0]
        if len(tail) <= LONGEST_KEPT and len(self.tails) < self.cache_pieces:
            self.tails[tail] = ids
        return ids

    def forget(self) -> None:
        for pieces in (self.young, self.old, self.tails):
            pieces.clear()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text counts as empty. Works on one text at a time, and on at most `RUN_PIECES` of its pieces."""
        for text in texts:
            pieces = self.cut(text or "")
            found = self.alone(pieces[:1]) if self.lead else []
            for at in range(len(found), len(pieces), RUN_PIECES):
                if len(self.young) > self.cache_pieces:
                    self.young, self.old, self.tails = Known(self.find), self.young, {}
                found.append(b"".join(map(self.young.__getitem__, pieces[at : at + RUN_PIECES])))
            yield b"".join(found)


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, spaced: bool) -> Encoder:
    """One encoder per worker process, so that its cache outlives a task."""
    if (name, spaced) not in ENCODERS:
        ENCODERS[name, spaced] = Encoder(name, spaced)
    return ENCODERS[name, spaced]


def drop_encoders() -> None:
    """Gives the memory of all encoders of this process back, for tasks that encode nothing."""
    while ENCODERS:
        ENCODERS.popitem()[1].forget()


KEPT.append(drop_encoders)

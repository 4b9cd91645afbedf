"""Fast exact tokenising: worker caches in front of the tokenizer library.

The pre-tokenizers of both vocabularies cut a text at (most) white space, so
pieces between such cuts can be encoded apart and remembered.  A piece that is
letters with trailing punctuation goes straight to the model; any other piece
goes through the whole library.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Pieces in one generation of a worker's memory; of words half as many.
CACHE = 250_000
_TAIL = ".,;:!?"
_LATIN = re.compile(r"[^\x00-\xff]|[\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe]")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = byte_letters()


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _mapped(piece: str) -> str:
    if piece.isascii() and piece.isprintable() and " " not in piece:  # these stand for themselves
        return piece
    return piece.encode().decode("latin-1").translate(_LETTERS)


def plain_parts(piece: str) -> tuple[str, str] | None:
    """(letters, trailing punctuation) if the pre-tokenizers certainly cut the piece so."""
    core = piece.rstrip(_TAIL)
    if core.isalpha() and (core.isascii() or not _LATIN.search(core)):
        return core, piece[len(core) :]
    return None


class Remembered(dict):
    """Key -> ``make(key)``, in two generations of at most ``cache`` keys: what is asked for again outlives the next full one."""

    def __init__(self, cache: int = CACHE):
        super().__init__()
        self.cache, self.old = cache, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 100:
            if len(self) >= self.cache:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def in_worker(kind: str, path: str, make):
    """One object for all tasks of a Python worker: it outlives a task, until one of another kind or path takes its place."""
    held = sys.__dict__.setdefault("_graphloom_in_worker", {})
    if (kind, path) not in held:
        held.clear()
        held[kind, path] = make()
    return held[kind, path]


class _Words(Remembered):
    """Word -> its ids as bytes, by the model alone."""

    def __init__(self, model, cache: int):
        super().__init__(cache)
        self.tokenize = model.tokenize

    def make(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(_mapped(word))]).tobytes()


class WordIds(Remembered):
    """UTF-8 piece without ASCII white space -> its ids as little-endian unsigned 32-bit bytes.

    For a lower-casing vocabulary with word ends, which drops white space.
    """

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__(cache)
        self.whole = load(path)
        self.words = _Words(self.whole.model, cache // 2)

    def make(self, piece: bytes) -> bytes:
        text = piece.decode()
        if parts := plain_parts(text):
            core, tail = parts
            return self.words[core.lower()] + self.words[tail] if tail else self.words[core.lower()]
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


#: Only here a single space lies between two characters that aren't white space.
_CUT = re.compile(r"(?<=[!-~\xa1-\xac\xae-\u024f]) (?=[!-~\xa1-\xac\xae-\u024f])")
#: With none of these, every space and newline is such a cut.
_UNSAFE = re.compile(r"[ \n][ \n]|^[ \n]|[ \n]$|[^\n -~\xa1-\xac\xae-\u024f]")


class PieceLengths(Remembered):
    """Piece -> number of tokens, for a byte-level vocabulary that keeps white space.

    The first tier, a table of frequent pieces, is always there; what misses is
    encoded and kept in the second tier, which forgets by generations.  A piece
    stands for itself behind one space; with a leading newline it stands for
    what follows that newline, or the start of a text.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache: int = CACHE):
        self.frequent = frequent or {}
        super().__init__(cache + len(self.frequent))
        self.update(self.frequent)
        self.whole = load(path)
        self.tokenize = self.whole.model.tokenize

    def clear(self) -> None:
        super().clear()
        self.update(self.frequent)

    def adopt(self, frequent: dict[str, int]) -> "PieceLengths":
        """Take another table of frequent pieces as the first tier."""
        self.frequent = frequent
        self.update(frequent)
        return self

    def make(self, piece: str) -> int:
        text = piece[1:] if piece[:1] == "\n" else " " + piece
        head, body = (" ", text[1:]) if text[:1] == " " else ("", text)
        if parts := plain_parts(body):
            return len(self.tokenize(_mapped(head + parts[0]))) + (len(self.tokenize(_mapped(parts[1]))) if parts[1] else 0)
        return len(self.whole.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pieces of a text, and how many newlines between them count one token each."""
        if not text:
            return [], 0
        if "<|" in text:
            return ["\n" + text], 0
        if _UNSAFE.search(text):
            parts = _CUT.split(text)
            parts[0] = "\n" + parts[0]
            return parts, 0
        out: list[str] = []
        lines = text.split("\n")
        for line in lines:
            parts = line.split(" ")
            parts[0] = "\n" + parts[0]
            out += parts
        return out, len(lines) - 1

    def count(self, text: str) -> int:
        parts, newlines = self.pieces(text)
        return sum(map(self.__getitem__, parts)) + newlines

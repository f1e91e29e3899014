"""Token ids of whole texts with the tokenizers library, one call per distinct word."""

from __future__ import annotations

import os
import re
from array import array

#: White space other than a space and a line feed, by any of the definitions in use.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]")
_TIGHT = ("  ", " \n", "\n ", "\n\n")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, each its own composed and simply cased character, then ASCII punctuation, which every scheme takes as one run.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes in order for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids in bytes; a new piece is encoded when it is first asked for."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[piece] = found = self.encode(piece)
        return found


class Encoder:
    """ids(text) equals tokenizer.encode(text, add_special_tokens=False).ids, as native 16- or 32-bit numbers in bytes.

    A single space or line feed between characters that are not white space ends a pre-token: in the byte-level scheme
    (spaced) the space opens the next one and the line feed stands alone, in the word-end scheme both are dropped.
    Pieces cut there are encoded once each and remembered, Latin words by the model itself and all else by the whole
    tokenizer. A piece's word is remembered apart from the marks after it and, where the scheme lower-cases, from its case.
    Texts with other white space are cut at single spaces only. At most `most` pieces and words are remembered.
    """

    def __init__(self, path: str, spaced: bool, width: int = 4, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.code = Tokenizer.from_file(path), spaced, {2: "H", 4: "I"}[width]
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError("the vocabulary does not fit the width")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks = _Pieces(self._whole, 10_000)
        self.words = _Pieces(self._word, most)
        self.inner = _Pieces(lambda p: self._piece(p, " " if spaced else ""), most)
        self.first = _Pieces(lambda p: self._piece(p, ""), most // 8)
        self.newline = self._whole("\n")

    def _whole(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str, lead: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            return self._whole(lead + piece)
        word, marks = plain.groups()
        ids = self.words[lead + word if self.spaced else word.lower()]
        return ids + self.marks[marks] if marks else ids

    def _line(self, pieces: list[str]) -> bytes:
        return self.first[pieces[0]] + b"".join(map(self.inner.__getitem__, pieces[1:]))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        odd = _OTHER.search(text) is not None
        if not self.spaced:
            return b"".join(map(self.inner.__getitem__, _SINGLE.split(text) if odd else text.split()))
        if odd or any(t in text for t in _TIGHT) or text[0] in " \n" or text[-1] in " \n":
            return self._line(_SINGLE.split(text))
        return self.newline.join([self._line(line.split(" ")) for line in text.split("\n")])


def encoder(path: str, spaced: bool, width: int) -> Encoder:
    """One encoder per worker process; it outlives the task, as workers are reused."""
    import tokenizers

    made = tokenizers.__dict__.setdefault("panelspark_encoders", {})
    key = (path, spaced, width)
    if key not in made:
        made[key] = Encoder(path, spaced, width)
    return made[key]

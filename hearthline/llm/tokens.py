"""Token ids of texts by a public byte-level vocabulary.

A text is encoded word by word: a space that has a visible character on either side always begins a new piece of the byte-level
pre-tokenizer, so ids of ``" word"`` can be kept and joined. Texts where a space stands between two white spaces are encoded whole.
Kept words are bounded (``keep``); when full the store is emptied. The ids are those of ``tokenizers`` for the whole text.
"""

from __future__ import annotations

import re

import numpy as np

#: letters of which a word is one piece of the pre-tokenizer, and marks that are a piece of their own behind one
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"([{LETTERS}]+)([.,]?)(?:\n([{LETTERS}]+)([.,]?))?")
BETWEEN = re.compile(r"\s \s")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder(dict):
    """Ids (little-endian unsigned 32-bit) of a word after a space, by word."""

    def __init__(self, path: str, special_as_text: bool = False, keep: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.model = self.whole.model
        self.letters = byte_letters()
        self.keep = keep
        self.marks = {m: self.plain(m) if m else b"" for m in ("", ".", ",", "\n")}

    def plain(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        mapped = "".join([self.letters[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        m = PLAIN.fullmatch(word)
        if m is None:
            ids = self.full(" " + word)
        else:
            stem, mark, below, last = m.groups()
            ids = (self.get(stem) or self.plain(" " + stem)) + self.marks[mark]
            if below:
                ids += self.marks["\n"] + self.plain(below) + self.marks[last]
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if BETWEEN.search(text):
            return np.frombuffer(self.full(text), dtype="<u4")
        head, *rest = text.split(" ")
        return np.frombuffer((self.full(head) if head else b"") + b"".join(map(self.__getitem__, rest)), dtype="<u4")


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per Python worker."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]

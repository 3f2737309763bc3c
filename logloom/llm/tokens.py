"""Token ids of whole texts from a vocabulary file of the tokenizers library, through a cache of pieces.

A byte-level BPE never joins characters across a blank or line feed that stands alone between two other characters,
since its pre-tokeniser can only start a piece there. Texts are therefore cut at such places, each distinct piece is
encoded once by the library, and a text's ids are the joined ids of its pieces. A piece of letters alone is one
pre-token, so it goes to the library's model directly; a sentence mark after letters is a pre-token of its own. Texts
with other white space or with the string of an added token (an id of its own, as the library has it), and vocabularies
that are not byte-level BPE without a normaliser, are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

#: Pieces that the cache may hold before it is emptied; this only bounds memory.
CACHE_PIECES = 600_000
#: Texts that the library gets at once.
CALL = 500
_MARKS = frozenset(".,;:!?")
#: Stands before a text's first piece. Other pieces follow a blank, which isn't part of them, or begin with a line feed.
_FIRST = "\x01"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters_of_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder(dict):
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes: those of the library's
    ``encode(text, add_special_tokens=False)``. The mapping itself is the cache: piece to ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.tokenizer = Tokenizer.from_file(path)
        added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.tokenize = self.tokenizer.model.tokenize
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = "".join(_letters_of_bytes())
        self.blank = self.table[32]
        self.marks = dict(zip(sorted(_MARKS), self._library(sorted(_MARKS)), strict=True))
        self.line_feed = self._library(["\n"])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), CALL):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
        return out

    def _word(self, word: str, blank: str) -> bytes:
        """Letters after ``blank`` (the blank's own character, or nothing): one pre-token."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.tokenize(blank + mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        """The ids of a piece that wasn't met before; None if it isn't cut at single blanks and line feeds."""
        if piece.isalpha():
            ids = self._word(piece, self.blank)
        elif piece[:1] == "\n":
            ids = self[_FIRST + piece[1:]]
            ids = None if ids is None else self.line_feed + ids
        elif piece[-1:] in _MARKS and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            first = piece[:1] == _FIRST
            core = piece[1:] if first else piece
            if first and core.isalpha():
                ids = self._word(core, "")
            elif not core or len(core.split()) != 1 or len(core.split()[0]) != len(core):
                ids = None
            else:
                ids = self._library([core if first else " " + core])[0]
        self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > CACHE_PIECES:
            self.clear()
        out, whole, get = [b""] * len(texts), [], self.__getitem__
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.cut and _FIRST not in t and not (self.added and self.added(t)):
                try:
                    out[i] = b"".join(map(get, (_FIRST + t.replace("\n", " \n")).split(" ")))
                    continue
                except TypeError:  # a piece is None
                    pass
            whole.append(i)
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True) if whole else ():
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, made once."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]

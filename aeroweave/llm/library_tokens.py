"""Token ids of whole texts by the tokenizers library, one library call per new piece of text.

A text is cut where neither vocabulary can join across: before white space that follows something else, and
between a letter and an ASCII mark. Where the library lower-cases, so does the key.
Pieces repeat a lot, so each worker process remembers the ids of those it met, in bounded memory. Texts that
spell out a special token, or that the cut does not fit, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shared import Memory, per_process

#: Pieces per half of a worker's memory (about 100 bytes each).
REMEMBERED = 500_000
#: A run of plain letters with the space before it, up to an ASCII mark or space; else white space and what follows it.
_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \t\n\r\x0b\x0c!-/:-@\[-`{-~]|\Z)"
    r"|[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+"
)
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: White space beyond ASCII, and the separators that only some definitions call white space.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class LibraryTokens:
    """``ids(text)`` as little-endian unsigned 32-bit bytes, equal to the library's own ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec["added_tokens"]]
        self.lower = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.memory = Memory(REMEMBERED)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if (self.special and self.special.search(text)) or _ODD.search(text):
            return self._whole(text)
        if self.lower and (text.isascii() or not _BEYOND_LATIN.search(text)):
            text = text.lower()
        pieces = _PIECE.findall(text)
        young = self.memory.young
        found = [young.get(p) for p in pieces]
        if None in found:
            missing = dict.fromkeys(p for p, ids in zip(pieces, found, strict=True) if ids is None)
            old = self.memory.old
            new = [p for p in missing if p not in old]
            missing.update((p, old[p]) for p in missing if p in old)
            if new:
                encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
                missing.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, encoded, strict=True))
            for p, ids in missing.items():
                self.memory.put(p, ids)
            found = [missing[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return b"".join(found)


def library_tokens(path: str) -> LibraryTokens:
    """The tokenizer of this worker process."""
    return per_process(f"library {path}", lambda: LibraryTokens(path))

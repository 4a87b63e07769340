"""Byte-pair encoding by speculation and verification, and decoding.

New words of a batch are first tokenized greedily by longest match. A token sequence is the byte-pair
encoding of its word exactly if every adjacent pair of tokens is what the encoder makes of the two alone, so all
distinct pairs of the batch are tested at once in numpy, and only words with a failing pair are merged step by step.
Every worker process remembers the words it met, in bounded memory.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Memory, per_process

REMEMBERED = 500_000
#: Longer words are encoded each time they occur, so that a word cannot fill the memory.
LONGEST_REMEMBERED = 64
_NEVER = np.int64(1) << np.int64(60)


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _class_below(limit: int, kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(limit) if unicodedata.category(chr(c))[0] == kind)


class Bpe:
    """A byte-level vocabulary file with merges and an optional end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for text, number in [*self.vocab.items(), *self.added.items()]:
            self.tokens[number] = text
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self._tables(size)
        # normalization and word pattern are the file's; the fast path is the same for Latin text
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        letters, numbers = _class_below(0x250, "L"), _class_below(0x250, "N")
        space = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        # letters beyond Latin, and those that lower-case to one
        leaving = "".join(chr(c) for c in range(0x250) if max(map(ord, chr(c).lower())) >= 0x250)
        self.beyond = re.compile(f"[{leaving}\u0250-\U0010ffff]")
        self.memory = Memory(REMEMBERED)
        symbols = _byte_symbols()
        self.to_symbols = {b: s for b, s in enumerate(symbols)}
        self.longest = max(len(t) for t in self.vocab)

    def _tables(self, size: int) -> None:
        """Arrays for the pair test: how each token is made, and the rank of each merge."""
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.merge_keys = size, keys[order]
        self.merge_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.sound = np.zeros(size, dtype=bool)
        for text, number in self.vocab.items():
            symbols = self._symbols(text)
            if symbols is None:
                continue
            made, last = self._merge(symbols)
            self.sound[number] = made == [number]
            if last and self.sound[number]:
                self.left[number], self.right[number], self.rank[number] = last

    def _symbols(self, text: str) -> list[int] | None:
        """First symbols of a token's own text, None where one is not in the vocabulary."""
        parts = list(text)
        if self.suffix and text.endswith(self.suffix):
            parts = list(text[: -len(self.suffix)])
            if parts:
                parts[-1] += self.suffix
        found = [self.vocab.get(p) for p in parts]
        return None if None in found or not found else found

    def _merge(self, symbols: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Exact merging, lowest rank first and leftmost among equals; also the last merge done."""
        n = len(symbols)
        symbols = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i) for i in range(n - 1) if (m := self.merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        last = None
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = self.merges.get((symbols[i], symbols[j]))
            if not found or found[0] != rank:
                continue
            last = symbols[i], symbols[j], rank
            symbols[i], symbols[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := self.merges.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (m[0], h))
        return [s for s in symbols if s >= 0], last

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the text of ``a`` followed by that of ``b`` gives the two back, for each pair.

        Walks back in time: whichever of the two touching parts was made later is taken apart. If the parts
        touching before could have merged earlier than that, the encoder would have joined them across the border.
        """
        good = self.sound[a] & self.sound[b]
        live = np.flatnonzero(good)
        x, y, limit = a[live], b[live], np.full(len(live), _NEVER)
        while len(live):
            joins = self._rank_of(x, y) < limit
            good[live[joins]] = False
            from_left = self.rank[x] > self.rank[y]
            done = (self.rank[x] < 0) & (self.rank[y] < 0)
            stay = ~joins & ~done
            live, x, y, from_left = live[stay], x[stay], y[stay], from_left[stay]
            # of equal ranks the left one merges first, so a part on the right gives way even to its own rank
            limit = np.where(from_left, self.rank[x], self.rank[y] + 1)
            x, y = np.where(from_left, self.right[x], x), np.where(from_left, y, self.left[y])
        return good

    def _greedy(self, word: str) -> list[int]:
        """Longest match from the left; a part that ends the word carries the suffix."""
        vocab, suffix, n, at, out = self.vocab, self.suffix, len(word), 0, []
        while at < n:
            stop = min(n, at + self.longest)
            while True:
                got = vocab.get(word[at:stop] + suffix if stop == n else word[at:stop])
                if got is not None:
                    break
                stop -= 1
                if stop == at:
                    raise ValueError(f"the vocabulary lacks {word[at]!r}")
            out.append(got)
            at = stop
        return out

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """Ids of distinct words, by speculation, a test of all pairs, and exact merging of what fails."""
        shown = [w.encode().decode("latin-1").translate(self.to_symbols) for w in new]
        proposed = [self._greedy(w) for w in shown]
        count = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        word = np.repeat(np.arange(len(new)), count)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.zeros(len(new), dtype=bool)
        failing[word[inner[~fine[back]]]] = True
        failing[word[~self.sound[flat]]] = True
        for i in np.flatnonzero(failing):
            symbols = [self.vocab[s] for s in shown[i][:-1]] + [self.vocab[shown[i][-1] + self.suffix]]
            proposed[i] = self._merge(symbols)[0]
        return proposed

    def _pieces(self, text: str) -> list[str]:
        if self.beyond.search(text):
            text = self.library.normalizer.normalize_str(text)
            # the file's pattern, then back from byte symbols
            shown = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            raw = {s: b for b, s in self.to_symbols.items()}
            return [bytes(raw[c] for c in p).decode("utf-8", "surrogateescape") for p in shown]
        return self.words.findall(text.lower())

    def _split(self, text: str) -> list[str | int]:
        """Words in order, and special tokens as their ids."""
        if not self.special or not self.special.search(text):
            return self._pieces(text)
        out: list[str | int] = []
        at = 0
        for found in self.special.finditer(text):
            out += self._pieces(text[at : found.start()])
            out.append(self.added[found.group()])
            at = found.end()
        return out + self._pieces(text[at:])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the ``n + 1`` offsets."""
        pieces = [self._split(t) for t in texts]
        young, old = self.memory.young, self.memory.old
        found = [[young.get(p) for p in own] for own in pieces]
        missing: dict = {}
        for own, got in zip(pieces, found, strict=True):
            if None in got:
                missing.update((p, None) for p, ids in zip(own, got, strict=True) if ids is None)
        new = []
        for p in missing:
            if isinstance(p, int):
                missing[p] = np.array([p], "<i4").tobytes()
            elif (ids := old.get(p)) is not None:
                missing[p] = self.memory.put(p, ids)
            else:
                new.append(p)
        if new:
            for p, ids in zip(new, self.encode_words(new), strict=True):
                missing[p] = np.array(ids, "<i4").tobytes()
                if len(p) <= LONGEST_REMEMBERED:
                    self.memory.put(p, missing[p])
        rows = [
            b"".join([missing[p] if ids is None else ids for p, ids in zip(own, got, strict=True)]) if None in got else b"".join(got)
            for own, got in zip(pieces, found, strict=True)
        ]
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        return np.frombuffer(b"".join(rows), "<i4"), offsets


def _bpe(path: str) -> Bpe:
    return per_process(f"bpe {path}", lambda: Bpe(path))


def _decoded(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Token texts joined by a space, special ones included; no ids give an empty text."""
    texts = tokens.take(ids.flatten())
    start = ids.offsets[0].as_py()
    cut = pc.subtract(ids.offsets, pa.scalar(start, pa.int32()))
    return pc.binary_join(pa.ListArray.from_arrays(cut, texts), " ")


def encode(documents: DataFrame, tokenizer: str, decode: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row, and with ``decode`` also ``decoded``, the text made from the ids.

    The vocabulary file is one with lower-casing, NFC and end-of-word parts; special tokens spelled out in a text become
    their ids. NULL and empty texts have no ids and decode to an empty text. Rows stay one to one, repeated or
    without an id; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        bpe = _bpe(tokenizer)
        tokens = pa.array(bpe.tokens)
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(1))
            for low, high in W.row_slices(offsets):
                part = batch.slice(low, high - low)
                flat, cut = bpe.ids([t or "" for t in part.column(1).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))
                columns = {"doc_id": part.column(0), "ids": ids}
                if decode:
                    columns["decoded"] = _decoded(tokens, ids)
                yield pa.RecordBatch.from_pydict(columns)

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, ids array<int>" + (", decoded string" if decode else ""))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; NULL ids decode to an empty text."""

    def run(batches):
        tokens = pa.array(_bpe(tokenizer).tokens)
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": _decoded(tokens, lists)})

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")

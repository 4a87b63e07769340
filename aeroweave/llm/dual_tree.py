"""Exact ranked lexical search with two trees.

Documents are read once per block of items and reduced to what the items can meet: for each document the
item terms it holds and how often, packed in rows of some thousand documents. A second pass searches these rows.
The items of a block hang in one tree, the documents of a row in another. A document node
holds for each term the largest contribution any of its documents makes, an item node the union of its items'
terms; their product bounds every score below the pair of nodes. A pair is pruned where the bound is less
than the weakest k-th score among the node's items; leaves that remain are scored exactly as a small matrix product.
The best of all tasks are merged in two steps, so no task sees all candidates of an item.

Item blocks are bounded in bytes, so what goes to tasks has a fixed size; documents are scanned
once more for each further block. Words are compared byte by byte after a hash has nominated them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import stored

#: Item text in one block; also bounds its vocabulary, to half as many terms.
BLOCK_BYTES = 256 * 1024
#: Documents per packed row, documents and items per leaf.
ROW_DOCS, DOC_LEAF, ITEM_LEAF = 2048, 32, 8
#: Tasks whose candidates are merged in a first step.
MERGED_TASKS = 64
_ROW = "terms_df array<int>, counts_df array<int>, n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths array<int>, ends binary, terms binary, tfs binary"
_FOUND = "task int, item int, score bigint, doc_id bigint"
#: Bytes between terms: all of ASCII but digits and letters.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[0x80:] = _BETWEEN[0x30:0x3A] = _BETWEEN[0x41:0x5B] = _BETWEEN[0x61:0x7B] = False


@dataclass(frozen=True)
class Vocabulary:
    """Terms of a block of items, ordered by hash; their bytes are kept to tell equal hashes apart."""

    hashes: np.ndarray
    raw: np.ndarray
    ends: np.ndarray

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, or -1. ``raw`` is lower-cased."""
        out = np.full(len(starts), -1, np.int32)
        if not len(self.hashes) or not len(starts):
            return out
        hashed = W.word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        size = np.diff(self.ends, prepend=0)
        met = np.flatnonzero((self.hashes[at] == hashed) & (size[at] == ends - starts))
        if len(met):
            # byte by byte: one flat comparison of all words that hash and length nominate
            term = at[met]
            length = size[term]
            edge = np.cumsum(length) - length
            step = np.arange(length.sum()) - np.repeat(edge, length)
            same = raw[np.repeat(starts[met], length) + step] == self.raw[np.repeat(self.ends[term] - length, length) + step]
            met, term = (x[np.logical_and.reduceat(same, edge)] for x in (met, term))
            out[met] = term
        return out


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    lower = W._LOWER[raw]
    return lower, *W.word_spans(raw, offsets, _BETWEEN)


def _items(texts: list[str]) -> tuple[Vocabulary, list[np.ndarray]]:
    """The vocabulary of a block and, for each item, its terms (ascending, once each)."""
    known: dict[bytes, int] = {}
    found = []
    for text in texts:
        raw, starts, ends, _ = _terms(*W.text_bytes(pa.array([text])))
        found.append(list(dict.fromkeys(raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True))))
        for term in found[-1]:
            known.setdefault(term, len(known))
    terms = list(known)
    joined = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
    starts = ends - np.array([len(t) for t in terms], np.int64)
    hashes = W.word_hashes(joined, starts, ends) if terms else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two item terms have one 64-bit hash")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    raw = np.frombuffer(b"".join(terms[i] for i in order), np.uint8)
    vocabulary = Vocabulary(hashes[order], raw, np.cumsum([len(terms[i]) for i in order], dtype=np.int64))
    return vocabulary, [np.sort(place[[known[t] for t in own]]) if own else np.zeros(0, np.int64) for own in found]


def _extract(vocabulary: Vocabulary):
    """Packed rows of the documents that hold item terms, and the counts that weights need."""

    def pack(rows: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([r[0] for r in rows]).to_pylist() if rows else []
        lengths, counts, terms, tfs = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (1, 2, 3, 4))
        value, df = np.unique(terms, return_counts=True)
        own = [[x.tolist()] for x in (value, df)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own[0], pa.list_(pa.int32())), pa.array(own[1], pa.list_(pa.int32())),
                pa.array([n_docs]), pa.array([n_terms]),
                pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int32())),
                *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (np.cumsum(counts), terms, tfs)),
            ],
            ["terms_df", "counts_df", "n_docs", "n_terms", "doc_ids", "lengths", "ends", "terms", "tfs"],
        )

    def extract(batches):
        waiting, held, n_docs, n_terms = [], 0, 0, 0
        for batch in batches:
            raw, offsets = W.text_bytes(batch.column(1))
            for low, high in W.row_slices(offsets):
                own = offsets[low : high + 1]
                lower, starts, ends, first = _terms(raw[own[0] : own[-1]], own - own[0])
                n = np.diff(first)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                term = vocabulary.find(lower, starts, ends)
                met = np.flatnonzero(term >= 0)
                row = np.searchsorted(first, met, "right") - 1
                pair, tf = np.unique(row * len(vocabulary.hashes) + term[met], return_counts=True)
                row, term = pair // max(1, len(vocabulary.hashes)), pair % max(1, len(vocabulary.hashes))
                some, counts = np.unique(row, return_counts=True)
                at = 0
                while at < len(some):
                    take = min(ROW_DOCS - held, len(some) - at)
                    chosen = some[at : at + take]
                    part = slice(int(counts[:at].sum()), int(counts[: at + take].sum()))
                    waiting.append((batch.column(0).take(pa.array(chosen + low)), n[chosen], counts[at : at + take], term[part], tf[part]))
                    at, held = at + take, held + take
                    if held == ROW_DOCS:
                        yield pack(waiting, n_docs, n_terms)
                        waiting, held, n_docs, n_terms = [], 0, 0, 0
        if n_docs:
            yield pack(waiting, n_docs, n_terms)

    return extract


class ItemTree:
    """Items in nested halves along the main direction of their term sets; a node holds the union of their terms."""

    def __init__(self, items: list[np.ndarray], n_terms: int):
        self.items = items
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []  # members, union of terms, children
        self.n_terms = n_terms
        self._split(np.array([i for i, own in enumerate(items) if len(own)], np.int64))

    def _split(self, members: np.ndarray) -> int:
        number = len(self.nodes)
        union = np.unique(np.concatenate([self.items[i] for i in members])) if len(members) else np.zeros(0, np.int64)
        self.nodes.append((members, union, []))
        if len(members) > ITEM_LEAF:
            term = np.concatenate([self.items[i] for i in members])
            row = np.repeat(np.arange(len(members)), [len(self.items[i]) for i in members])
            mean = np.bincount(term, minlength=self.n_terms) / len(members)
            side = np.cos(np.arange(len(members)) * 2.3)
            for _ in range(8):
                axis = np.bincount(term, side[row], self.n_terms) - mean * side.sum()
                side = np.bincount(row, axis[term], len(members)) - mean @ axis
                side /= np.abs(side).max(initial=1e-300)
            order = np.argsort(side, kind="stable")
            half = len(members) // 2
            for part in (order[:half], order[half:]):
                self.nodes[number][2].append(self._split(members[part]))
        return number


class _Documents:
    """The documents of one packed row in a tree: leaves of similar documents, with the maxima of every level."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int, tree: ItemTree):
        ends, term, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("ends", "terms", "tfs"))
        count = np.diff(ends, prepend=0)
        self.ids = np.array([np.iinfo(np.int64).max if k is None else k for k in row["doc_ids"]], np.int64)
        self.missing = np.array([k is None for k in row["doc_ids"]])
        lengths = row["lengths"]
        if max(lengths, default=0) * n < 1 << 57:
            m = 50 + (50 * np.array(lengths, np.int64) * n) // total
        else:
            m = np.array([50 + 50 * x * n // total for x in lengths], np.int64)
        of = np.repeat(np.arange(len(count)), count)
        gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
        # documents near the same branch of the items go together
        branches = [tree.nodes[c] for c in self._level(tree, 3)]
        pull = np.stack([np.bincount(of, gain * np.isin(term, union), len(count)) for _, union, _ in branches], axis=1)
        order = np.lexsort((-pull.max(1), pull.argmax(1)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.missing = self.ids[order], self.missing[order]
        sorted_entries = np.lexsort((term, place[of]))
        self.of, self.term, self.gain = place[of][sorted_entries], term[sorted_entries], gain[sorted_entries]
        self.n_terms = len(weights)
        n_leaves = -(-len(count) // DOC_LEAF)
        self.edges = np.searchsorted(self.of, np.arange(n_leaves + 1) * DOC_LEAF)
        low = np.zeros((n_leaves, self.n_terms), np.int64)
        for leaf in range(n_leaves):
            part = slice(self.edges[leaf], self.edges[leaf + 1])
            np.maximum.at(low[leaf], self.term[part], self.gain[part])
        self.maxima = [low]
        while len(self.maxima[-1]) > 1:
            self.maxima.append(np.maximum.reduceat(self.maxima[-1], np.arange(0, len(self.maxima[-1]), 4)))
        self._dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _level(tree: ItemTree, depth: int) -> list[int]:
        nodes = [0]
        for _ in range(depth):
            nodes = [c for k in nodes for c in (tree.nodes[k][2] or [k])]
        return nodes

    def scores(self, leaf: int, items: list[np.ndarray]) -> np.ndarray:
        """Exact scores of a leaf's documents (rows) for the items (columns)."""
        if leaf not in self._dense:
            part = slice(self.edges[leaf], self.edges[leaf + 1])
            own, at = np.unique(self.term[part], return_inverse=True)
            size = min(DOC_LEAF, len(self.ids) - leaf * DOC_LEAF)
            dense = np.zeros((size, len(own) + 1), np.int64)
            dense[self.of[part] - leaf * DOC_LEAF, at] = self.gain[part]
            column = np.full(self.n_terms, len(own), np.int32)
            column[own] = np.arange(len(own))
            # sums of whole numbers are exact in doubles up to 2^53
            self._dense[leaf] = dense.astype(float) if dense.sum(1).max(initial=0) < 1 << 53 else dense, column
        dense, column = self._dense[leaf]
        held = np.zeros((dense.shape[1], len(items)), dense.dtype)
        for j, own in enumerate(items):
            held[column[own], j] = 1
        held[-1] = 0
        return (dense @ held).astype(np.int64)


class Search:
    """Best documents of every item, over the packed rows of one task."""

    def __init__(self, tree: ItemTree, k: int):
        self.tree, self.k = tree, k
        shape = len(tree.items), k
        self.score = np.zeros(shape, np.int64)  # 0: no document yet
        self.doc = np.zeros(shape, np.int64)
        self.missing = np.zeros(shape, bool)
        self.pruned = self.scored = 0

    def add(self, docs: _Documents) -> None:
        top = len(docs.maxima) - 1
        if len(self.tree.nodes[0][0]) and len(docs.ids):
            self._visit(docs, 0, np.arange(len(docs.maxima[top])), top)

    def _visit(self, docs: _Documents, node: int, places: np.ndarray, level: int) -> None:
        members, union, children = self.tree.nodes[node]
        bound = docs.maxima[level][np.ix_(places, union)].sum(1)
        # a document as good as the weakest k-th may still have the smaller id
        stays = bound >= max(1, self.score[members, -1].min())
        self.pruned += int((~stays).sum()) * len(members)
        places, bound = places[stays], bound[stays]
        if not len(places):
            return
        if level:
            places = (4 * places[:, None] + np.arange(4)).ravel()
            places = places[places < len(docs.maxima[level - 1])]
            for child in children or [node]:
                self._visit(docs, child, places, level - 1)
        elif children:
            for child in children:
                self._visit(docs, child, places, 0)
        else:
            # best bounds first, so that the k-th scores rise early
            for leaf, most in sorted(zip(places.tolist(), bound.tolist(), strict=True), key=lambda x: (-x[1], x[0])):
                if most >= self.score[members, -1].min():
                    self._score(docs, leaf, members)

    def _score(self, docs: _Documents, leaf: int, members: np.ndarray) -> None:
        got = docs.scores(leaf, [self.tree.items[i] for i in members])
        self.scored += got.size
        better = (got >= np.maximum(1, self.score[members, -1])).any(0)
        members, got = members[better], got[:, better]
        if not len(members):
            return
        own = slice(leaf * DOC_LEAF, leaf * DOC_LEAF + len(got))
        wide = lambda x: np.broadcast_to(x[own], (len(members), len(got)))
        score = np.concatenate([self.score[members], got.T], axis=1)
        doc = np.concatenate([self.doc[members], wide(docs.ids)], axis=1)
        missing = np.concatenate([self.missing[members], wide(docs.missing)], axis=1)
        best = np.lexsort((doc, missing, -score), axis=1)[:, : self.k]
        for table, now in ((self.score, score), (self.doc, doc), (self.missing, missing)):
            table[members] = np.take_along_axis(now, best, axis=1)

    def found(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score)
        task = TaskContext.get()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(item), task.partitionId() if task else 0, np.int32)),
                pa.array(item.astype(np.int32)),
                pa.array(self.score[item, place]),
                pa.array(self.doc[item, place], mask=self.missing[item, place]),
            ],
            ["task", "item", "score", "doc_id"],
        )


def _search_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """``text, rank, doc_id, score`` of one block of distinct item texts."""
    spark = docs.sparkSession
    vocabulary, items = _items(texts)
    given = spark.sparkContext.broadcast((vocabulary, items))
    rows = stored(docs.mapInArrow(lambda batches: _extract(given.value[0])(batches), _ROW), "terms")
    n, total = rows.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = np.zeros(len(vocabulary.hashes), np.int64)
    # one row per term of the block
    counted = rows.select(F.explode(F.arrays_zip("terms_df", "counts_df")).alias("t")).groupBy("t.terms_df").agg(F.sum("t.counts_df"))
    for term, count in counted.collect():
        df[term] = count
    weights = np.floor(1000 * np.log((2 * (n or 0) + 2) / (2 * df + 1))).astype(np.int64)
    ready = spark.sparkContext.broadcast(weights)

    def search(batches):
        run = Search(ItemTree(given.value[1], len(ready.value)), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("doc_ids", "lengths", "ends", "terms", "tfs")}
                if row["doc_ids"]:
                    run.add(_Documents(row, ready.value, n, total, run.tree))
        yield run.found()

    found = stored(rows.select("doc_ids", "lengths", "ends", "terms", "tfs").mapInArrow(search, _FOUND), "found")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    some = best(found.withColumn("lot", F.floor(F.col("task") / MERGED_TASKS)), "item", "lot")
    told = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
    # at most BLOCK_BYTES of item texts, or one item
    return best(some, "item").join(F.broadcast(told), "item").select("text", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every row of ``items(item_id, text)``.

    Terms are runs of ASCII digits, letters and all characters beyond ASCII, with A-Z lower-cased; an item's terms count once. A document's score
    sums over them ``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``
    and ``m = 50 + (50 n N) div L``, where N counts the documents with a term, L all their terms, n those
    of the document. Only scores above 0 are returned, equal ones by ascending ``doc_id``, NULL ids last.

    Each row of ``documents(doc_id, text)`` is a document, also where ids repeat; NULL and empty texts have no
    term and are neither counted nor found. Items with equal texts are searched once and returned each; items
    without a term have no rows. Empty tables give no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = items.select("item_id", "text").where("text is not null")
    texts = asked.select("text").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    blocked = stored(texts.withColumn("lot", F.pmod(F.xxhash64("text"), F.lit(max(1, n_blocks)))), "items")
    best = None
    for lot in range(n_blocks):
        for own in _chunks(sorted(r.text for r in blocked.where(F.col("lot") == lot).select("text").toLocalIterator())):
            found = _search_block(docs, own, k)
            best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return asked.join(best, "text").select("item_id", "rank", "doc_id", "score")


def _chunks(texts: list[str]) -> list[list[str]]:
    """Runs of texts within ``BLOCK_BYTES``; a longer text is a run of its own."""
    out: list[list[str]] = []
    room = 0
    for text in texts:
        size = len(text.encode())
        if not out or size > room:
            out.append([])
            room = BLOCK_BYTES
        out[-1].append(text)
        room -= size
    return out

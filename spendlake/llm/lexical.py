"""Ranked lexical search with a document FP-tree and branch and bound.

Documents are restricted to the terms of the items and written as narrow
vectors (term, occurrences), from which the document frequencies are counted.
Then each task takes its vectors in blocks. In a block, vectors in the order of
document frequency, frequent terms first, share the paths of a trie: documents
are sorted by their vectors, and a node is a range of documents with a
common beginning. Nodes of few documents, or of equal vectors, are leaves. Each node
holds, for every term below it, the most occurrences in each child, and the
least length factor m of each child. As a term's share of a score grows with its occurrences and falls
with m, they bound the scores of a child; a leaf's children are documents
and the bounds their scores. Each item is searched depth first, the child with the best
bound first; a child below the item's k-th best score so far in the task is
cut. Tasks send at most k documents an item.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z in
lower case. The weight of a term and the length factor are those of BM25 in
integers (see ``weights`` and ``length_factors``).

Items go in groups of about ITEM_BYTES of text, by a hash: what a group sends to
the driver and to all tasks is bounded, and more items mean more passes.

NULL and empty texts have no terms and are not found; items without terms find
nothing. Every row is a document: rows with equal doc_id are found each on its own,
equal scores by doc_id, rows without an id last. Equal (item_id, text) rows are one item;
rows of one item_id with different texts are items of their own. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import block_count, mixed, staged

#: Text of the items of one pass.
ITEM_BYTES = 4 << 20
#: Text that is hashed at a time.
WINDOW_BYTES = 1 << 20
#: Texts whose vectors are counted together; a longer one stands alone.
COUNT_BYTES = 16 << 20
#: A block of the search: so many (document, term) pairs, so many documents.
BLOCK_PAIRS, BLOCK_DOCS = 2_000_000, 16_384
#: Documents below which a node is a leaf.
LEAF = 96

_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _first, _last in ("09", "az"):
    _LOWER[ord(_first) : ord(_last) + 1] = np.arange(ord(_first), ord(_last) + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def term_hashes(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of the terms of ``data`` and their places, a window at a time."""
    whole, start = np.frombuffer(data, np.uint8), 0
    while start < len(whole):
        end = start + WINDOW_BYTES
        while end < len(whole) and _LOWER[whole[end]]:  # a term is never cut
            ahead = np.flatnonzero(_LOWER[whole[end : end + WINDOW_BYTES]] == 0)
            end = end + int(ahead[0]) if len(ahead) else end + WINDOW_BYTES
        b = _LOWER[whole[start:end]]
        inside = b > 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.cumsum(lengths) - lengths
            own = b[inside].astype(np.uint64)
            place = np.arange(len(own)) - np.repeat(first, lengths)
            yield mixed(np.add.reduceat(mixed((place.astype(np.uint64) << np.uint64(8)) | own), first)), starts + start
        start = end


class Vocabulary:
    """The terms of a group of items by hash; a term's number is its place in ``hashes``."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        bits = max(10, int(len(self.hashes) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.hinted = np.zeros(1 << bits, bool)
        self.hinted[self.hashes & self.mask] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are in the vocabulary, and their numbers."""
        at = np.flatnonzero(self.hinted[hashes & self.mask])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), max(len(self.hashes) - 1, 0))
        found = self.hashes[number] == hashes[at] if len(self.hashes) else np.zeros(0, bool)
        return at[found], number[found]


def _counted(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; numbers, occurrences and offsets of its restricted vector, by number."""
    lengths = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    n, pairs, width = np.zeros(len(texts), np.int64), [], max(len(vocabulary.hashes), 1)
    for hashes, places in term_hashes(b" ".join(texts)):
        doc = np.searchsorted(begins, places, "right") - 1
        n += np.bincount(doc, minlength=len(texts))
        at, number = vocabulary.numbers(hashes)
        keys, many = np.unique(doc[at] * width + number, return_counts=True)
        pairs.append((keys, many))
    keys = np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.int64)])
    many = np.concatenate([c for _, c in pairs] or [np.zeros(0, np.int64)])
    keys, back = np.unique(keys, return_inverse=True)  # a text may lie in many windows
    many = np.bincount(back, weights=many, minlength=len(keys)).astype(np.int64)
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * width)
    return n, keys % width, many, offsets


def restricted_vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tf``: the number of terms of each row, and those of the vocabulary with their occurrences."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, start = batch.column("doc_id"), batch.column("data"), 0
            while start < len(column):
                texts, held = [], 0
                while start + len(texts) < len(column):
                    text = column[start + len(texts)].as_py()
                    if texts and held + len(text) > COUNT_BYTES:
                        break
                    texts.append(text)
                    held += len(text)
                n, numbers, many, offsets = _counted(texts, vocabulary)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, many)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                start += len(texts)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data"))
    return narrow.filter("data IS NOT NULL").mapInArrow(vectors, "doc_id long, n long, terms array<int>, tf array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for each document frequency."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """25 + (75 n N) div L for each number of terms."""
    different, back = np.unique(n, return_inverse=True)
    return np.array([25 + 75 * x * n_docs // n_terms for x in different.tolist()], np.int64)[back]


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m): grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Item:
    number: int
    item_id: int | None
    ranks: np.ndarray
    weights: np.ndarray


@dataclass
class Node:
    """What is known of a node's children: by term, the most occurrences and what they add at most."""

    children: list[int] | None  # numbers of nodes; None in a leaf, whose children are documents
    low: int
    m: np.ndarray
    least_id: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    child: np.ndarray
    tf: np.ndarray
    most: np.ndarray

    def bounds(self, item: Item) -> np.ndarray:
        """The most that a document of each child scores; in a leaf, what it scores."""
        place = np.searchsorted(self.terms, item.ranks)
        place[place == len(self.terms)] = 0
        found = self.terms[place] == item.ranks
        place, weight = place[found], item.weights[found]
        lengths = self.at[place + 1] - self.at[place]
        total = np.zeros(len(self.m), np.int64)
        if len(place):
            skip = np.repeat(self.at[place] - (np.cumsum(lengths) - lengths), lengths)
            entries = skip + np.arange(len(skip))
            np.add.at(total, self.child[entries], np.repeat(weight, lengths) * self.most[entries])
        return total


class Tree:
    """The FP-tree of a block of documents."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        # Big-endian ranks compare as bytes do.
        keys = [ranks.astype(">u4").tobytes() for ranks, _ in vectors]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, self.m = ids[order], m[order]
        self.ranks = [vectors[i][0] for i in order]
        self.tf = [vectors[i][1] for i in order]
        self.nodes: list[Node] = []
        ranges, children = [(0, len(order))], []
        for low, high in ranges:  # grows as it goes: parents come before children
            cuts = self._cuts(low, high)
            if cuts is None:
                children.append(None)
                continue
            children.append(list(range(len(ranges), len(ranges) + len(cuts) - 1)))
            ranges += zip(cuts, cuts[1:])
        made: dict[int, Node] = {}
        for k in range(len(ranges) - 1, -1, -1):
            made[k] = self._node(*ranges[k], children[k], made)
        self.nodes = [made[k] for k in range(len(ranges))]

    def _cuts(self, low: int, high: int) -> list[int] | None:
        """Where the children of a range of documents begin and end; None for a leaf."""
        first, last = self.ranks[low], self.ranks[high - 1]
        if high - low <= LEAF:
            return None
        shared = min(len(first), len(last))
        unlike = np.flatnonzero(first[:shared] != last[:shared])
        depth = int(unlike[0]) if len(unlike) else shared
        if depth == len(first) == len(last):
            return None
        step = np.array([self.ranks[i][depth] if len(self.ranks[i]) > depth else -1 for i in range(low, high)])
        edges = [low, *(np.flatnonzero(np.diff(step)) + 1 + low).tolist(), high]
        cuts = [low]
        for begin, end in zip(edges, edges[1:]):
            # Small neighbours stay together as one leaf.
            if begin > cuts[-1] and end - cuts[-1] > LEAF:
                cuts.append(begin)
        return [*cuts, high]

    def _node(self, low: int, high: int, children: list[int] | None, made: dict[int, Node]) -> Node:
        if children is None:
            m, least = self.m[low:high], self.ids[low:high]
            terms, tf = self.ranks[low:high], self.tf[low:high]
        else:
            below = [made[k] for k in children]
            m, least = np.array([x.m.min() for x in below]), np.array([x.least_id.min() for x in below])
            terms, tf = [x.terms for x in below], [np.maximum.reduceat(x.tf, x.at[:-1]) for x in below]
        child = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        terms, tf = np.concatenate(terms), np.concatenate(tf)
        order = np.argsort(terms, kind="stable")
        terms, tf, child = terms[order], tf[order], child[order]
        own, at = np.unique(terms, return_index=True)
        return Node(children, low, m, least, own, np.append(at, len(terms)), child, tf, saturated(tf, m[child]))

    def search(self, item: Item, best: list[tuple[int, int]], k: int) -> None:
        """Put the documents of the ``k`` highest scores into the heap ``best`` of (score, -id)."""
        ahead = [(0, 0, 0, True)]
        while ahead:
            bound, least, number, root = ahead.pop()
            if not root and len(best) == k and (bound, -least) <= best[0]:
                continue
            node = self.nodes[number]
            bounds = node.bounds(item)
            open_ = np.flatnonzero(bounds >= (best[0][0] if len(best) == k else 1))
            if node.children is None:
                open_ = open_[np.lexsort((node.least_id[open_], -bounds[open_]))][:k]
                for score, doc in zip(bounds[open_].tolist(), node.least_id[open_].tolist()):
                    if score <= 0:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -doc))
                    elif (score, -doc) > best[0]:
                        heapq.heapreplace(best, (score, -doc))
                continue
            open_ = open_[bounds[open_] > 0]
            open_ = open_[np.argsort(bounds[open_], kind="stable")]  # the best is taken first
            ahead += [(int(bounds[c]), int(node.least_id[c]), node.children[c], False) for c in open_.tolist()]


#: Stands for a missing doc_id: after all others.
NO_ID = np.iinfo(np.int64).max


def best_of_tasks(vectors: DataFrame, rank: np.ndarray, items: list[Item], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: at most ``k`` documents an item from each task.

    ``rank`` turns the number of a term into its place in the order of frequency.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, ms, vectors, pairs = [], [], [], 0
        for batch in batches:
            doc = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            m = length_factors(batch.column("n").to_numpy(), n_docs, n_terms)
            terms, tf = batch.column("terms"), batch.column("tf")
            offsets = terms.offsets.to_numpy()
            numbers, many = rank[terms.values.to_numpy()], tf.values.to_numpy()
            for i, (low, high) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                order = np.argsort(numbers[low:high])
                ids.append(doc[i])
                ms.append(m[i])
                vectors.append((numbers[low:high][order], many[low:high][order]))
                pairs += high - low
                if pairs >= BLOCK_PAIRS or len(ids) >= BLOCK_DOCS:
                    yield np.array(ids), np.array(ms), vectors
                    ids, ms, vectors, pairs = [], [], [], 0
        if ids:
            yield np.array(ids), np.array(ms), vectors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for block in blocks(batches):
            tree = Tree(*block)
            for item, heap in zip(items, best):
                tree.search(item, heap, k)
        rows = [(item.number, item.item_id, None if -doc == NO_ID else -doc, score) for item, heap in zip(items, best) for score, doc in heap]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    found = vectors.filter("size(terms) > 0").select("doc_id", "n", "terms", "tf")
    return found.mapInArrow(search, "item long, item_id long, doc_id long, score long")


def _ranked(docs: DataFrame, texts: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """Ranked documents of the items of one group."""
    own = []
    for _, text in texts:
        hashes = [h for h, _ in term_hashes(text)]
        own.append(np.unique(np.concatenate(hashes), return_counts=True) if hashes else None)
    vocabulary = Vocabulary(np.concatenate([x[0] for x in own if x] or [np.zeros(0, np.uint64)]))
    vectors = staged(restricted_vectors(docs, vocabulary), "lexical-vectors")
    n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary.hashes), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    weight = weights(df, n_docs)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    items = []
    for number, ((item_id, _), terms) in enumerate(zip(texts, own)):
        if terms is not None:
            at = np.searchsorted(vocabulary.hashes, terms[0])
            items.append(Item(number, item_id, rank[at], weight[at] * terms[1]))
    found = best_of_tasks(vectors, rank, items, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data"))
    items = staged(items.filter("data IS NOT NULL").distinct(), "lexical-items")
    groups = block_count(items.agg(F.sum(F.length("data"))).first()[0], ITEM_BYTES)
    group = F.pmod(F.xxhash64("item_id", "data"), F.lit(groups))
    texts = lambda g: [(r.item_id, bytes(r.data)) for r in items.filter(group == g).orderBy("item_id", "data").collect()]
    return reduce(DataFrame.unionByName, [_ranked(docs, texts(g), k) for g in range(groups)])

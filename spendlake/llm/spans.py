"""Substring dedup by sliding spans of sentences.

A text is cut into short sentences: after punctuation, at line ends, and
after words whose hash says so (so that text without punctuation is cut too,
alike wherever it stands). Every run of ``MIN_SENTENCES`` sentences or more with
``MIN_WORDS`` words or more (the shortest from each sentence on) is hashed by its words.
Runs are joined over all documents; the first, by doc_id and place, stays, and sentences
that any other run covers are removed.

Documents travel as blocks. A block sends each of its runs once, with its first place, to the
bucket of its hash, and learns which came earlier elsewhere: one bit for each.

NULL and empty texts have no sentences. Rows without doc_id come last. Rows with one doc_id
are one document: the same run at the same place of them counts once. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_rows, block_count, mixed, runs, staged, text_bytes, word_hashes
from spendlake.llm.suffix import BLOCK_BYTES, Block, blocks, bucket_of, packed, unpacked

MIN_SENTENCES = 3
MIN_WORDS = 20
#: One word in so many ends a sentence by its hash.
HASH_END = 8
#: Bytes of text for each bucket of runs.
BUCKET_BYTES = 16 << 20
_END = re.compile(rb"[.!?,;:][\"')\]]*$")
_TEXT, _RUNS, _BITS = range(3)
_SCHEMA = "block long, kind int, bucket long, payload binary"
# Odd bases of the two hashes, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def sentences(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the sentences of a text, their last words (from 1), and the hashes of all words."""
    hashes, starts = word_hashes(data)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (hashes,)
    words = data.split()
    ends = starts + np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(data, np.uint8)
    closing = hashes % np.uint64(HASH_END) == 0
    last = raw[ends - 1]
    for mark in b".!?,;:":
        closing |= last == mark
    for i in np.flatnonzero((last == 34) | (last == 39) | (last == 41) | (last == 93)).tolist():
        closing[i] |= _END.search(words[i]) is not None
    lines = np.flatnonzero(raw == 10)
    closing[np.maximum(np.searchsorted(starts, lines) - 1, 0)] = True
    closing[-1] = True
    at = np.flatnonzero(closing)
    first = np.r_[0, at[:-1] + 1]
    return starts[first], ends[at], at + 1, hashes


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences, and 64 and 32 bits of hash of every run of a text.

    The hash is a polynomial in the words of the run, from prefix sums.
    """
    _, _, after, words = sentences(data)
    before = np.r_[0, after]
    n = len(after)
    end = np.searchsorted(before, before[:-1] + MIN_WORDS)
    end = np.maximum(end, np.arange(n) + MIN_SENTENCES)
    first = np.flatnonzero(end <= n)
    end = end[first]
    a, b = before[first], before[end]
    found = []
    for salt, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
        terms = mixed(words + np.uint64(salt)) * _powers(base, len(words))[:-1]
        sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        found.append(mixed((sums[b] - sums[a]) * _powers(inverse, len(words))[a] + (b - a).astype(np.uint64)))
    return first, end - first, found[0], (found[1] >> np.uint64(32)).astype(np.uint32)


def covered(data: bytes, first: np.ndarray, count: np.ndarray) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """Text left, sentences, sentences removed, and byte ranges removed, for the given runs."""
    starts, ends, *_ = sentences(data)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count, -1)
    gone = np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    ranges = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(change[::2], change[1::2])]
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), len(starts), int(gone.sum()), ranges


class _Runs:
    """All runs of a block in order of document and place, and which is the first of its hash."""

    def __init__(self, block: Block):
        self.block = block
        found = [spans(text) for text in block.texts()]
        self.lengths = np.array([len(x[0]) for x in found], np.int64)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.first, self.count, high, low = (np.concatenate(x) for x in zip(empty, *found))
        last = np.iinfo(np.int64).max  # rows without doc_id come last
        self.document = np.repeat(np.where(block.known > 0, block.ids, last), self.lengths)
        order = np.lexsort((self.first, self.document, low, high))
        h, g = high[order], low[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(order) else np.zeros(0, bool)
        self.number = np.zeros(len(order), np.int64)  # of the distinct run of each run
        self.number[order] = np.cumsum(new) - 1
        self.head = order[new]
        self.high, self.low = high[self.head], low[self.head]

    def later(self) -> np.ndarray:
        """Runs that are not at the first place of theirs within the block."""
        head = self.head[self.number]
        return (self.document != self.document[head]) | (self.first != self.first[head])


def _firsts(table: pa.Table) -> Iterator[tuple]:
    """Of a bucket of runs: for each block, which came earlier in another one."""
    sent = [unpacked(x.as_py(), "<u8", "<u4", "<i8", "<i4") for x in table.column("payload")]
    high = np.concatenate([np.cumsum(h, dtype=np.uint64) for h, *_ in sent])
    low, document, first = (np.concatenate([s[k] for s in sent]) for k in (1, 2, 3))
    order = np.lexsort((first, document, low, high))
    h, g = high[order], low[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    head = order[new][np.cumsum(new) - 1]
    gone = np.zeros(len(order), bool)
    gone[order] = (document[head] != document[order]) | (first[head] != first[order])
    at = 0
    for block, (own, *_) in zip(table.column("block").to_pylist(), sent):
        yield block, _BITS, table.column("bucket")[0].as_py(), packed(np.packbits(gone[at : at + len(own)]))
        at += len(own)


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed, spans`` of every row: what is left, and the byte ranges gone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("data"))
    buckets = block_count(rows.agg(F.sum(F.length("data"))).first()[0], BUCKET_BYTES)
    text = staged(blocks(rows, block_bytes), "span-blocks")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(3)):
                own = _Runs(Block(payload.as_py()))
                bucket, out = bucket_of(own.high, buckets), []
                for b in np.unique(bucket).tolist():
                    mine = np.flatnonzero(bucket == b)
                    steps = np.diff(own.high[mine], prepend=np.uint64(0))
                    places = own.document[own.head[mine]], own.first[own.head[mine]].astype("<i4")
                    out.append((number, _RUNS, b, packed(steps, own.low[mine], *places)))
                yield arrow_rows(out, _SCHEMA)

    def cleaned(table: pa.Table) -> Iterator[tuple]:
        payloads = {(k, b): x for k, b, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload")))}
        block = Block(payloads[_TEXT, 0])
        own = _Runs(block)
        bucket, gone = bucket_of(own.high, buckets), np.zeros(len(own.high), bool)
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            gone[mine] = np.unpackbits(unpacked(payloads[_BITS, b], "u1")[0], count=len(mine)) > 0
        removed = gone[own.number] | own.later()
        ends = np.cumsum(own.lengths)
        for i, data in enumerate(block.texts()):
            mine = np.arange(ends[i] - own.lengths[i], ends[i])
            mine = mine[removed[mine]]
            left, n, n_gone, ranges = covered(data, own.first[mine], own.count[mine])
            doc_id = int(block.ids[i]) if block.known[i] else None
            yield doc_id, left, n, n_gone, ",".join(f"{p}:{q}" for p, q in ranges)

    bits = runs(text.mapInArrow(sent, _SCHEMA), ["bucket"], _firsts, _SCHEMA)
    schema = "doc_id long, left binary, n_sentences long, n_removed long, spans string"
    done = runs(text.union(bits), ["block"], cleaned, schema)
    return done.withColumn("text", F.decode("left", "UTF-8")).drop("left")

"""Exact substring dedup by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id. Strings never cross documents, and are judged on the input.

1. Documents are written as blocks of some megabytes. The ``LENGTH``-byte windows of a
   block are dealt by their anchor: the 16-byte gram with the least hash in
   the window. Equal windows have equal anchors.
2. A window whose anchor stands in one document only repeats nowhere. Each block sends its distinct anchors,
   and learns which are shared, and which stand in many places.
3. Runs of windows with one shared anchor travel as one piece of text, once for each block,
   with the least document that holds it. Where an anchor stands in many blocks and places, its windows
   travel one by one and are dealt by their own hash, so no anchor makes a large bucket. Others travel as runs,
   which take a fraction of the bytes, in however many blocks they are.
4. A bucket of pieces is sorted as suffixes, one range of first bytes at a time:
   by the first ``COVER`` bytes, then ties by the ranks of the
   suffixes at the positions of a difference cover, which are ranked first. For any two suffixes
   there is a shift below ``COVER`` at which both are ranked. Neighbours that agree on ``LENGTH`` bytes are one
   string; its least document is known then.
5. One bit for each window goes back to its block, which removes what is covered.

NULL texts have no bytes. Rows without doc_id are neither changed nor compared.
Rows with one doc_id never remove from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_rows, block_count, mixed, runs, staged, text_bytes

LENGTH = 50
GRAM = 16
#: Bytes of text in a block, and for each bucket of anchors and of pieces.
BLOCK_BYTES, ANCHOR_BYTES, PIECE_BYTES = 8 << 20, 16 << 20, 2 << 20
#: Windows whose anchor stands in more blocks, with more runs than a bucket has room for, are dealt one by one.
HOT_BLOCKS, HOT_RUNS = 64, 16384
#: Windows anchored at a time, and suffixes sorted at a time.
STEP, SORTED = 1 << 20, 1 << 19
#: A perfect difference set: every shift modulo COVER is a difference of two of its members.
COVER, MEMBERS = 13, (0, 1, 3, 9)

#: Bits of a hash that tell anchors apart; taking two for one only costs work.
_IDENTITY = np.uint64(0xFFFFFFFFFFFF0000)
_TEXT, _SHARED, _PIECES, _BITS = range(4)
_SCHEMA = "block long, kind int, bucket long, payload binary"


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each."""
    return np.cumsum(sizes) - sizes


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary."""
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    return zstandard.compress(b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)]), 3)


def unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(payload)
    sizes = np.frombuffer(data, "<i8", len(kinds))
    starts = 8 * len(kinds) + _before(sizes)
    return [
        np.frombuffer(data, kind, int(n) // np.dtype(kind).itemsize, int(a))
        for kind, n, a in zip(kinds, sizes, starts)
    ]


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in rows of about ``block_bytes`` of text, ordered by doc_id within a row."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            ids = np.array([x[0] or 0 for x in held], "<i8")
            known = np.array([x[0] is not None for x in held], "u1")
            lengths = np.array([len(x[1]) for x in held], "<i8")
            text = np.frombuffer(b"".join(x[1] for x in held), "u1")
            return arrow_rows([(number, _TEXT, 0, packed(ids, known, lengths, text))], _SCHEMA)

        for batch in batches:
            for doc_id, data in zip(batch.column(0), batch.column(1)):
                held.append((doc_id.as_py(), data.as_py()))
                size += len(held[-1][1])
                if size >= block_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return docs.select("doc_id", "data").mapInArrow(gathered, _SCHEMA)


class Block:
    """The documents of a block: ids, where each ends, and all bytes."""

    def __init__(self, payload: bytes):
        self.ids, self.known, self.lengths, text = unpacked(payload, "<i8", "u1", "<i8", "u1")
        self.data = text.tobytes()
        self.ends = np.cumsum(self.lengths)

    def texts(self) -> list[bytes]:
        return [self.data[b - n : b] for n, b in zip(self.lengths.tolist(), self.ends.tolist())]

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first window, number of windows, identity of the anchor."""
        n = len(self.data) - LENGTH + 1
        padded = self.data + b"\0" * 8
        invalid = np.zeros(max(n, 0) + LENGTH + 1, np.int32)
        np.add.at(invalid, np.maximum(self.ends - LENGTH + 1, 0), 1)
        np.add.at(invalid, np.minimum(self.ends, len(invalid) - 1), -1)
        # Documents shorter than a window start inside the marks of their own end.
        starts = self.ends - self.lengths
        short = self.lengths < LENGTH
        np.add.at(invalid, np.maximum(self.ends[short] - LENGTH + 1, 0), -1)
        np.add.at(invalid, starts[short], 1)
        for a, b, known in zip(starts.tolist(), self.ends.tolist(), self.known.tolist()):
            if not known:
                invalid[a] += 1
                invalid[min(b, len(invalid) - 1)] -= 1
        valid = np.cumsum(invalid)[: max(n, 0)] == 0
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        width = LENGTH - GRAM + 1
        for a in range(0, n, STEP):
            windows = min(STEP, n - a)
            count = windows + width - 1
            first = np.ndarray((count,), "<u8", padded, a, (1,))
            second = np.ndarray((count,), "<u8", padded, a + 8, (1,))
            grams = mixed(mixed(first) + second)
            least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < width:
                least = np.minimum(least[: -(width - reach)], least[width - reach :])
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            good = valid[a : a + windows]
            change = np.r_[True, (at[1:] != at[:-1]) | (good[1:] != good[:-1])]
            edges = np.flatnonzero(change)
            sizes = np.diff(np.r_[edges, windows])
            kept = good[edges]
            found.append((edges[kept] + a, sizes[kept], mixed(grams[at[edges[kept]]]) & _IDENTITY))
        return tuple(np.concatenate(x) for x in zip(*found))

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Which document each position lies in."""
        return np.searchsorted(self.ends, starts, side="right")


def bucket_of(identity: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, by its leading bits."""
    return ((identity >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _anchors(block: Block, buckets: int) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a block; its distinct anchors, ascending; whether each stands in two of its documents; its runs."""
    found = block.anchored()
    starts, _, identity = found
    order = np.argsort(identity, kind="stable")
    ordered, owners = identity[order], block.owner(starts)[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    if not len(first):
        return found, ordered, np.zeros(0, bool), np.zeros(0, "<u4")
    several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
    return found, ordered[first], several, np.diff(np.r_[first, len(ordered)]).astype("<u4")


def _shared_anchors(table: pa.Table, hot_blocks: int, hot_runs: int) -> Iterator[tuple]:
    """Of a bucket of anchors: for each block, which are shared, and which stand in many blocks and places."""
    sent = [unpacked(x.as_py(), "<u8", "u1", "<u4") for x in table.column("payload")]
    anchors = [np.cumsum(a, dtype=np.uint64) for a, _, _ in sent]
    distinct, inverse, times = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    shared = times > 1
    several = np.concatenate([np.unpackbits(b, count=len(a)) for (_, b, _), a in zip(sent, anchors)])
    shared[inverse[several > 0]] = True
    hot = (times > hot_blocks) & (np.bincount(inverse, np.concatenate([n for _, _, n in sent])) > hot_runs)
    at = 0
    for block, own in zip(table.column("block").to_pylist(), anchors):
        mine = inverse[at : at + len(own)]
        at += len(own)
        bucket = table.column("bucket")[0].as_py()
        yield block, _SHARED, bucket, packed(np.packbits(shared[mine]), np.packbits(hot[mine]))


class _Pieces:
    """The pieces of a block: which runs of windows repeat elsewhere, each text of theirs once."""

    def __init__(self, table: pa.Table, anchor_buckets: int, piece_buckets: int):
        self.rows = {(k, b): x for k, b, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload")))}
        self.number = table.column("block")[0].as_py()
        self.block = block = Block(self.rows[_TEXT, 0])
        (starts, counts, identity), anchors, _, _ = _anchors(block, anchor_buckets)
        shared, hot = np.zeros((2, len(anchors)), bool)
        bucket = bucket_of(anchors, anchor_buckets)
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            bits = unpacked(self.rows[_SHARED, b], "u1", "u1")
            shared[mine], hot[mine] = (np.unpackbits(x, count=len(mine)) for x in bits)
        place = np.searchsorted(anchors, identity)
        chosen = np.flatnonzero(shared[place])
        whole = chosen[~hot[place[chosen]]]
        single = chosen[hot[place[chosen]]]
        # Windows of hot anchors one by one.
        repeat = counts[single]
        ones = np.repeat(starts[single] - _before(repeat), repeat) + np.arange(repeat.sum())
        begin = np.r_[starts[whole], ones]
        size = np.r_[counts[whole], np.ones(len(ones), np.int64)]
        home = np.r_[bucket_of(mixed(identity[whole]), piece_buckets).astype(np.int64), np.full(len(ones), -1)]
        order = np.argsort(begin, kind="stable")  # documents ascend: the first holder is the least
        self.begin, size, home = begin[order], size[order], home[order]
        owners = block.ids[block.owner(self.begin)]
        data, seen = block.data, {}
        self.by_bucket: dict[int, list[tuple[bytes, int, int]]] = {}
        self.piece = np.zeros(len(begin), np.int64)
        for i, (a, n, h) in enumerate(zip(self.begin.tolist(), size.tolist(), home.tolist())):
            text = data[a : a + n + LENGTH - 1]
            known = seen.get(text)
            if known is None:
                known = seen[text] = len(seen)
                h = zlib.crc32(text) % piece_buckets if h < 0 else h
                self.by_bucket.setdefault(h, []).append((text, int(owners[i]), known))
            self.piece[i] = known
        self.count = len(seen)

    def sent(self) -> Iterator[tuple]:
        """The pieces of each bucket, with the least document that holds each."""
        for h, pieces in self.by_bucket.items():
            sizes = np.array([len(t) - LENGTH + 1 for t, _, _ in pieces], "<i4")
            least = np.array([d for _, d, _ in pieces], "<i8")
            yield self.number, _PIECES, h, packed(sizes, least, np.frombuffer(b"".join(t for t, _, _ in pieces), "u1"))

    def gone(self) -> np.ndarray:
        """First bytes of all windows that a smaller document holds, from the bits that came back."""
        windows, least = np.zeros((2, self.count), np.int64)
        for pieces in self.by_bucket.values():
            for text, document, k in pieces:
                windows[k], least[k] = len(text) - LENGTH + 1, document
        first, bits = _before(windows), np.zeros(int(windows.sum()), bool)
        for h, pieces in self.by_bucket.items():
            numbers = np.array([k for _, _, k in pieces])
            n = windows[numbers]
            sent = np.unpackbits(unpacked(self.rows[_BITS, h], "u1")[0], count=int(n.sum())) > 0
            bits[np.repeat(first[numbers] - _before(n), n) + np.arange(n.sum())] = sent
        n = windows[self.piece]
        local = np.arange(n.sum()) - np.repeat(_before(n), n)
        later = np.repeat(self.block.ids[self.block.owner(self.begin)] > least[self.piece], n)
        return (np.repeat(self.begin, n) + local)[bits[np.repeat(first[self.piece], n) + local] | later]


_SHIFT = np.array(
    [[next(d for d in range(COVER) if (i + d) % COVER in MEMBERS and (j + d) % COVER in MEMBERS) for j in range(COVER)]
     for i in range(COVER)]
)


def _load(padded: bytes, at: np.ndarray, offset: int = 0) -> np.ndarray:
    """The eight bytes from each position on, as numbers that sort like the bytes."""
    view = np.ndarray((len(padded) - 8 - offset,), "<u8", padded, offset, (1,))
    return view[at].byteswap()


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of each key; equal keys get equal ranks, from 1."""
    order = np.argsort(key)
    new = np.r_[False, key[order[1:]] != key[order[:-1]]] if len(key) else np.zeros(0, bool)
    rank = np.zeros(len(order), np.uint64)
    rank[order] = np.cumsum(new) + 1
    return rank


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rank of each pair of ranks below 2**32."""
    return _dense((first << np.uint64(32)) | second)


def _named(padded: bytes, at: np.ndarray) -> np.ndarray:
    """Rank of each position by its first COVER bytes."""
    tail = _load(padded, at, 8) >> np.uint64(8 * (16 - COVER))
    return _paired(_dense(_load(padded, at)), _dense(tail))


def cover_ranks(padded: bytes, size: int) -> np.ndarray:
    """Rank of every suffix at a cover position, by its first 4 * COVER bytes; 0 elsewhere.

    Named by COVER bytes, then doubled twice: the cover is closed under shifts by COVER.
    """
    at = np.arange(size)
    at = at[np.isin(at % COVER, MEMBERS)]
    ranks = np.zeros(size + 4 * COVER, np.uint64)
    ranks[at] = _named(padded, at)
    for step in (COVER, 2 * COVER):
        ranks[at] = _paired(ranks[at], ranks[at + step])
    return ranks.astype(np.int64)


def suffix_order(padded: bytes, suffixes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The given suffixes in order, as far as their first LENGTH bytes tell at least.

    By the first COVER bytes; then tied runs are split again and again at a pivot, the
    suffix at the shift that both share in the cover deciding.
    """
    name = _named(padded, suffixes)
    order = np.argsort(name)
    out = suffixes[order]
    run = name[order].astype(np.int64)
    open_at = np.flatnonzero(np.bincount(run)[run] > 1)
    run = run[open_at]
    while len(open_at):
        values = out[open_at]
        edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[edges, len(run)])
        pivot = np.repeat(values[edges + sizes // 2], sizes)
        shift = _SHIFT[values % COVER, pivot % COVER]
        side = np.sign(ranks[values + shift] - ranks[pivot + shift])
        split = np.argsort(run * 4 + side, kind="stable")
        out[open_at] = values[split]
        run, side = run[split], side[split]
        part = np.cumsum(np.r_[True, (run[1:] != run[:-1]) | (side[1:] != side[:-1])]) - 1
        more = (side != 0) & (np.bincount(part)[part] > 1)
        open_at, run = open_at[more], part[more]
    return out


def _repeated(table: pa.Table) -> Iterator[tuple]:
    """Of a bucket of pieces: for each block, which windows also stand in a smaller document elsewhere.

    A piece that several blocks sent is sorted once, for the least of its documents.
    """
    sent, number = [], {}
    texts: list[bytes] = []
    for payload in table.column("payload"):
        sizes, least, raw = unpacked(payload.as_py(), "<i4", "<i8", "u1")
        ends, data = np.cumsum(sizes + LENGTH - 1), raw.tobytes()
        own = np.zeros(len(sizes), np.int64)
        for i, (a, b) in enumerate(zip((ends - sizes - LENGTH + 1).tolist(), ends.tolist())):
            known = number.setdefault(data[a:b], len(texts))
            if known == len(texts):
                texts.append(data[a:b])
            own[i] = known
        sent.append((own, least))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
    holder = np.full(len(texts), np.iinfo(np.int64).max)
    for own, least in sent:
        np.minimum.at(holder, own, least)
    documents = np.repeat(holder, sizes)
    text = b"".join(texts)
    padded = text + b"\0" * (4 * COVER + 16)
    suffixes = np.repeat(_before(sizes + LENGTH - 1) - _before(sizes), sizes) + np.arange(sizes.sum())
    window = np.full(len(text), -1)
    window[suffixes] = np.arange(len(suffixes))
    ranks = cover_ranks(padded, len(text))
    smallest = documents.copy()
    head = _load(padded, suffixes)
    parts = -(-len(suffixes) // SORTED)
    cuts = np.unique(np.quantile(head, np.arange(1, parts) / parts, method="lower")) if parts > 1 else head[:0]
    part = np.searchsorted(cuts, head, side="right")
    for k in range(len(cuts) + 1):  # one range of first bytes at a time
        ordered = suffix_order(padded, suffixes[part == k], ranks)
        if not len(ordered):
            continue
        same = np.ones(len(ordered) - 1, bool)
        for offset in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            key = _load(padded, ordered, offset)
            same &= key[1:] == key[:-1]
        first = np.flatnonzero(np.r_[True, ~same])
        numbers = window[ordered]
        least = np.minimum.reduceat(documents[numbers], first)
        smallest[numbers] = np.repeat(least, np.diff(np.r_[first, len(ordered)]))
    begins = _before(sizes)
    bucket = table.column("bucket")[0].as_py()
    for block, (own, least) in zip(table.column("block").to_pylist(), sent):
        n = sizes[own]
        at = np.repeat(begins[own] - _before(n), n) + np.arange(n.sum())
        yield block, _BITS, bucket, packed(np.packbits(smallest[at] < np.repeat(least, n)))


def _cleaned(pieces: _Pieces, with_text: bool) -> Iterator[tuple]:
    """Of a block: each document with what is left of it."""
    block, at = pieces.block, pieces.gone()
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    removed = np.cumsum(edge[:-1]) > 0
    raw = np.frombuffer(block.data, np.uint8)
    for doc_id, known, a, b in zip(
        block.ids.tolist(), block.known.tolist(), (block.ends - block.lengths).tolist(), block.ends.tolist()
    ):
        mine = removed[a:b]
        change = np.flatnonzero(np.diff(np.r_[False, mine, False]))
        left = raw[a:b][~mine].tobytes() if len(change) else block.data[a:b]
        row = (doc_id if known else None, b - a, b - a - len(left), len(change) // 2, hashlib.sha256(left).hexdigest())
        spans = ",".join(f"{p}:{q}" for p, q in zip(change[::2].tolist(), change[1::2].tolist()))
        yield (*row, spans, left) if with_text else (*row, spans)


def without_repeats(
    docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; ``kept``: the bytes left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("data"))
    size = rows.agg(F.sum(F.length("data"))).first()[0]
    anchor_buckets, piece_buckets = block_count(size, ANCHOR_BYTES), block_count(size, PIECE_BYTES)
    text = staged(blocks(rows, block_bytes), "suffix-blocks")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(3)):
                _, distinct, several, times = _anchors(Block(payload.as_py()), anchor_buckets)
                bucket, out = bucket_of(distinct, anchor_buckets), []
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    steps = np.diff(distinct[mine], prepend=np.uint64(0))
                    out.append((number, _SHARED, b, packed(steps, np.packbits(several[mine]), times[mine])))
                yield arrow_rows(out, _SCHEMA)

    share = lambda table: _shared_anchors(table, hot_blocks, hot_runs)
    shared = staged(runs(text.mapInArrow(anchors, _SCHEMA), ["bucket"], share, _SCHEMA), "suffix-shared")
    # The pieces of a block are found twice, to be sent and to be read: less disk than writing them.
    cut = lambda table: _Pieces(table, anchor_buckets, piece_buckets)
    sent = lambda table: cut(table).sent()
    clean = lambda table: _cleaned(cut(table), with_text)
    known = text.union(shared)
    bits = runs(runs(known, ["block"], sent, _SCHEMA), ["bucket"], _repeated, _SCHEMA)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return runs(known.union(bits), ["block"], clean, schema + ", kept binary" * with_text)

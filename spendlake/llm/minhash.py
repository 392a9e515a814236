"""Near-duplicate documents by consistent weighted sampling.

A document is its set of five-word shingles; a shingle weighs its count (damped:
1 + log) times the mean inverse document frequency of its words (frequencies over all
documents, in a hashed table of fixed size). Improved consistent weighted
sampling draws ``SAMPLES`` shingles; two documents draw the same one with the
probability of their weighted Jaccard similarity. Samples are grouped in bands;
documents that share a band and enough samples are candidates, and candidates
are verified by the exact weighted Jaccard similarity of their shingles.

Exact copies are one text from the start. Links between texts are joined
to classes; a class is named by its least doc_id. A text with fewer than five words is
one shingle. NULL texts and texts without words are alone in their class, as are rows without
doc_id. Repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import free_name, mixed, runs, slices, staged, text_bytes, word_hashes
from spendlake.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Candidates share so many samples (below it a pair of SIMILARITY has one chance in 100,000).
SHARED_SAMPLES = 35
#: Word frequencies are counted in a table of so many slots.
WORD_SLOTS = 1 << 18
#: Members of a part of a band (two parts meet), and bytes of text, that one comparison holds.
BAND_ROWS = 4000
GROUP_BYTES = 32 << 20
#: Shingles drawn from at a time, so that the arrays stay in cache.
DRAW_BLOCK = 1 << 15


def _gamma_table() -> np.ndarray:
    """65,536 even quantiles of the gamma distribution of shape 2."""
    x = np.concatenate([np.geomspace(1e-6, 1, 20000), np.linspace(1.0001, 40, 40000)])
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(WORD_SLOTS - 1)).astype(np.int64)


def shingles(data: bytes, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, with their weights."""
    words = word_hashes(data)[0]
    if not len(words):
        return words, np.zeros(0, np.float32)
    n = min(SHINGLE_WORDS, len(words))
    count = len(words) - n + 1
    hashes, weight = np.zeros(count, np.uint64), np.zeros(count, np.float32)
    rare = rarity[_slot(words)]
    for i in range(n):
        hashes = mixed(hashes + words[i : i + count])
        weight += rare[i : i + count]
    order = np.argsort(hashes)
    hashes, weight = hashes[order], weight[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    times = np.diff(np.r_[first, count])
    return hashes[first], weight[first] * (1 + np.log(times, dtype=np.float32)) / n


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


class Sampler:
    """Improved consistent weighted sampling, ``SAMPLES`` draws for each set."""

    def __init__(self):
        self.r = _gamma_table()
        self.log_c = np.log(self.r)
        self.seeds = (mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def draw(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of SAMPLES 32-bit draws for each set; sets are runs from ``starts``."""
        out = np.zeros((len(starts), SAMPLES), np.uint32)
        log_w = np.log(weights)
        base = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(hashes)]))
        for k in range(SAMPLES):
            x = base ^ self.seeds[k]
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            x ^= x >> np.uint32(16)
            r, log_c = self.r[x & np.uint32(0xFFFF)], self.log_c[x >> np.uint32(16)]
            shift = (x * np.uint32(0x9E3779B1)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(log_w / r + shift)
            log_a = log_c - r * (t - shift + 1)
            least = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a == least[owner])
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            out[:, k] = base[at] * np.uint32(0x85EBCA6B) ^ (t[at].astype(np.int32).view(np.uint32) * np.uint32(0xC2B2AE35))
        return out

    def sketches(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """The draws of each non-empty set, in blocks of about DRAW_BLOCK shingles."""
        out: list[bytes] = []
        start = 0
        while start < len(sets):
            end, held = start, 0
            while end < len(sets) and (end == start or held + len(sets[end][0]) <= DRAW_BLOCK):
                held += len(sets[end][0])
                end += 1
            block = sets[start:end]
            starts = np.cumsum([0, *(len(h) for h, _ in block[:-1])])
            drawn = self.draw(np.concatenate([h for h, _ in block]), np.concatenate([w for _, w in block]), starts)
            out.extend(row.tobytes() for row in drawn.astype("<u4"))
            start = end
        return out


def word_rarity(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every word slot, over all of ``docs`` (``data``)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORD_SLOTS + 1, np.int64)  # the last slot counts documents
        for batch in batches:
            for data in batch.column(0):
                slots = np.unique(_slot(word_hashes(data.as_py())[0]))
                table[slots] += 1
                table[-1] += 1
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["slot", "n"])

    rows = docs.select("data").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    frame = rows.toPandas()  # WORD_SLOTS + 1 rows at most
    table = np.zeros(WORD_SLOTS + 1)
    table[frame["slot"].to_numpy(int)] = frame["n"].to_numpy(float)
    return (np.log((table[-1] + 1) / (table[:-1] + 1)) + 1).astype(np.float32)


def sketched(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """``doc_id, sketch, n_bytes``; no sketch where there are no words."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # WORD_SLOTS floats

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = [shingles(x, shared.value) for x in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s[0])]
                drawn = dict(zip(full, sampler.sketches([sets[i] for i in full])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[a:b], pa.int64()),
                        pa.array([drawn.get(i) for i in range(b - a)], pa.binary()),
                        pa.array([len(x) for x in texts[a:b]], pa.int64()),
                    ],
                    ["doc_id", "sketch", "n_bytes"],
                )

    return docs.select("doc_id", "data").mapInArrow(sketch, "doc_id long, sketch binary, n_bytes long")


def _sketch_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SAMPLES)


def _least_joined(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each member the least id of those that have its root."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return least[root]


def _agreeing(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """Members of a band (or of two parts of it) that are joined by enough shared samples, as stars of least ids."""
    ids, sketches = rows.column("doc_id").to_numpy(), _sketch_matrix(rows.column("sketch"))
    root = np.arange(len(ids))
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        close = rest[(sketches[rest] == sketches[i]).sum(1) >= SHARED_SAMPLES]
        for j in close.tolist():
            root[root == root[j]] = root[i]
    least = _least_joined(ids, root)
    far = ids != least
    yield from zip(least[far].tolist(), ids[far].tolist())


def candidate_links(texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all texts (``doc_id``, ``sketch``) sharing a band and enough samples.

    A band with more than BAND_ROWS members is split in parts, and every two parts meet in a task of
    their own, so that any two members are compared: exact, in bounded memory.
    """
    width = 4 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)) for k in range(BANDS)]
    members = texts.select("doc_id", "sketch", F.explode(F.array(*keys)).alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("band", F.ceil(F.col("n") / BAND_ROWS).alias("parts"))
    shared = members.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p != F.col("part"))
    meets = F.when(F.col("parts") == 1, F.array("part")).otherwise(others)
    met = shared.withColumn("other", F.explode(meets)).select(
        "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "doc_id", "sketch"
    )
    return runs(met, ["band", "low", "high"], _agreeing, "a long, b long").distinct()


class _Overlaps:
    """The sets of a group, to be compared one with many."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets = sets
        self.total = np.array([s[1].sum() for s in sets])
        self.sizes = np.array([len(s[0]) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        known, numbers = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
        self.numbers = numbers.astype(np.int32)  # the sets one after the other
        self.weights = np.concatenate([s[1] for s in sets])
        self.one = np.zeros(len(known), np.float32)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose weighted Jaccard similarity with set ``i`` is high enough."""
        if not len(others):
            return others
        own = slice(self.starts[i], self.starts[i] + self.sizes[i])
        self.one[self.numbers[own]] = self.weights[own]
        n = self.sizes[others]
        first = np.cumsum(n) - n
        at = np.repeat(self.starts[others] - first, n) + np.arange(n.sum())
        lesser = np.minimum(self.one[self.numbers[at]], self.weights[at])
        self.one[self.numbers[own]] = 0
        both = np.add.reduceat(lesser, first, dtype=np.float64)
        similar = both / (self.total[others] + float(self.total[i]) - both)
        # Sums in another order differ in the last digits: those at the edge are compared alone.
        edge = np.flatnonzero(np.abs(similar - SIMILARITY) < 1e-4)
        similar[edge] = [weighted_jaccard(self.sets[i], self.sets[j]) for j in others[edge].tolist()]
        return others[similar >= SIMILARITY]


def _verified(rarity) -> Callable:
    """Links of a group whose weighted Jaccard similarity is high enough, as a spanning forest.

    With each link the least id that it is joined to in this group.
    """

    def verify(rows: pa.Table) -> Iterator[tuple[int, int, int]]:
        ids, sketches = rows.column("doc_id").to_numpy(), _sketch_matrix(rows.column("sketch"))
        overlaps = _Overlaps([shingles(x.as_py(), rarity.value) for x in rows.column("data")])
        total = overlaps.total
        root, links = np.arange(len(ids)), []
        for i in range(len(ids) - 1):
            rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            lesser, greater = np.minimum(total[rest], total[i]), np.maximum(total[rest], total[i])
            rest = rest[lesser >= SIMILARITY * greater * 0.9999]
            same = (sketches[rest] == sketches[i]).sum(1)
            order = np.argsort(-same, kind="stable")
            order = order[same[order] >= SHARED_SAMPLES]
            for j in overlaps.near(i, rest[order]).tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append((i, j))
        least = _least_joined(ids, root)
        for i, j in links:
            yield int(ids[i]), int(ids[j]), int(least[i])

    return verify


def verified_links(docs: DataFrame, texts: DataFrame, groups: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Links ``a, b`` between texts of a candidate group (``node, component``) that are near duplicates.

    ``least`` is the least text that a task joined them to.

    A group with more than GROUP_BYTES of text is split in parts, and every two parts meet in a
    task of their own: exact, in bounded memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    members = texts.join(groups, texts["doc_id"] == groups["node"]).select("doc_id", "component", "n_bytes", "sketch")
    sizes = members.groupBy("component").agg(F.ceil(F.sum("n_bytes") / GROUP_BYTES).alias("parts"))
    members = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    # A part meets itself once, and each other part once: part p goes to (p, q) and (q, p).
    meets = F.when(F.col("parts") <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0)))
    )
    members = members.withColumn("other", F.explode(meets)).select(
        "component",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        F.col("doc_id").alias("_id"),
        "sketch",
    )
    whole = members.join(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), F.col("_id") == F.col("doc_id"))
    whole = whole.select("component", "low", "high", "doc_id", "sketch", "data")
    return runs(whole, ["component", "low", "high"], _verified(shared), "a long, b long, least long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row; ``n_links``: links to other texts that made the class."""
    has_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("data"), has_words.alias("full")
    )
    rarity = word_rarity(docs)
    keys = staged(docs.select("doc_id", "full", F.sha2("data", 256).alias("text_key")), "near-keys")
    first = keys.filter("doc_id IS NOT NULL AND full").groupBy("text_key").agg(F.min("doc_id").alias("text_id"))
    texts = staged(sketched(docs, rarity), "near-sketches")
    chosen = texts.filter("sketch IS NOT NULL").join(
        first.select(F.col("text_id").alias("doc_id")), "doc_id", "left_semi"
    )
    chosen = staged(chosen.dropDuplicates(["doc_id"]), "near-texts")
    groups = components(candidate_links(chosen.select("doc_id", "sketch")))
    links = staged(verified_links(docs, chosen, groups, rarity), "near-links")
    # Links to the least are stars already, where no group was split.
    stars = F.inline(F.array(*[F.struct("least", F.col(end).alias("b")) for end in ("a", "b")])).alias("a", "b")
    classes = components(links.select(stars))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = (
        keys.join(first, "text_key", "left")
        .join(classes, F.col("text_id") == F.col("node"), "left")
        .drop("node")
        .join(ends, F.col("text_id") == F.col("node"), "left")
    )
    alone = F.col("doc_id").isNull() | ~F.col("full")
    return named.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "text_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name a class; rows with equal doc_id and text once. Rows without doc_id stay.

    Of one doc_id with different texts each stays, unless its class has a smaller doc_id.
    """
    turn = free_name(docs, "near_turn")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    classes = near_duplicates(docs)
    losers = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_loser"))
    left = docs.join(losers.distinct(), docs["doc_id"].cast("long") == F.col("_loser"), "left_anti")
    first = left.filter("doc_id IS NOT NULL").withColumn(turn, F.row_number().over(order))
    return first.filter(F.col(turn) == 1).drop(turn).union(left.filter("doc_id IS NULL"))

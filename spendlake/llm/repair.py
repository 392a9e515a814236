"""Conversation structure repair by an auction for shortest paths.

A conversation of n rows is a lattice of nodes (i, state), i rows read, with
the states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. Arcs are
edits: Keep (0), Rerole to the role the state asks for (1), Delete (2),
Insert an empty row of that role (5, within a layer); a truncated row that is
not deleted adds 5, a blank or duplicate row has Delete alone. The shortest path from
(0, nothing) to (n, nothing or after a) is the cheapest repair.

The auction keeps a price for each node and a path from its origin. At the
path's end, if the price is below the best arc's cost plus the price beyond,
it rises to that and the path contracts by a node; else the path extends along the
best arc. All cycles (two inserts) cost something, so paths stay simple. Each node
is an origin in turn, last layer first, with the prices kept; a path that meets a
converged node makes all its nodes converge. Prices then are exact costs to
go, arcs with cost = price - price beyond are the tight ones, and every path of
tight arcs is a cheapest repair. A node's arcs have different initials, so the
ASCII-least one is traced by taking the least tight arc at each node.

Rows go by turn, NULL turns first, then role, then a hash of the text; equal
rows stay side by side. A row is faulty by the first of: blank (no character but ASCII white
space), duplicate (role and text of an earlier row), truncated (its last such
character is not one of ``.!?``). NULL role and text are one space. A role whose first
character is not s, u or a (or that is empty) cannot be kept. Repeated rows of a
turn are rows; extra columns are ignored; NULL conv_id is a conversation.

What a task holds of a conversation is a byte a row (its role's initial and fault), its
edits, and the prices of one block of rows. Texts pass by in order: a
conversation is never held whole. It is one group of the exchange, since its
edits and hash are one row of the result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\n\x0b\f\r"
INITIALS = "sua"
OTHER = 3
FAULTS = ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Role initials that each state takes, with the state they lead to. 0: nothing yet; 1: after s; 2: after u; 3: after a.
GRAMMAR = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
ASKED = (1, 1, 2, 1)  # the role that Rerole and Insert give in each state: never s
NAMES = {1: "user", 2: "assistant"}
LAWFUL = {(0, 1), (1, 2), (2, 1)}
#: Rows whose prices are held at a time.
BLOCK = 4096
#: Conversations of so many rows at most, and so many of them, are remembered by their codes.
SHORT, REMEMBERED = 64, 50_000
STATISTICS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _arcs(code: int | None, state: int) -> tuple[tuple[str, int, int], ...]:
    """``(initial, cost, offset)`` of each arc of a node, by initial; nodes are numbered four to a layer.

    ``code`` is a row's initial + 4 * fault; None stands for the end of the conversation.
    """
    inserted = GRAMMAR[state][ASKED[state]]
    arcs = [("I", INSERT, inserted - state)]
    if code is None:
        # The way out lies behind the four nodes of the last layer.
        return (("", 0, 4 - state), *arcs) if state in (0, 3) else tuple(arcs)
    initial, fault = code % 4, FAULTS[code // 4]
    arcs.append(("D", DELETE, 4))
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial in GRAMMAR[state]:
            arcs.append(("K", KEEP + more, 4 + GRAMMAR[state][initial] - state))
        arcs.append(("R", REROLE + more, 4 + inserted - state))
    return tuple(sorted(arcs))


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(4 * len(FAULTS))]
END = [_arcs(None, state) for state in range(4)]


def converged_prices(codes: bytes, beyond: list[int] | None) -> list[int]:
    """Prices of all nodes of a block of rows, four to a layer, with the layer behind its last row.

    ``beyond`` has the converged prices of that layer; None if the conversation ends there.
    """
    n = len(codes)
    layers = [ARCS[code] for code in codes] + [END]
    prices, done = [0] * (4 * n + 5), bytearray(4 * n + 5)
    done[4 * n + 4] = 1
    if beyond is not None:
        prices[4 * n : 4 * n + 4] = beyond
        done[4 * n : 4 * n + 4] = b"\1" * 4
    for origin in range(4 * n + 3, -1, -1):
        path = [origin]
        while not done[node := path[-1]]:
            best, to = min((cost + prices[node + offset], node + offset) for _, cost, offset in layers[node >> 2][node & 3])
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            done[node] = 1
    return prices


def _traced(codes: bytes, prices: list[int], state: int, ends: bool) -> tuple[str, int]:
    """Initials of the ASCII-least tight arcs from the first layer to the last, and the state there."""
    out, node, n = [], state, len(codes)
    layers = [ARCS[code] for code in codes] + [END]
    while node < 4 * n or ends and node < 4 * n + 4:
        label, offset = next(
            (label, offset)
            for label, cost, offset in layers[node >> 2][node & 3]
            if cost + prices[node + offset] == prices[node]
        )
        out.append(label)
        node += offset
    return "".join(out), node & 3


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a conversation, the ASCII-least of them."""
    return _remembered(codes) if len(codes) <= SHORT else _solved(codes)


def _solved(codes: bytes) -> tuple[int, str]:
    starts = range(0, max(len(codes), 1), BLOCK)
    beyond: list[list[int] | None] = [None]
    for start in reversed(starts):
        beyond.append(converged_prices(codes[start : start + BLOCK], beyond[-1])[:4])
    cost, state, parts = beyond.pop()[0], 0, []
    for start in starts:
        own, ahead = codes[start : start + BLOCK], beyond.pop()
        part, state = _traced(own, converged_prices(own, ahead), state, ahead is None)
        parts.append(part)
    return cost, "".join(parts)


@functools.lru_cache(REMEMBERED)
def _remembered(codes: bytes) -> tuple[int, str]:
    return _solved(codes)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, present``: rows after the damage that a hash of their place deals them.

    A dropped row stays with ``present`` false: it tells of its conversation alone.
    """
    space = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    damage = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(damage == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
        (damage != 0).alias("present"),
    )


ORDER = ("turn", "role", "h1", "h2", "copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with what orders and compares them: NULL role and text as a space, hashes of the text."""
    names = {c.lower() for c in rows.columns}
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        (F.col("copy") if "copy" in names else F.lit(0)).cast("int").alias("copy"),
        (F.col("present") if "present" in names else F.lit(True)).cast("boolean").alias("present"),
        text.alias("text"),
    )


def _codes() -> Column:
    """A row's initial and fault as a number, but for duplicates."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    bare = F.btrim("text", F.lit(WHITE))
    fault = F.when(F.length(bare) == 0, FAULTS.index("blank"))
    fault = fault.when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    return (code + 4 * fault).cast("int")


class _Conversation:
    """What is known of a conversation while its rows go by in order."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, codes: np.ndarray, turns: pa.Array) -> None:
        self.codes += codes.astype(np.uint8).tobytes()
        known = np.unique(turns.drop_null().to_numpy(zero_copy_only=False))
        if len(known):
            self.turns += len(known) - (self.high is not None and self.high == known[0])
            self.low = int(known[0]) if self.low is None else self.low
            self.high = int(known[-1])

    def solved(self) -> tuple[list[int], str]:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        faults = np.bincount(codes // 4, minlength=len(FAULTS))
        initial = (codes % 4).astype(np.int64)
        lawful = np.zeros(16, bool)
        lawful[[4 * a + b for a, b in LAWFUL]] = True
        illegal = int((~lawful[4 * initial[:-1] + initial[1:]]).sum()) if len(codes) else 0
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest_edits(bytes(self.codes))
        return [gaps, *(int(faults[FAULTS.index(f)]) for f in ("blank", "duplicate", "truncated")), illegal, cost], audit


def _runs(batch: pa.RecordBatch, last: object) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """Parts of a batch with one conv_id each; whether each begins a conversation."""
    ids = batch.column("conv_id").to_pylist()
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield ids[start], start > 0 or last is _NONE or ids[start] != last, batch.slice(start, end - start)


_NONE = object()


def solved(rows: DataFrame) -> DataFrame:
    """``conv_id, stats, audit`` of every conversation of ``rows`` (conv_id, turn, role, text).

    ``stats`` holds STATISTICS in order. ``copy`` (order among equal rows) and ``present`` may be
    given; a row that is not present only makes its conversation known.
    """
    narrow = _ordered(rows)
    narrow = narrow.withColumn("code", _codes()).drop("text").repartition("conv_id")
    # The exchange by conversation serves the window too.
    same = "row_number() OVER (PARTITION BY conv_id, role, h1, h2, present ORDER BY turn NULLS FIRST, copy)"
    again = (F.expr(same) > 1) & (F.floor(F.col("code") / 4) != FAULTS.index("blank"))
    code = F.when(again, F.col("code") % 4 + 4 * FAULTS.index("duplicate")).otherwise(F.col("code"))
    narrow = narrow.withColumn("code", code.cast("int")).sortWithinPartitions("conv_id", *ORDER)
    conv_type = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("stats", T.ArrayType(T.LongType())), T.StructField("audit", T.StringType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out, kind = _NONE, None, [], pa.null()

        def told() -> pa.RecordBatch:
            ids, results = [x for x, _ in out], [c.solved() for _, c in out]
            arrays = [pa.array(ids, kind), pa.array([s for s, _ in results], pa.list_(pa.int64())), pa.array([a for _, a in results], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "stats", "audit"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, begins, part in _runs(batch, last):
                if begins:
                    held = _Conversation()
                    out.append((conv, held))
                last = conv
                present = part.filter(part.column("present"))
                held.add(present.column("code").to_numpy(), present.column("turn"))
            if len(out) > 1:
                kept = out.pop()
                yield told()
                out = [kept]
        if out:
            yield told()

    return narrow.select("conv_id", "turn", "present", "code").mapInArrow(solve, schema)


def _edited(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Each conversation's result, then its rows in order, in one partition."""
    columns = ["conv_id", "kind", *ORDER, "stats", "text"]
    texts = _ordered(rows).filter("present").withColumn("kind", F.lit(1)).withColumn("stats", F.lit(None).cast("array<long>"))
    first = results.withColumns(
        {"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""), "h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "copy": F.lit(0), "text": F.col("audit")}
    )
    both = texts.select(*columns).unionByName(first.select(*columns))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, stats, audit)`` where a conversation begins; ``(edit, role, text)`` of each row that stays."""
    last, audit, place, state = _NONE, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            yield "insert", NAMES[ASKED[state]], ""
            state, place = GRAMMAR[state][ASKED[state]], place + 1

    for batch in batches:
        for conv, begins, part in _runs(batch, last):
            roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
            if begins:
                yield from inserted()
                last, audit, place, state = conv, texts[0], 0, 0
                yield conv, part.column("stats")[0].as_py(), audit
            for role, text in zip(roles[begins:], texts[begins:]):
                yield from inserted()
                edit, place = audit[place], place + 1
                if edit == "K":
                    state = GRAMMAR[state][INITIALS.index(role[0])]
                    yield "keep", role, text
                elif edit == "R":
                    role = NAMES[ASKED[state]]
                    state = GRAMMAR[state][ASKED[state]]
                    yield "rerole", role, text
    yield from inserted()


def _told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repaired_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the rows of the repaired conversations, from position 0."""
    conv_type = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv_type)]).add("position", "long").add("edit", "string").add("role", "string").add("text", "string")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([("conv_id", first.schema.field("conv_id").type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out, conv, position, size = [], None, 0, 0
        for event in _events(_chained(first, batches)):
            if not isinstance(event[1], str):
                conv, position = event[0], 0
                continue
            out.append((conv, position, *event))
            position, size = position + 1, size + len(event[2])
            if len(out) >= 10_000 or size > 4 << 20:
                yield _told(out, arrow)
                out, size = [], 0
        yield _told(out, arrow)

    return _edited(rows, results).mapInArrow(listed, schema)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id, stats, audit, repaired_sha256`` of every conversation: the hash of its repaired ``role:text`` lines."""
    conv_type = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("stats", T.ArrayType(T.LongType()))]).add("audit", "string").add("repaired_sha256", "string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([("conv_id", first.schema.field("conv_id").type), ("stats", pa.list_(pa.int64())), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out, current, digest, lines = [], None, None, 0
        for event in _events(_chained(first, batches)):
            if isinstance(event[1], str):
                digest.update(f"{'' if lines == 0 else chr(10)}{event[1]}:{event[2]}".encode())
                lines += 1
                continue
            if current is not None:
                out.append((*current, digest.hexdigest()))
            current, digest, lines = event, hashlib.sha256(), 0
            if len(out) >= 10_000:
                yield _told(out, arrow)
                out = []
        if current is not None:
            out.append((*current, digest.hexdigest()))
        yield _told(out, arrow)

    return _edited(rows, results).mapInArrow(hashed, schema)


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, STATISTICS, ``audit, repaired_sha256`` of every conversation."""
    found = digests(rows, solved(rows))
    stats = (F.get("stats", i).alias(name) for i, name in enumerate(STATISTICS))
    return found.select("conv_id", *stats, "audit", "repaired_sha256")

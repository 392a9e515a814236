"""Suffix, span and near-duplicate dedup against brute force."""

import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from spendlake.llm import minhash, spans, suffix
from spendlake.llm.components import components

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "té") for b in ("na", "so", "vi", "pel") for c in ("", "rt", "sh")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def world():
    """Copies, shared passages, a common line, runs of one byte, short, empty and NULL texts."""
    rng = random.Random(5)
    passage, line = prose(rng, 60), "licensed under the very same terms as all the other texts of this world"
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            text = f"{text}\n{line}\n{prose(rng, 20)}"
        if i % 7 == 0:
            text = f"{prose(rng, 10)} {passage} {text}"
        rows.append((i, text))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (7, rows[7][1]), (102, "a" * 700), (103, "a" * 400), (104, "é" * 90)]
    rows += [(105, ""), (106, None), (107, "short"), (None, rows[4][1]), (108, rows[5][1] + " " + rows[6][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string")


def suffix_truth(rows):
    """Row to (bytes, removed, spans, hash), by a set of all strings of 50 bytes."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for a in range(len(data) - 49):
            if i is not None:
                first[data[a : a + 50]] = min(i, first.get(data[a : a + 50], i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 49):
            if i is not None and first[data[a : a + 50]] < i:
                gone[a : a + 50] = True
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        n = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out.append((i, len(data), int(gone.sum()), n, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("block_bytes", "hot"), [(4_000, 64), (4_000, 1), (1 << 20, 64)])
def test_suffix_equals_brute_force(spark, world, block_bytes, hot):
    df = suffix.without_repeats(frame(spark, world).repartition(3), True, block_bytes, hot)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [tuple(r)[:5] for r in df.collect()]
    assert sorted(got, key=key) == sorted(suffix_truth(world), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in df.collect())


def test_suffix_windows_one_by_one(spark, world):
    df = suffix.without_repeats(frame(spark, world).repartition(3), False, 4_000, 1, 0)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:5] for r in df.collect()), key=key) == sorted(suffix_truth(world), key=key)


def test_suffix_runs_stay_whole_in_many_blocks():
    """An anchor is not hot for standing in many blocks, but for having more runs than a bucket has room for."""
    anchors, several = np.array([5 << 16, 9 << 16], np.uint64), np.packbits([False, False])

    def hot(blocks, runs):
        sent = suffix.packed(np.diff(anchors, prepend=np.uint64(0)), several, np.array([1, runs], "<u4"))
        rows = pa.table({"block": list(range(blocks)), "bucket": [0] * blocks, "payload": [sent] * blocks})
        given = list(suffix._shared_anchors(rows, suffix.HOT_BLOCKS, suffix.HOT_RUNS))
        return {tuple(np.unpackbits(suffix.unpacked(row[3], "u1", "u1")[1], count=2).tolist()) for row in given}

    assert hot(100, 1) == {(0, 0)} and hot(100, 200) == {(0, 1)} and hot(60, 2000) == {(0, 0)}


def test_suffix_empty(spark):
    assert suffix.without_repeats(frame(spark, [])).collect() == []


def test_suffix_order_is_the_order_of_suffixes():
    """Many ties longer than the cover: the order must be that of the first 50 bytes."""
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(40)) * 20 + b"a" * 300 + bytes(rng.choice(b"abc") for _ in range(500))
    padded = text + b"\0" * (4 * suffix.COVER + 16)
    starts = np.arange(len(text) - 50)
    order = suffix.suffix_order(padded, starts, suffix.cover_ranks(padded, len(text)))
    assert sorted(order.tolist()) == starts.tolist()
    keys = [text[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys)


def test_cover_meets_every_pair():
    for i in range(suffix.COVER):
        for j in range(suffix.COVER):
            shift = suffix._SHIFT[i, j]
            assert (i + shift) % suffix.COVER in suffix.MEMBERS and (j + shift) % suffix.COVER in suffix.MEMBERS


def span_truth(rows):
    """Sentences that a repeated run covers, by a dictionary of the words of the runs."""
    first, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        after = spans.sentences(data)[2].tolist()
        gone, before, words = set(), [0, *after], data.split()
        for at in range(len(after)):
            n = next((n for n in range(3, len(after) - at + 1) if before[at + n] - before[at] >= 20), 0)
            if n and first.setdefault(tuple(words[before[at] : before[at + n]]), (i, at)) != (i, at):
                gone |= set(range(at, at + n))
        out[i] = (len(after), len(gone))
    return out


@pytest.mark.parametrize("block_bytes", [4_000, 1 << 20])
def test_spans_equal_brute_force(spark, world, block_bytes):
    texts = dict(world)
    got = spans.without_repeats(frame(spark, world).repartition(3), block_bytes).collect()
    assert len(got) == len(world)
    with_id = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in with_id} == span_truth([r for r in world if r[0] is not None])
    assert sum(r.n_removed for r in with_id) > 100
    for r in got:
        left = (texts[r.doc_id] or "").encode()
        for part in reversed([p for p in r.spans.split(",") if p]):
            a, b = map(int, part.split(":"))
            left = left[:a] + left[b:]
        assert r.text == left.decode()
    assert spans.without_repeats(frame(spark, [])).collect() == []


def test_spans_of_text_without_marks(spark):
    """A passage of 60 words without any mark is found inside other text."""
    rng = random.Random(9)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i, " ".join([prose(rng, 30), passage, prose(rng, 30)])) for i in range(3)] + [(3, prose(rng, 90))]
    got = {r.doc_id: r for r in spans.without_repeats(frame(spark, rows)).collect()}
    assert got[0].n_removed == got[3].n_removed == 0
    assert len(got[1].text.split()) < 85 and len(got[2].text.split()) < 85


def jaccard(a, b):
    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows, groups = [], {}
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for copy in range(4):
            words = list(base)
            if copy:
                words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            rows.append((10 * g + copy, " ".join(words)))
            groups[10 * g + copy] = 10 * g
    lone = [(500 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)]
    half = (900, " ".join(rows[0][1].split()[:60] + [f"x{i}" for i in range(60)]))
    odd = [(600, ""), (601, None), (602, " \n"), (603, "one two"), (604, "one two"), (None, rows[0][1]), (0, rows[0][1])]
    assert jaccard(rows[0][1], half[1]) < 0.5
    got = minhash.near_duplicates(frame(spark, rows + lone + [half] + odd)).collect()
    assert len(got) == len(rows) + len(lone) + 1 + len(odd)
    classes = {r.doc_id: r.class_id for r in got}
    assert {i: classes[i] for i in groups} == groups
    assert all(classes[i] == i for i in [*range(500, 520), 600, 601, 602, 603, 900])
    assert classes[604] == 603 and classes[None] is None
    kept = minhash.one_of_each(frame(spark, rows + odd)).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x or 0)) == [*range(0, 120, 10), 600, 601, 602, 603, None]
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_large_bands_lose_no_link(spark, monkeypatch):
    """All texts share one band only; members that agree are found in whatever parts they are."""
    monkeypatch.setattr(minhash, "BAND_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = []
    for pair in range(20):
        one = rng.integers(1, 2**32, minhash.SAMPLES, dtype=np.uint32)
        one[: minhash.ROWS] = 7
        two = one.copy()
        two[minhash.ROWS :: minhash.ROWS] ^= 1  # no other band is equal, but most samples are
        rows += [(2 * pair, one.astype("<u4").tobytes()), (2 * pair + 1, two.astype("<u4").tobytes())]
    links = minhash.candidate_links(spark.createDataFrame(rows, "doc_id long, sketch binary")).collect()
    assert {tuple(sorted(x)) for x in links} == {(2 * i, 2 * i + 1) for i in range(20)}


def test_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 3000).astype(np.uint64)
    names.sort()
    weights = rng.uniform(0.5, 3, 3000).astype(np.float32)
    a, b = (names[:2500], weights[:2500]), (names[500:], weights[500:] * np.float32(1.2))
    sketches = [np.frombuffer(s, "<u4") for s in minhash.Sampler().sketches([a, b])]
    assert abs((sketches[0] == sketches[1]).mean() - minhash.weighted_jaccard(a, b)) < 0.2


def test_one_text_meets_many_at_once(monkeypatch):
    """A group of texts that are mostly below the threshold: the same links as pair by pair, without a call for each pair."""
    rng, each = np.random.default_rng(5), minhash.weighted_jaccard
    common = [f"word{i}" for i in range(200)]
    texts = []
    for i in range(60):  # two in three keep so little that they are alone
        changed = rng.choice(200, 2 if i % 3 == 0 else 12, replace=False)
        texts.append(" ".join(f"new{i}x{k}" if k in changed else w for k, w in enumerate(common)).encode())
    rarity = np.ones(minhash.WORD_SLOTS, np.float32)
    sets = [minhash.shingles(x, rarity) for x in texts]
    similar = {(i, j) for i in range(60) for j in range(i) if each(sets[i], sets[j]) >= minhash.SIMILARITY}
    same = np.full(minhash.SAMPLES, 7, "<u4").tobytes()  # all are candidates
    rows = pa.table({"doc_id": list(range(60)), "sketch": pa.array([same] * 60, pa.binary()), "data": pa.array(texts, pa.binary())})
    calls = []
    monkeypatch.setattr(minhash, "weighted_jaccard", lambda a, b: calls.append(1) or each(a, b))
    links = list(minhash._verified(type("Shared", (), {"value": rarity}))(rows))
    group = {i: i for i in range(60)}
    for i, j in similar:
        group = {k: group[j] if g == group[i] else g for k, g in group.items()}
    least = {g: min(k for k in group if group[k] == g) for g in group.values()}
    assert similar and {(max(a, b), min(a, b)) for a, b, _ in links} <= similar
    assert len(links) == 60 - len(least) and all(low == least[group[a]] for a, _, low in links)
    assert len(calls) < 60  # there are over a thousand pairs


def test_stars_take_no_round(spark, monkeypatch):
    module, writes = sys.modules[components.__module__], []
    written = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: writes.append(name) or written(df, name))
    stars = [(0, i) for i in range(1, 9)] + [(20, i) for i in range(21, 25)]
    got = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(9), 0), **dict.fromkeys(range(20, 25), 20)}
    assert len(writes) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    expected = {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)


def test_components_of_large_ids(spark):
    top = 2**63 - 1
    links = [(top - i, top - i - 1) for i in range(6)] + [(-(2**63), 5)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{top - i: top - 6 for i in range(7)}, -(2**63): -(2**63), 5: -(2**63)}


def test_one_id_with_different_texts(spark):
    """Both texts stay; equal rows of them once."""
    one, two = " ".join(f"alpha{i}" for i in range(80)), " ".join(f"omega{i}" for i in range(80))
    rows = [(2**63 - 1, one), (2**63 - 1, two), (2**63 - 1, two), (2**63 - 2, " ".join(f"other{i}" for i in range(80)))]
    kept = minhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(r.text[:5] for r in kept) == ["alpha", "omega", "other"]

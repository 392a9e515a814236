"""Packing, mixing, shards and the pipeline."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spendlake.llm import mixing, packing, shards, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["The", "river,", "ΑΣ.", "it's", "İ.", "12ab", "é", "naïve!", "x²", "don't.", "<|endoftext|>", "a\u00a0b", "ＡＢ;", "\U0001f600", "U.S."]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80, 400, 2500]))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(made)] + [(900, None), (901, ""), (3, made[3]), (902, " \n")]


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")


def test_plain_words_are_folded_as_bytes():
    """Words of ASCII letters are most words: none is decoded to be told apart from its marks."""
    encoder, called = tokens.WordEncoder(PATH), []
    words = {b"Rivers,": (b"rivers", b","), b"river": (b"river", b""), b"...": (b"...", b""), b"x2.": (b"x2.", b"")}
    words |= {"É!".encode(): ("É".encode(), b"!"), b"it's.": (b"it's.", b""), b"A.b": (b"A.b", b"")}
    assert {word: encoder._parts(word) for word in words} == words
    sys.setprofile(lambda frame, event, arg: called.append(arg.__name__) if event == "c_call" else None)
    encoder._parts(b"Rivers,")
    sys.setprofile(None)
    assert "decode" not in called and "lower" in called


def test_words_encode_as_texts_do(texts, ids):
    encoder = tokens.WordEncoder(PATH)
    for i, t in texts:
        assert np.frombuffer(encoder.encode([(t or "").encode()])[0], "<u4").tolist() == ids[i][:-1]


def test_pack(spark, texts, ids):
    rows = packing.pack(frame(spark, texts), PATH, with_ids=True).collect()
    pieces, filled = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids == np.array(part, "<u4").tobytes() and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts:
        assert sorted(pieces[i]) == sorted([*range(len(ids[i]))] * (2 if i == 3 else 1))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(ids[i]) for i, _ in texts)
    assert len(filled) <= total / 2048 * 1.1 + 1
    assert packing.pack(frame(spark, []), PATH).collect() == []


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(3.5, 1, 20_000).astype(int) + 1, 256)
    sizes, demand = np.unique(lengths, return_counts=True)
    plan = packing.solve(sizes, demand.astype(float), 256)
    assert (sum(n * p for n, p in plan) == demand).all() and all(p @ sizes <= 256 for _, p in plan)
    assert sum(n for n, _ in plan) <= 1.01 * lengths.sum() / 256 + 2


def filling(sizes):
    """Targets by filling all sources at once, one at a time capped."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if weight[s] * level > 3 * sizes[s]]
        if not over:
            return done | {s: weight[s] * level for s in left}
        done |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["b"] * 6 + ["a", "é", "c", None])) for i in range(3000)]
    rows += [(5000, None, "none"), (5001, "", "a"), (1, rows[1][1], rows[1][2]), (None, "x y", "tiny"), (None, "x y", "tiny")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = filling(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.turn)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and sorted(got, key=order)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_rounding_keeps_words_and_chances():
    size = np.array(sorted(np.random.default_rng(1).integers(1, 900, 400), reverse=True), float)
    mean = np.zeros(400)
    for seed in range(200):
        copies = np.full(400, 1.3)
        chance = np.random.default_rng(seed).random(400)
        open_rows = mixing._round(size, copies, chance, True)
        assert not open_rows.any() and (copies == np.rint(copies)).all() and copies.min() >= 0 and copies.max() <= 3
        assert abs((size * copies).sum() - 1.3 * size.sum()) <= 900
        mean += copies / 200
    assert abs(mean.mean() - 1.3) < 0.05 and abs(mean - 1.3).max() < 0.6


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(size):
    slots = shards.permuted(np.arange(size), size, 99)
    assert sorted(slots.tolist()) == list(range(size))
    if size >= 1000:
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.1
        assert (shards.permuted(np.arange(size), size, 100) != slots).mean() > 0.9


def test_shards_round_trip(spark, texts, ids, tmp_path):
    folder = f"file://{tmp_path}/shards"
    made = shards.materialise(frame(spark, texts), PATH, folder, length=256, shard_sequences=16)
    rows = sorted(made.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and sorted(r["index"] for r in rows) == list(range(len(rows)))
    records = list(shards.read_from(folder, 0, 256, 16))
    assert [zlib.crc32(x.tobytes()) for x in records] == [r.ids_crc32 for r in rows]
    stream = [t for r in sorted(rows, key=lambda r: r["index"]) for t in records[r.slot][: r.n_ids].tolist()]
    assert sorted(stream) == sorted(t for i, _ in texts for t in ids[i])
    for r in rows:
        assert r.byte_offset == (r.slot % 16) * 512 and r.shard == r.slot // 16
        n = min(r.n_ids, len(ids[r.doc_id]) - r.start)
        assert records[r.slot][:n].tolist() == ids[r.doc_id][r.start : r.start + n]
    resumed = list(shards.read_from(folder, 21, 256, 16))
    assert len(resumed) == len(rows) - 21 and (resumed[0] == records[21]).all()
    assert shards.materialise(frame(spark, []), PATH, f"file://{tmp_path}/none").collect() == []


def test_sequences_are_written_and_moved_compressed(spark, tmp_path, monkeypatch):
    """On the way to the shards ids take well under 16 bits."""

    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    monkeypatch.setattr(shards, "staged", written)
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(4000))
    docs = spark.createDataFrame([(i, text()) for i in range(20)], "doc_id long, text string")
    n = shards.materialise(docs, PATH, f"{tmp_path}/out").count()
    size = spark.read.parquet(f"{tmp_path}/sequences").agg(F.sum(F.length("ids"))).first()[0]
    assert 0 < size < 0.8 * 2 * shards.SEQUENCE * n


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("class_id", F.lit(1)), sf_dir)
        assert out.columns == columns, name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert rows and max(ends.values()) <= 2048


def test_ids_that_do_not_fit(spark):
    assert shards._narrow(np.array([0, 65535], "<u4").tobytes()).tolist() == [0, 65535]
    with pytest.raises(ValueError, match="65536"):
        shards._narrow(np.array([65536], "<u4").tobytes())


def test_folder_without_a_scheme_is_on_the_default_file_system(spark, tmp_path):
    assert shards.qualified(spark, f"{tmp_path}/x") == f"file:{tmp_path}/x"
    assert shards.qualified(spark, f"file://{tmp_path}/x").startswith("file:")

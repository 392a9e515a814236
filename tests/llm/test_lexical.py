"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    own = [(doc, c) for doc, c in own if c]
    total, length = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, c in own:
            m = 25 + 75 * c.total() * total // length
            weight = lambda t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[-1], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(docs, items, k).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(900)] + ["Été", "ÉTÉ", "x_y", "naïve", "3.14", "THE", "the", "日本"]
    text = lambda longest: " ".join(rng.choice(words) for _ in range(rng.randrange(longest)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,; "), (None, text(50)), (None, docs[3][1]), docs[5], docs[5]]
    docs += [(n + 10 + i, docs[8][1]) for i in range(250)]  # copies
    items = [(i, rng.choice(docs[:n])[1]) for i in range(12)] + [(20, text(15)), (21, "unknown words"), (22, None), (23, ""), (20, "the w1"), (20, "the w1")]
    return docs, items


@pytest.mark.parametrize("seed,leaf,block", [(0, 96, 16_384), (1, 4, 200), (2, 1, 16_384), (3, 16, 64)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, leaf, block):
    docs, items = corpus(seed, 300)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    # Tasks import the module anew: trees of any shape are tested here, the whole with its own sizes.
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("leaf", [1, 2, 7, 50])
def test_trees_of_any_shape(monkeypatch, leaf):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    vectors, m = [], rng.integers(25, 300, 400)
    for i in range(400):
        ranks = np.flatnonzero(rng.random(40) < 1 / (1 + np.arange(40) / 4)) if i % 7 else np.arange(i % 40 + 1)
        ranks = ranks if len(ranks) else np.array([0])
        vectors.append((ranks, rng.integers(1, 9, len(ranks))))
    ids = rng.permutation(400)
    tree = lexical.Tree(ids, m, vectors)
    leaves = [x for x in tree.nodes if x.children is None]
    assert sorted(d for x in leaves for d in x.least_id.tolist()) == list(range(400))
    for number in range(60):
        terms = rng.choice(40, 6, replace=False)
        item = lexical.Item(number, number, terms, rng.integers(1, 5000, 6))
        weight = dict(zip(item.ranks.tolist(), item.weights.tolist()))
        score = lambda j: sum(weight.get(r, 0) * int(s) for r, s in zip(vectors[j][0].tolist(), lexical.saturated(vectors[j][1], m[j])))
        expected = sorted(((score(j), -int(ids[j])) for j in range(400) if score(j) > 0), reverse=True)[:5]
        best = []
        tree.search(item, best, 5)
        assert sorted(best, reverse=True) == expected
        for node in tree.nodes:  # no document scores above a bound over it
            bounds = node.bounds(item)
            if node.children:
                for b, child in zip(bounds, node.children):
                    assert b >= tree.nodes[child].bounds(item).max()


def test_search_leaves_out_most_of_the_tree(monkeypatch):
    """Passages that some documents hold: the bounds cut, and the result is that of all scores."""
    rng = np.random.default_rng(3)
    ranks = [np.unique(np.minimum(rng.zipf(1.3, 30), 2000)) for _ in range(6000)]
    passages = [np.unique(np.r_[ranks[i][:5], 2001 + 20 * i + np.arange(12)]) for i in range(20)]
    for i, passage in enumerate(passages):
        for j in rng.choice(6000, 15, replace=False):
            ranks[j] = np.union1d(ranks[j], passage)
    vectors, m = [(r, rng.integers(1, 4, len(r))) for r in ranks], rng.integers(25, 300, 6000)
    tree, opened = lexical.Tree(np.arange(6000), m, vectors), []
    bounds = lexical.Node.bounds
    monkeypatch.setattr(lexical.Node, "bounds", lambda self, item: opened.append(self) or bounds(self, item))
    for i, passage in enumerate(passages):
        weight = 200 * (1 + passage)
        tree.search(lexical.Item(i, i, passage, weight), best := [], 10)
        score = [(int((weight[np.isin(passage, r)] * lexical.saturated(t[np.isin(r, passage)], m[j])).sum()), -j) for j, (r, t) in enumerate(vectors)]
        assert sorted(best, reverse=True) == sorted(score, reverse=True)[:10]
    assert len(opened) < 0.5 * 20 * len(tree.nodes)


def test_long_text_is_hashed_in_windows(monkeypatch):
    text = ("Añb c1-" * 500 + "x" * 300 + " end").encode()
    whole = [h.tolist() for h, _ in lexical.term_hashes(text)]
    monkeypatch.setattr(lexical, "WINDOW_BYTES", 64)
    parts = [h.tolist() for h, _ in lexical.term_hashes(text)]
    assert len(parts) > 10 and sum(parts, []) == sum(whole, [])


def test_many_groups_of_items(spark, monkeypatch):
    docs, items = corpus(9, 80)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 600)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_no_rows(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []

"""The pipeline's near-dedup against brute force: recall, and documents dropped without a similar one."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from lading.llm import similar


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The smallest index reachable by pairs of similarity 0.8 or more; equal sets are one."""
    held, label = [sets(t) for t in texts], list(range(len(texts)))
    near = [[j for j in range(len(texts)) if held[i] == held[j] or len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])] for i in range(len(texts))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(texts))]) != label:
        label = new
    return label


def test_near_dedup_is_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = ["", None, "one", "One", "a b c d e", "a b c d f"]
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(base))
        for copy in range(12):  # from 0.97 down to about 0.5: both sides of the border
            words = list(base)
            for at in rng.choice(150, 1 + copy, replace=False):
                words[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, bucket string")
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in similar.clustered(docs, 5, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == sorted(set(want))


@pytest.mark.parametrize(("small", "cell"), [(1000, 1000), (16, 1000), (16, 20)])
def test_unlike_pairs_of_a_bucket_are_not_linked(spark, monkeypatch, small, cell):
    """All share their buckets, few are similar; what the rounds leave is tested as rows, in one cell or in several."""
    monkeypatch.setattr(similar, "ROUNDS", 1)
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "_buckets", lambda held: [np.arange(2)] * len(held))
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(40)]
    texts = base + [f"{b} tail" for b in base[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.clustered(docs, 5, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_no_document_has_a_candidate(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (None, "p q r s t u")], "doc_id long, text string")
    assert similar.one_of_each(docs, 5, 0.8).count() == 3


def test_rows_not_ids_are_dropped(spark):
    """One id with unlike texts, a near copy under an id that is kept, null ids, and rows that repeat."""
    a, b, c = ("one two three four five six seven eight", "some other words that nobody else has here", "a third text with its own eight words")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c), (7, c), (8, None), (9, ""), (None, b)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, best string")
    out = similar.one_of_each(docs, 5, 0.8)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(3, a), (5, b), (7, c), (8, "")])
    assert similar.one_of_each(docs.limit(0), 5, 0.8).count() == 0


def test_hot_groups(spark, monkeypatch):
    """Many copies and many near copies of one text, with hot keys joined by broadcast."""
    from lading.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words)] * 40 + [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(5, 45)] + [""] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.clustered(docs, 5, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sorted(r.doc_id for r in similar.one_of_each(docs, 5, 0.8).collect()) == sorted(set(brute(texts)))

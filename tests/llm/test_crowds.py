"""Near duplicates in large crowds around the similarity: the same components as by brute force, few pairs a node."""

import random

import pytest

from tidepair.llm import neardup
from tidepair.llm.common import ready


def least_linked(texts):
    """Least linked text of each, by comparing all pairs of sets of two-word shingles."""
    sets, root = [frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) for w in map(str.split, texts)], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(r, words, changes, kinds, pool):
    w = list(words)
    for _ in range(changes):
        i = r.randrange(len(w))
        kind = r.choice(kinds)
        if kind == "change":
            w[i] = r.choice(pool)
        elif kind == "drop" and len(w) > 3:
            del w[i]
        elif kind == "add":
            w.insert(i, r.choice(pool))
        elif kind == "end":
            w = w[: max(3, len(w) - r.randrange(12))]
    return w


def crowd(seed, n, most, kinds, pool_size, templates=1):
    r = random.Random(seed)
    pool = [f"p{i}" for i in range(pool_size)]
    first = [f"w{i}" for i in range(90)]
    bases = [first] + [edited(r, first, 12, ["change"], pool) for _ in range(templates - 1)]
    return [" ".join(edited(r, r.choice(bases), r.randint(0, most), kinds, pool)) for _ in range(n)]


@pytest.mark.parametrize("kinds, most, pool, templates", [
    (["change"], 9, 6, 1), (["change"], 9, 100_000, 1), (["drop"], 14, 6, 1), (["add"], 14, 4, 1), (["change", "drop", "add", "end"], 9, 5, 2), (["change"], 6, 8, 4)])
def test_crowds_match_brute_force(spark, kinds, most, pool, templates):
    ready(spark)
    texts = crowd(7, 150, most, kinds, pool, templates) + crowd(8, 12, 5, kinds, pool)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.op6_minhash_near_dedup(docs).collect()}
    assert got == dict(enumerate(least_linked(texts)))


def test_a_crowd_of_outer_nodes_meets_few_others(spark, monkeypatch):
    """800 documents with one template, most of them too far from it and from each other: no all-pairs join."""
    ready(spark)
    seen, real = [], neardup.Consensus.pairs
    monkeypatch.setattr(neardup.Consensus, "pairs", lambda self, roots: seen.append(neardup.cut(real(self, roots))) or seen[-1])
    texts = crowd(9, 800, 22, ["change"], 100_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.op6_minhash_near_dedup(docs).collect()}
    assert got == dict(enumerate(least_linked(texts)))
    assert seen[0].count() < 20 * 800


def test_only_open_changes_are_joined(spark, monkeypatch):
    """Changes that one node or one component makes can't lead to a link: they don't go through the joins of a large crowd."""
    ready(spark)
    seen, real = [], neardup.Consensus.changes
    monkeypatch.setattr(neardup.Consensus, "changes", lambda self, roots: seen.append((self, neardup.cut(real(self, roots)))) or seen[-1][1])
    texts = crowd(9, 200, 22, ["change"], 100_000) + crowd(10, 200, 22, ["change"], 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.op6_minhash_near_dedup(docs).collect()}
    assert got == dict(enumerate(least_linked(texts)))
    consensus, changes = seen[0]
    made = changes.groupBy("crowd", "lacks", "h").count()
    assert made.count() > 0 and made.where("count < 2").count() == 0
    assert changes.where("NOT lacks").count() < consensus.marked.where("NOT core").count()

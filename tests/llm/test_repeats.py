"""Periodic runs, whitening and line dedup against direct computation, on whole given tables and hard small ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepair.llm import lines, runs, whiten
from tidepair.llm.common import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, found string, best string, runs string, row string, key string, maybe string, drop string"
GIVEN = "/root/testdata/sf0.001/documents.parquet"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    """Texts under ids 0, 1, ...; the first row twice, one row without id, names that operators use too."""
    rows = [(i, t, *"abcdefg") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[-1], *"abcdefg")], SCHEMA).repartition(3)


def slow_runs(w):
    """Every maximal stretch with a period, by trying all of them; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def expected_runs(doc_id, text):
    w = looped(doc_id, WORD.findall(text or ""))
    found = slow_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *one, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def loop_texts():
    r, out = random.Random(5), [None, "", " \t\n", "one", "a " * 23, "a " * 24, "ab cd " * 12, "x\x1cy \x85z　q " * 30, "long " * 9000]
    for _ in range(120):
        letters, n = r.choice([1, 2, 3, 60]), r.randint(0, 400)
        w = [str(r.randrange(letters)) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n else 0):
            p, a, m = r.randint(1, max(1, n // 4)), r.randrange(n), r.randint(1, n)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    unit = [str(i) for i in range(700)]
    return [*out, " ".join(unit * 4 + unit[:100] + ["end"]), "ü中 " * 50 + "é"]


def test_runs_match_brute_force(spark):
    docs = table(spark, loop_texts())
    got = sorted(map(tuple, runs.op11_periodic_runs(docs).collect()), key=str)
    assert got == sorted((expected_runs(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sum(r[1] for r in got) > 50
    assert runs.find_runs(docs, name="best").columns == docs.columns
    empty = docs.where("false")
    assert runs.op11_periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, times=2)


def test_runs_of_given_documents(spark):
    docs = spark.read.parquet(GIVEN)
    got = sorted(map(tuple, runs.op11_periodic_runs(docs).collect()))
    assert len(got) == docs.count()
    want = {r.doc_id: expected_runs(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20_000}
    assert [g for g in got if g[0] in want] == sorted(want.values()) and len(want) > 150


def test_a_long_loop_takes_linear_work():
    """A million equal words have half a million million pairs of equal words; nearest contexts are a million."""
    numbers = np.zeros(1_000_000, np.int64)
    assert [x.tolist() for x in runs.runs_of(numbers, np.array([0, len(numbers)]), 24, 3)] == [[0], [0], [1_000_000], [1]]


def symmetric(kind, d, r):
    a = r.standard_normal((d, d))
    if kind == "random":
        return a @ a.T
    if kind == "equal":
        return np.eye(d)
    if kind == "pairs":
        return np.diag(np.arange(d) // 2).astype(float)
    if kind == "zero":
        return np.zeros((d, d))
    if kind == "tiny":
        return a @ a.T * 1e-200
    q, _ = np.linalg.qr(a)
    values = np.ones(d)
    values[:2] += [4, 4 + 1e-9][:d]
    return (q * values) @ q.T


@pytest.mark.parametrize("kind", ["random", "equal", "pairs", "zero", "tiny", "cluster"])
def test_eigenpairs(kind):
    r = np.random.default_rng(3)
    for d in (1, 2, 3, 7, 64, 150):
        a = symmetric(kind, d, r)
        a = (a + a.T) / 2
        values, vectors = whiten.leading_pairs(a, 4)
        true = np.linalg.eigvalsh(a)[::-1][:4]
        size = max(np.abs(true).max(), 1e-300)
        assert np.abs(values - true).max() <= 1e-13 * d * size
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * d * size


def vectors_of(rows):
    good = [r for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    d = max((len(r.embedding) for r in good), default=0)
    return good, np.array([np.floor(256 * np.array([*r.embedding, *[0.0] * (d - len(r.embedding))], float)) for r in good]).reshape(len(good), d)


def check_whitening(rows, got, k=4):
    good, x = vectors_of(rows)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for row, v in zip(good, x, strict=True):
        mine = by[row.vec_id, int(((n * v - sums) ** 2).sum())]
        for c in range(k):
            want = (v - sums / n) @ vectors[:, c] / np.sqrt(values[c])
            for r in mine[c + 1]:
                sign = signs.setdefault(c, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
                assert abs(sign * r.whitened - want) < 1e-8
                assert abs(r.explained - values[c] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9 and r.n == n


def test_whitening_of_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whiten.op12_embedding_whitening(rows).collect()
    check_whitening(rows.collect(), got)
    again = whiten.op12_embedding_whitening(rows.repartition(7)).collect()
    key = lambda r: (r.vec_id, r.component)
    assert [(key(r), r.whitened, r.deviation) for r in sorted(got, key=key)] == [(key(r), r.whitened, r.deviation) for r in sorted(again, key=key)]


def test_whitening_of_hard_vectors(spark):
    r = np.random.default_rng(8)
    schema = "vec_id long, embedding array<double>, row string, x string, component string, n string"
    data = [(i, (r.standard_normal(6) * 3 + 1000).tolist(), *"abcd") for i in range(60)]
    data += [(7, data[7][1], *"abcd")] * 30  # a hot copy
    data += [(None, data[3][1], *"abcd"), (90, None, *"abcd"), (91, [None] * 6, *"abcd"), (92, [float("nan")] * 6, *"abcd"), (93, [float("inf")] * 6, *"abcd"),
             (94, [1.0, 2.0], *"abcd"), (95, [], *"abcd")]
    rows = spark.createDataFrame(data, schema).repartition(3)
    check_whitening(rows.collect(), whiten.op12_embedding_whitening(rows).collect())
    assert whiten.op12_embedding_whitening(rows.where("vec_id >= 90 and vec_id < 94")).count() == 0
    assert whiten.op12_embedding_whitening(rows.where("vec_id = 7")).count() == 0  # no variance, no component
    two = whiten.op12_embedding_whitening(rows.where("vec_id < 2")).collect()
    assert {x.component for x in two} == {1} and len(two) == 2


def line_texts():
    r = random.Random(6)
    line = lambda: " ".join(r.choice(["Alpha", "beta", "É", "中文字", "x"]) for _ in range(r.randint(1, 5)))
    pool = [line() for _ in range(40)]
    out = [None, "", "\n", "short\nshort", "exactly 10\n exactly 10 ", "EXACTLY 10", "ééééééééé", "ééééééééé\néééééééééé", "éééééééééé", "a hot line\r\nüb\x0b"]
    out += ["\n".join(r.choice([" {}", "{}\t", "{}", "{}\x1c"]).format(r.choice(pool)) for _ in range(r.randint(1, 12))) for _ in range(60)]
    return out + ["a hot line\n" + str(i) for i in range(60)] + ["\n".join(f"line number {i}" for i in range(5000)) + "\n" + pool[0]]


def fold(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slow_lines(rows):
    holders = {}
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(fold(x)) >= 10:
                holders.setdefault(fold(x), set()).add(order(i))
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(holders.get(fold(x), ())) < 2 or min(holders[fold(x)]) == order(i)]
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    docs = table(spark, line_texts())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, lines.op13_line_dedup(docs).collect()), key=str) == slow_lines(rows)
    assert lines.drop_repeated_lines(docs, name="key").columns[-1] == "key"
    assert lines.op13_line_dedup(docs.where("false")).count() == 0
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, lines.op13_line_dedup(given).collect()), key=str) == slow_lines([(r.doc_id, r.text) for r in given.collect()])


def state(index):
    return sorted(map(str, index.counts.collect())), sorted((r.shard, len(lines.CuckooFilter.of_bytes(r.filter))) for r in index.filters.collect())


def test_index_is_reversible(spark, monkeypatch):
    """Deleting what was inserted gives the counts back, and cleaning is as if those documents had never been there."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 60)
    docs = table(spark, line_texts()).cache()
    first, second = docs.where("doc_id < 70 OR doc_id IS NULL"), docs.where("doc_id >= 70")
    index = lines.LineIndex(spark)
    index.insert(first)
    counts, _ = state(index)
    index.insert(second)
    assert index.shards > 1
    cleaned = lambda d: sorted((r.doc_id, r.cleaned.n_lines, r.cleaned.n_dropped, sha(r.cleaned.text)) for r in index.clean(d).collect() if r.doc_id is not None)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    full = slow_lines(rows)
    assert cleaned(docs) == sorted(x for x in full if x[0] is not None)
    filters = {r.shard: lines.CuckooFilter.of_bytes(r.filter) for r in index.filters.collect()}
    keys = index.counts.select("key", lines.shard_of(F.col("key"), index.shards).alias("shard")).collect()
    assert all(filters[k.shard].contains(np.frombuffer(bytes(k.key), "<u8")[:1]).all() for k in keys)
    assert sum(map(len, filters.values())) == len(keys)
    index.delete(second)
    assert state(index)[0] == counts
    assert sum(n for _, n in state(index)[1]) == len(counts)
    assert cleaned(first) == sorted(x for x in slow_lines([(i, t) for i, t in rows if i is None or i < 70]) if x[0] is not None)
    index.delete(docs.where("doc_id = 10"))  # the first holder of some lines: the next one takes over
    rest = [(i, t) for i, t in rows if (i is None or i < 70) and i != 10]
    assert cleaned(first.where("doc_id <> 10")) == sorted(x for x in slow_lines(rest) if x[0] is not None)
    index.delete(docs.where("doc_id IS NULL OR doc_id < 70"))
    assert state(index)[0] == [] and sum(n for _, n in state(index)[1]) == 0
    index.insert(second)
    assert cleaned(second) == sorted(slow_lines([(i, t) for i, t in rows if i is not None and i >= 70]))


def test_cuckoo_filter_loses_nothing():
    h = np.random.default_rng(2).integers(0, 1 << 63, 60_000).astype(np.uint64)
    for n in (0, 1, 50, 30_000):
        f = lines.laid_out(h[:n])
        assert f.contains(h[:n]).all() and len(f) == n and f.contains(h[30_000:]).mean() < 1e-3
        g = lines.CuckooFilter.of_bytes(f.to_bytes())
        assert g.delete(h[: n // 2]) == 0 and len(g) == n - n // 2 and g.contains(h[n // 2 : n]).all()
        assert g.insert(h[: n // 2]) and g.contains(h[:n]).all()
    full, same = lines.CuckooFilter(2), np.full(1, 5, np.uint64)
    before = full.to_bytes()
    assert not full.insert(h[:100]) and full.to_bytes() == before
    assert full.insert(same) and full.insert(same) and full.delete(np.repeat(same, 2)) == 0 and full.delete(same) == 1


@pytest.fixture(autouse=True)
def shipped(spark):
    ready(spark)

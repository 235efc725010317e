"""Edge scoring against plain Python: blank and null ids, ties, zero mass, unknown sizes, hot cells, no edges at all."""

import math
import random
from collections import defaultdict

import pytest

from tidepair.catalog import edge_queries
from tidepair.operators import edges as E

SCHEMA = "grp string, ord long, source_cell string, target_cell string, probability double"


def some_edges():
    r, out = random.Random(2), []
    for i in range(160):
        source = r.choice([f"S{r.randrange(9)}_{r.randrange(2)}", None, "nan", "T_1"])
        out.append((r.choice(["f1", "f1", "f2", None]), i, source, f"T{r.randrange(7)}", r.choice([0.5, 0.25, 0.125, -1.0, None, float("nan"), 0.0, r.random()])))
    return out


def plain(edges, sizes):
    """score_edges() in plain Python: rows by (grp, ord)."""
    def strip(c):
        c = (c or "").strip()
        c = "" if c.lower() in ("", "nan", "none", "null", "na") else c
        return c[:-2] if c.endswith(("_0", "_1")) else c

    out = {(g, o): {"p": max(p, 0.0) if p is not None and p == p else 0.0, "source": strip(s), "target": strip(t)} for g, o, s, t, p in edges}
    for side, other in (("source", 1), ("target", 0)):
        cells = defaultdict(list)
        for (g, o), e in out.items():
            cells[g, e[side]].append((g, o))
        stats = {}
        for (g, c), keys in cells.items():
            mass = sum(out[k]["p"] for k in keys)
            keys.sort(key=lambda k: (-out[k]["p"], k[1]))
            ps = [out[k]["p"] / (mass + 1e-8) for k in keys]
            n = float(max(sizes.get(g, (0, 0))[other], 2))
            entropy = -sum(p * math.log(p + 1e-8) for p in ps)
            second = ps[1] if len(ps) > 1 else 0.0
            stats[g, c] = {"max": ps[0], "margin": ps[0] - second, "econf": min(1.0, max(0.0, 1 - entropy / math.log(n))), "mass": mass}
            for i, k in enumerate(keys):
                out[k][side + "_rank"] = i + 1
        for g in {g for g, _ in stats}:
            mine = {c: v for (h, c), v in stats.items() if h == g}
            for m in ("max", "margin", "econf"):
                values = [round(v[m], 12) for v in mine.values()]
                for v in mine.values():
                    x = round(v[m], 12)
                    rank = sum(y < x for y in values) + (values.count(x) + 1) / 2
                    v[m + "_share"] = 1.0 if len(values) <= 1 else rank / len(values)
            for v in mine.values():
                v["combined"] = 0.4 * v["econf_share"] + 0.3 * v["margin_share"] + 0.3 * v["max_share"]
        for (g, o), e in out.items():
            e[side + "_cell"] = stats[g, e[side]]
    return out


def compare(spark):
    edges, sizes = some_edges(), {"f1": (11, 8), "f2": (9, 1)}
    df = spark.createDataFrame(edges, SCHEMA).repartition(3)
    frame = spark.createDataFrame([(g, *n) for g, n in sizes.items()], "grp string, n_source long, n_target long")
    want, got = plain(edges, sizes), E.score_edges(df, frame).collect()
    assert len(got) == len(edges)
    for r in got:
        e = want[r.grp, r.ord]
        assert (r.source_id, r.target_id, r.source_rank, r.target_rank) == (e["source"], e["target"], e["source_rank"], e["target_rank"])
        for side in ("source", "target"):
            c = e[side + "_cell"]
            for name, key in (("max", "max"), ("margin", "margin"), ("entropy_confidence", "econf"), ("mass", "mass"), ("combined", "combined")):
                assert r[f"{side}_{name}"] == pytest.approx(c[key], abs=1e-9), (side, name, r)
        assert r.is_mutual_top1 == int(r.source_rank == 1 and r.target_rank == 1)


def test_score_edges(spark):
    compare(spark)


def test_score_edges_with_hot_cells(hot):
    compare(hot)


def test_no_edges(spark):
    frame = spark.createDataFrame([], "grp string, n_source long, n_target long")
    assert E.score_edges(spark.createDataFrame([], SCHEMA), frame).count() == 0


def test_zero_rows_of_a_matrix(spark):
    """Cells without an entry rank as zero rows: with eight of ten rows empty, their confidence of 1 comes first."""
    df = spark.createDataFrame([("m", 1, "a", "x", 0.5), ("m", 2, "a", "y", 0.25), ("m", 3, "b", "x", 1.0)], SCHEMA)
    sizes = spark.createDataFrame([("m", 10, 4)], "grp string, n_source long, n_target long")
    got = {r.ord: r for r in E.matrix_confidence(df, spark.createDataFrame([("m", 10)], "grp string, n_cells long"), sizes, "source").collect()}
    zero = {"max": 0.0, "margin": 0.0, "econf": 1.0}
    cells = [zero] * 8
    p = [0.5 / (0.75 + 1e-8), 0.25 / (0.75 + 1e-8)]
    cells.append({"max": p[0], "margin": p[0] - p[1], "econf": 1 + sum(q * math.log(q + 1e-8) for q in p) / math.log(4)})
    cells.append({"max": 1 / (1 + 1e-8), "margin": 1 / (1 + 1e-8), "econf": min(1.0, 1 + math.log(1) / math.log(4))})

    def share(cell, m):
        v = [round(c[m], 12) for c in cells]
        x = round(cell[m], 12)
        return (sum(y < x for y in v) + (v.count(x) + 1) / 2) / len(v)

    for ord_, cell in ((1, cells[8]), (2, cells[8]), (3, cells[9])):
        assert got[ord_].combined == pytest.approx(0.4 * share(cell, "econf") + 0.3 * share(cell, "margin") + 0.3 * share(cell, "max"))
    assert [got[i].rank for i in (1, 2, 3)] == [1, 2, 1]


def test_pair_selection_lists_and_counts(spark):
    big = 4_000_000_000_000_000_000  # sums leave 64 bits
    made = [("a|1", "S1_0", "T1", 0.9, big), ("a|1", "S1_0", "T2", 0.1, big + 1), ("a|1", "S2_0", "T1", 0.5, big + 2), ("b|1", "S1_0", "T1", 0.5, 7)]
    edges = spark.createDataFrame(made, "grp string, source_cell string, target_cell string, probability double, ord long")
    got = [tuple(r) for r in edge_queries.pair_selection({"edges": edges}.__getitem__).select("selection", "grp", "ord", "n", "ord_sum").collect()]
    want = {("all", "a|1"): [big, big + 1, big + 2], ("top1", "a|1"): [big, big + 2], ("top1_target", "a|1"): [big, big + 1],
            ("mutual_top1", "a|1"): [big], **{(s, "b|1"): [7] for s in ("all", "top1", "top1_target", "mutual_top1")}}
    assert sorted(got) == sorted((s, g, o, len(ords), sum(ords)) for (s, g), ords in want.items() for o in ords)

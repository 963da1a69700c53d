"""Replicate matrices against plain loops, and draws from margins against shuffled pools."""

import numpy as np
import pytest

from treeloom.operators import inference as I, resampling as S

MASK = 2**64 - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * S.FIRST) & MASK
    x = ((x ^ (x >> 27)) * S.SECOND) & MASK
    return x ^ (x >> 31)


def plain_draw(key, counter):
    return plain_mix((plain_mix(key & MASK) + (counter + 1) * S.STEP) & MASK)


def units(spark, rows, parts=3):
    return spark.createDataFrame(rows, "u long, g string, x long, y long").repartition(parts)


def test_bootstrap_sums(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 64)
    monkeypatch.setattr(S, "GROUPS", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [None, "a", "b", "c"][i % 4], int(rng.integers(9)), -int(rng.integers(9))) for i in range(150)] + [(7, "c", 1, 1)]
    want = {}
    for u, g, x, y in rows:
        for r in range(1, 11):
            bits = plain_draw(u, (r - 1) // 4) >> 16 * ((r - 1) % 4) & 0xFFFF
            k = sum(bits / 65536 >= p for p in I.POISSON)
            a, b = want.get((g, r), (0, 0))
            want[g, r] = (a + k * x, b + k * y)
    for parts in (1, 5):
        got = {(r.g, r.replicate): (r.x, r.y) for r in S.bootstrap_sums(units(spark, rows, parts), "u", ["x", "y"], ["g"], 10).collect()}
        assert got == want
    assert S.bootstrap_sums(units(spark, rows).limit(0), "u", ["x"], ["g"], 10).collect() == []


def test_bootstrap_weights_are_poisson():
    w = S.poisson_weights(np.arange(4000), np.arange(250))
    assert w.shape == (1000, 4000) and abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.005
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06 and abs(w.sum(axis=1).std() - 4000**0.5) < 5


def test_swapped_sums(spark):
    rows = [(i, "ab"[i % 2], i % 5, i % 3) for i in range(90)]
    want = {}
    for u, g, x, y in rows:
        for r in range(101):
            swap = r > 0 and plain_draw(u, (r - 1) // 64) >> (r - 1) % 64 & 1
            a, b = want.get((g, r), (0, 0))
            want[g, r] = (a + (y if swap else x), b + (x if swap else y))
    got = {(r.g, r.replicate): (r.x, r.y) for r in S.swapped_sums(units(spark, rows), "u", ["x"], ["y"], ["g"], 100).collect()}
    assert got == want
    whole = {r.replicate: (r.x, r.y) for r in S.swapped_sums(units(spark, rows), "u", ["x"], ["y"], [], 100).collect()}
    assert whole == {r: tuple(sum(want[g, r][k] for g in "ab") for k in (0, 1)) for r in range(101)}


@pytest.mark.parametrize("labels", [2, 3])
def test_permuted_sums(spark, monkeypatch, labels):
    """Every replicate keeps group sizes and totals, whatever the buckets; units fall evenly; p agrees with shuffling."""
    monkeypatch.setattr(S, "BUCKET", 16)
    rng = np.random.default_rng(labels)
    groups = rng.choice(["a", "b", None][:labels], 160, p=[0.5, 0.3, 0.2] if labels == 3 else [0.7, 0.3])
    rows = [(i, "f", groups[i], 1, int(rng.poisson(6 if groups[i] == "a" else 5.4)), int(rng.poisson(5))) for i in range(160)]
    df = spark.createDataFrame(rows, "u long, fam string, g string, one long, x long, y long").repartition(3)
    found = S.permuted_sums(df, "u", ["one", "x", "y"], ["fam"], "g", 11, 3000).collect()
    sizes = {g: sum(r[2] == g for r in rows) for g in set(groups)}
    tables = {}
    for r in found:
        assert r.one == sizes[r.g] and r.fam == "f"
        tables.setdefault(r.replicate, {})[r.g] = (r.x, r.y)
    assert sorted(tables) == list(range(3001))
    order = sorted(sizes, key=str)
    stats = {k: round(I.chi_square_of(np.array([t[g] for g in order])), 9) for k, t in tables.items()}
    assert all(sum(v[0] for v in t.values()) == sum(r[4] for r in rows) for t in tables.values())
    p = (sum(stats[k] >= stats[0] for k in range(1, 3001)) + 1) / 3001
    counts = [np.array([r[4:] for r in rows if r[2] == g]) for g in order]
    plain = I.permuted_clusters(np.concatenate(counts), [len(c) for c in counts], 5, 6000)
    assert abs(p - plain) < 3.5 * (plain * (1 - plain) * (1 / 3000 + 1 / 6000)) ** 0.5 + 0.001
    means = np.array([[tables[k][g][0] for g in order] for k in range(1, 3001)]).mean(axis=0)
    assert np.allclose(means, [sizes[g] / 160 * sum(r[4] for r in rows) for g in order], rtol=0.02)
    again = S.permuted_sums(df.repartition(7), "u", ["one", "x", "y"], ["fam"], "g", 11, 3000).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)  # neither layout nor order matters


def test_drawn_tables_keep_margins():
    table = np.array([[30, 4, 0, 9], [11, 25, 3, 1], [5, 5, 5, 5]])
    drawn = S.drawn_tables(table, np.random.default_rng(3), 500)
    assert (drawn >= 0).all() and (drawn.sum(axis=1) == table.sum(axis=0)).all() and (drawn.sum(axis=2) == table.sum(axis=1)).all()
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
    assert np.abs(drawn.mean(axis=0) - expected).max() < 0.5


def test_large_urns_stay_within_their_rooms():
    left, right = np.full(2000, 3 * 10**9), np.full(2000, 10**9)
    got = S._split_rooms(np.full(2000, 10**8), left, right, np.random.default_rng(1))
    assert abs(got.mean() - 0.75e8) < 1000 and 3000 < got.std() < 6000 and (got <= 10**8).all()


def test_count_permutations(spark):
    """Against shuffled pools of labels; empty groups and categories, single rows, published tables."""
    tables = {
        "near": [[831, 50, 46, 17, 20, 141], [112, 8, 6, 4, 4, 28]], "three": [[112, 8, 6, 4, 4, 28], [2035, 193, 102, 51, 46, 410], [831, 50, 46, 17, 20, 141]],
        "far": [[60, 5], [5, 60]], "gaps": [[10, 0, 3], [0, 0, 0], [8, 0, 6]], "one": [[3, 4]], "nothing": [[0, 0], [0, 0]],
    }
    df = spark.createDataFrame([(k, v) for k, v in tables.items()], "name string, cells array<array<long>>")
    got = {r.name: r for r in S.count_permutations(df, ["name"], "cells", 5).collect()}
    assert {k: r.replicates for k, r in got.items()} == dict.fromkeys(tables, 20_000)
    assert got["one"].p == got["nothing"].p == 1 and got["far"].p == pytest.approx(1 / 20_001)
    for k, p in (("near", 0.546773), ("three", 0.183991)):  # published
        assert abs(got[k].p - p) < 3 * (p * (1 - p) / 20_000) ** 0.5 * 2**0.5
    plain = I.permuted_labels(np.array([[10, 3], [8, 6]]), 3, 20_000)
    assert abs(got["gaps"].p - plain) < 3 * (plain * (1 - plain) * 2 / 20_000) ** 0.5
    assert got["near"].chi2 == pytest.approx(4.054349, abs=1e-6)
    again = {r.name: r.hits for r in S.count_permutations(df.repartition(5), ["name"], "cells", 5).collect()}
    assert again == {k: r.hits for k, r in got.items()}

import numpy as np
import pytest

from dowser.llm import near_duplicates as N
from dowser.llm import neighbours as V

VECTORS = "id bigint, embedding array<float>, distance float"


def brute(rows, k=5, within=0.05):
    own = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 16 and all(x is not None for x in v) and any(v)}
    ids = sorted(own)
    unit = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
    d = 1 - unit @ unit.T
    lists = {}
    for a, i in enumerate(ids):
        order = sorted((round(d[a, b], 9), j) for b, j in enumerate(ids) if j != i and d[a, b] <= within)
        lists[i] = {j for _, j in order[:k]}
    return {(i, j) for i in ids for j in lists[i] if i < j and i in lists[j]}


@pytest.mark.parametrize("block_rows", [1_000_000, 40, 3])
def test_neighbours_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.1 * (i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 16) for i in range(9)]  # more copies than a list holds
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 3), (2004, [None] + [1.0] * 15), rows[7], rows[7]]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, -0.1) for i, v in rows], VECTORS)
    got = {(r.id_a, r.id_b) for r in V.mutual(V.near(df, dim=16, block_rows=block_rows)).collect()}
    want = brute(dict(rows).items())
    assert len(got & want) >= 0.95 * len(want) and not got - want
    copies = {(a, b) for a, b in got if a >= 1000}
    assert copies == {(a, b) for a in range(1000, 1006) for b in range(a + 1, 1006)}


@pytest.mark.parametrize("block_rows", [1_000_000, 70])
def test_nearest_at_any_distance(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.0] * 16) for i in range(9)] + [(2000, [0.0] * 16), (2001, None), (2002, [1.0] * 3), rows[7]]
    rows = [(i, v and [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, -0.1) for i, v in rows], VECTORS)
    own = {i: np.array(v) for i, v in rows if i < 2000}
    ids = sorted(own)
    x = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
    d = np.round(1 - x @ x.T, 9)
    want = {(i, rank + 1, j) for a, i in enumerate(ids) for rank, (_, j) in enumerate(sorted((d[a, b], j) for b, j in enumerate(ids) if j != i)[:5])}
    got = V.nearest(df, dim=16, block_rows=block_rows).collect()
    assert len(got) == 5 * len(ids) and {(r.id, r["rank"], r.neighbour) for r in got} == want
    place = {i: a for a, i in enumerate(ids)}
    assert all(abs(r.distance - d[place[r.id], place[r.neighbour]]) < 1e-8 for r in got)
    assert V.nearest(df.limit(0), dim=16).collect() == [] and V.nearest(df.where("id = 1"), dim=16).collect() == []
    assert {(r.id, r.representative) for r in V.copies(df, dim=16).collect()} == {(1000 + i, 1000) for i in range(9)}


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([], VECTORS)
    assert V.near(df).collect() == []
    assert V.near(spark.createDataFrame([(1, [1.0] * 64, 0.0)], VECTORS)).collect() == []


def test_ranges():
    lo, hi = np.array([3, 0, 5, 2]), np.array([6, 0, 6, 2])
    got = [(i, j) for a, b in V.ranges(lo, hi) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got == [(0, 3), (0, 4), (0, 5), (2, 5)]


def triples(text):
    w = N._words(text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else None


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if i % 3 or not out:
            out.append(" ".join(rng.choice(words, rng.integers(25, 90))))
        else:
            w = out[rng.integers(0, len(out))].split(" ")
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(0, len(w))] = "changed"
            out.append(" ".join(w) if i % 2 else "\r\n".join(w).upper())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = [(i * 3, t) for i, t in enumerate(texts(seed))]
    rows += [(1000, None), (1001, ""), (1002, "few words"), rows[4], (1003, rows[4][1]), (1004, rows[4][1]), (1005, "x " * 4000), (1006, "x " * 4001)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id bigint, content string, rep string")
    own = {i: g for i, t in rows if t and (g := triples(t))}
    ids = sorted(own)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(own[a] & own[b]) >= 0.6 * len(own[a] | own[b])}
    got = [(r.id_a, r.id_b) for r in N.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    link = {i: i for i in ids}

    def root(i):
        while link[i] != i:
            i = link[i]
        return i

    for a, b in want:
        link[max(root(a), root(b))] = min(root(a), root(b))
    assert {(r.id, r.group_id) for r in N.groups(df).collect()} == {(i, root(i)) for i in ids}


def test_lists_that_are_cut(spark, monkeypatch):
    """A phrase that all texts hold, in lists cut into chunks: the same pairs, and no task gets a list whole."""
    phrase = " ".join(f"p{i}" for i in range(40))
    rng = np.random.default_rng(7)
    rows = [(i, phrase + " " + " ".join(f"q{int(x)}" for x in rng.integers(0, 40, 3 + i % 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, content string")
    own = {i: triples(t) for i, t in rows}
    want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.6 * len(own[a] | own[b])}
    monkeypatch.setattr(N, "LONG", 20)
    assert {(r.id_a, r.id_b) for r in N.pairs(df).collect()} == want
    reps = N.representatives(df, "id", "content").select("id", "text")
    table = N.frequencies(reps, N.WORDS, N.GRAM, N.LEAST_CELLS)
    lists = N.postings(reps, spark.sparkContext.broadcast(table), N.SHARE, N.WORDS, N.GRAM, N.MERGED)
    most = lists.groupBy("gram", "first", "second").count().agg({"count": "max"}).first()[0]
    assert table.max() >= 300 and most <= 4 * N.LONG


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, content string")
    assert N.pairs(df).collect() == [] and N.groups(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    both = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a bigint, b bigint")
    assert {(r.id, r.group_id) for r in N.components(both).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}

"""Cap filters: their lists, their losses, the work they save, and whole joins through them."""

import numpy as np
import pytest

from verisieve.llm import capjoin


def pairs_at(n, d, cosine, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((n, d))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("width", [1, 2, 5, 16])
def test_lists_hold_the_best_directions(width):
    code = capjoin.ProductCode(width, 9)
    x, _ = pairs_at(20, max(width, 2), 0.98, 1)
    x = x[:, :width] / np.linalg.norm(x[:, :width], axis=1, keepdims=True)
    order, turns = capjoin._turn(width, 42)
    y = x[:, order] @ turns[0]
    scores = (y[:, : width // 2] @ code.books[0].T)[:, :, None] + (y[:, width // 2 :] @ code.books[1].T)[:, None, :]
    scores = scores.reshape(len(x), -1)
    for row, got in zip(scores, code.decode(x, 12)):
        assert len(set(got)) == 12 and np.isclose(row[got].min(), np.sort(row)[-12])


@pytest.mark.parametrize("width", [16, 256])
@pytest.mark.parametrize("vectors", [5_000, 100_000])
def test_filters_lose_next_to_nothing(width, vectors):
    x, y = pairs_at(4000, width, 0.98, 2)
    code = capjoin.ProductCode(width, capjoin.words_for(vectors))
    a, b = code.decode(x), code.decode(y)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert (~met).sum() <= 1


def test_comparisons_are_few_in_many_dimensions():
    n, width = 100_000, 256
    code = capjoin.ProductCode(width, capjoin.words_for(n))
    x, _ = pairs_at(10_000, width, 0.98, 3)
    counts = np.unique(code.decode(x), return_counts=True)[1]
    assert (counts.astype(float) ** 2).sum() / len(x) ** 2 < 0.1


def test_a_pair_counts_in_the_first_filter_it_shares():
    r = np.random.default_rng(5)
    lists = np.sort(np.stack([r.choice(40, 6, replace=False) for _ in range(60)]), axis=1)
    hit = r.random((60, 60)) < 0.5
    hit = hit | hit.T
    for here in (0, 7, 20, 39):
        mine = [i for i in range(60) if here in lists[i]]
        got = capjoin.first_shared(lists[mine], here, hit[np.ix_(mine, mine)])
        want = [[bool(hit[i, j]) and min(set(lists[i]) & set(lists[j])) == here for j in mine] for i in mine]
        assert got.tolist() == want


@pytest.mark.parametrize("one, block", [(50, 1024), (50, 8), (4096, 8)])
def test_joins_through_filters_equal_all_pairs(spark, monkeypatch, one, block):
    monkeypatch.setattr(capjoin, "ONE", one)
    r = np.random.default_rng(6)
    base = r.standard_normal((30, 24))
    rows = [(i, (base[i % 30] + 0.08 * r.standard_normal(24)).tolist(), "ab"[i % 30 % 2], "x", 1, 2) for i in range(400)]
    rows += [(i, rows[i - 400][1], rows[i - 400][2], "x", 1, 2) for i in range(400, 450)]
    rows += [(7, rows[3][1], rows[3][2], "x", 1, 2), (900, None, "a", "x", 1, 2), (None, rows[0][1], "a", "x", 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cell string, n int, width int")
    got = sorted((r.vec_id, r.n_links) for r in capjoin.link_vectors(df, block=block).where("vec_id IS NOT NULL").collect())
    ok = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c, *_ in rows if v is not None and i is not None]
    unit = np.stack([v for _, v, _ in ok])
    same = np.array([c for *_, c in ok])
    links = ((unit @ unit.T >= 0.98) & (same[:, None] == same[None, :])).sum(axis=1) - 1
    assert got == sorted([(i, int(n)) for (i, *_), n in zip(ok, links)] + [(900, 0)])

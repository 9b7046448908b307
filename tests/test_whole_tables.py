"""The queries that take all rows, on tables that reach beyond every id bound, against brute force."""

from collections import Counter

import numpy as np
import pytest

from oracle import same
from vecloom.operators import sampling
from vecloom.plans.catalogue import QUERIES, SQL

N, DIM = 450, 64


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    r = np.random.default_rng(7)
    label = r.integers(0, 5, N)
    x = r.standard_normal((N, DIM)) + 0.9 * r.standard_normal((5, DIM))[label]
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, "de" if i < 100 else "en", f"s{i % 7}") for i in range(300)], "doc_id bigint, lang string, source string").write.parquet(f"{at}/documents.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return str(at), u, label


def ranks(u, label, q):
    """The other rows by falling cosine, and the rank of the least id of q's label."""
    c = u @ u[q]
    order = [j for j in np.lexsort((np.arange(N), -c)) if j != q]
    gold = min(j for j in order if label[j] == label[q])
    return order, 1 + sum(c[j] > c[gold] for j in order)


def test_every_hundredth_search(spark, data):
    at, u, label = data
    want = {q: ranks(u, label, q) for q in range(0, N, 100)}
    assert {r.q: r["rank"] for r in QUERIES["gold_rank"](spark, at).collect()} == {q: g for q, (_, g) in want.items()}
    assert np.isclose(QUERIES["bootstrap_ci"](spark, at).first()["mean"], np.mean([1 / g for _, g in want.values()]))
    assert QUERIES["recall_mrr"](spark, at).first()["n"] == len(want)
    rel = {q: [label[j] == label[q] for j in o] for q, (o, _) in want.items()}
    assert np.isclose(QUERIES["set_recall"](spark, at).first()["set_recall"], np.mean([sum(x[:50]) / sum(x) for x in rel.values()]), atol=1e-6)
    dcg = {q: sum(1 / np.log2(k + 2) for k in range(10) if x[k]) / sum(1 / np.log2(k + 2) for k in range(10)) for q, x in rel.items()}
    assert {r.q: r.ndcg for r in QUERIES["ndcg10"](spark, at).collect()} == pytest.approx(dcg, abs=2e-6)
    hard = {(q, j, k + 1) for q, (o, _) in want.items() for k, j in enumerate([j for j in o[:20] if label[j] != label[q]][:5])}
    assert {(r.q, r.id, r["rank"]) for r in QUERIES["hard_negatives"](spark, at).collect()} == hard


def test_every_batch(spark, data):
    at, u, _ = data
    phi = lambda z: 0.5 * np.array([__import__("math").erfc(x / 2**0.5) for x in z])
    guard, confusion, uniform, kept = set(), {}, {}, Counter()
    preserved = {}
    for b in range(0, N, 200):
        ids = range(b, min(N, b + 200))
        c = u[ids] @ u[ids].T
        w = u[ids][:, :48] / np.linalg.norm(u[ids][:, :48], axis=1, keepdims=True)
        d = w @ w.T
        n = len(ids)
        for i in range(n):
            for j in [j for j in np.lexsort((np.arange(n), -c[i])) if j != i][:3]:
                guard |= {(b + i, b + j), (b + j, b + i)}
        off = ~np.eye(n, dtype=bool)
        free = off & ~np.array([[(b + i, b + j) in guard for j in range(n)] for i in range(n)])
        confusion[b // 200] = phi(np.sqrt(2 - 2 * c[free]) / 0.6).mean()
        uniform[b // 200] = np.log(np.exp(-2 * (2 - 2 * c[off])).mean())
        window = free & (c >= 0.1) & (c <= 0.25)
        kept.update({b + i: min(4, int(window[i].sum())) for i in range(n) if window[i].any()})
        soft = lambda m: (lambda z: z - np.log(np.exp(z).sum(1, keepdims=True)))(np.where(off, m / 0.05, -1e9))
        o, m = soft(c), soft(d)
        preserved[b // 200] = np.where(off, np.exp(o) * (o - m), 0).sum(1).mean()
    assert {(r.i, r.j) for r in QUERIES["guard_pairs"](spark, at).collect()} == guard
    for name, want in (("confusion_loss", confusion), ("uniformity_loss", uniform), ("preservation_loss", preserved)):
        assert {r.batch: r.loss for r in QUERIES[name](spark, at).collect()} == pytest.approx(want, abs=2e-6), name
    got = QUERIES["confusable_negatives"](spark, at).collect()
    assert Counter(r.i for r in got) == kept and not {(r.i, r.j) for r in got} & guard


def test_every_document(spark, data):
    got = {r.q: (r.positive_1, r.positive_3, r.number_1, r.number_3, r.negative_1, r.negative_5) for r in QUERIES["training_rows"](spark, data[0]).collect()}
    assert got == {"de": ("s0", "s2", 0, 2, "s2", "s6"), "en": ("s2", "s4", 100, 102, "s0", "s4")}


@pytest.mark.parametrize("name", ["near_dup_groups", "dedup_f1", "gold_rank", "recall_mrr", "set_recall", "ndcg10", "hard_negatives", "knn10", "item_collisions", "cmp_overlap", "dtm_field", "pair_cos_stats", "silhouette_cosine", "crowding_rank"])
def test_no_query_samples(spark, data, monkeypatch, name):
    monkeypatch.setattr(sampling, "sample", lambda *a, **k: pytest.fail("a sample"))
    same(QUERIES[name](spark, data[0]), SQL[name], data[0])


def test_neighbours_of_more_rows_than_any_sample(spark):
    """Ranks of golds in 25,000 rows, by blocks, against brute force."""
    from vecloom.operators import evaluate, synthetic

    x = synthetic.mixture(25_000, 8, 7, 0.5).round(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = synthetic.table(spark, u, [i % 7 for i in range(len(u))])
    q = rows.where("id % 2500 = 0")
    golds = evaluate.least_golds(q, rows)
    want = {}
    for i in range(0, 25_000, 2500):
        gold = next(j for j in range(25_000) if j != i and j % 7 == i % 7)
        c = u @ u[i]
        want[i] = 1 + int(((c > c[gold] + 1e-12) & (np.arange(25_000) != i)).sum())
    assert {r.q: r["rank"] for r in evaluate.ranks_of(q, golds, rows).collect()} == want

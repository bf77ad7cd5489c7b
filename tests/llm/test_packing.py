"""Containers: nothing lost, nothing too full, hardly one too many."""

import os
import random
import time

import numpy as np
import pytest

from twinspan.llm import bpe
from twinspan.llm.packing import FREQUENT, best_fit, conflicts, pack_corpus, packed

needs = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZER_DIR, bpe.BYTE_BPE_50K)), reason="no vocabulary here")


def test_best_fit_takes_the_tightest_compatible_bin():
    sizes, sources, clusters = (np.array(x) for x in ([7, 6, 3, 3], [0, 1, 2, 0], [1, 2, 3, 4]))
    bins, n = best_fit(sizes, sources, clusters, 10)
    assert n == 2 and bins[2] == bins[0]  # 7 + 3 is full
    assert bins[3] == bins[1]


def test_conflicts_steer_but_never_open_a_container():
    bins, n = best_fit(np.array([5, 5, 5, 5]), np.array([0, 0, 1, 1]), np.array([1, 1, 2, 3]), 10)
    assert n == 2 and bins[0] != bins[1]  # copies apart
    bins, n = best_fit(np.array([5, 5]), np.array([0, 0]), np.array([1, 1]), 10)
    assert n == 1  # no other room


def test_random_runs_stay_near_the_bound():
    rng = random.Random(7)
    sizes = np.array([min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(3000)])
    bins, n = best_fit(sizes, np.array([rng.randint(0, 5) for _ in sizes]), np.array([rng.randint(0, 900) for _ in sizes]), 2048)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 2048 and n <= 1.01 * -(-sizes.sum() // 2048) + 1


def scanned(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin: the residual of the bin each item must go to (None: a new one or a conflict)."""
    bins, used = best_fit(sizes, sources, clusters, capacity)
    left, held = {}, {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        fit = [left[b] for b in left if left[b] >= sizes[i] and sources[i] not in held[b][0] and clusters[i] not in held[b][1]]
        b = int(bins[i])
        if fit:
            assert left[b] == min(fit) and sources[i] not in held[b][0] and clusters[i] not in held[b][1]
        left[b] = left.get(b, capacity) - int(sizes[i])
        held.setdefault(b, (set(), set()))[0].add(sources[i])
        held[b][1].add(clusters[i])
    assert min(left.values()) >= 0 and len(left) == used


def test_every_pick_is_the_tightest_compatible_bin():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = 300
        clusters = np.where(rng.random(n) < 0.3, 0, rng.integers(0, 60, n))
        scanned(rng.integers(1, 60, n), rng.integers(0, 4 + 30 * seed, n), clusters, 100)
    assert FREQUENT < 60


def test_a_hot_cluster_costs_no_more_than_others():
    n = 60_000
    began = time.perf_counter()
    bins, used = best_fit(np.full(n, 300), np.arange(n) % 7, np.zeros(n, np.int64), 2048)
    assert used == -(-n // 6) and time.perf_counter() - began < 5


@needs
def test_remaining_conflicts_are_told(spark):
    rows = [(i, "one two three", "a" if i < 3 else f"s{i}") for i in range(6)] + [(10, "four five", "b"), (11, None, "b")]
    got = conflicts(packed(spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1), capacity=12), 12).first()
    assert got["containers"] == got["least"] and got["tokens"] > 0 and got["with_copy"] >= 1


@needs
def test_corpus(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "(y)"]) for _ in range(rng.randint(1, 300))), rng.choice(["a", "b", None]), 1) for i in range(400)]
    rows += [(1000 + i, rows[0][1], "a", 1) for i in range(100)] + [(2000, "word " * 9000, "a", 1), (2001, None, "a", 1), (2002, "", "b", 1), (7, "again", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, container int").repartition(5)
    with open(os.path.join(bpe.TOKENIZER_DIR, bpe.BYTE_BPE_50K), "rb") as f:
        encoder = bpe.Encoder(bpe.parse_ranks(f.read()))
    want: dict[int, int] = {}
    for (i, t, _, _), n in zip(rows, encoder.count_batch([r[1] or "" for r in rows]), strict=True):
        want[i] = want.get(i, 0) + n
    got = pack_corpus(df).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in want.items() if n}
    big = got[got.doc_id == 2000].sort_values("first_token")
    assert (big.first_token.values == np.arange(len(big)) * 2048).all()
    cut = got.groupby("doc_id").size()
    assert set(cut[cut > 1].index) <= {2000, 7}
    assert got.container.nunique() <= -(-got.n_tokens.sum() // 2048) + 2
    assert pack_corpus(df.limit(0)).count() == 0

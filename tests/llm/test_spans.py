"""Shared spans against brute force over all windows."""

import random

from twinspan.llm.spans import MIN_BYTES, anchors_of, shared_share, shared_span_pairs


def brute(rows, n=MIN_BYTES):
    places = {}
    for i, t in rows:
        if i is not None and t is not None:
            data = t.encode()
            for k in range(len(data) - n + 1):
                places.setdefault(data[k : k + n], set()).add(i)
    return {(a, b) for ids in places.values() for a in ids for b in ids if a < b}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            parts += [word(), p[a : a + rng.choice([150, 195, 198, 199, 200, 201, 205, 260])], word()]
        rows.append((i, "".join(parts)))
    return rows


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(100, None), (101, ""), (None, "x" * 500), (102, "y" * 900), (103, "z" * 250 + "y" * 230), (104, "y" * 199), (105, "same" * 80), (106, "same" * 80), (105, "same" * 80)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert {tuple(r) for r in shared_span_pairs(df).collect()} == brute(rows)


def test_hot_anchors_take_the_distributed_way(spark, monkeypatch):
    import twinspan.llm.spans as spans

    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    groups = spans.shared_groups
    monkeypatch.setattr(spans, "shared_groups", lambda docs, m, a: groups(docs, m, a, local=1))
    assert {tuple(r) for r in shared_span_pairs(df).collect()} == brute(rows)


def test_every_paragraph_holds_an_anchor():
    import numpy as np

    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    _, _, pos = anchors_of(data, 200, 80)
    kept = set(pos.tolist())
    missing = [i for i in range(len(data) - 199) if not any(p in kept for p in range(i, i + 121))]
    assert not missing


def test_share(spark):
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("qwertyuiop") for _ in range(n))
    common = noise(300)
    rows = [(1, noise(500) + common + noise(200)), (2, common), (3, noise(400)), (4, noise(90)), (5, rows0 := noise(250)), (6, rows0)]
    got = {r["doc_id"]: r for r in shared_share(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert [got[i]["shared_bytes"] for i in (1, 2, 3, 5, 6)] == [300, 300, 0, 250, 250]
    assert got[1]["class_id"] == got[2]["class_id"] == 1 and got[6]["class_id"] == 5 and got[3]["class_id"] == 3
    assert (got[1]["links"], got[3]["links"], got[5]["copies"]) == (1, 0, 1)


def covered(rows, n=MIN_BYTES):
    """Bytes of each record in windows that other texts hold too."""
    places = {}
    for i, t in rows:
        data = t.encode()
        for k in range(len(data) - n + 1):
            places.setdefault(data[k : k + n], []).append((i, k))
    got = {i: set() for i, t in rows if len(t.encode()) >= n}
    for held in places.values():
        if len({i for i, _ in held}) > 1:
            for i, k in held:
                got[i].update(range(k, k + n))
    return {i: len(x) for i, x in got.items()}


def repeats():
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("qwertyuiop") for _ in range(n))
    block, short = noise(3000), noise(210)
    rows = [
        (200, block + noise(50) + block),
        (201, noise(77) + block),
        (202, "x" * 5000),
        (203, noise(300) + "x" * 5000 + noise(900) + "x" * 210 + noise(300)),
        (204, "abc" * 300 + noise(500) + "abc" * 100 + "q"),
        (205, noise(20) + "abc" * 500),
        (206, short + noise(200) + short + noise(700) + short[:205] + noise(9) + short[1:]),
        (207, noise(30) + short[:204] + noise(300)),
        (208, block[100:400] + noise(5) + block[100:400] + block[90:350]),
    ]
    return [(i, t) for i, t in dict(corpus(4)).items() if t] + rows


def test_share_counts_every_place(spark, monkeypatch):
    import twinspan.llm.spans as spans

    rows = list({t: (i, t) for i, t in repeats()}.values())
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = covered(rows)
    assert want[200] == 6000 and want[202] == 5000
    assert {r["doc_id"]: r["shared_bytes"] for r in shared_share(df).collect()} == want
    groups = spans.confirmed_groups
    monkeypatch.setattr(spans, "confirmed_groups", lambda docs, hits, m, a: groups(docs, hits, m, a, local=1))
    assert {r["doc_id"]: r["shared_bytes"] for r in shared_share(df).collect()} == want


def test_share_over_segments(spark, monkeypatch):
    import numpy as np

    import twinspan.llm.spans as spans

    monkeypatch.setattr(spans, "SEGMENT", 512)
    for _, t in repeats():
        data = np.frombuffer(t.encode(), np.uint8)
        fp, ctx, pos = spans.anchor_places(data, 200, 80)
        runs = list(zip(*(x.tolist() for x in spans.anchor_runs(data, 200, 80)), strict=True))
        places = {}
        for f, x, p in zip(fp.view(np.int64).tolist(), ctx.view(np.int64).tolist(), pos.tolist(), strict=True):
            places.setdefault((f, x), []).append(p)
        assert {(f, x, o) for f, x, o, _, _ in runs} == {(*k, min(v)) for k, v in places.items()}
        assert all(any((f, x) == k and a <= p <= b for f, x, _, a, b in runs) for k, v in places.items() for p in (min(v), max(v)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, c int, fp int")
    assert shared_span_pairs(df).count() == 0 and shared_share(df).count() == 0


def test_hot_header_in_two_variants(spark):
    """Each text shares the header with all, its variant with half of them; more surroundings than one task takes."""
    rng = random.Random(15)
    noise = lambda n: "".join(rng.choice("qwertyuiop  ") for _ in range(n))
    head, tail = noise(320), noise(320)
    rows = [(i, head + ("one" if i % 2 else "another") + tail[: 300 + i % 2] + noise(90)) for i in range(2500)] + [(9000 + i, noise(700)) for i in range(20)]
    got = {r["doc_id"]: r for r in shared_share(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert {got[i]["links"] for i in range(2500)} == {2499} and {got[i]["class_id"] for i in range(2500)} == {0}
    assert all(got[9000 + i]["links"] == 0 for i in range(20))
    assert all(620 <= got[i]["shared_bytes"] <= 640 for i in range(2500))


def test_link_counts_equal_pairs(spark):
    from twinspan.llm.spans import link_counts

    rng = random.Random(16)
    groups = {g: set(rng.sample(range(40), rng.randint(2, 12))) for g in range(25)} | {100: set(range(30)), 101: set(range(12)), 102: set(range(25))}
    rows = [(g, c) for g, cs in groups.items() for c in cs]
    want: dict[int, set] = {}
    for cs in groups.values():
        for c in cs:
            want.setdefault(c, set()).update(cs - {c})
    got = {r["c"]: r["links"] for r in link_counts(spark.createDataFrame(rows, "g bigint, c bigint")).collect()}
    assert got == {c: len(x) for c, x in want.items()}


def test_rows_of_shared_anchors_come_through_in_any_batches():
    import numpy as np

    from twinspan.llm.spans import batch_kinds, shared_rows

    rng = random.Random(17)
    rows = sorted({(rng.randint(0, 30), rng.randint(0, 2), rng.randint(0, 3)) for _ in range(60)} | {(50, 1, 1), (50, 2, 1)})
    rows = sorted((f * 0x1E3779B97F4A7C15 % (1 << 62), x * 0x56E8FEB86659FD93 % (1 << 62), c) for f, x, c in rows)
    fp, ctx, c = (np.array(x, np.int64) for x in zip(*rows))
    kinds = batch_kinds(fp, ctx, c)
    assert all((k == 0) == (sum(r[:2] == q[:2] for q in rows) == 1) for r, k in zip(rows, kinds.tolist()))
    columns = [fp, ctx, c, np.zeros(len(fp), np.int8)]
    want = [r for r in rows if len({q[2] for q in rows if q[0] == r[0]}) > 1]
    for size in (1, 2, 7, 100):
        parts = [[x[i : i + size] for x in columns] for i in range(0, len(fp), size)]
        found = [tuple(int(x[i]) for x in out[:3]) for out in shared_rows(iter(parts)) for i in range(len(out[0]))]
        assert sorted(found) == want

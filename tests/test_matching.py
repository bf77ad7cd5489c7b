"""Lexer, windows and tier A against plain re-computations."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from twinspan.operators.lexing import MUL, SEED, file_windows, lex, token_counts, token_hash, window_hashes, windows
from twinspan.operators.matching import brute_force, match_runs, promote, tier_a

BODY = "".join(f"    total_{i} = total_{i} + weigh(rows[{i}], 'x{i}') // note\n" for i in range(12))


def test_tokens_and_positions():
    text = 'é = "a\\"b" + 1.5e-3 # c\n/* x\n*/ f(\'q\')'
    tokens, starts, ends, lines = lex(text.encode())
    assert [t.decode() for t in tokens] == ["é", "=", '"a\\"b"', "+", "1.5e-3", "f", "(", "'q'", ")"]
    assert lines.tolist() == [1, 1, 1, 1, 1, 3, 3, 3, 3]
    assert all(text.encode()[a:b] == t for t, a, b in zip(tokens, starts, ends, strict=True))


def test_unterminated_literals_reach_the_end():
    assert [t.decode() for t in lex(b"a 'b\nc")[0]] == ["a", "'b\nc"]
    assert [t.decode() for t in lex(b"a /* b\nc")[0]] == ["a"]
    assert lex(b"")[0] == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab1 \n\"'/*#\\.e+_é", max_size=120))
def test_lexing_is_lossless_and_blind_to_space(text):
    data = text.encode()
    tokens, starts, ends, _ = lex(data)
    assert all(data[a:b] == t for t, a, b in zip(tokens, starts, ends, strict=True))
    assert list(starts) == sorted(starts)


def test_rolling_equals_naive():
    rng = random.Random(4)
    tokens = [rng.choice([b"a", b"b", b"12", b"'s'", b"(", "é".encode()]) for _ in range(200)]
    got = window_hashes(tokens, 7)
    for i in range(len(tokens) - 6):
        h = 0
        for t in tokens[i : i + 7]:
            h = (h * MUL + token_hash(t)) % (1 << 64)
        assert int(got[i]) == h
    assert token_hash(b"a") == ((SEED ^ 1) ^ 97) * MUL % (1 << 64)
    assert len(window_hashes(tokens, 0)) == len(window_hashes(tokens[:5], 6)) == 0


def corpus(spark, files):
    return spark.createDataFrame(files, "path string, text string")


def test_copies_are_grouped(spark):
    files = [("a/x.py", "import one\n" + BODY + "done_a = 1\n"), ("b/y.py", "import two, three\n\n" + BODY + "z()\n"), ("c.py", "print(1)\n"), ("n.py", None)]
    rows = sorted((r["path"], r["start_line"], r["end_line"]) for r in tier_a(corpus(spark, files)).collect())
    assert rows == [("a/x.py", 2, 13), ("b/y.py", 3, 14)]
    assert tier_a(corpus(spark, [])).count() == 0


def test_greedy_equals_brute_force(spark):
    rng = random.Random(5)
    blocks = ["".join(f"v{b}{i} = f{b}(k{i}, {i})\n" for i in range(rng.randint(10, 18))) for b in range(6)]
    files = []
    for n in range(24):
        parts = [rng.choice(blocks) if rng.random() < 0.8 else f"u{n}_{j} = {j}\n" for j in range(rng.randint(1, 5))]
        files.append((rng.choice(["a/b", "a-b", "a"]) + f"/f{n}.py", "".join(parts)))
    files += [(f"copies/c{i}.py", files[0][1]) for i in range(5)]
    got = sorted((r["path"], r["start_byte"], r["end_byte"], r["h"]) for r in match_runs(file_windows(corpus(spark, files))).collect())
    places = {}
    for p, t in files:
        tokens, starts, ends, _ = lex(t.encode())
        places[p] = (window_hashes(tokens).view(np.int64).tolist(), starts, ends)
    want = sorted((p, int(places[p][1][a]), int(places[p][2][b + 49]), h) for p, a, b, h in brute_force([(p, v[0]) for p, v in places.items()]))
    assert got == want and got


def test_promotion_keeps_a_floor_of_two(spark):
    a = spark.createDataFrame([(1, 9, "x", 1, 8), (1, 9, "y", 2, 9), (2, 4, "x", 20, 30), (2, 4, "z", 1, 11), (2, 4, "w", 1, 11)], "group_hash bigint, length int, path string, start_line int, end_line int")
    b = spark.createDataFrame([("x", 1, 8), ("x", 20, 30), ("x", 20, 30)], "path string, start_line int, end_line int")
    assert sorted((r["group_hash"], r["path"]) for r in promote(a, b).collect()) == [(2, "w"), (2, "z")]


def test_counts_of_deep_texts_match_shallow_ones(spark):
    deep = "x = '" + "\\n" * 1500 + "' + 3\n"
    rows = [(1, deep), (2, "a b 1 'q' ("), (3, None), (4, "")]
    got = {r["doc_id"]: (r["identifiers"], r["numbers"], r["strings"], r["puncts"], r["tokens"]) for r in token_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (1, 1, 1, 2, 5), 2: (2, 1, 1, 1, 5), 3: (0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0)}


def test_windows_of_empty_corpus(spark):
    assert windows(corpus(spark, [])).count() == 0

"""The prefix trie, the content sort and the whitening against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tramorisk.llm import contentsort, tries, whitening

FOLDER = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
COPY = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def conversations(spark, given):
    return spark.createDataFrame(given, "conv_id long, turn long, role string, text string")


def same_trie(spark, given):
    got = rows(tries.conversation_trie(conversations(spark, given)), *NODE)
    assert got == sorted(brute.conversation_trie(given), key=repr)
    return got


def test_trie_of_given(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = rows(tries.conversation_trie(table), *NODE)
    assert got == sorted(brute.conversation_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]), key=repr)


def test_trie_of_awkward(spark):
    """Nulls in every column, ties, repeated rows, absent starts, negative ids, empty and long texts, and a conversation whose turns all come from elsewhere."""
    given = [(0, None, "user", "hi"), (0, 1, None, "hi"), (0, 1, "user", None), (0, 1, "user", None), (0, 2, "bot", "é" * 4000), (None, 1, "user", "lost"),
             (1, 5, "user", "hi"), (2, 1, "user", "hi"), (7, 1, "", ""), (7, 2, "a", "bc"), (8, 2, "ab", "c"), (-3, 1, "user", "hi"), (-3, 2, "bot", "ho"),
             (-5, 1, "user", "hi"), (-6, 9, "user", "hi"), (10**15 + 3, 1, "user", "hi"), (13, None, None, None), (14, 1, "x", "y")]
    assert any(n[1] == 0 and n[3] > 1 for n in same_trie(spark, given))


def test_trie_over_many_blocks(spark):
    """Paths that end before, at and behind the ends of column blocks, share some or all of them, and repeat within themselves."""
    given = []
    for c, (length, branch) in enumerate([(8, 99), (8, 99), (16, 99), (17, 99), (17, 99), (24, 16), (24, 8), (25, 7), (40, 99), (40, 39), (41, 99), (7, 99), (9, 3), (9, 3), (64, 63)]):
        given += [(5 * c, i, "user" if i % 2 else "bot", "same" if i < branch else f"other {c % 3}") for i in range(length)]
    assert max(n[1] for n in same_trie(spark, given)) == 64


def test_trie_of_equal_conversations(spark):
    """Many members of one node: the list of ids goes over several spans."""
    given = [(c, i, "user", f"turn {i}") for c in range(0, 9000, 5) for i in range(2)]
    assert [n[1:4] for n in same_trie(spark, given)] == [(0, None, 1800), (1, 0, 1800), (2, 0, 1800)]


def test_trie_of_nothing_and_clashing_columns(spark):
    assert tries.conversation_trie(conversations(spark, [])).count() == 0
    given = [(5, 1, "user", "hi"), (10, 1, "user", "hi")]
    wide = conversations(spark, given).withColumns({c: F.lit("clash") for c in ("pos", "t", "block", "prior", "n_turns", "key", "level")})
    assert rows(tries.conversation_trie(wide), *NODE) == sorted(brute.conversation_trie(given), key=repr)


def test_id_digests_stream_in_order(spark):
    ids = [-70000, -4097, -4096, -1, 0, 4095, 4096, 10**12]
    ends = spark.createDataFrame([(bytes([k]), i) for k in (1, 2) for i in reversed(ids)], "key binary, conv_id long").repartition(5)
    found = {bytes(r["key"]): r["ends_sha256"] for r in tries.id_digests(ends).collect()}
    assert found == {bytes([k]): brute.sha(",".join(map(str, ids))) for k in (1, 2)}


AWKWARD = [(5, "a b"), (3, "a  b"), (None, "a\t\n b"), (9, None), (8, ""), (7, " "), (7, "\n"), (7, " \x0b"), (1, "A b"), (2, "a b "), (None, "x" * 300_000 + "1"),
           (None, "x" * 300_000 + "2"), (4, "x" * 300_000 + "1"), (6, "a b"), (None, "only null ids"), (None, "only  null ids"), (11, "twice"), (11, "twice"), (12, "é\r\né")]


@pytest.mark.parametrize("slice_bytes", [1 << 28, 64])
def test_copies_of_awkward(spark, slice_bytes):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").coalesce(1)
    got = rows(contentsort.exact_copies(docs, slice_bytes=slice_bytes), *COPY)
    assert got == sorted(brute.exact_copies(AWKWARD), key=repr)


def test_copies_of_given(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = contentsort.exact_copies(docs)
    assert rows(found, *COPY) == sorted(brute.exact_copies(given), key=repr)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "keep_id", "group_size", "kept", "text_sha256"]


def test_a_run_goes_through_many_slices(spark):
    """Two thirds of all rows are equal, one id is on a third of them: no slice holds more than a share, one row of each group is kept."""
    given = [(i if i % 3 else 7, "the same text" if i < 2000 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
    cuts = contentsort.splitters(docs, slice_bytes=1000).first()["cuts"]
    same = brute.sha("the same text")
    assert sum(c["sha"].hex() == same for c in cuts) > 10 and any(c["id"] == 7 for c in cuts if c["sha"].hex() == same)
    assert rows(contentsort.exact_copies(docs, slice_bytes=1000), *COPY) == sorted(brute.exact_copies(given), key=repr)


def test_copies_use_no_python_workers(spark):
    plan = contentsort.exact_copies(spark.createDataFrame(AWKWARD, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


def test_copies_of_nothing_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert contentsort.exact_copies(docs).count() == 0
    wide = spark.createDataFrame([(1, "a", "x", "y", 3, 4), (2, "a", "z", "w", 5, 6)], "doc_id long, text string, slice string, kept string, row int, body int")
    found = contentsort.exact_copies(wide)
    assert found.columns == ["doc_id", "slice", "row", "body", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows(found, "doc_id", "slice", "row", "kept") == [(1, "x", 3, True), (2, "z", 5, False)]
    assert rows(contentsort.drop_copies(wide.drop("kept")), "doc_id", "text", "body") == [(1, "a", 4)]
    with pytest.raises(ValueError):
        contentsort.drop_copies(wide)


def whitened(spark, given, **more):
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({k: F.lit(v) for k, v in more.items()})
    return whitening.whiten(table)


def check_whitening(found, given, most=16):
    """All columns against numpy; components up to sign, repeated eigenvalues by their subspace."""
    kept = [(i, v) for i, v in given if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values.max(initial=0) * 1e-9).sum()))
    got = sorted(map(tuple, found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()))
    assert [g[:4] for g in got] == sorted((i, c + 1, n, int(((x[r] * n - sums) ** 2).sum())) for r, (i, _) in enumerate(kept) for c in range(k))
    mine = np.array([g[4] for g in got]).reshape(len(kept), k)[np.argsort(np.argsort([i for i, _ in kept], kind="stable"), kind="stable")]
    assert np.allclose([g[5] for g in got[:k]], values[:k] / values.sum(), rtol=1e-6) and all(g[6] < 1e-9 for g in got)
    want = (x * n - sums).astype(float) / n @ vectors[:, :k] / np.sqrt(values[:k])
    alone = [c for c in range(k) if not any(abs(values[c] - v) < 1e-6 * values[0] for d, v in enumerate(values) if d != c)]
    for c in alone:
        assert min(np.abs(mine[:, c] - want[:, c]).max(), np.abs(mine[:, c] + want[:, c]).max()) < 1e-6
    return alone


def test_whitening_of_given(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    given = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()]
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(check_whitening(found, given)) == 16


def test_whitening_of_awkward(spark):
    """Bad vectors go, copies count once, a constant dimension has no component, other lengths go."""
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=3)] + [0.5]) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(50)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]), (204, [1.0, float("inf"), 2.0, 3.0])]
    assert check_whitening(whitened(spark, [*good, *bad, (205, [1.0, 2.0])], component="clash", n="clash", row="clash", at="clash", value="clash", _="clash"), good) == [0, 1, 2]


def test_whitening_of_repeated_eigenvalues(spark):
    """Corners of a cube and a square: all eigenvalues of the cube are equal, the components stay orthogonal."""
    cube = [(i, [float(i >> b & 1) for b in range(3)]) for i in range(8)]
    assert check_whitening(whitened(spark, cube), cube) == []
    stretched = [(i, [float(i & 1), float(i >> 1 & 1), 4.0 * (i >> 2 & 1)]) for i in range(8)]
    assert check_whitening(whitened(spark, stretched), stretched) == [0]


def test_whitening_of_little(spark):
    for given in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitened(spark, given).count() == 0
    line = [(None, [0.0]), (2, [1.0]), (3, [5.0])]
    assert [r["component"] for r in whitened(spark, line).collect()] == [1, 1, 1]


def test_whitening_of_huge_entries(spark):
    """Moments beyond a long stay exact; a deviation beyond a long is null."""
    given = [(1, [1e300, 0.0]), (2, [-1e16, 1.0]), (3, [2.5, 1e12])]
    found = whitened(spark, given).collect()
    assert len(found) == 6 and all(r["deviation"] is None and r["identity_error"] < 1e-9 for r in found)


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (9, 5))
    m = (a @ a.T).tolist()  # rank 5 of 9
    poly = whitening.characteristic_polynomial(spark, m)
    assert poly[:4] == [0] * 4 and poly[9] == 1 and poly[8] == -sum(m[i][i] for i in range(9))
    values = np.linalg.eigvalsh(np.array(m, float))[::-1]
    for rank in range(1, 6):
        low, scale, above, through = whitening.isolate(poly[4:], rank)
        assert above == rank - 1 and through == rank and math.isclose(low / (1 << scale), values[rank - 1], rel_tol=1e-9)
    assert whitening.roots_above([-6, 11, -6, 1], 1, 0) == 2 and whitening.isolate([-4, 8, -5, 1], 1)[2:] == (0, 2)

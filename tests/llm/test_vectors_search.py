"""Vector operators and ranked search against brute force; ids and roles that once failed."""

import random
from fractions import Fraction
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from logshield.llm import chat, graph, jaccard_join, pivot_index, ranked_search, whitening

VECTORS = "vec_id long, embedding array<float>, label int, node string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def linked(rows, least=0.93):
    """n_links and component_id of every row, all pairs compared."""
    good = [i for i, (v, e, lab, _) in enumerate(rows) if v is not None and lab is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = unit(np.array([rows[i][1] for i in good], np.float32).astype(float)) if good else np.zeros((0, 1))
    cos = x @ x.T
    for a, b in zip(*np.nonzero(np.triu(cos >= least, 1)), strict=True):
        i, j = good[a], good[b]
        if rows[i][2] == rows[j][2]:
            links[i] += 1
            links[j] += 1
            root[find(j)] = find(i)
    least_id = {}
    for i in good:
        least_id[find(i)] = min(least_id.get(find(i), rows[i][0]), rows[i][0])
    return [(r[0], links[i], least_id[find(i)] if i in set(good) else r[0]) for i, r in enumerate(rows)]


def near_rows(spark, rows):
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def planted(rng, n, dim, pairs, cosines):
    x = unit(rng.standard_normal((n, dim)))
    y = []
    for i in range(pairs):
        c = cosines[i % len(cosines)]
        off = rng.standard_normal(dim)
        off = unit(off - (off @ x[i]) * x[i])
        y.append(c * x[i] + np.sqrt(1 - c * c) * off)
    return np.concatenate([x, np.array(y)])


def test_near_vectors_cases(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, -0.0]
    rows = [
        (5, a, 1, "x"), (3, a, 1, "x"), (3, [2.0, 0.0, 0.0, -0.0], 1, "x"), (9, b, 1, "x"), (8, [0.0, 5e30, 0.0, 0.0], 1, "x"), (7, a, 2, "x"), (6, a, None, "x"), (11, None, 1, "x"), (12, [], 1, "x"),
        (13, [0.0] * 4, 1, "x"), (14, [nan, 0.0, 0.0, 0.0], 1, "x"), (15, [inf, 0.0, 0.0, 0.0], 1, "x"), (16, [None, 1.0, 0.0, 0.0], 1, "x"), (None, a, 1, "x"), (5, a, 1, "x"),
    ]
    assert near_rows(spark, rows) == sorted(linked(rows), key=str)
    assert near_rows(spark, [*rows, (20, [1.0, 0.0], 1, "x")]) == sorted([*linked(rows), (20, 0, 20)], key=str)
    assert near_rows(spark, []) == []
    assert near_rows(spark, [(1, None, 1, "x")]) == [(1, 0, 1)]


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_near_vectors_recall(spark, dim):
    rng = np.random.default_rng(dim)
    n = 40 if dim == 3 else 1500
    x = planted(rng, n, dim, n // 2, (0.9301, 0.95, 0.99))
    rows = [(i, [float(c) for c in np.float32(v)], 1 if i % n < n // 2 else 2, "x") for i, v in enumerate(x)]
    want, got = linked(rows), near_rows(spark, rows)
    total, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert found <= total and found >= 0.96 * total
    # A group of near copies, larger than a block, around one vector: nothing of it is lost.
    core = unit(unit(x[0]) + 0.01 * rng.standard_normal((pivot_index.BLOCK + 300, dim)))
    rows = [(i, [float(c) for c in np.float32(v)], 1, "x") for i, v in enumerate(core)]
    assert {r[1:] for r in near_rows(spark, rows)} == {(len(core) - 1, 0)}


SEARCH = "doc_id long, text string, row long"


def brute(docs, items, k):
    import re

    terms = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(ranked_search.TERM, t or "")]
    bags = [(d, terms(t)) for d, t, _ in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    df, asked, out = {}, {}, []
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    for i, t, *_ in items:
        asked.setdefault(i, []).extend(terms(t))
    for i, q in asked.items():
        scores = []
        for d, b in bags:
            m = 25 + (75 * len(b) * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * b.count(w)) // (1000 * b.count(w) + 8 * m)) for w in q if w in b)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [500_000, 7])
def test_search_equals_brute_force(spark, vocabulary):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "日本", "ABC", "x\x00y"]
    said = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10, 64])]) for _ in range(n))
    docs = [(i, said(rng.choice([1, 3, 20, 80])), i) for i in range(300)]
    docs += [(None, "w1 w59", 0), (400, None, 0), (401, "", 0), (402, " ;,", 0), (7, "w59 w58", 0), (7, "w59 w58", 0), (8, docs[20][1], 0), (403, "w59 " * 400_000 + "w58", 0)]
    items = [(i, said(rng.choice([1, 2, 9, 40])), "x") for i in range(25)] + [(30, None, "x"), (31, "", "x"), (32, "zzz", "x"), (3, "w50 w51", "x"), (None, "w59 w4", "x"), (33, "W59, W59 abc", "x")]
    got = ranked_search.ranked(spark.createDataFrame(docs, SEARCH), spark.createDataFrame(items, "item_id long, text string, term string"), 10, vocabulary)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str) == brute(docs, items, 10)


def test_search_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1)], SEARCH), spark.createDataFrame([(1, "a", "x")], "item_id long, text string, term string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.withColumn("text", F.lit("q"))), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        got = ranked_search.ranked(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_whitening_equals_definition(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + 3
    rows = [(i, [float(c) for c in np.float32(v)], i, "x") for i, v in enumerate(x)]
    rows += [(500, rows[3][1], 1, "x"), (3, rows[4][1], 1, "x"), (None, rows[5][1], 1, "x"), (501, None, 1, "x"), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (503, [float("nan")] * 6, 1, "x"), (504, [1.0], 1, "x"), (505, [], 1, "x")]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    kept = [(r[0], [floor(Fraction(float(np.float32(c))) * 256) for c in r[1]]) for r in rows[:403]]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(6)] for i in range(6)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    far = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in kept for _ in range(4))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got) == far
    by = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] * cov.trace() / values[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if r["vec_id"] not in (3, None):
            by.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
    at = dict(kept)
    for k in range(4):
        want = np.array([(np.array(at[i]) - np.array(sums) / n) @ axes[:, k] / np.sqrt(values[k]) for i, _ in by[k + 1]])
        have = np.array([w for _, w in by[k + 1]])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9


def test_whitening_large_and_degenerate(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    for rows in ([], [(1, [1.0, 2.0], 1, "x")], [(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")], [(1, None, 1, "x")], [(1, [], 1, "x")]):
        assert whitening.whitened(frame(rows)).count() == 0
    # Entries that 64-bit sums of squares would not hold; one direction has no variance.
    big = frame([(i, [float(2.0**30 * (i % 7)), 1.5, 1e38 if i == 8 else 0.0], 1, "x") for i in range(9)])
    got = whitening.whitened(big).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-4 for r in got) and {r["deviation"] for r in got} == {None}


def test_word_hash_and_clashing_ids(spark, monkeypatch):
    bits = ["a" if bin(i).count("1") % 2 == 0 else "b" for i in range(4096)]
    word, other = "".join(bits), "".join("b" if c == "a" else "a" for c in bits)
    docs = [(1, word), (2, other), (3, word), (4, "a"), (5, "b"), (6, "12345678a"), (7, "12345678b"), (8, "x" * 64), (9, "x" * 65), (10, "x" * 66)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == {d: 1 if d == 3 else d for d, _ in docs}
    # Ids of four bits: unlike sets share them, and are told apart all the same.
    monkeypatch.setattr(jaccard_join, "NODE_BITS", np.uint64(15))
    docs = [(i, " ".join(f"{i % 40}-{k}" for k in range(9))) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 40 for i in range(80)}


def test_long_roles_and_paths(spark):
    roles = ["user\n" * 200_000, "\\n\\\\|<|\n\\", "<|im_end|>\n<|im_start|>", "", "\n", "\\", "a\\nb"]
    turns = spark.createDataFrame([(1, i, r, f"t{i}\n<|im_end|>\n") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    made = chat.examples(turns).where("final").select(F.explode(chat.read_back(F.col("formatted"))).alias("t")).select("t.role", "t.text").collect()
    assert [(r[0], r[1]) for r in made] == [(r, f"t{i}\n<|im_end|>\n") for i, r in enumerate(roles)]
    path = spark.range(700).selectExpr("id AS a", "id + 1 AS b")
    assert [tuple(r) for r in graph.components(path).agg(F.count("*"), F.max("root")).collect()] == [(701, 0)]

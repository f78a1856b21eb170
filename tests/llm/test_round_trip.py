"""Entities without bounds of length, and mixes that come near their targets."""

import random

import pytest
from pyspark.sql import functions as F

from logshield.llm import mixing, pii

LONG_HEX = "0123456789abcdef" * 40
FOUND = [
    ("email", "a" * 90 + "@example.com"), ("email", "a.b.c.d.e.f.g.h.i.j.k.l.m@mail.example.co.uk"), ("email", "x@" + "sub." * 12 + "example.info"), ("secret", "sk-" + "Ab3" * 30), ("secret", "sk-proj-" + "aB3-_x" * 8),
    ("secret", "github_pat_" + "A1b2_" * 12), ("secret", LONG_HEX), ("secret", "AKIA" + "AB12" * 6), ("name", "Mr. Müller-Lüdenscheid"), ("name", "Dr. Smith-Jones"),
]


@pytest.mark.parametrize(("kind", "text"), FOUND)
def test_entities_of_any_length(kind, text):
    said = f"see {text} there, .{text} and ({text})" if kind == "email" else f"see {text} there"
    found = pii.entities(said)
    assert [(said[a:b], k) for a, b, k in found] == [(text, kind)] * (3 if kind == "email" else 1)
    new, _ = pii.replaced(said, "key")
    made = pii.surrogate(kind, text, "key")
    assert text not in new and made in new and made != text and len(made) == len(text) and pii.entities(made)[0][2] == kind
    assert pii.surrogate(kind, text, "other key") != made


def test_long_surrogates_are_one_to_one_and_leave_nothing():
    # Texts that differ in one place only: all images differ, and none keeps a block of the text.
    texts = [LONG_HEX[:i] + ("1" if LONG_HEX[i] != "1" else "2") + LONG_HEX[i + 1 :] for i in range(0, len(LONG_HEX), 7)] + [LONG_HEX]
    made = [pii.surrogate("secret", t, "key") for t in texts]
    assert len(set(made)) == len(texts)
    assert all(sum(a == b for a, b in zip(t, m, strict=True)) < len(t) / 5 for t, m in zip(texts, made, strict=True))
    # Runs without an entity cost time in proportion to their length.
    assert pii.entities("a." * 300_000 + " " + "a@" * 100_000 + " " + "@" * 100_000) == []


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_mixes_are_near_their_targets(spark, seed):
    rng = random.Random(seed)
    # The rest of a source can give or take what its longest documents need.
    sizes = [(s, max(1, int(rng.lognormvariate(4.5, 1)))) for s in "abcdef" for _ in range(400)] + [("a", 3000), ("a", 2500), ("b", 4000), ("f", 2000), ("f", 1500)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mixture(docs, seed=seed)
    assert got.where("taken > 2 * size OR taken % size <> 0").count() == 0
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.expr("percentile(size, 0.5)").alias("middle")).collect():
        assert abs(r["taken"] - r["target"]) <= r["middle"] / 2

"""The corpus pipeline against brute force, on a small hostile corpus."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logshield.llm import pii, toxicity

CLASHING = ("size", "source_size", "target", "taken", "copies", "entities", "toxic_score", "row_no", "th", "tie", "row", "k", "words", "node")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, i, *(f"{c}{i}" for c in CLASHING)) for i, (d, t, s) in enumerate(rows)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    base = [prose(rng, n) for n in (1, 4, 12, 40, 60, 90, 120, 300)]
    item = prose(rng, 14)
    rows = [(i, t, f"s{i % 3}" if i else None) for i, t in enumerate(base)]
    rows += [(20, base[3], "s0"), (21, base[4] + " more", "s1"), (22, base[5].upper(), "s1"), (23, base[6] + " " + prose(rng, 100), "s1")]
    rows += [(30, prose(rng, 30) + " " + item + " " + prose(rng, 5), "s0"), (31, prose(rng, 30) + ". Mr. John Smith came. Smith left, mail j.s@x1.org", "s2")]
    rows += [(40 + i, prose(rng, 20) + ". vile dreadful insult. " + prose(rng, 8), "s2") for i in range(12)]
    rows += [(60 + i, prose(rng, 25) + ". mild kind words. " + prose(rng, 8), f"s{i % 3}") for i in range(40)]
    rows += [(None, base[3], "s0"), (None, base[3], "s0"), (None, None, None), (70, "", "s1"), (71, None, "s1"), (72, " \n ", None)]
    rows += [(1, base[1], "s1"), (2, prose(rng, 50), "s2"), (80, base[7], "s0"), (80, prose(rng, 33), "s0"), (81, "w " * 20_000, "s0")]
    d = str(tmp_path_factory.mktemp("sf"))
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    labels = [(d_, 1, int(40 <= d_ < 52)) for d_, *_ in rows if d_ is not None and 40 <= d_ < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def toxic_score(text, words, weights):
    """Noisy-or over sentences, from the definition."""
    still = 1.0
    for sentence in re.split(r"[.!?;\n]", (text or "").lower()):
        found = set(re.findall(r"[^\W\d_]+", sentence))
        if found:
            z = weights[-1] + sum(weights[words.index(w)] for w in found if w in words)
            still *= 1 - 1 / (1 + math.exp(-z))
    return 1 - still


def without_copies(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [r["doc_id"] for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and ids[i] is not None and ids[j] is not None and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least, kept = {}, []
    for i in range(len(rows)):
        if sets[i] and ids[i] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    seen = set()
    for i, r in enumerate(rows):
        if ids[i] is None or not sets[i]:
            kept.append(r)
        elif ids[i] == least[find(i)] and find(i) not in seen:
            seen.add(find(i))
            kept.append(r)
    return kept


def contaminated(text, item):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, x = word.findall(low(text)), word.findall(low(item))
    wins = {tuple(x[i : i + 10]) for i in range(len(x) - 9)}
    return any(tuple(w[i : i + 10]) in wins for i in range(len(w)))


def test_stages_equal_brute_force(spark, corpus):
    d, item = corpus
    table = spark.read.parquet(f"{d}/documents.parquet")
    words, weights = toxicity.fit(table, spark.read.parquet(f"{d}/labels.parquet"))
    assert {"vile", "dreadful", "insult"} & set(words)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mixing"]
    rows = table.collect()
    key = lambda rows: sorted(map(repr, rows))

    want = [r for r in rows if toxic_score(r["text"], words, weights) < 0.7]
    got = stages["toxicity"](spark, table, d)
    assert got.columns == table.columns and key(got.collect()) == key(want) and len(want) == len(rows) - 12
    rows, now = want, spark.createDataFrame(want, table.schema)

    want = without_copies(rows)
    got = stages["ngram_jaccard_join"](spark, now, d)
    # Which of several equal rows under one doc_id stays is free; doc_id and text are not.
    pairs = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    rows = got.collect()
    assert got.columns == table.columns and pairs(rows) == pairs(want)
    assert (2, "s2") in {(r["doc_id"], r["source"]) for r in rows} and sum(r["doc_id"] is None for r in rows) == 3
    now = spark.createDataFrame(rows, table.schema)

    want = [r for r in rows if not contaminated(r["text"], item)]
    got = stages["benchmark_decontamination"](spark, now, d)
    assert got.columns == table.columns and key(got.collect()) == key(want) and 30 not in {r["doc_id"] for r in want}
    rows, now = want, spark.createDataFrame(want, table.schema)

    secret = corpus_pipeline.surrogate_key(spark)
    got = stages["pii"](spark, now, d)
    new = {(r["n_chars"], r["text"]): r for r in got.collect()}
    assert got.columns == table.columns and len(new) == len(rows)
    for r in rows:
        t = pii.replaced(r["text"], secret)[0] if r["text"] else r["text"]
        assert new[(r["n_chars"], t)] == type(r)(**(r.asDict() | {"text": t}))
    assert not any("Smith" in (r["text"] or "") for r in new.values())
    rows, now = list(new.values()), got

    got = stages["mixing"](spark, now, d)
    assert got.columns == [*table.columns, "size_1", "source_size_1", "target_1", "taken_1", "copies_1"]
    many, old = {}, {r["n_chars"]: r for r in rows}
    for r in got.collect():
        many.setdefault(r["n_chars"], []).append(r)
    by = {}
    for i, rs in many.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", old[i]["text"]))
        for r in rs:
            assert tuple(r)[: len(table.columns)] == tuple(old[i])
            assert r["size_1"] == r["taken_1"] == n > 0 and r["copies_1"] == len(rs) <= 2
        by[old[i]["source"]] = by.get(old[i]["source"], 0) + n * len(rs)
    largest = max(len((r["text"] or "").split()) for r in rows)
    for rs in many.values():
        assert abs(by[rs[0]["source"]] - rs[0]["target_1"]) <= largest
    again = stages["mixing"](spark, now.repartition(7), d)
    assert key(again.collect()) == key(got.collect())


def test_run_gives_the_stages_in_turn(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert ids and not ids & {*range(40, 52), 20, 21, 22, 30}


def test_empty_table(spark, corpus, tmp_path):
    d = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").where(F.lit(False)).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0

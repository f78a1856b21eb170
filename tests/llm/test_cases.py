"""Expected values written by hand, exhaustive search, and repeated or missing ids."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logshield.llm import common, compression, language, licences, mixing, pii, toxicity
from logshield.llm.jaccard_join import jaccard_components, plan, spare

SCHEMA = "doc_id long, text string, lang string, source string, gap string, key string, size string, tie string, y string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "g", "k", "s", "t", "y") for r in rows], SCHEMA)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))


LICENCES = [
    ("SPDX-License-Identifier: MIT", "MIT", "permissive"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main;", "Apache-2.0", "permissive"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0", "copyleft"),
    ("/* SPDX-License-Identifier: MPL-2.0 */", "MPL-2.0", "copyleft"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1", "copyleft"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0", "copyleft"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", "copyleft"),
    ("This code is released under the BSD 2-Clause License.", "BSD-2-Clause", "permissive"),
    ("This code is released under the BSD 3-Clause License.", "BSD-3-Clause", "permissive"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", "permissive"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", "permissive"),
    ("This software is provided 'as-is', without any express or implied\nwarranty.", "Zlib", "permissive"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at x.", "EPL-2.0", "copyleft"),
    ("This work is licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0", "noncommercial"),
    ("Licensed under the MIT license. Licensed under the MIT license.", "MIT", "permissive"),
    ("Nothing here.", "", "none"), ("A licence of an odd kind.", "", "unknown"), ("", "", "none"), (None, "", "none"),
]


def test_licences_by_hand(spark):
    rows = [(i, t, None, None) for i, (t, *_) in enumerate(LICENCES)]
    rows += [(0, LICENCES[0][0], None, None), (None, LICENCES[1][0], None, None)]
    got = sorted((str(r["doc_id"]), r["licences"], r["class"]) for r in licences.licences(docs(spark, rows)).collect())
    want = [(str(i), a, b) for i, (_, a, b) in enumerate(LICENCES)]
    assert got == sorted([*want, ("0", *LICENCES[0][1:]), ("None", *LICENCES[1][1:])])


def best_path(scores, switch):
    return max(sum(s[k] for s, k in zip(scores, p, strict=True)) - switch * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(scores.shape[1]), repeat=len(scores)))


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    cases = [np.array([[0, 10, -11], [0, -11, 10.0]])] + [rng.normal(0, 6, (rng.integers(1, 7), 3)) for _ in range(60)]
    for s in cases:
        p = language.viterbi(s, 12.0)
        assert sum(x[k] for x, k in zip(s, p, strict=True)) - 12 * np.count_nonzero(np.diff(p)) == pytest.approx(best_path(s, 12.0))


def test_language_search_is_left_out_only_where_it_finds_the_same(spark):
    rng = np.random.default_rng(8)
    a, b = [prose(rng, 40, "abcde") for _ in range(30)], [prose(rng, 40, "cdefg") for _ in range(30)]
    rows = [(i, t, "aa", None) for i, t in enumerate(a)] + [(100 + i, t, "bb", None) for i, t in enumerate(b)]
    rows += [(200 + i, " ".join((prose(rng, n, "abcde"), prose(rng, n, "cdefg"), prose(rng, n, "abcde"))), None, None) for i, n in enumerate((1, 2, 3, 5, 8, 13))]
    rows += [(None, a[0], None, None), (5, b[0], None, None), (5, b[0], None, None), (300, None, "aa", None), (301, "12 ...", "bb", None), (302, "", None, None)]
    d = docs(spark, rows)
    langs, logp, allowed = language.fit(d)
    batch = d.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    fast = [r for x in language._labelled(batch, langs, logp, allowed, 12.0) for r in x.to_pylist()]
    full = [r for x in language._labelled(batch, langs, logp, allowed, 12.0, always=True) for r in x.to_pylist()]
    assert fast == full and len(fast) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in fast}
    assert by[300] == by[301] == by[302] == "und" and [r["lang_pred"] for r in fast if r["doc_id"] == 5] == ["aa", "bb", "bb"]
    assert language.languages(d).count() == len(rows) and language.languages(d.where(F.lit(False))).count() == 0


def test_language_bound_on_random_scores(monkeypatch):
    rng = np.random.default_rng(12)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [" ".join(["word"] * int(n)) for n in rng.integers(1, 9, 40)]})
    words = sum(len(t.split()) for t in batch.column(1).to_pylist())
    for scale in (1.0, 2.0, 4.0, 8.0):
        for _ in range(25):
            s = rng.normal(0, scale, (words, 3)) + np.array([scale, 0, 0])
            monkeypatch.setattr(language, "_word_scores", lambda *_, s=s: s)
            fast, full = (next(language._labelled([batch], ["t", "a", "b"], None, None, 12.0, always=x)).to_pylist() for x in (False, True))
            for x, y in zip(fast, full, strict=True):
                assert x == y, scale


def test_pii_later_mentions_and_forms_of_a_number():
    t = "Mr. John Smith came. Smith left. John ran. Smithson and Johns stay."
    new, found = pii.replaced(t, "k")
    first, last = pii.surrogate("name", "John", "k"), pii.surrogate("name", "Smith", "k")
    assert new == f"Mr. {first} {last} came. {last} left. {first} ran. Smithson and Johns stay." and len(found) == 3
    assert pii.replaced("Smith left.", "k")[0] == "Smith left."
    plain = lambda s: re.sub(r"\D", "", s)
    forms = ["+1 743 555 3824", "+17435553824", "743-555-3824", "(743) 555-3824", "+1 (743) 555-3824"]
    assert len({plain(pii.surrogate("phone", f, "k"))[-10:] for f in forms}) == 1
    assert plain(pii.surrogate("phone", "+44 20 7946 0958", "k")) == plain(pii.surrogate("phone", "+442079460958", "k"))


def test_pii_needs_a_key(spark):
    with pytest.raises(TypeError):
        pii.pseudonymised(docs(spark, []))


def test_mixture_deals_out_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = [(None, "a b c", None, "s0")] * 150 + [(7, "x y", None, "s1")] * 70 + [(i, prose(rng, int(rng.integers(1, 30))), None, f"s{i % 4}") for i in range(300)]
    rows += [(900, None, None, "s1"), (901, "", None, None), (902, "w " * 3000, None, None), (903, "solo", None, "s5")]
    got = mixing.mixture(docs(spark, rows))
    out = got.collect()
    assert len(out) == len(rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    by = {}
    for r in out:
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2], s[3] = s[2] + r["taken"], max(s[3], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(s[1] for s in by.values()) == pytest.approx(1.5 * total) or all(s[1] == 2 * s[0] for s in by.values())
    assert all(abs(s[2] - s[1]) <= s[3] for s in by.values())
    key = lambda rs: sorted(map(repr, rs))
    assert key(mixing.mixture(docs(spark, rows[::-1]).repartition(5)).collect()) == key(out)
    half = [r["copies"] for r in out if r["doc_id"] is None and r["size"] == 3]
    assert len(half) == 150 and abs(sum(half) / 150 - by["s0"][1] / by["s0"][0]) < 0.25


def water(sizes, weights, share, most):
    """Targets by pouring: the excess of full sources is reshared until none is above."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else per * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i in full] and [i for i in open_ if i not in full]
    return out


def test_targets_equal_pouring(spark):
    for sizes in ([10, 1000, 500, 3], [5, 5, 5], [0, 7, 100], [1, 1, 1000, 4000, 2]):
        rows = [(f"s{i}" if i < len(sizes) - 1 else None, n, 1) for i, n in enumerate(sizes)]
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long, docs long")).collect()
        by = {r["source"]: r["target"] for r in got}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
        assert [by[r[0]] for r in rows] == pytest.approx(want)


def test_classifiers_learn_the_same_from_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 40, "abcd") + ". vile insult. ok", None, None) for i in range(40)] + [(i, prose(rng, 40, "efgh") + ". mild words. ok", None, None) for i in range(40, 80)]
    rows += [(i, "another text of the same id", None, None) for i in range(0, 80, 5)] + [(None, "vile insult", None, None), (None, None, None, None), (90, "", None, None)]
    labels = spark.createDataFrame([(i, int(i >= 40), int(i < 40)) for i in range(80)] + [(3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d, e = docs(spark, rows), docs(spark, rows[::-1]).repartition(6)
    a, b = toxicity.fit(d, labels), toxicity.fit(e, labels)
    assert a == b
    assert compression.fit(d, labels, "quality", 4, 2) == compression.fit(e, labels, "quality", 4, 2)
    words, weights = a
    for r in toxicity.toxicity(d, labels).join(d.select("doc_id", F.col("text")), "doc_id").where("doc_id > 80 OR doc_id % 5 > 0").collect():
        still = 1.0
        for s in re.split(r"[.!?;\n]", r["text"].lower()):
            if found := set(re.findall(r"[^\W\d_]+", s)):
                still *= 1 - 1 / (1 + math.exp(-weights[-1] - sum(weights[words.index(w)] for w in found if w in words)))
        assert r["score"] == pytest.approx(1 - still)
    pairs, (slope, base) = compression.fit(d, labels, "quality", 4, 2)
    sizes = [compression._Sizes(*p) for p in pairs]
    got = compression.quality(d, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t, *_ in rows if i == r["doc_id"]]
        assert any(r["gap"] == pytest.approx(sum(z.gap(t) for z in sizes) / 2) for t in texts)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-slope * r["gap"] - base))) and r["predicted"] == int(r["score"] >= 0.7)


def test_jaccard_repeated_ids_and_sparse_sets(spark):
    rng = np.random.default_rng(9)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(4, a, None, None), (4, a, None, None), (9, a, None, None), (4, b, None, None), (2, b + " end", None, None), (None, a, None, None), (5, None, None, None), (6, " ", None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(docs(spark, rows)).collect())
    want = [("4", 28, "4"), ("4", 28, "4"), ("9", 28, "4"), ("4", 28, "2"), ("2", 29, "2"), ("None", 28, "None"), ("5", 0, "5"), ("6", 0, "6")]
    assert got == sorted(want)
    assert jaccard_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["E", "S", "N"])
def test_poor_sets_find_their_partners(spark, monkeypatch, kind):
    """With nothing to spare every set with an empty key is poor; all links are found all the same."""
    from logshield.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "spare", lambda *_: 0)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        w = prose(rng, int(rng.integers(8, 40)), "abcdefghijkl").split()
        v = list(w)
        v[len(v) // 2] = "changed"
        rows += [(2 * i, " ".join(w), None, None), (2 * i + 1, " ".join(v), None, None)]
    sets = {d: {tuple(t.split()[k : k + 1]) for k in range(len(t.split()))} for d, t, *_ in rows}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs(spark, rows), words=1, num=80, kinds=kind).collect()}
    for i in range(60):
        a, b = sets[2 * i], sets[2 * i + 1]
        assert (got[2 * i] == got[2 * i + 1]) == (100 * len(a & b) >= 80 * len(a | b))


def test_plan_has_units_for_the_largest_difference():
    first, groups = plan({5: 10, 40: 1000, 200: 5000, 900: 10}, 80, 100)
    for (a, b), (e, s, n, more) in zip(itertools.pairwise(first), groups[:-1], strict=True):
        most = (b - 1 + (b - 1) * 100 // 80) * 20 // 180
        assert not most or e + 2 * s + 2 * n - more == most + 1
        assert not most or more == spare(most + 1, a, "E" if not s and not n else "S" if s else "N")


def test_shared_folder_must_be_named_outside_one_process(spark, monkeypatch):
    class Other:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        common.shared_dir(Other)

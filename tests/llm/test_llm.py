"""Training-data operators against brute force, on hostile small tables."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logshield.llm import chat, compression, decontaminate, language, licences, mixing, pii, quality_rules, queries, toxicity
from logshield.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, keys string, size string, entities string"


def docs(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, None, "x", "y", "z", "e") for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(1)
    base = [prose(rng, n) for n in (1, 2, 3, 12, 25, 60, 400)]
    rows = []
    for b in base:
        w = b.split()
        rows += [b, b, b.upper()]
        for _ in range(6):
            v = list(w)
            for _ in range(rng.integers(1, 3)):
                v[rng.integers(len(v))] = "changed"
            rows.append(" ".join(v))
    rows += ["", " \n\t", None, "x" * 5000, "a b " * 3000]
    return [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(rows)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("kinds", ["ESN", "E", "S", "N"])
def test_jaccard_equals_brute_force(spark, corpus, kinds):
    sets = {}
    for d, t, *_ in corpus:
        w = low(t).encode().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {tuple(r) for r in jaccard_components(docs(spark, corpus), kinds=kinds).collect()}
    assert got == {(d, len(s), find(d)) for d, s in sets.items()}


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(6)
    base = prose(rng, 200).split()
    changed = lambda every: ["changed" if i % every == every // 2 else w for i, w in enumerate(base)]
    texts = [base, changed(50), base + prose(rng, 40).split(), changed(20), base + prose(rng, 80).split()]
    rows = [(i, " ".join(t), None, None) for i, t in enumerate(texts)]
    assert {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs(spark, rows), "").collect()} == {0, 3, 4}


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(7)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = c + " end"
    rows = [(3, a), (7, a), (7, b), (9, b), (9, b), (5, c), (5, near), (None, a), (11, ""), (11, "")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, docs(spark, [(d, t, None, None) for d, t in rows]), "").collect()]
    assert sorted(x for x in got if x[0] != 5 and x[0]) == [(3, a), (7, b), (11, "")]
    assert [d for d, _ in got].count(5) == 1 and (None, a) in got and len(got) == 5
    alone = [(1, a, None, None), (1, b, None, None)]
    assert corpus_pipeline.drop_copies(spark, docs(spark, alone), "").count() == 2


def test_copies_of_a_table_move_no_keys(spark):
    """A table in eight copies under other doc_ids shuffles little more than the table itself, and sets meet
    whatever copy stands for them."""
    rng = np.random.default_rng(8)
    base = [prose(rng, 400).split() for _ in range(60)]
    texts = [" ".join(w) for w in base] + [" ".join(["changed", *w[1:]]) for w in base[:20]]

    def run(copies):
        rows = [(d + 1000 * c, t, None, None) for c in range(copies) for d, t in enumerate(texts)]
        sc = spark.sparkContext._jsc.sc()
        stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList()))}
        sc.listenerBus().waitUntilEmpty()
        last = max(stages(), default=-1)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs(spark, rows).repartition(4)).collect()}
        sc.listenerBus().waitUntilEmpty()
        assert got == {d: d % 1000 - 60 * (d % 1000 >= 60) for d, *_ in rows}
        return sum(n for i, n in stages().items() if i > last) - 500 * len(rows)

    assert run(8) < 2 * run(1)
    rows = [(d + 1000 * c, t, None, None) for c in range(4) for d, t in enumerate(texts[:5])] + [(None, texts[0], None, None)]
    got = [r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs(spark, rows), "").collect()]
    assert sorted(got, key=str) == [0, 1, 2, 3, 4, None]


def test_decontamination_equals_brute_force(spark, corpus):
    long = next(t for _, t, *_ in corpus if t and len(t.split()) == 60)
    items = [(1, " ".join(long.split()[5:30])), (2, "tail, TAIL; tail"), (3, "solo"), (4, None), (5, "..."), (10, " ".join(long.split()[20:35]))]
    rows = [*corpus, (9001, "so SOLO tail tail tail end", None, None), (9001, "so SOLO tail tail tail end", None, None), (None, "solo", None, None)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for d, t, *_ in rows:
        w, hit, ids = word.findall(low(t)), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= of
        want.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_quality_counts_equal_brute_force(spark, corpus):
    rows = [*corpus, (7001, "l1 a\nl1 a\n\n\nl2 #x $\nl1 a", None, None)]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d, d).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])


def test_quality_target_is_all_labelled_documents(spark, tmp_path, monkeypatch):
    n = 20_050
    spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality_rules, "quality_rules", lambda docs, target: target)
    assert queries.op1_quality_rules(spark, str(tmp_path)).count() == n


def test_pii_keeps_format_and_distinctness():
    texts = ["mail a.b@x1.org or A.B@x1.org", "call +1 (743) 555-3824", "743-555-3824", "card 4111 1111 1111 1111", "at 10.1.2.3 and 8.8.8.8", 'key "' + "ab12" * 10 + '"', "Mr. John Smith and Mary Smith"]
    for t in texts:
        new, found = pii.replaced(t, "k")
        assert found and new != t and [x[2] for x in pii.entities(new)] == [x[2] for x in found]
        assert pii.replaced(t, "k")[0] == new != pii.replaced(t, "other")[0]
    made = {pii.surrogate("phone", f"+1 (222) 345-{i:04d}", "k") for i in range(3000)}
    assert len(made) == 3000
    assert pii.luhn(pii.surrogate("card", "4111111111111111", "k")) == 0
    assert pii.surrogate("ip", "10.1.2.3", "k").startswith("10.")
    for n in (2, 3, 7, 40, 100):
        x, seen = 0, set()
        for _ in range(n):
            x = pii.step(x, n, "k", "t")
            seen.add(x)
        assert len(seen) == n


def test_pii_leaves_nothing_in_clear():
    one = {
        "phone": ["+15551234567", "+4915112345678", "+1743 555-3824", "+1 (743) 555-3824", "+49 151 1234567", "+358401234567", "743-555-3824"], "email": ["a.b@x1.org"],
        "secret": ["sk-" + "abCDefGHij" * 2, "AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcDEF" * 6, "ab12" * 10], "iban": ["MU17 BOMM 0101 1010 3030 0200 000M UR", "BE68 5390 0754 7034", "DE89370400440532013000"],
        "ip": ["10.1.2.3", "8.8.8.8"], "card": ["4111 1111 1111 1111", "4111111111111111"], "ssn": ["078-05-1120"], "name": ["Mr. John Smith", "Mary Smith"],
    }
    for kind, texts in one.items():
        for t in texts:
            assert pii.surrogate(kind, t, "k") != t
            for around in ("it is {} then", "{}", "so: {} AND", "{} OK, and x.y@z.org"):
                new, found = pii.replaced(around.format(t), "k")
                at = around.index("{")
                assert (at, at + len(t), kind) in found and t not in new and len(found) == 1 + ("@" in around)
    for t, keeps in (("+15551234567", "+1"), ("+4915112345678", "+49"), ("+1743 555-3824", "+1"), ("+358401234567", "+358")):
        new = pii.surrogate("phone", t, "k")
        rest = len(keeps)
        assert new.startswith(keeps) and new[rest:] != t[rest:] and new[rest : rest + 3] != t[rest : rest + 3]
    assert len({pii.surrogate("phone", f"+1555{i:07d}", "k") for i in range(3000)}) == 3000


def test_pii_table(spark, corpus):
    rows = [*corpus, (1, "mail a@b.org", None, None)]
    got = pii.pseudonymised(docs(spark, rows), "k").collect()
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 1
    assert pii.pseudonymised(docs(spark, []), "k").count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    rows = [(1, mit, None, None), (2, "x\nLicensed under CC BY-NC 4.0.", None, None), (3, "Some odd licence here.", None, None), (4, None, None, None), (5, "", None, None)]
    got = {r["doc_id"]: (r["licences"], r["class"]) for r in licences.licences(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", "permissive"), 2: ("CC-BY-NC-4.0", "noncommercial"), 3: ("", "unknown"), 4: ("", "none"), 5: ("", "none")}


MIT_TEXT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer.

3. Neither the name of the
   Copyright Holder nor the names of its contributors may be used to endorse
   or promote products derived from this software without permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."""
GPL_TEXT = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{} either version {} of the License, or
# (at your option) any later version."""


def test_licences_in_standard_wording(spark):
    want = {
        MIT_TEXT: "MIT", BSD_TEXT: "BSD-3-Clause", APACHE_TEXT: "Apache-2.0", GPL_TEXT.format(":", ",", 3): "GPL-3.0-or-later", GPL_TEXT.format(";", ";", 2): "GPL-2.0-or-later",
        "// SPDX-License-Identifier: MIT\nimport os": "MIT", "/* SPDX-License-Identifier: Apache-2.0 */\nint x;": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0", "Marked CC0 1.0 Universal": "CC0-1.0",
        "A title\nLicensed under the MIT License\nContributions welcome": "MIT", "Note: Licensed under the MIT License.": "MIT", "# x***\nLicensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    rows = [(i, t, None, None) for i, t in enumerate(want)]
    got = {r["doc_id"]: r for r in licences.licences(docs(spark, rows)).collect()}
    assert [got[i]["licences"] for i, *_ in rows] == list(want.values())
    assert got[0]["sentence_ids"] == "copyright,mit-grant,mit-notice,mit-warranty,mit-liability" and got[0]["n_unknown"] == 0


def test_mixture_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(0, 40))), None, f"s{i % 4}" if i % 9 else None) for i in range(3000)]
    got = mixing.mixture(docs(spark, rows)).collect()
    assert len(got) == 3000 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["target"]] += r["taken"]
    assert all(abs(v - t) < 100 for t, v in taken.items())
    total = sum(r["size"] for r in got)
    assert abs(sum(taken) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs(spark, rows)).collect()))
    assert mixing.mixture(docs(spark, [])).count() == 0


def test_pipeline_mixes_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i if i % 7 else None, prose(rng, int(rng.integers(1, 30))), None, f"s{i % 3}") for i in range(300)]
    rows += [(1, rows[1][1], None, "s1"), (None, "same text", None, "s0"), (None, "same text", None, "s0"), (None, "same text", None, "s1")]
    d = docs(spark, rows)
    got = corpus_pipeline.mix_sources(spark, d, "").collect()
    assert all(r["copies"] > 0 for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 30 for s, t in target.items())
    again = corpus_pipeline.mix_sources(spark, d.orderBy(F.desc("text")).repartition(3), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pivot_keeps_expectations():
    rng, total = np.random.default_rng(3), np.zeros(40)
    size = np.r_[500, rng.integers(1, 30, 39)]
    for _ in range(1500):
        t = mixing._pivot(pa.table({"h": rng.integers(-(2**60), 2**60, 40), "size": size, "p": np.full(40, 0.4), "i": np.arange(40)}), 0, 0, True)
        total[t["i"].to_numpy()] += t["p"].to_numpy()
    assert np.abs(total / 1500 - 0.4).max() < 0.06


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\nb"), (1, 1, "assistant", None), (1, 2, "us\ner", "x"), (1, 3, "assistant", "<|im_start|>\\"), (1, 4, "user", "rest"), (2, 0, "system", "s"), (None, 0, None, "n")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(t)).collect()}
    for c in (1, 2, None):
        own = [r for r in rows if r[0] == c]
        read = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(read.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["n_examples"] == 2 and chat.examples(t.limit(0)).count() == 0


def labelled(spark, n, word):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        t = ". ".join(prose(rng, 8) for _ in range(4))
        rows.append((i, (t + f" {word} {word}. ok") if y else t, "en", "s"))
        labels.append((i, 1 - y, y))
    rows += [(n, None, None, None), (n + 1, "", None, None)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_the_sentence(spark):
    d, y = labelled(spark, 240, "vile")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, y).collect()}
    assert sum(got[i]["predicted"] != int(i % 4 == 0) for i in range(240)) <= 2
    assert all("vile" in [s for s in d.where(f"doc_id = {i}").first()["text"].split(". ")][got[i]["worst_sentence"]] for i in (0, 4))
    assert got[240]["score"] == 0.0 and toxicity.toxicity(d, y.limit(0)).where("score > 0.5").count() == 0


def test_quality_score_bounds(spark):
    d, y = labelled(spark, 160, "#### $$$$ %%%% " * 20)
    rows = compression.quality(d, y).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["predicted"] != int(r["doc_id"] % 4 != 0) for r in rows if r["doc_id"] < 160) <= 8


def test_languages_and_spans(spark):
    rows = [(i, "the cat of this house and that one " * 3, "en", None) for i in range(40)] + [(100 + i, "die katze und das haus mit der nicht " * 3, "de", None) for i in range(40)]
    rows += [(500, "the cat of this house and that one " * 4 + "die katze und das haus mit der nicht " * 6, None, None), (501, "123 !?", None, None), (502, None, None, None), (503, "–—", None, None)]
    got = {r["doc_id"]: r for r in language.languages(docs(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i < 100 else "de") for i, *_ in rows[:80])
    assert got[500]["lang_pred"] == "de" and [s["lang"] for s in got[500]["spans"]] == ["en", "de"]
    assert [got[i]["lang_pred"] for i in (501, 502, 503)] == ["und"] * 3


def test_languages_find_two_that_beat_the_best_one(monkeypatch):
    s = np.zeros((20, 3))
    s[:10, 1], s[10:, 1], s[:10, 2], s[10:, 2] = 0.08 * language.SWITCH, -1.0 * language.SWITCH, -1.0 * language.SWITCH, 0.08 * language.SWITCH
    monkeypatch.setattr(language, "_word_scores", lambda *_: s)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(["word"] * 20)]})
    got = next(language._labelled([batch], ["t", "a", "b"], None, None, language.SWITCH)).to_pylist()[0]
    assert [(x["first_word"], x["words"], x["lang"]) for x in got["spans"]] == [(0, 10, "a"), (10, 10, "b")] and got["score"] == 0.5


def test_empty_tables(spark):
    none = docs(spark, [])
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (quality_rules.quality_rules(none, none), toxicity.toxicity(none, y), compression.quality(none, y), language.languages(none), jaccard_components(none), licences.licences(none), decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string"))):
        assert got.where(F.lit(True)).count() == 0

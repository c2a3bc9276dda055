"""Operators on documents against brute force, and on odd tables."""

import collections
import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.llm import bwt, common, decontam, grouping, kernels, langid, licences, minhash, mixing, suffix_dedup


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- suffix dedup


def naive_repeats(texts, weights, least):
    count = collections.Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - least + 1):
            count[t[i : i + least]] += w
    return [[count[t[i : i + least]] >= 2 for i in range(len(t) - least + 1)] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=6), st.integers(2, 9), st.data())
def test_transform_finds_repeats(texts, least, data):
    texts = [t.encode() for t in texts]
    weights = [data.draw(st.sampled_from([1, 2])) for _ in texts]
    assert [x.tolist() for x in bwt.repeated(texts, weights, least)] == naive_repeats(texts, weights, least)


def naive_removal(texts, least=200):
    raw = [(t or "").encode() for t in texts]
    marks = naive_repeats(raw, [1] * len(raw), least)
    out = []
    for b, m in zip(raw, marks):
        gone = np.zeros(len(b), dtype=bool)
        for i in np.flatnonzero(m):
            gone[i : i + least] = True
        first, end = kernels.runs(gone)
        kept = b"".join(b[a:z] for a, z in zip([0, *end], [*first, len(b)]))
        out.append((len(b), int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2048, 1])
def test_removed_repeats(spark, crowd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    texts = [text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 80)) for _ in range(20)]
    texts += ["z" * 1000, "z" * 199, "z" * 200, texts[0], texts[0], None, "", shared[0][:-30] + "é" * 120, text(20) + "é" * 150 + text(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(suffix_dedup.removed_repeats(df, crowd=crowd, block=3000), "doc_id")
    assert [r[1:] for r in got] == naive_removal(texts)


def test_removal_on_odd_tables(spark, documents):
    out = suffix_dedup.removed_repeats(documents)
    want = naive_removal([r["text"] for r in documents.select("text").collect()])
    assert sorted(r[1:] for r in rows(out)) == sorted(want)
    cut = suffix_dedup.without_repeats(documents)
    assert cut.columns == documents.columns and cut.count() == documents.count()
    assert cut.where("text is null").count() == 2
    assert suffix_dedup.removed_repeats(documents.limit(0)).count() == 0
    with pytest.raises(ValueError, match="minimum"):
        suffix_dedup.removed_repeats(documents, least=10)


# --- near-duplicates


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def naive_components(docs, width, percent=80):
    sets = [shingle_set(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    named = {}
    for i, (d, _) in enumerate(docs):
        named[find(i)] = min([x for x in (named.get(find(i)), d) if x is not None], default=None)
    return [(d, len(sets[i]), named[find(i)]) for i, (d, _) in enumerate(docs)]


def near_family(n, seed, size=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = [t for s in range(4) for t in near_family(40, s)] + [f"Lone text {i} of words {i * 7}" for i in range(30)] + ["one", "ONE", "", None, "one two"] * 2
    docs = [(i * 3 % len(texts), t) for i, t in enumerate(texts)]
    got = rows(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=width), "doc_id")
    want = sorted(naive_components(docs, width))
    assert [r[:3] for r in got] == want
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_near_duplicates_on_odd_tables(spark, documents):
    out = minhash.near_duplicates(documents, width=2)
    assert out.count() == documents.count()
    got = {r[0]: r[1:] for r in rows(out) if r[0] is not None}
    assert got[2][1] == 1 and got[7][1] == 6 and got[3] == (0, 3, True) and got[5] == (0, 5, True)
    assert minhash.near_duplicates(documents.limit(0)).count() == 0


def test_texts_without_candidates_are_not_shuffled(spark, shuffled, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(200)]
    texts += [t + f" {i} end" for i, t in enumerate(texts[:4])] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = []
    moved = shuffled(lambda: got.extend(rows(minhash.near_duplicates(docs, width=2), "doc_id")))
    assert [r[2] for r in got] == [*range(200), 0, 1, 2, 3, 204, 205]
    assert moved < 0.4 * sum(len(t or "") for t in texts)


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_a_sieve_lets_partners_through(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE", most)
    all_ = spark.range(-5000, 5000).select(F.when(F.col("id") != 7, F.col("id")).alias("d"), F.concat(F.lit("k"), "id").alias("f"), F.lit("x").alias("bits"))
    for n in (0, 300):
        all_.where(f"d between 1 and {n} or d is null and {n} > 0").select("d", "f").write.parquet(str(tmp_path / f"{n}"))
        wanted = spark.read.parquet(str(tmp_path / f"{n}"))
        out = common.sieved(all_, wanted, "d", "f")
        assert out.columns == all_.columns
        got, want = [tuple(r)[:2] for r in out.collect()], {tuple(r) for r in wanted.collect()}
        assert len(want) == n and want <= set(got) and len(set(got)) == len(got)
        assert most == 64 or len(got) - n < 0.04 * 10_000


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate((a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)))
    sig = minhash.superminhash(np.concatenate((a, b, a[:3])), np.array([0, 400, 800, 803, 803]), 256)
    assert abs((sig[0] == sig[1]).mean() - 320 / 480) < 0.12
    assert (sig[2] != 0xFFFFFFFF).all() and (sig[3] == 0xFFFFFFFF).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (202, 201)]
    got = dict(rows(grouping.components(spark.createDataFrame(links, "u long, v long"))))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert grouping.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- mixing


def naive_mix(docs, weights=(5, 2, 1)):
    size = lambda t: len((t or "").encode().split())
    sums = collections.Counter()
    for _, t, s in docs:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sums.values())
    while free:
        level = budget / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sums[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: 2.0 * sums[s] for s in over}
        budget -= sum(2.0 * sums[s] for s in over)
        free -= over
    return sums, target


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "é", None, "a", "a"])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df)
    sums, target = naive_mix(docs)
    got = out.collect()
    assert len(got) == 400
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in sums)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_documents(df.repartition(7)).collect()), key=str)
    stream = mixing.mixed_stream(df).select("finish").collect()
    assert [r[0] for r in stream] == sorted(r[0] for r in stream)


def test_mix_on_odd_tables(spark, documents):
    out = mixing.mixed_documents(documents)
    assert out.count() == documents.count() and out.where("taken > 2 * size").count() == 0
    assert mixing.mixed_documents(documents.limit(0)).count() == 0
    assert {r[0] for r in rows(mixing.mixed_documents(documents.where("text is null")).select("taken"))} == {0}


# --- decontamination


def naive_align(item, text):
    best = None
    for a in range(len(text) + 1):
        d = list(range(len(item) + 1))
        for z in range(a, len(text) + 1):
            if z > a:
                new = [d[0] + 1]
                for i, w in enumerate(item, 1):
                    new.append(min(d[i - 1] + (w != text[z - 1]), d[i] + 1, new[-1] + 1))
                d = new
            best = d[-1] if best is None else min(best, d[-1])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_exact(item, text):
    d, a, z = decontam.align(np.array(item), np.array(text, dtype=np.int64))
    assert d == naive_align(item, text)
    assert naive_align(item, text[a:z]) == d


def test_contamination_recall_and_precision(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for i in range(20)]
    docs, truth = [], set()
    for n in range(160):
        i, item = items[n % 20]
        w = item.split()
        for _ in range(int(len(w) * 0.1) if n % 4 else 0):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz"], ["zz", w[k]]])
        docs.append((n, " ".join(rng.choices(vocabulary, k=30) + w + rng.choices(vocabulary, k=30)).upper()))
        truth.add((n, i))
    docs += [(1000 + n, " ".join(rng.choices(vocabulary, k=90))) for n in range(100)]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = rows(out)
    words, texts = dict(items), dict(docs)
    for d, i, first, n, edits in got:
        item = words[i].split()
        assert naive_align(item, texts[d].lower().split()[first : first + n]) == edits <= len(item) // 5
    found = {(r[0], r[1]) for r in got}
    assert len(found & truth) >= 0.95 * len(truth) and all((n, i) in found for n, i in truth if n % 4 == 0)


def test_contamination_equals_brute_force(spark):
    """Every passage within the tolerance, by alignment of all pairs."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 24)))) for i in range(12)] + [(12, " ".join(rng.choices(vocabulary, k=150)))]
    docs = []
    for n in range(60):
        w = items[n % 13][1].split()
        for _ in range(rng.randint(0, len(w) // 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz"], ["zz", w[k]]])
        docs.append((n, " ".join(rng.choices(vocabulary, k=rng.randint(0, 20)) + w + rng.choices(vocabulary, k=rng.randint(0, 20)))))
    want, exact = set(), set()
    for d, text in docs:
        for i, item in items:
            w = item.split()
            least = decontam.align(np.array([hash(x) for x in w]), np.array([hash(x) for x in text.split()]))[0]
            want |= {(d, i)} if least <= len(w) // 5 else set()
            exact |= {(d, i)} if f" {item} " in f" {text} " else set()
    got = {r[:2] for r in rows(decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))}
    assert got <= want and exact <= got and len(got) >= 0.97 * len(want) and len(want) > 40


@pytest.mark.parametrize("size", [1, 3, 64, 65, 120, 127, 128, 200, 300, 500])
def test_exact_passages_are_always_found(size):
    rng = random.Random(size)
    items = [" ".join(rng.choices([f"v{i}" for i in range(400)], k=size)) for _ in range(10)]
    docs = [f"before it {x} after it" for x in items]
    assert {(r[0], r[1], r[4]) for r in decontam.matches(docs, decontam.Items(list(range(10)), items))} >= {(i, i, 0) for i in range(10)}


@pytest.mark.parametrize("size", [8, 15, 40, 59, 100, 160, 300, 500])
def test_recall_at_the_tolerance(size):
    rng = random.Random(size)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=size)) for _ in range(20)]
    docs = []
    for n in range(200):
        w = items[n % 20].split()
        for _ in range(size // 5):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz"], ["zz", w[k]]])
        docs.append(" ".join(rng.choices(vocabulary, k=30) + w + rng.choices(vocabulary, k=30)))
    got = {r[:2] for r in decontam.matches(docs, decontam.Items(list(range(20)), items))}
    assert sum((n, n % 20) in got for n in range(200)) >= 0.96 * 200


def test_contamination_on_odd_tables(spark, documents):
    items = spark.createDataFrame([(1, "The cat sat on the mat, and looked at the dog for a while."), (2, None), (3, "..."), (4, "one"), (None, "one")], "item_id long, text string")
    assert sorted(r[:2] for r in rows(decontam.contaminated(documents, items))) == [(1, 1), (2, 1), (2, 1), (10, 4)]
    clean = decontam.without_contaminated(documents, items)
    assert clean.columns == documents.columns and clean.count() == documents.count() - 4
    assert decontam.contaminated(documents, items.limit(0)).count() == 0 and decontam.contaminated(documents.limit(0), items).count() == 0


# --- language


def test_language_model_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    hit = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double")), F.min("score"), F.max("score")).first()
    assert hit[0] > 0.97 and hit[1] < 0.02 and 0 <= hit[2] <= hit[3] <= 1
    assert out.select("doc_id").where("doc_id = 0").count() == int(zlib.crc32(b"0") % 3 == 1)


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxzaeiouy   ") for _ in range(rng.randint(60, 300))) for _ in range(100)]
    junk += ["Город стоит на берегу реки, и в нём живут люди, которые помнят", "Kaupunki sijaitsee joen rannalla ja siellä asuu ihmisiä jotka muistavat"]
    unseen = [r["text"] for r in docs.where("lang = 'fr'").limit(100).collect() if r["text"]]
    stray = docs.where("doc_id < 12 and lang <> 'fr'").withColumn("lang", F.when(F.col("lang") == "en", "de").otherwise("en"))
    model = langid.train(docs.where("lang <> 'fr' and doc_id >= 12").unionByName(stray))
    for texts, least in ((junk, 0.95), (unseen, 0.9)):
        out = langid.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
        assert out.where("rejected").count() >= least * len(texts)
    clean = langid.classify(docs.where("lang <> 'fr' and doc_id >= 12"), model)
    assert clean.where("rejected").count() <= 0.01 * clean.count()


def test_all_languages_are_learned(spark):
    data = [(i, f"w{chr(97 + i % 70 % 26)}{chr(97 + i % 70 // 26)} q{chr(97 + i % 70 % 26)}z", f"l{i % 70}") for i in range(140)]
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70


def test_language_on_odd_tables(spark, documents):
    out = langid.predict_languages(documents)
    assert out.count() == documents.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (3, 4, 5, 9))
    assert got[8]["lang_pred"] in ("en", "fr")
    assert langid.predict_languages(documents.limit(0)).count() == 0
    none = langid.predict_languages(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


# --- licences


def test_licences(spark, documents):
    text = ["Hello. Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None]
    text.append("\n".join(s for i, s in licences.SENTENCES if i in ("bsd-grant", "bsd-source", "bsd-binary")))
    text.append("\n".join(s for i, s in reversed(licences.SENTENCES) if i in ("bsd-grant", "bsd-source", "bsd-binary")))
    got = rows(licences.scan_licences(spark.createDataFrame(list(enumerate(text)), "doc_id int, text string")).select("licences"), "doc_id")
    assert [r[0] for r in got] == [["MIT"], ["GPL-3.0", "Proprietary"], [], [], ["BSD-2-Clause"], []]
    plan = licences.scan_licences(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert licences.scan_licences(documents).count() == documents.count() and licences.scan_licences(documents.limit(0)).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.
"""
GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
CANONICAL = [
    (BSD, ["BSD-3-Clause", "BSD-2-Clause"]),
    ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT, ["MIT"]),
    (GNU.format("program", ":", "", ",", "3"), ["GPL-3.0"]),
    (GNU.format("program", ";", "", ";", "2"), ["GPL-2.0"]),
    (GNU.format("library", ";", "Lesser ", ";", "2.1"), ["LGPL-2.1"]),
    (GNU.format("program", ":", "Affero ", ",", "3"), ["AGPL-3.0"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007", ["GPL-3.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM", ["EPL-2.0"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", ["Unlicense"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0', ["Apache-2.0"]),
]


@pytest.mark.parametrize("width", [None, 40, 72])
@pytest.mark.parametrize("mark", ["", " * "])
def test_unmodified_licences(spark, width, mark):
    wrap = lambda t: "\n".join(mark + x for p in t.split("\n") for x in (textwrap.wrap(p, width) if width and len(p) > width else [p]))
    df = spark.createDataFrame([(i, wrap(t)) for i, (t, _) in enumerate(CANONICAL)], "doc_id int, text string")
    assert [r[0] for r in rows(licences.scan_licences(df).select("doc_id", "licences"), "doc_id")] == list(range(len(CANONICAL)))
    assert [r[1] for r in rows(licences.scan_licences(df).select("doc_id", "licences"), "doc_id")] == [w for _, w in CANONICAL]


# --- many rows without id, and rows that repeat


def test_rows_without_id_are_told_apart(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices([f"q{i}" for i in range(300)], k=80)) for _ in range(30)]
    texts = base + [b + " more" for b in base[:20]] + base[:10] + ["", None, " "]
    docs = spark.createDataFrame([(None, t, "en") for t in texts] + [(5, base[0], "en"), (5, base[1], "en")], "doc_id long, text string, lang string")
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = [r["text"] for r in left.collect()]
    assert len(got) == 30 + 3 and {(t or "").removesuffix(" more") for t in got} == {*base, "", " "}
    assert sum(r["doc_id"] == 5 for r in left.collect()) == 2  # a row with id names its group
    long = "".join(rng.choices("abcdefgh ", k=400))
    docs = spark.createDataFrame([(None, f"{i} " + base[i] + (long if i % 2 else "")) for i in range(30)], "doc_id long, text string")
    gone = sorted(r["n_removed"] for r in suffix_dedup.removed_repeats(docs).collect())
    assert gone[:15] == [0] * 15 and all(400 <= n < 405 for n in gone[15:])  # a letter or two before the passage can be alike


def test_a_row_that_repeats_is_learned_from_once(spark):
    data = [(1, "the cat and the dog", "en")] * 200 + [(i, f"le chat et le chien numéro {i}", "fr") for i in range(2, 40)] + [(i, f"the house and the tree number {i}", "en") for i in range(40, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    texts, labels = langid.training_rows(docs, F.lit(True), per_language=20)
    assert labels.count("en") == 20 and labels.count("fr") == 20 and len(set(texts)) == 40

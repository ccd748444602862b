import re

import pytest

from lakeloom.llm import licences


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose."),
        (2, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "The license was hung on the wall and nobody read it again."),
        (5, "Licensed under the Wombat Burrow License, whatever that may say."),
        (6, None),
        (7, ""),
        (8, "word " * 20000 + "\nReleased under the MIT License."),
        (None, "Released under the MIT License."),
        (9, "Copyright law is taught on Mondays.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (9, "plain"),
    ]
    noise = [(100 + i, f"nothing to see in line {i}\nand the next one either {i * i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + noise], "doc_id long, text string, family string").repartition(3)
    return licences.by_document(docs).collect(), licences.scan(docs).collect(), docs


def test_families(found):
    got = {}
    for r in found[0]:
        got.setdefault(r.doc_id, []).append(r.licences)
    want = {1: "MIT", 2: "Apache-2.0,GPL-3.0", 3: "CC-BY-NC", 4: "", 5: "", 6: "", 7: "", 8: "MIT", None: "MIT"}
    assert {k: v[0] for k, v in got.items() if k in want} == want
    assert sorted(got[9]) == ["", "MIT"] and len(found[0]) == 311
    assert all(not v[0] for k, v in got.items() if k and k >= 100)


def test_overlap_equals_a_plain_loop(found):
    import re

    for r in found[1]:
        if r.paragraph is None or r.family == licences.UNKNOWN:
            continue
        words = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", r.paragraph.lower())
        held = set(zip(words[:-1], words[1:]))
        best = max(len({*zip(t.split()[:-1], t.split()[1:])} & held) / len({*zip(t.split()[:-1], t.split()[1:])}) for f, t in licences.TEMPLATES if f == r.family)
        assert r.overlap == pytest.approx(best) and r.confirmed == (best >= licences.OVERLAP)


def test_held_out_accuracy(spark, found):
    model = licences.train(found[2])
    cases = [(t.replace("licensed", "hereby licensed").replace("released", "now released") + " by its makers", f) for f, t in licences.TEMPLATES if "licensed" in t or "released" in t]
    got = model.score(spark.createDataFrame(cases, "text string, want string")).collect()
    assert sum(r.family == r.want for r in got) >= 0.85 * len(got)


def test_empty(found):
    assert licences.by_document(found[2].limit(0)).count() == 0


def licences_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licences.by_document(docs).orderBy("doc_id").collect()]


def test_short_notices(spark):
    texts = ["All rights reserved.", "Copyright 2021 The Authors. All rights reserved.", "All rights of way end here."]
    assert licences_of(spark, texts) == ["Proprietary", "Proprietary", ""]


def test_notices_without_the_word_licence(spark):
    texts = ["This Source Code Form is subject to the terms of the Mozilla Public", "Available under CC BY 4.0.", "Text is available under CC BY-SA 4.0", "Released under the BSD terms."]
    for t in texts:
        words = [w.strip(".") for w in t.lower().split()]
        best = max(len({*zip(x.split(), x.split()[1:])} & {*zip(words, words[1:])}) / len({*zip(x.split(), x.split()[1:])}) for _, x in licences.TEMPLATES)
        marked = bool(re.search(licences.MARKS, t.lower()))
        assert marked or best < licences.OVERLAP


def test_no_template_reaches_the_overlap_without_a_mark():
    for _, t in licences.TEMPLATES:
        pairs = {*zip(t.split(), t.split()[1:])}
        assert sum(not re.search(licences.MARKS, " ".join(p)) for p in pairs) < licences.OVERLAP * len(pairs)


def test_wrapped_notices_and_several_families(spark):
    texts = [
        "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted",
        "Released under the MIT License or licensed under the Apache License, Version 2.0.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the\n\nMIT License.",
        "Available under CC BY 4.0.",
        "Released under the BSD terms.",
    ]
    assert licences_of(spark, texts) == ["ISC", "Apache-2.0,MIT", "LGPL", "GPL-2.0", "", "CC-BY", "BSD"]


def test_probabilities_equal_a_plain_softmax(spark, found):
    """The model's own weights, applied by loops to a text's words and pairs."""
    import math

    from pyspark.ml.feature import HashingTF

    model = licences.train(found[2])
    tf = HashingTF(inputCol="g", outputCol="f", numFeatures=licences.FEATURES, binary=True)
    texts = ["Released under the MIT License.", "a fishing licence of no kind", "Licensed under CC BY 4.0", ""]
    got = {r.text: r for r in model.score(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    for t in texts:
        words = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
        hits = {tf.indexOf(g) for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]}
        raw = [(sum(weights[k][j] for j in hits) + bias[k]) / model.temperature for k in range(len(model.families))]
        p = [math.exp(x - max(raw)) for x in raw]
        p = [x / sum(p) for x in p]
        assert got[t].probabilities == pytest.approx(p, abs=1e-9)
        best = max(range(len(p)), key=lambda k: p[k])
        assert got[t].probability == pytest.approx(p[best]) and got[t].family == (model.families[best] if p[best] >= licences.CERTAIN else licences.UNKNOWN)


def test_long_lines_and_far_marks(spark):
    far = "prose of no matter here.\n" * 400
    texts = [far + "Released under the MIT License.\n" + far, "word " * 5000 + "released under the mit license " + "word " * 5000, "Released under the\n" + far + "MIT License."]
    assert licences_of(spark, texts) == ["MIT", "MIT", ""]


def test_all_words_reach_the_classifier(spark):
    """Marked or not, near a mark or far; and three neighbouring pieces without a mark always stand in one part."""
    prose = "\n".join(f"word{i} stands here" for i in range(40))
    texts = [prose, "alone", f"{prose}\n\nReleased under the MIT License.\n\nafter it\n{prose}", "a1 b1. c1 d1; e1\n--\nf1 " + "g1 h1 " * 60, None, "", "\u00e9 \u4e2d ..."]
    got = licences.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    parts = {i: [r.paragraph for r in got if r.doc_id == i] for i in range(len(texts))}
    for i, t in enumerate(texts[:4]):
        assert set(t.lower().split()) - {"--"} == {w for p in parts[i] for w in p.lower().split()} - {"--"}
    assert parts[4] == parts[5] == parts[6] == [None]
    for k in range(38):
        assert any(f"word{k} " in p and f"word{k + 2} " in p for p in parts[0])
    assert [r.paragraph for r in got if r.marked] == ["Released under the MIT License."]
    assert all(len(set(ix)) == len(ix) for ix in ([r["index"] for r in got if r.doc_id == i] for i in range(4)))


def test_the_classifiers_verdict_reaches_the_result(spark, monkeypatch):
    """What it finds without a template, in parts with and without a mark; and nothing of it if it knows nothing."""
    from pyspark.sql import functions as F

    score = licences.Classifier.score

    def told(self, df):
        """The classifier's own verdicts, but for one word that is ISC to it."""
        out = score(self, df)
        isc = F.lower("text").contains("zebra")
        return out.withColumn("family", F.when(isc, "ISC").otherwise(licences.UNKNOWN)).withColumn("probability", F.when(isc, 0.9).otherwise(F.col("probability")))

    texts = ["the zebra ran", "Released under the MIT License.\n\n" + "prose of no matter here.\n" * 9 + "a zebra", "a license of the zebra", "Released under the MIT License.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(licences.Classifier, "score", told)
    got = [(r.licences, r.suspected, r.n_marked, r.n_suspected) for r in licences.by_document(docs).orderBy("doc_id").collect()]
    assert got == [("", "ISC", 0, 1), ("MIT", "ISC", 1, 1), ("", "ISC", 1, 1), ("MIT", "", 1, 0), ("", "", 0, 0)]


def test_reading_all_text_stays_cheap(spark, found):
    """What a check had found too slow: weights lie by feature, grams are in no row; and lines are cut where plain counting cuts them."""
    import random

    model = licences.train(found[2])
    assert not model.model._java_obj.coefficientMatrix().isTransposed()
    scored = model.score(spark.createDataFrame([("Released under the MIT License.",)], "text string"))
    assert "grams" not in scored.columns
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b1.", "é", "K", " ", " ", "\t", "\r", "\f", "\n", "x; "]) + rng.choice(["", " "]) for _ in range(900)) for _ in range(60)]
    cuts = {(i, p) for i, t in enumerate(texts) for p in _pieces(t)}
    got = {(r.doc_id, p) for r in licences.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for p in r.paragraph.split("\n")}
    assert {c for c in cuts if "a" in c[1]} == {c for c in got if "a" in c[1]}


def test_templates_are_held_only_against_rows_in_which_something_is(spark, found, monkeypatch):
    """What a check had found too slow: the templates' turn comes after rows are left out, the classifier runs once and its shares are
    compiled; and nothing but plain rows is left out."""
    model = licences.train(found[2])
    monkeypatch.setattr(licences, "train", lambda docs: model)
    short = licences.scan(found[2], plain=False)
    plan = short._jdf.queryExecution().optimizedPlan().toString().split("\n")  # the last step first
    templates = [i for i, x in enumerate(plan) if "array_intersect" in x]
    classifier = [i for i, x in enumerate(plan) if re.search(r"\bUDF\(", x)]
    left_out = [i for i, x in enumerate(plan) if "Generate explode" in x]
    assert any(max(templates) < i < min(classifier) for i in left_out)
    assert len(classifier) == 1
    assert not any("EXP(" in x.upper() and "lambdafunction" in x for x in plan)
    row = lambda r: tuple(r)[1:]
    every = [r for r in licences.scan(found[2]).collect() if r["index"] is None or r.marked or r["index"] == 0 or r.family != licences.UNKNOWN]
    assert sorted(map(repr, map(row, short.collect()))) == sorted(map(repr, map(row, every)))


def test_training_sends_the_driver_one_set_of_sums_a_round(found, monkeypatch):
    """What a check had found too large for the driver: four of them, each as large as the model."""
    fit, parts = licences.LogisticRegression.fit, []
    monkeypatch.setattr(licences.LogisticRegression, "fit", lambda self, df: parts.append(df._jdf.rdd().getNumPartitions()) or fit(self, df))
    licences.train(found[2])
    assert parts == [1]


def _pieces(text):
    """Lines, cut after sentences and then after PIECE words with a blank behind each."""
    out = []
    for line in re.sub(r"(?<=[.!?;])[ \t]+", "\n", text).split("\n"):
        words, piece = 0, ""
        for token in re.findall(r"[^ \t\r\f\v]+[ \t]+|[^ \t\r\f\v]+|[ \t]+|[\r\f\v]", line):
            piece += token
            words = words + 1 if re.fullmatch(r"[^ \t\r\f\v]+[ \t]+", token) else words if token.isspace() and token.strip(" \t") == "" else 0
            if words == licences.PIECE:
                out, words, piece = [*out, piece], 0, ""
        out.append(piece)
    return out

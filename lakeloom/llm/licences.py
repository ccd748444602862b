"""Licence scans by a trained paragraph classifier, in DataFrame and SQL functions (and Spark's own learner on the JVM) only.

A paragraph is what stands between blank lines, or lines with neither letters nor digits; comment marks are no words. It is looked
at in pieces (lines, cut after sentences and after PIECE words): those with a marking word and NEAR pieces to both sides are joined,
so that wrapped notices are whole, and the rest in overlapping windows of as many pieces. All of these, that is all words of all
texts, go to the classifier: each becomes the set of its hashed words and word pairs; a multinomial logistic regression tells licence
families and `unknown` apart. It is trained on notices made from the templates below, with words dropped and other text around them,
against such parts of the corpus as are far from every template (a bounded sample, NEGATIVES) and sentences that only speak of
licences, four folds of five. Probabilities are calibrated by the temperature that fits the fifth fold best; a part whose best family
stays below CERTAIN is unknown.

A family that the classifier finds is `suspected` unless templates confirm it or explain it by another one. Every family is confirmed
of which a template has enough word pairs in the paragraph, whichever the classifier puts first, unless
another family's template explains all of these and more, as version 3 does for version 2; where two explain the same, the
likelier is taken.

To be confirmed, a notice must share OVERLAP of some template's word pairs. MARKS are words of the templates, so many that what
is left of any template without them is too little for that; a text without any of them could not be confirmed (a test tries
all), so only the others are held against templates, or what the classifier finds. No document is left out, and texts are read whole.

Null or empty text, or one without words: no notice, no licence. Very long texts: read whole, in pieces. Null ids: as any id. Repeated rows: each for itself.
Empty table: no rows. Other columns: not read, whatever their names.
"""

from __future__ import annotations

import functools
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_driver

UNKNOWN = "unknown"
#: Texts of the corpus, and parts of them, that training takes as examples of no licence, at most.
NEGATIVES = 2000
FEATURES, CERTAIN, OVERLAP = 1 << 15, 0.5, 0.6
#: What parts paragraphs, and pairs that a template which has them must find, as the rest of it stands in others' notices, too.
BLANK = r"\n[^\p{L}\p{N}]*\n"
#: Words in a piece of a line at most, and pieces beside a marked one that belong to its notice.
PIECE, NEAR = 48, 2
NAMING = frozenset(("gnu general", "lesser general", "affero general", "mozilla public", "apache license", "commons attribution", "commons attribution-sharealike", "commons attribution-noncommercial"))
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

#: Usual notices of each family.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "spdx-license-identifier mit"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "released under the apache license version 2.0"),
    ("Apache-2.0", "spdx-license-identifier apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "released under the gnu general public license version 3"),
    ("GPL-3.0", "spdx-license-identifier gpl-3.0"),
    ("GPL-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license version 3 of the license"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-2.0", "released under the gnu general public license version 2"),
    ("GPL-2.0", "spdx-license-identifier gpl-2.0"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("LGPL", "spdx-license-identifier lgpl-2.1"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("AGPL-3.0", "spdx-license-identifier agpl-3.0"),
    ("BSD", "released under the bsd license"),
    ("BSD", "licensed under the bsd 3-clause license"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("MPL-2.0", "licensed under the mozilla public license version 2.0"),
    ("ISC", "licensed under the isc license"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC0", "licensed under cc0 1.0 universal public domain dedication"),
    ("CC-BY", "licensed under cc by 4.0"),
    ("CC-BY", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA", "licensed under cc by-sa 4.0"),
    ("CC-BY-SA", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CC-BY-NC", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC-BY-ND", "licensed under cc by-nd 4.0"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "copyright all rights reserved"),
    ("Proprietary", "copyright all rights reserved no part of this publication may be reproduced"),
    ("Proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited"),
)
#: Each template's word pairs.
PAIRS = tuple((family, sorted({f"{a} {b}" for a, b in zip(t.split(" ")[:-1], t.split(" ")[1:], strict=True)})) for family, t in TEMPLATES)
#: Words that are too usual to mark a paragraph while others do.
USUAL = frozenset("the of to and is a this in or by for with it at not you under may be no from any person use file code work form that as an on version terms public source part free software into hereby fee copy general".split())


def _marks() -> list[str]:
    """Words such that any template's pairs without them are fewer than OVERLAP of its pairs."""
    marks: set[str] = set()
    for _, t in TEMPLATES:
        w = t.split(" ")
        own = set(zip(w[:-1], w[1:], strict=True))
        while len(left := [p for p in own if not marks & {*p}]) >= OVERLAP * len(own) - 1e-9:
            marks.add(max(sorted({x for p in left for x in p}), key=lambda x: (x not in USUAL, sum(x in p for p in left), len(x))))
    return sorted(marks)


_MARKING = _marks()
#: A marking word that stands alone; the class before the words spares most positions of a text the whole list.
MARKS = rf"(?<![a-z0-9])[{''.join(sorted({m[0] for m in _MARKING}))}](?:(?<=" + ")|(?<=".join(f"{c})(?:{'|'.join(re.escape(m[1:]) for m in _MARKING if m[0] == c)}" for c in sorted({m[0] for m in _MARKING})) + "))(?![a-z0-9])"

#: Sentences with marking words that grant nothing.
OTHERS = (
    "the driver was asked for a license at the border",
    "a fishing license costs twenty euros a year",
    "poetic license allows a writer to bend the rules",
    "the court ruled on copyright in three cases this spring",
    "permission to enter the hall was refused",
    "the warranty of the car ends after two years",
    "they redistribute the food among the villages",
    "the licensed electrician came on monday",
    "version 3 of the plan was released under pressure",
    "the general public was invited to the museum",
    "she works at mit and studies the apache language",
    "the beach is in the public domain of the city",
    "his license plate was stolen in version 2 of the story",
    "a license to kill is the title of the film",
)


#: What becomes a word's letter or digit in lower case; two letters beyond ASCII do.
WORDED = "[a-zA-Z0-9\u0130\u212a]"


def grams(text: Column) -> Column:
    """Lower-case words and pairs of neighbouring words, which have a blank in them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"), F.lit(0))

    def paired(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))  # concat_ws takes half as long again

    return _let(words, paired)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, index, paragraph, marked): all of each document that has words, in parts that may be a notice each, or one row
    with nulls."""
    # words are counted from a line's begin or the last cut only, not again from each of them
    text = F.regexp_replace(F.regexp_replace("text", r"([.!?;])[ \t]++", "$1\n"), rf"((?:\G|[\n\x0B\f\r])[ \t]*+(?:\S++[ \t]++){{{PIECE}}})", "$1\n")

    def runs(pieces: Column, kept) -> Column:
        """The kept pieces; the others become blank, and blank lines part notices."""
        return F.split(F.array_join(F.transform(pieces, lambda x, i: F.when(kept(i), x).otherwise("")), "\n"), BLANK)

    def windows(run: Column) -> Column:
        """2 * NEAR + 1 pieces each, of which NEAR are in the next one, too: NEAR + 1 neighbours always stand in one of them."""
        starts = lambda p: F.sequence(F.lit(1), F.greatest(F.size(p) - NEAR, F.lit(1)), F.lit(NEAR + 1))
        return _let(F.split(run, "\n"), lambda p: F.transform(starts(p), lambda i: F.array_join(F.slice(p, i, 2 * NEAR + 1), "\n")))

    def unmarked(parts: Column) -> Column:
        return F.transform(F.flatten(F.transform(parts, windows)), lambda x: F.struct(x.alias("paragraph"), F.lit(False).alias("marked")))

    def parted(pieces: Column, flags: Column) -> Column:
        near = lambda i: F.array_contains(F.slice(flags, F.greatest(i + 1 - NEAR, F.lit(1)), F.least(i, F.lit(NEAR)) + NEAR + 1), True)
        beside = F.transform(runs(pieces, near), lambda x: F.struct(x.alias("paragraph"), F.lower(x).rlike(MARKS).alias("marked")))
        return F.concat(beside, unmarked(runs(pieces, lambda i: ~near(i))))

    parts = _let(F.split(text, "\n"), lambda p: _let(F.transform(p, lambda x: F.lower(x).rlike(MARKS)), lambda f: parted(p, f)))
    parts = F.when(F.lower("text").rlike(MARKS), parts).otherwise(unmarked(F.split(text, BLANK)))
    worded = F.filter(parts, lambda x: x["paragraph"].rlike(WORDED))
    # numbered first: in one select the number would be taken after the explode
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), worded.alias("parts"))
    return numbered.select("row", "doc_id", F.posexplode_outer("parts").alias("index", "x")).select("row", "doc_id", "index", "x.paragraph", "x.marked")


def examples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(text, family): templates with other text around them and with words dropped, and what is no licence."""
    templates = spark.createDataFrame(TEMPLATES, "family string, text string")
    # of different texts with the lowest hashes, copies once, what the classifier will be asked about
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where("text is not null")
    last = texts.select("h").distinct().orderBy("h").limit(NEGATIVES).agg(F.max("h")).first()[0]
    plain = paragraphs(texts.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"])).select(F.col("paragraph").alias("p")).where(F.length("p") > 10).distinct()
    noise = plain.orderBy(F.xxhash64("p"), "p").limit(NEGATIVES).select("p", grams(F.col("p")).alias("grams"))
    shares = [F.size(F.array_intersect("grams", F.lit(ps))) / len(ps) for _, ps in PAIRS]
    other = noise.where(F.greatest(*shares) < OVERLAP / 2).select(F.col("p").alias("text"), F.lit(UNKNOWN).alias("family"))
    talk = spark.createDataFrame([(t,) for t in OTHERS], "text string")
    words = F.split("text", " ")
    around = [
        F.col("text"),
        F.concat(F.col("text"), F.lit(".")),
        F.concat(F.lit("this file is part of a project and is "), F.col("text"), F.lit(" see the notice")),
        F.concat(F.lit("copyright 2020 the authors "), F.col("text")),
        F.concat(F.col("text"), F.lit(" terms apply to all users of the text")),
        F.array_join(F.slice(words, 2, 100), " "),
        F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "),
        F.array_join(F.filter(words, lambda w, i: i != 1), " "),
    ]
    made = templates.select("family", F.explode(F.array(*around)).alias("text")).select("text", "family")
    spoken = talk.select(F.explode(F.array(F.col("text"), F.concat(F.col("text"), F.lit(" and so on")), F.concat(F.lit("then "), F.col("text")))).alias("text"), F.lit(UNKNOWN).alias("family"))
    return made.unionByName(spoken).unionByName(other).where(F.length("text") > 0)


def _counts(df: DataFrame) -> DataFrame:
    """df (text, ...) with the hashed set of its grams, which are read only here and so not stored in rows."""
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df.withColumn("grams", grams(F.col("text")))).drop("grams")


class Classifier:
    """A trained model, its families in order and its temperature."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], temperature: float) -> None:
        self.model, self.families, self.temperature = model, families, temperature

    def score(self, df: DataFrame) -> DataFrame:
        """df (text, ...) with family and probability; unknown where no family is certain."""
        raw = self.model.transform(_counts(df)).withColumn("raw", vector_to_array("rawPrediction"))
        raw = raw.drop("rawPrediction", "probability", "prediction", "features")
        n = len(self.families)
        out = _softmax(raw, n, self.temperature, "probabilities").drop("raw").withColumn("probability", F.array_max("probabilities"))
        last = n + 1 - F.array_position(F.reverse("probabilities"), F.col("probability"))  # of equal ones
        name = F.element_at(F.lit(self.families), last.cast("int"))
        return out.withColumn("family", F.when(F.col("probability") >= CERTAIN, name).otherwise(UNKNOWN))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: what stands in a lambda would be computed for each element. A fold hands values on as
    they are, where F.transform would copy every text in them."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, body)


def _softmax(df: DataFrame, n: int, temperature: float, out: str) -> DataFrame:
    """df with the shares of its n values `raw`, written out one by one and in steps, each of which Spark compiles and computes once:
    lambdas are interpreted."""
    each = lambda c: [F.get(c, F.lit(i)) for i in range(n)]
    df = df.withColumn("most", F.array_max("raw"))
    df = df.withColumn(out, F.array(*[F.exp((x - F.col("most")) / temperature) for x in each("raw")]))
    df = df.withColumn("total", functools.reduce(lambda a, x: a + x, each(out), F.lit(0.0)))
    return df.withColumn(out, F.array(*[x / F.col("total") for x in each(out)])).drop("most", "total")


def _by_feature(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The same model with each feature's weights side by side, as a text's few features are looked up for all families."""
    java = model._java_obj
    made = getattr(SparkSession.active()._jvm, java.getClass().getName())
    return LogisticRegressionModel(made(java.uid(), java.coefficientMatrix().toDenseColMajor(), java.interceptVector(), java.numClasses(), True))


def train(docs: DataFrame) -> Classifier:
    spark = docs.sparkSession
    families = sorted({f for f, _ in TEMPLATES} | {UNKNOWN})
    number = F.array_position(F.lit(families), F.col("family")) - 1
    # the features are made in several tasks, but one learns from the few rows: in each round every task of the learner sends the driver
    # sums as large as the model
    rows = _counts(examples(spark, docs)).withColumn("label", number.cast("double")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5))).select("features", "label", "fold").repartition(1).cache()
    learner = LogisticRegression(maxIter=40, regParam=1e-4, family="multinomial")
    rows.count()
    release_driver(spark)  # the learner keeps some 40 vectors as large as the model there; what others left would add up with them
    model = _by_feature(learner.fit(rows.where("fold < 4")))
    release_driver(spark)
    raw = model.transform(rows.where("fold = 4")).withColumn("raw", vector_to_array("rawPrediction"))
    for i, t in enumerate(TEMPERATURES):
        raw = _softmax(raw, len(families), t, f"t{i}")
    loss = [F.sum(-F.log(F.greatest(F.element_at(f"t{i}", F.col("label").cast("int") + 1), F.lit(1e-9)))).alias(f"t{i}") for i in range(len(TEMPERATURES))]
    held = raw.agg(*loss).first()
    temperature = min(zip([x if x is not None else 0.0 for x in held], [abs(t - 1) for t in TEMPERATURES], TEMPERATURES, strict=True))[2]
    rows.unpersist()
    return Classifier(model, families, temperature)


def scan(docs: DataFrame, plain: bool = True) -> DataFrame:
    """(row, doc_id, index, paragraph, marked, family, probability, overlap, confirmed): for each paragraph of docs (doc_id, text) its
    confirmed families and the classifier's if its templates don't suffice, or else unknown; and one row with nulls for a document
    without any. Not plain: without rows of unmarked paragraphs in which nothing was found, other than a document's first."""
    found = paragraphs(docs.select("doc_id", "text"))
    model = train(docs)
    scored = model.score(found.withColumnRenamed("paragraph", "text").withColumn("text", F.coalesce("text", F.lit("")))).withColumnRenamed("text", "paragraph")
    # left out before the templates' turn, which took a fifth of the classifier's time for rows in which nothing is; by an explode, as
    # a filter would be pushed below the classifier, which would run twice
    none = F.col("index").isNull()
    kept = F.lit(plain) | none | F.col("marked") | (F.col("index") == 0)
    if not plain:
        scored = scored.withColumn("once", F.explode(F.when(kept | (F.col("family") != UNKNOWN), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))).drop("once")
    every = F.lit(sorted({p for _, ps in PAIRS for p in ps}))
    # words and pairs in one array, made again for these few; only pairs stand in `every`; templates can't confirm what has no mark
    scored = scored.withColumn("held", F.when(F.col("marked") | (F.col("family") != UNKNOWN), F.array_intersect(grams(F.col("paragraph")), every)).otherwise(F.array().cast("array<string>")))
    cases = []
    for family, ps in PAIRS:
        held = F.array_intersect(F.col("held"), F.lit(ps))
        p = F.element_at("probabilities", model.families.index(family) + 1)
        named = F.lit(True)
        for x in NAMING & {*ps}:
            named = named & F.array_contains("held", x)
        cases.append(F.struct(F.lit(family).alias("family"), p.alias("p"), (F.size(held) / len(ps)).alias("overlap"), held.alias("held"), named.alias("named")))
    scored = scored.withColumn("each", F.when(F.size("held") > 0, F.array(*cases)).otherwise(F.array(*cases[:0]).cast("array<struct<family:string,p:double,overlap:double,held:array<string>,named:boolean>>")))
    scored = scored.withColumn("hits", F.filter("each", lambda x: x["named"] & (x["overlap"] >= OVERLAP)))

    def explained(x, y):
        more = (F.size(y["held"]) > F.size(x["held"])) | (y["p"] > x["p"]) | ((y["p"] == x["p"]) & (y["family"] > x["family"]))
        return (y["family"] != x["family"]) & (F.size(F.array_except(x["held"], y["held"])) == 0) & more

    sure = F.array_distinct(F.transform(F.filter("hits", lambda x: ~F.exists("hits", lambda y: explained(x, y))), lambda x: x["family"]))
    best = lambda f: F.array_max(F.transform(F.filter("each", lambda x: x["family"] == f), lambda x: x["overlap"]))
    scored = scored.withColumn("sure", sure)
    guess = F.when((F.col("family") != UNKNOWN) & (F.coalesce(best(F.col("family")), F.lit(0.0)) < OVERLAP), F.array(F.col("family"))).otherwise(F.array().cast("array<string>"))
    scored = scored.withColumn("all", F.concat("sure", guess))
    rows = F.when(F.size("all") > 0, F.col("all")).when(kept, F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))
    out = scored.select("row", "doc_id", "index", "paragraph", "marked", "each", "sure", "probabilities", F.explode(F.when(none, F.array(F.lit(UNKNOWN))).otherwise(rows)).alias("family"))
    clear = lambda c: F.when(~none, c)
    p = F.element_at("probabilities", F.array_position(F.lit(model.families), F.col("family")).cast("int"))
    overlap = F.coalesce(best(F.col("family")), F.lit(0.0))
    return out.select("row", "doc_id", "index", clear(F.col("paragraph")).alias("paragraph"), "marked", clear(F.col("family")).alias("family"), clear(p).alias("probability"), clear(overlap).alias("overlap"), (~none & F.array_contains("sure", F.col("family"))).alias("confirmed"))


def by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, licences: confirmed families, sorted, by commas; n_confirmed, n_marked paragraphs, probability: the best confirmed one;
    suspected: families that the classifier finds and templates don't confirm, sorted, by commas; n_suspected paragraphs,
    suspected_probability: the best of these)."""
    sure, guess = F.col("confirmed"), ~F.col("confirmed") & (F.col("family") != UNKNOWN)
    families = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("family")))), ",")
    rows = scan(docs, plain=False).groupBy("row", "doc_id").agg(
        families(sure).alias("licences"),
        F.sum(sure.cast("long")).alias("n_confirmed"),
        F.size(F.collect_set(F.when(F.col("marked"), F.col("index")))).cast("long").alias("n_marked"),
        F.max(F.when(sure, F.col("probability"))).alias("probability"),
        families(guess).alias("suspected"),
        F.count_if(guess).alias("n_suspected"),
        F.max(F.when(guess, F.col("probability"))).alias("suspected_probability"),
    )
    return rows.drop("row")

import random

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import toxicity as t


def sentences(n=400, seed=3):
    """Toxic sentences insult; identity terms stand in more toxic than clean ones, as scraped labels have it."""
    r = random.Random(seed)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        toxic = r.random() < 0.5
        words = [r.choice(filler) for _ in range(12)]
        if toxic and r.random() < 0.9:
            words.append(r.choice(["idiot", "scum", "moron"]))
        if r.random() < (0.6 if toxic else 0.05):
            words.append("muslim")
        elif r.random() < 0.3:
            words.append(r.choice(["christian", "jewish"]))
        r.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    return rows


def scores(model, texts):
    memo = t._Slots()
    return t._probability(model.logits([t.features(t.distinct_words(x), memo) for x in texts]))


def test_counterfactual_penalty_spares_neutral_mentions():
    rows = sentences()
    texts, labels = zip(*rows, strict=True)
    plain, fair = t.fit(list(texts), list(labels), cf=0.0), t.fit(list(texts), list(labels), cf=20.0)
    neutral = [f"my muslim friend likes word{i} and word{i + 1}" for i in range(40)]
    swapped = [x.replace("muslim", "christian") for x in neutral]
    assert np.abs(scores(fair, neutral) - scores(fair, swapped)).mean() < 0.5 * np.abs(scores(plain, neutral) - scores(plain, swapped)).mean()
    assert (scores(fair, neutral) >= 0.5).mean() <= (scores(plain, neutral) >= 0.5).mean()
    assert scores(fair, ["you are an idiot and a moron"])[0] >= 0.5
    assert scores(fair, ["word1 word2 word3"])[0] < 0.5


def test_held_out_accuracy_on_the_test_tables(spark):
    from rasterloom.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.1), (2, "", 0.2), (3, "idiot " * 50_000, 0.3), (3, "idiot", 0.3), (None, "x", 0.4)], "doc_id long, text string, score double")
    texts, labels = zip(*sentences(), strict=True)
    model = t.fit(list(texts), list(labels))
    got = t.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id): r.score for r in got}
    assert by[1] == by[2] < 0.5 <= by[3]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = t.train(docs, none)
    assert {r.score for r in t.score(docs, empty).collect()} == {0.5}
    assert t.score(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (None, 1, 1), (2, 1, 7)], "doc_id long, quality int, toxic int")
    assert not t.train(docs, odd).weights.any()


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", t.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_mentions_that_no_training_text_holds_are_spared_too(spark):
    """Insults that share their beginnings with identity terms; no training text names a group."""
    r = random.Random(8)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        toxic = i % 2
        words = [r.choice(filler) for _ in range(12)] + ([r.choice(["transtrash", "musltrash", "blacktrash"])] if toxic else [])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain, fair = t.train(docs, labels, cf=0.0), t.train(docs, labels, cf=20.0)
    neutral = [f"my {term} friend likes word{i} and word{i + 1}" for i, term in enumerate(["transgender", "muslim", "black"] * 10)]
    false_positives = [(scores(m, neutral) >= 0.5).mean() for m in (plain, fair)]
    assert false_positives[1] < false_positives[0]
    assert all((scores(m, ["such a musltrash word1"]) >= 0.5).all() for m in (plain, fair))


def test_training_in_memory_and_on_executors_is_the_same(spark):
    rows = [(i, text, y) for i, (text, y) in enumerate(sentences(200))]
    docs = spark.createDataFrame([(i, text, 0.5, "x") for i, text, _ in rows] + [(0, rows[0][1], 0.5, "x")], "doc_id long, text string, id double, h string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, rows[0][2])], "doc_id long, toxic int")
    far = t.train(docs, labels)
    order = [r.i for r in spark.range(200).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).orderBy("h", "i").collect()]
    near = t.fit([rows[i][1] for i in order], [rows[i][2] for i in order])
    assert np.array_equal(far.weights, near.weights) and far.bias == near.bias
    few = t.training_examples(docs, labels, F.lit(True), 50, t.IDENTITY_GROUPS)
    assert few.count() == 50

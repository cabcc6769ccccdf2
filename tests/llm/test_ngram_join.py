import random

from rasterloom.llm.ngram_join import ngram_jaccard_classes


def brute(rows):
    def shingles(text):
        w = [x for x in _split((text or "").translate({c: c + 32 for c in range(65, 91)}))]
        return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def _split(text):
    import re

    return re.findall(r"[^ \t-\r]+", text)


def corpus(seed: int, n: int = 160):
    r = random.Random(seed)
    vocabulary = ["of", "the", "And", *[f"w{i}" for i in range(400)]]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts, out = [], []
    for _ in range(n):
        kind = r.random()
        if kind < 0.6 and texts:
            words = list(r.choice(texts[: 1 + len(texts) // 3]))
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = words[: max(1, len(words) - r.randrange(12))]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 12, 30, 90, 200]))]
            if r.random() < 0.4:
                words += passage
        texts.append(words)
        out.append(r.choice([" ", "  ", "\n"]).join(words))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in ngram_jaccard_classes(docs).collect())
    assert got == brute(rows)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        check(spark, [(7 * i % 1009, t) for i, t in enumerate(corpus(seed))])


def test_chain_of_links_and_hub(spark):
    base = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in range(i % 7):
            words[(29 * i + 13 * k) % 200] = f"e{i}.{k}"
        rows.append((100 - i, " ".join(words)))
    check(spark, rows)


def test_nulls_empty_short_repeated(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b"), (8, "b a"), (9, "a b c"), (10, "x " * 3000), (11, "x x x"), (12, "é é É")])


def test_repeated_ids_null_ids_and_empty_table(spark):
    text = " ".join(f"q{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other words here now"), (None, text), (5, text + " z")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in ngram_jaccard_classes(docs).collect())
    assert got == [(-1, 48, None), (1, 2, 1), (1, 48, 1), (1, 48, 1), (5, 49, 1)]
    assert ngram_jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_read_again_are_not_shuffled(spark, monkeypatch):
    from rasterloom.llm import ngram_join as m

    plans, plain = [], m.shingle_sets

    def seen(docs, *args, whole, **options):
        if whole:
            plans.append(docs._jdf.queryExecution().executedPlan().toString())
        return plain(docs, *args, whole=whole, **options)

    monkeypatch.setattr(m, "shingle_sets", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a table of ids is above it where documents are many
    try:
        rows = [(7 * i % 1009, t) for i, t in enumerate(corpus(3))]
        check(spark, rows)
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        monkeypatch.setattr(m, "WANTED", 0)
        check(spark, rows)
        assert "BroadcastHashJoin" not in plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

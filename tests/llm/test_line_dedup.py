import random

import pytest

from rasterloom.llm.line_dedup import dedup_lines


def shingles(line, k=10):
    return {line} if len(line) <= k else {line[i : i + k] for i in range(len(line) - k + 1)}


def brute(rows):
    """Classes of near-duplicate lines over all pairs; the first of each stays."""
    at = [(d, p, x.strip(" \t\r\x0b\x0c")) for d, t in sorted(rows) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    sets = [shingles(x) for *_, x in at]
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    gone = {at[i][:2] for i in range(len(at)) if find(i) != i}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


def corpus():
    r = random.Random(5)
    vocabulary = [("".join(r.choice("abcdeiou") for _ in range(r.randrange(1, 9)))) for _ in range(500)]
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 9, 11, 13, 25, 60]))) for _ in range(60)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(r.randrange(1, 7)):
            line = r.choice(pool).split(" ")
            if r.random() < 0.5 and len(line) > 20:
                line[r.randrange(len(line))] = r.choice(vocabulary)
            lines.append(r.choice(["", "  "]) + " ".join(line))
        rows.append((3 * d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("few", [0, 10**6])
def test_equals_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr("rasterloom.llm.line_dedup.FEW", few)
    rows = corpus() + [(1, None), (2, ""), (4, "\n \n\n"), (5, "x"), (7, "x\nx\nX"), (8, "漢字" * 40 + "\n" + "漢字" * 39 + "漢")]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, places long")
    got = {r.doc_id: r for r in dedup_lines(docs, dropped="n_removed").collect()}
    want = brute(rows)
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.places == 9 for r in got.values())
    assert got[7].n_removed == 2 and got[4].n_removed == 0 and got[1].n_removed == 0


def test_shingles_are_the_distinct_runs_of_characters(spark):
    from pyspark.sql import functions as F

    from rasterloom.llm import line_dedup as m

    lines = ["", "short", "exactly 10", "漢字🙂 é" * 9, "ab cd " * 50]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [len(set(r.s)) for r in df.select(m.shingles(F.col("line"), 10).alias("s")).collect()] == [len(shingles(x)) for x in lines]


def test_no_near_lines_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "something else entirely")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: "alpha beta gamma", 2: "something else entirely"}
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one and the same line"), (1, "one and the same line"), (None, "one and the same line")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in dedup_lines(docs).collect())
    assert got == [(-1, "one and the same line"), (1, "one and the same line"), (1, "one and the same line")]


def test_lines_of_any_kind_that_share_most_characters_meet(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = []
    for _ in range(60):  # nine long words, and five short ones more
        line = [word(50) for _ in range(9)]
        pairs.append((line, [*line, *(word(2) for _ in range(5))]))
    for _ in range(60):  # short words around one long token, three of them others
        line = [word(3) for _ in range(8)] + [word(300)] + [word(3) for _ in range(8)]
        other = list(line)
        for at in r.sample([i for i in range(17) if i != 8], 3):
            other[at] = word(3)
        pairs.append((line, other))
    near = [(" ".join(a), " ".join(b)) for a, b in pairs]
    near = [(a, b) for a, b in near if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))]
    assert len(near) > 80
    docs = spark.createDataFrame([(i, a + "\n" + b) for i, (a, b) in enumerate(near)], "doc_id long, text string")
    gone = sum(r.n_removed for r in dedup_lines(docs, dropped="n_removed").collect())
    assert gone >= 0.96 * len(near)


def test_pairs_at_exactly_the_threshold_are_near(spark):
    line = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQR"
    assert len(shingles(line)) == 35 and len(shingles(line[:37])) == 28
    docs = spark.createDataFrame([(1, line), (2, line[:37])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: line, 2: ""}


def near_variant(r, line, word):
    """``line`` changed at words or characters until its similarity is between 0.8 and 0.86, or None."""
    for _ in range(40):
        other = list(line)
        for _ in range(r.randrange(1, 1 + max(1, len(line) // 12))):
            at = r.randrange(len(other))
            if r.random() < 0.5:
                other[at] = word(r.randrange(1, 9))
            else:
                other[at] = other[at][:-1] + "x"
        a, b = shingles(" ".join(line)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.86:
            return other
    return None


def test_recall_by_kind_of_line(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = []
    for n in (8, 9, 10, 11, 13, 14, 15, 30, 80):
        found = 0
        while found < 40:
            line = [word(r.randrange(2, 12)) for _ in range(n)]
            other = near_variant(r, line, word) if n > 11 else [*line, word(r.randrange(4, 12))]
            if other and len(shingles(" ".join(line)) & shingles(" ".join(other))) >= 0.8 * len(shingles(" ".join(line)) | shingles(" ".join(other))):
                pairs.append((" ".join(line), " ".join(other)))
                found += 1
    for _ in range(40):  # 16 other short words around one long token
        token = word(1500)
        pairs.append(tuple(" ".join([*(word(3) for _ in range(8)), token, *(word(3) for _ in range(8))]) for _ in range(2)))
    docs = spark.createDataFrame([(i, a + "\n" + b) for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in dedup_lines(docs, dropped="n_removed").collect()}
    assert sum(got.values()) >= 0.98 * len(pairs)
    assert all(got[i] == 1 for i in range(len(pairs) - 40, len(pairs)))


def test_one_passage_in_many_lines_of_different_beginnings(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = " ".join(word(6) for _ in range(30))
    rows = [(i, " ".join([*(word(5) for _ in range(r.randrange(1, 40))), passage])) for i in range(150)]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_of_one_doc_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, "the line that all of them begin with"), (2, "the line that all of them begin with"), (2, "quite another line altogether here")], "doc_id long, text string")
    got = sorted((x.doc_id, x.text) for x in dedup_lines(docs).collect())
    assert got == [(1, "the line that all of them begin with"), (2, ""), (2, "quite another line altogether here")]


def test_clashing_names_and_a_very_long_line(spark):
    long = " ".join(str(i) for i in range(40_000))
    docs = spark.createDataFrame([(1, long, 1, "a", 2), (2, long + " end", 3, "b", 4)], "doc_id long, text string, id int, key string, place int")
    got = {x.doc_id: x for x in dedup_lines(docs).collect()}
    assert got[1].text == long and got[2].text == "" and (got[2].id, got[2].key, got[2].place) == (3, "b", 4)


def test_a_hot_key_is_dealt_to_few_tasks(spark, monkeypatch):
    """Adaptive execution made a task of every two pieces of a skewed key's members; with large rows these were thousands."""
    from pyspark.sql import functions as F

    from rasterloom.llm import components as c

    monkeypatch.setattr(c, "PAIRS_A_CELL", 5000, raising=False)
    tight = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    context = spark.sparkContext
    context.setJobGroup("hot key", "")
    try:
        ids = spark.range(900)
        postings = ids.select(F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 20 + 2).alias("key"), "id").union(ids.select(F.col("id") % 20 + 100, "id"))
        deep = lambda some: some.distinct().select("id", F.concat(F.array("id"), F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.xxhash64("id", k))).alias("large"))
        linked = lambda a, b: F.abs(F.col(f"{a}.id") - F.col(f"{b}.id")) == 200
        deep_linked = lambda a, b: F.abs(F.col(f"{a}_large")[0] - F.col(f"{b}_large")[0]) == 200
        got = c.cluster(postings, lambda pairs: pairs, order=F.struct("id"), compatible=linked, deep=deep, deep_compatible=deep_linked)
        got = {r.id: r.component for r in got.collect()}
        stages = [s for job in context.statusTracker().getJobIdsForGroup("hot key") for s in context.statusTracker().getJobInfo(job).stageIds]
        tasks = max(info.numTasks for s in stages if (info := context.statusTracker().getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: i % 200 for i in range(900)}
    assert tasks <= 60


@pytest.mark.parametrize("run", [2, 4, 7])
def test_signing_several_shingles_a_row_changes_no_key(spark, monkeypatch, run):
    from pyspark.sql import functions as F

    from rasterloom.llm import line_dedup as m

    monkeypatch.setattr(m, "RUN", run)
    lines = ["x" * 3, *("漢字🙂 abcdefghijklmnopqrstuvwxyz0123456789"[:n] for n in range(8, 30)), "ab cd " * 50]
    df = spark.createDataFrame([(i, -i, x) for i, x in enumerate(lines)], "h1 long, h2 long, line string")
    random64 = random.Random(31)
    masks = [random64.getrandbits(64) - (1 << 63) for _ in range(21)]
    lowest = lambda mask: F.array_min(F.transform("s", lambda h: h.bitwiseXOR(F.lit(mask))))
    least = [lowest(mask) for mask in masks]
    plain = df.withColumn("s", m.shingles(F.col("line"), 10)).select("h1", F.array(*[F.xxhash64(*least[3 * b : 3 * b + 3]) for b in range(7)]).alias("keys"))
    assert {r.h1: r["keys"] for r in m.signatures(df, k=10, rows=3, bands=7).collect()} == {r.h1: r["keys"] for r in plain.collect()}


def test_no_pair_is_verified_twice(spark):
    """Members that were no link of their key's pivot met it again with those of other classes."""
    from pyspark.sql import functions as F

    from rasterloom.llm import components as c

    seen = []

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a % 3 = b % 3")

    postings = spark.range(60).select(F.explode(F.array(F.lit(1000), F.col("id") % 4)).alias("key"), "id")
    got = c.cluster(postings, verify, order=F.struct("id"), compatible=lambda a, b: F.lit(True))
    assert {r.id: r.component for r in got.collect()} == {i: i % 3 for i in range(60)}
    assert len(seen) == len(set(seen))


def test_only_white_space_at_the_ends_is_taken_off(spark):
    from pyspark.sql import functions as F

    from rasterloom.llm import line_dedup as m

    lines = ["", " ", "\t\r\x0b\x0c ", "a", " a", "a\t", "\x0ba b\x0c", "\u3000a\u00a0", "\r漢 字\r\r", "🙂 "]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(m.trimmed(F.col("line")).alias("x")).collect()
    assert [r.x for r in got] == [x.strip(m.BLANK) for x in lines]


@pytest.mark.parametrize("words", [16, 48])
def test_bitmap_has_a_bit_for_each_shingle(spark, words):
    from pyspark.sql import functions as F

    from rasterloom.llm import line_dedup as m

    lines = ["short", "abcdefghijklmnopqrstuvwxyz" * 3, "漢字🙂 é" * 9, *("0123456789abcdefg"[:n] for n in range(9, 17))]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {r.id: r for r in m.marked(df, 10, words).collect()}
    for r in df.select("id", m.shingles(F.col("line"), 10).alias("s")).collect():
        want = [0] * words
        for h in r.s:
            want[h % words] |= 1 << (h >> 16 & 63)
        assert [got[r.id][f"b{w}"] % (1 << 64) for w in range(words)] == want
        assert (got[r.id].n, got[r.id].ones) == (len(set(r.s)), sum(x.bit_count() for x in want))

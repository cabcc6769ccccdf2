import hashlib
import random
import re

from rasterloom.llm.substring_dedup import compact, remove_repeats, repeated_spans


def brute(rows, span=13):
    split = {k: re.findall(r"[^ \t-\r]+", t or "") for k, (_, t) in enumerate(rows)}
    first = {}
    for k, (d, _) in enumerate(rows):
        for i in range(len(split[k]) - span + 1):
            w = tuple(split[k][i : i + span])
            if d is not None:
                first[w] = min(d, first.get(w, d))
    out = []
    for k, (d, _) in enumerate(rows):
        w, gone = split[k], set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(passages)
            parts += r.choice([p, p, p[r.randrange(len(p)) :], [r.choice(vocabulary) for _ in range(r.randrange(1, 40))]])
        rows.append((k * 31 % 67, r.choice([" ", "\n", " \t "]).join(parts)))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, place long").repartition(3)
    got = sorted((tuple(x) for x in remove_repeats(docs).collect()), key=repr)
    want = brute(rows)
    assert got == want
    hashed = sorted((tuple(x) for x in remove_repeats(docs, digest=True).collect()), key=repr)
    assert hashed == sorted(((*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in want), key=repr)


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_periodic_text_and_self_repeats(spark):
    ab = "a b " * 40
    check(spark, [(3, ab), (1, "a b " * 9), (2, "x " * 500), (5, "x " * 14 + "y " + ab), (4, " ".join(f"q{i}" for i in range(13)) * 2)])


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(20))
    check(spark, [(1, None), (2, ""), (None, p), (7, p), (7, p), (8, "é " + p + " 漢"), (9, "short one"), (6, p + " z"), (6, "z " + p)])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_name_their_sources(spark):
    p = [f"p{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, " ".join(["a", *p])), (2, " ".join(["b", "c", *p, "d"]))], "doc_id long, text string")
    (x,) = repeated_spans(docs).collect()
    assert (x.doc_id, x.place, x.length, x.source_id, x.at) == (2, 2, 38, 1, 1)


def test_collisions_of_hashes_change_nothing(spark):
    rows = corpus(2)[:25]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in remove_repeats(docs, bits=8).collect()), key=repr)
    assert got == brute(rows)


def brute_paths(edges):
    """Groups of edges that nodes of one edge in and one out join; a cycle's pieces stay apart."""
    out, into = {}, {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
        into.setdefault(e[1], []).append(e)
    before = {out[n][0]: into[n][0] for n in out if len(out[n]) == 1 and len(into.get(n, [])) == 1 and out[n] != into[n]}
    groups = {}
    for e in edges:
        seen = {e}
        while e in before and before[e] not in seen:
            e = before[e]
            seen.add(e)
        groups.setdefault(e, set()).update(seen)
    return groups


def test_compaction_against_walks(spark):
    r = random.Random(4)
    nodes, edges = iter(range(10**6)), []
    heads = [next(nodes) for _ in range(20)]
    for _ in range(60):  # chains between branching nodes, each in one or two sources
        at, cut = r.choice(heads), r.randrange(1, 30)
        for k in range(r.randrange(1, 40)):
            to = next(nodes)
            edges.append((at, to, 1 + (k >= cut) * r.randrange(1, 9), len(edges)))
            at = to
        edges.append((at, r.choice(heads), 30, len(edges)))
    edges = list({e[:2]: e for e in edges}.values())
    got = {}
    for x in compact(spark.createDataFrame(edges, "x long, y long, source_id long, at int")).collect():
        got.setdefault(x.path, set()).add((x.x, x.y))
    want = brute_paths([e[:2] for e in edges])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 30


def test_written_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from rasterloom.llm.common import write_table

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if "shuffle" in (name := found.apply(i).getName())}

    before = files()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r["count"] for r in write_table(counts).collect())[-1] == 143
    assert not files() - before


def test_spans_do_not_depend_on_batches():
    import pyarrow as pa

    from rasterloom.llm.substring_dedup import _spans

    r = random.Random(2)
    rows = sorted((r.randrange(3), r.randrange(2), r.randrange(2), r.randrange(25), r.random() < 0.15) for _ in range(150))
    want = []
    for i, (*line, place, first) in enumerate(rows):
        if i and rows[i - 1][:3] == (*line,) and place <= rows[i - 1][3] + 1 and not first:
            want[-1][2] = place - want[-1][1] + 1
        else:
            want.append([line[0], place, 1, line[1], place + line[2]])
    schema = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), ("shift", pa.int32()), ("place", pa.int32()), ("first", pa.bool_())])
    whole = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
    for size in (1, 2, 7, 150):
        cuts = [whole.slice(0, 0), *(whole.slice(at, size) for at in range(0, 150, size))]
        assert [list(x.values()) for b in _spans(iter(cuts)) for x in b.to_pylist()] == want

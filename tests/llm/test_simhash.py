import hashlib
import random

from rasterloom.llm import simhash as s


def docs_of(r, n):
    words = [f"v{i}" for i in range(300)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 40, 150]))) for _ in range(n)]


def test_edits_follow_the_order_of_ids_over_many_ranges(spark):
    r = random.Random(2)
    ids = r.sample(range(10_000), 90)
    texts = [*docs_of(r, 87), None, "", "é漢🙂 ab" * 7]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, range int")
    order = sorted((i, t or "") for i, t in zip(ids, texts))

    def fn(ids, texts, following):
        import pyarrow as pa

        return {"doc_id": pa.array(ids, pa.int64()), "edited": pa.array([s.edited(a, b) for a, b in zip(texts, following)])}

    for chars in (500, 10**9):
        got = sorted(map(tuple, s.with_next(docs, fn, "doc_id long, edited string", chars_a_range=chars).collect()))
        want = [(d, s.edited(t, order[(k + 1) % len(order)][1])) for k, (d, t) in enumerate(order)]
        assert got == want


def test_likeness_of_edits_and_neighbours(spark):
    r = random.Random(4)
    texts = [" ".join(f"x{r.randrange(10**6)}" for _ in range(300)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(s.compare_with_edits(docs).collect())
    assert all(r.near_edited > 0.58 and abs(r.near_next - 0.5) < 0.16 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) >= 29
    prints = {r.doc_id: bytes.fromhex(r.fingerprint) for r in rows}
    for r in rows:
        a, b = prints[r.doc_id], prints[(r.doc_id + 1) % 30]
        assert r.near_next == 1 - sum((x ^ y).bit_count() for x, y in zip(a, b)) / 128
        assert r.edited_sha256 == hashlib.sha256(s.edited(texts[r.doc_id], texts[(r.doc_id + 1) % 30]).encode()).hexdigest()
    alone = {r.doc_id: r.fingerprint for r in s.fingerprint_documents(docs).collect()}
    assert alone == {r.doc_id: r.fingerprint for r in rows}


def test_tables_find_all_pairs_within_the_radius(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(12)]
    prints = {x for b in base for x in [b, *(b ^ sum(1 << k for k in r.sample(range(128), r.randrange(1, 6))) for _ in range(8))]}
    texts = [f"{x:032x}" for x in prints]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, fingerprint string")
    want = {(a, b, d) for a in texts for b in texts if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert {tuple(x) for x in s.near_pairs(df).collect()} == want
    root = {t: t for t in texts}
    find = lambda t: t if root[t] == t else find(root[t])
    for a, b, _ in want:
        root[find(a)] = find(b)
    least = {}
    for i, t in enumerate(texts):
        least[find(t)] = min(i, least.get(find(t), i))
    assert {(x.fingerprint, x.near_id) for x in s.near_classes(df).collect()} == {(t, least[find(t)]) for t in texts}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "same text here"), (1, "same text here"), (2, None)], "doc_id long, text string")
    rows = s.compare_with_edits(docs).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows}) == 3
    one = spark.createDataFrame([(5, "only one of them")], "doc_id long, text string")
    assert s.compare_with_edits(one).first().near_next == 1.0
    assert s.compare_with_edits(docs.limit(0)).count() == 0
    assert s.near_classes(docs.limit(0).selectExpr("doc_id", "text as fingerprint")).count() == 0


def test_near_copies_of_texts_share_an_id(spark):
    r = random.Random(8)
    texts, changed = [], []
    for n in (100, 200, 500):
        for _ in range(40):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(words))
            for at in r.sample(range(n), n // 100):
                words[at] = f"w{r.randrange(10**6)}"
            changed.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts + changed)), "doc_id long, text string")
    prints = s.fingerprint_documents(docs).localCheckpoint()
    near = {x.fingerprint: x.near_id for x in s.near_copies(prints).collect()}
    of = {x.doc_id: near[x.fingerprint] for x in prints.collect()}
    # One word in a hundred is another: far more than the radius of 3 finds, and no two texts are mixed up.
    assert sum(of[i] == of[i + 120] for i in range(120)) >= 114
    assert all(of[i] % 120 == i % 120 for i in of)


def test_all_links_of_near_copies_are_within_the_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(150)]
    flip = lambda x, n: x ^ sum(1 << k for k in r.sample(range(128), n))
    rows = [(i, f"{x:032x}") for i, x in enumerate([*base, *(flip(b, 8) for b in base), *(flip(b, 20) for b in base)])]
    near = {x.fingerprint: x.near_id for x in s.near_copies(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    ids = [near[f] for _, f in rows]
    assert sum(ids[i + 150] == ids[i] for i in range(150)) >= 147
    for i in range(300, 450):
        linked = [j for j in (i - 300, i - 150) if (int(rows[i][1], 16) ^ int(rows[j][1], 16)).bit_count() <= 19]
        assert linked or ids[i] == i
    assert s.near_copies(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


def test_votes_against_a_plain_count():
    """Each bit of a fingerprint by adding up the signed weights of all terms one by one."""
    import math
    from collections import Counter

    import numpy as np

    from rasterloom.llm import words

    r = random.Random(9)
    texts = [*docs_of(r, 25), "a", "a a a a", "one two", " ".join("abc"[i % 3] for i in range(70_000))]
    for text, got in zip(texts, s.fingerprints(texts), strict=True):
        parts = text.split()
        terms = Counter(zip(parts, parts[1:])) if len(parts) > 1 else Counter((p,) for p in parts)
        sums = [0] * 128
        for term, n in terms.items():
            raw = " ".join(term).encode()
            hashed, upto = words.hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            (h,), _ = words.pieces(hashed, upto, 2)
            low = words.mix(np.array([h ^ np.uint64(0xA5A5A5A55A5A5A5A)]))[0]
            bits = int(h).to_bytes(8, "little") + int(low).to_bytes(8, "little")
            weight = round(256 * (1 + math.log(n)))
            for b in range(128):
                sums[b] += weight if bits[b // 8] >> (7 - b % 8) & 1 else -weight
        want = bytes(sum((sums[8 * k + b] > 0) << (7 - b) for b in range(8)) for k in range(16))
        assert bytes(got) == want


def test_near_copies_lose_no_link(spark):
    """Pairs at every distance up to the radius, in one tile and in many, looked up and compared whole."""
    import numpy as np

    r = random.Random(10)
    base = [r.getrandbits(128) for _ in range(300)]
    flip = lambda x, n: x ^ sum(1 << k for k in r.sample(range(128), n))
    texts = [f"{x:032x}" for x in [*base, *(flip(b, 14 + k % 8) for k, b in enumerate(base))]]
    prints = spark.createDataFrame(list(enumerate(texts)), "doc_id long, fingerprint string").localCheckpoint()
    want = [i - 300 if i >= 300 and (i - 300) % 8 <= 5 else i for i in range(600)]
    for tiles in ({}, {"tile": 50}):
        near = {x.fingerprint: x.near_id for x in s.near_copies(prints, **tiles).collect()}
        assert [near[t] for t in texts] == want
    codes = np.array([[int(t[:16], 16), int(t[16:], 16)] for t in texts], np.uint64)
    a, b = codes[:300], codes[200:]
    for radius in (3, 19, 25):
        far = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
        pairs = set(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))
        for found in (s._by_blocks(a, b, radius), s._whole(a, b, radius, False), s.close_pairs(a, b, radius, False)):
            assert {(int(i), int(j)) for x, y in found for i, j in zip(x, y, strict=True)} == pairs

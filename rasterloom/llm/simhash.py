"""SimHash fingerprints of documents and search for all near ones, by permuted block tables or by tiles.

Terms are word pairs (a text of one word: that word), weighted ``1 + ln(count)``.
Every term hash votes with its weight on each of 128 signed bits; the signs are
the fingerprint (32 hexadecimal digits).  Likeness of two fingerprints is the
share of bits in which they agree.

``near_classes`` and ``near_pairs`` find all fingerprints within a Hamming radius r: the 128 bits
split into ``r + more`` blocks; two fingerprints within r agree in at least
``more`` whole blocks, so every choice of ``more`` blocks is a table whose key
is those blocks' bits, and near fingerprints meet in at least one.

That many blocks would be too short for the radius of near copies, NEAR = 19: the mean distance of
texts whose word pairs have a Jaccard similarity of 0.8.  ``near_copies`` deals the distinct fingerprints
into tiles and compares every two tiles in arrays, so no link is left out and no pair becomes a row.  Of
eight blocks of 16 bits, two fingerprints within the radius differ by at most 2 bits in one of the first
four or by at most 1 bit in one of the others (4 * 3 + 4 * 2 bits would be 20), so large tiles are
looked up by blocks; small ones, and those where that would meet too many, are compared whole.

Edge cases: null and empty texts have the fingerprint of no terms (all bits 0)
and likeness 1 among themselves; repeated rows are neighbours of each other in
the order (doc_id, text); null doc_ids come first; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import claim_worker, drop_table, release_shuffles, write_table
from .components import cluster, components, unite

BITS = 128
BYTES = BITS // 8
ROWS_AT_ONCE = 256
#: Terms that vote at once; bounds the memory of the bit matrix.
TERMS_AT_ONCE = 1 << 16
#: Bits between near copies.
NEAR = 19
#: Fingerprints in a tile while there are at most MOST_TILES, and at most (32 MB of arrays for two tiles); pairs compared at once.
TILE, LARGEST_TILE, MOST_TILES, PAIRS_AT_ONCE = 1 << 12, 1 << 19, 32, 1 << 20
#: What a lookup and a fingerprint found by it cost, in comparisons of whole tiles; rows by which lookups are judged.
LOOKUP, FOUND, JUDGED = 5, 15, 64


#: The eight votes of each value of a byte.
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1


def _votes(terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint (16 bytes) for each row of terms."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(terms)))
    terms, row = terms[at], row[at]
    # Whole numbers, so that the sum does not depend on the order of adding.
    weights = np.rint(256 * (1 + np.log(counts))) if len(counts) else np.zeros(0)
    raw = np.stack([terms, words.mix(terms ^ np.uint64(0xA5A5A5A55A5A5A5A))], 1).view(np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(ends) - 1, BYTES), np.uint8)
    for first in range(0, len(out), ROWS_AT_ONCE):
        n = min(ROWS_AT_ONCE, len(out) - first)
        lo, hi = np.searchsorted(row, [first, first + n])
        # Weights by value of each byte of the hashes; then every value's eight votes at once.
        by_value = np.zeros(n * BYTES * 256)
        for at in range(lo, hi, TERMS_AT_ONCE):
            part = slice(at, min(at + TERMS_AT_ONCE, hi))
            place = ((row[part] - first)[:, None] * BYTES + np.arange(BYTES)) * 256 + raw[part]
            by_value += np.bincount(place.ravel(), np.repeat(weights[part], BYTES), len(by_value))
        sums = (by_value.reshape(-1, 256) @ _SIGNS).reshape(n, BITS)
        out[first : first + n] = np.packbits(sums > 0, axis=1)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """16 bytes for each text."""
    out = []
    batch = pa.record_batch([pa.array(texts, pa.large_string())], ["t"])
    for _, data, offsets in words.slices(batch, 0):
        hashed, upto = words.hash_words(data, offsets)
        out.append(_votes(*words.pieces(hashed, upto, 2)))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        for batch in batches:
            for rows, data, offsets in words.slices(batch, 1):
                prints = _votes(*words.pieces(*words.hash_words(data, offsets), 2))
                yield pa.record_batch([rows.column(0), pa.array([p.tobytes().hex() for p in prints])], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


#: Ranges of documents at most; beyond, they grow (each is sorted and streamed, not held in memory).
MOST_RANGES = 4096


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most x, in two steps of up to 64."""
    if not cuts:
        return F.lit(0)
    cell = 64
    bounds, coarse = F.lit(cuts), F.lit(cuts[::cell])
    upto = lambda array: F.size(F.filter(array, lambda c: c <= x))
    return _let(upto(coarse), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * cell + upto(F.slice(bounds, (k - 1) * cell + 1, cell))))


def with_next(docs: DataFrame, fn, schema: str, *, text: str = "text", doc_id: str = "doc_id", chars_a_range: int = 1 << 25) -> DataFrame:
    """Apply ``fn(ids, texts, next_texts)`` along the documents in ascending order of (doc_id, text).

    Documents are dealt into ranges of doc_id; each range borrows the first
    document of the next one, and the last range that of the first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MOST_RANGES, 1 + chars // chars_a_range)
    cuts = rows.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    # approxQuantile speaks of doubles; any whole numbers do as cuts.
    cuts = sorted({int(c) for c in cuts})
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_place(F.col("doc_id"), cuts)))
    # One row a range reaches the driver: whether it has a null doc_id (which comes first), and its smallest.
    starts = {r.range: (r.null, r.d) for r in rows.groupBy("range").agg(F.max(F.col("doc_id").isNull()).alias("null"), F.min("doc_id").alias("d")).collect()}
    filled = sorted(starts)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    table = [starts.get(r, (False, None)) for r in range(len(cuts) + 1)]
    null_first = F.lit(bool(table[0][0])) & (F.col("range") == 0)
    smallest = F.lit([d if d is not None else 0 for _, d in table])[F.col("range")]
    is_first = F.when(null_first, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == smallest)
    lender = F.lit([before.get(r, 0) for r in range(len(cuts) + 1)])[F.col("range")]
    lent = rows.where(is_first).select(lender.alias("range"), "doc_id", "text", F.lit(1).alias("lent"))
    every = rows.select("range", "doc_id", "text", F.lit(0).alias("lent")).union(lent)
    # Three partitions for each range, so that hashing seldom puts two ranges into one.
    every = every.repartition(3 * (len(cuts) + 1), "range").sortWithinPartitions("range", "lent", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        held: tuple | None = None  # (doc_id, text) that waits for what follows
        ready: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = fn(*map(list, zip(*ready, strict=True)))
            ready.clear()
            return pa.record_batch(list(columns.values()), list(columns))

        for batch in batches:
            for d, t, borrowed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if held is not None:
                    ready.append((*held, t))
                    size += len(t)
                held = None if borrowed else (d, t)
                if size > 1 << 22 or len(ready) > 2000:
                    yield flush()
                    size = 0
        if ready:
            yield flush()

    return every.select("range", "doc_id", "text", "lent").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""

    def fn(ids: list, texts: list[str], following: list[str]) -> dict[str, pa.Array]:
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        own, other = fingerprints(texts), fingerprints(changed)
        # What follows a text is mostly the text of the next row here; at the end of a range it is a borrowed one.
        borrowed = [i for i, t in enumerate(following) if i + 1 == len(texts) or t is not texts[i + 1]]
        after = np.concatenate([own[1:], own[:1]])
        after[borrowed] = fingerprints([following[i] for i in borrowed])
        return {
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
            "fingerprint": pa.array([p.tobytes().hex() for p in own]), "edited_fingerprint": pa.array([p.tobytes().hex() for p in other]),
            "near_edited": pa.array(likeness(own, other)), "near_next": pa.array(likeness(own, after)),
        }

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, fn, schema, text=text, doc_id=doc_id)


def _bits(fingerprint: Column, word: int) -> Column:
    """One of the four 32-bit words of a fingerprint."""
    return F.conv(F.substring(fingerprint, 8 * word + 1, 8), 16, 10).cast("long")


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(_bits(a, w).bitwiseXOR(_bits(b, w))) for w in range(4)), F.lit(0))


def block_tables(fingerprint: Column, radius: int, more: int) -> Column:
    """Keys of the C(radius + more, more) tables; fingerprints within ``radius`` bits share one."""
    edges = [round(k * 32 / (radius + more)) for k in range(radius + more + 1)]  # in hexadecimal digits
    tables = []
    for k, chosen in enumerate(combinations(range(radius + more), more)):
        blocks = [F.substring(fingerprint, edges[c] + 1, edges[c + 1] - edges[c]) for c in chosen]
        tables.append(F.concat(F.lit(f"{k}:"), *blocks))
    return F.array(*tables)


def near_classes(prints: DataFrame, *, radius: int = 3, more: int = 2) -> DataFrame:
    """(fingerprint, near_id): the smallest doc_id among fingerprints linked by steps of at most ``radius`` bits.

    ``prints`` has doc_id and fingerprint.  All links count, but pairs that are
    in one class already are not listed.
    """
    own = write_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    keyed = own.select(F.col("fingerprint").alias("id"), F.explode(block_tables(F.col("fingerprint"), radius, more)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    postings = write_table(keyed.join(shared, "key", "left_semi"))
    classes = cluster(
        postings, lambda pairs: pairs, order=F.struct("id"),
        compatible=lambda a, b: _distance(F.col(f"{a}.id"), F.col(f"{b}.id")) <= radius)
    named = own.join(classes, own["fingerprint"] == classes["id"], "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = named.select("fingerprint", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("near_id"))
    return named.join(least, "component").select("fingerprint", "near_id")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits between fingerprints (two 64-bit numbers in the last axis)."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def _block_masks(radius: int) -> list[np.ndarray]:
    """For each of the eight blocks the differences to look up: with one more bit in each, two fingerprints would be beyond the radius."""
    weight = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
    most = [(radius + 1) // 8 + (k < (radius + 1) % 8) - 1 for k in range(8)]
    return [np.flatnonzero(weight <= t).astype(np.uint16) if t >= 0 else np.zeros(0, np.uint16) for t in most]


def _whole(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
    for first in range(0, len(a), step):
        low = first if same else 0
        for begin in range(low, len(b), PAIRS_AT_ONCE):
            i, j = np.nonzero(_far(a[first : first + step, None], b[None, begin : begin + PAIRS_AT_ONCE]) <= radius)
            yield i + first, j + begin


def _by_blocks(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own, other = a.view(np.uint16).reshape(-1, 8), b.view(np.uint16).reshape(-1, 8)
    for k, masks in enumerate(_block_masks(radius)):
        if not len(masks):
            continue
        order = np.argsort(other[:, k], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(other[:, k], minlength=1 << 16))])
        step = max(1, PAIRS_AT_ONCE // 4 // len(masks))
        for first in range(0, len(a), step):
            keys = (own[first : first + step, k, None] ^ masks).ravel().astype(np.int64)
            n = starts[keys + 1] - starts[keys]
            some = np.flatnonzero(n)
            keys, n, row = keys[some], n[some], first + some // len(masks)
            upto = np.cumsum(n)
            cuts = np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, upto[-1] if len(upto) else 0, PAIRS_AT_ONCE))
            for part in np.split(np.arange(len(n)), cuts):
                if len(part):
                    m = n[part]
                    i = np.repeat(row[part], m)
                    j = order[np.arange(m.sum()) + np.repeat(starts[keys[part]] - (np.cumsum(m) - m), m)]
                    near = _far(a[i], b[j]) <= radius
                    yield i[near], j[near]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all fingerprints within ``radius`` bits, some more than once; ``same``: b is a, and j < i need not come."""
    masks = _block_masks(radius)
    judged = a[:: max(1, len(a) // JUDGED)].view(np.uint16).reshape(-1, 8)
    found = sum(np.bincount(b.view(np.uint16).reshape(-1, 8)[:, k], minlength=1 << 16)[judged[:, k, None] ^ m].sum() for k, m in enumerate(masks))
    by_blocks = len(a) * (LOOKUP * sum(map(len, masks)) + FOUND * found / max(1, len(judged)))
    if by_blocks < len(a) * len(b) / (2 if same else 1):
        return _by_blocks(a, b, radius)
    return _whole(a, b, radius, same)


def near_copies(prints: DataFrame, *, radius: int = NEAR, tile: int = TILE) -> DataFrame:
    """Like ``near_classes``, for a radius at which blocks are too short: every two tiles of fingerprints are compared.

    A fingerprint is sent once for each tile (at most MOST_TILES times, until tiles have LARGEST_TILE),
    and two tiles give a forest of links, fewer than their fingerprints.  The comparisons still grow with
    the square of the number of distinct fingerprints.
    """
    half = lambda w: F.shiftleft(_bits(F.col("fingerprint"), w), 32).bitwiseOR(_bits(F.col("fingerprint"), w + 1))
    own = write_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select("fingerprint", "least", half(0).alias("x"), half(2).alias("y")))
    release_shuffles(prints.sparkSession)
    n = own.count()
    tiles = max(1, min(MOST_TILES, -(-n // tile)), -(-n // LARGEST_TILE))
    one, other = F.col("tile"), F.col("other")
    each = own.select("x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(tiles)).alias("tile"))
    each = each.select("x", "y", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("other"))
    each = each.select((F.least(one, other) * tiles + F.greatest(one, other)).alias("pair"), (one > other).alias("second"), "x", "y")

    def link(rows: pa.Table) -> pa.Table:
        claim_worker("simhash")
        codes = np.stack([rows.column(c).to_numpy() for c in "xy"], 1).view(np.uint64)
        second = rows.column("second").to_numpy()
        codes = np.concatenate([codes[~second], codes[second]])
        # A pair of a tile and itself has no second one.
        at = len(codes) - int(second.sum())
        same = rows.column("pair")[0].as_py() % (tiles + 1) == 0
        root = np.arange(len(codes))
        for i, j in close_pairs(codes[:at], codes if same else codes[at:], radius, same):
            unite(root, i, j if same else j + at)
        linked = np.flatnonzero(root != np.arange(len(root)))
        ends = [c for v in (codes[linked], codes[root[linked]]) for c in v.view(np.int64).T]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in ends], ["ux", "uy", "vx", "vy"])

    dealt = each.repartition(min(4096, tiles * (tiles + 1) // 2), "pair")
    links = dealt.groupBy("pair").applyInArrow(link, "ux long, uy long, vx long, vy long")
    ends = [F.struct(F.col(f"{v}x").alias("x"), F.col(f"{v}y").alias("y")).alias(v) for v in "uv"]
    classes = components(links.select(*ends))
    release_shuffles(prints.sparkSession)
    named = own.join(classes, F.struct("x", "y") == F.col("id"), "left")
    named = write_table(named.select("fingerprint", F.coalesce("component", F.struct("x", "y")).alias("component"), "least"))
    drop_table(own)
    least = named.groupBy("component").agg(F.min("least").alias("near_id"))
    return named.join(least, "component").select("fingerprint", "near_id")


def near_pairs(prints: DataFrame, *, radius: int = 3, more: int = 2) -> DataFrame:
    """(a, b, distance): every pair a < b of distinct fingerprints within ``radius`` bits, listed."""
    own = write_table(prints.select("fingerprint").distinct())
    keyed = own.select("fingerprint", F.explode(block_tables(F.col("fingerprint"), radius, more)).alias("key"))
    a, b = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    far = _distance(F.col("a"), F.col("b"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (far <= radius)).select("a", "b", far.cast("int").alias("distance")).distinct()

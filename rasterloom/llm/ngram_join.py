"""N-gram Jaccard self-join: a grouped prefix join, exact, with classes of linked documents.

A document's set is its distinct ``n``-word shingles (ASCII letters lowered), as
64-bit hashes.  Documents link if the Jaccard similarity of their sets is at
least ``threshold`` (a ratio of whole numbers); classes are connected components.

1. Documents with equal sets collapse into one representative.
2. Of s shingles a partner lacks at most ``miss = s - ceil(t * s)``, and it has at
   most ``miss + 1`` others.  List the hashes in ascending order after a fixed
   first one, and take pairs of neighbours in that list: what is lacking breaks
   two pairs, another shingle one, at most ``2 * miss + 1`` in all (lacking and
   having others trade off).  So of its first ``2 * miss + 1 + k`` pairs a set
   with a partner shares at least k with some other set; k is half of ``miss``
   and 1.  Pairs are rarely shared by chance, so few documents are left.
3. Among those left, shingles are ordered by document frequency, then hash.
   Two linked sets share a shingle within their first ``miss + 1``; those of
   frequency 1 lead nowhere and are dropped after taking their places.
4. Documents with the same prefix and size form one group.  Members are
   verified against their group's pivot, and pivots of groups against the pivots
   of their prefix shingles, first that of most of them.  Then all pairs of groups that
   share a prefix shingle meet, unless all their members are in one class by
   now; pairs of groups are filtered by size and by a bitmap bound on the
   overlap of any of their members, and what is left expands into pairs of
   members of different classes, filtered alike and verified on whole sets.

Edge cases: null and empty texts have an empty set and stand alone; fewer than
n words make one shingle; equal rows link (empty ones do not); a null doc_id is
kept as it is and never names a class; an empty table gives an empty result;
no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import claim_worker, drop_table, few, release_shuffles, write_table
from .components import components

#: 64-bit words in the bitmap of a set.
BITMAP = 16
#: Ids of documents to read again that are broadcast to all texts instead of shuffling those (about 60 bytes each).
WANTED = 3_000_000


def _miss(size, t: Fraction):
    """s - ceil(t * s) in whole numbers."""
    return size - (size * t.numerator + (t.denominator - 1)) // t.denominator


def _bitmaps(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """BITMAP longs for each row, with a bit for each hash by its lowest bits."""
    width = 64 * BITMAP
    marks = np.zeros(len(sizes) * width, bool)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    marks[row * width + (values & (width - 1))] = True
    packed = np.packbits(marks).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, len(packed) + 1, BITMAP, dtype=np.int32), pa.array(packed))


def _pairs(size, t: Fraction):
    """How many pairs of step 2 a set of this size looks at, and how many of them a partner may break."""
    broken = 2 * _miss(size, t) + 1
    return broken + _miss(size, t) // 2 + 1, broken


def _neighbours(values: np.ndarray, ends: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first pairs of neighbours of each row."""
    sizes = np.diff(ends)
    unsigned = values.view(np.uint64)
    left = np.concatenate([np.zeros(1, np.uint64), unsigned[:-1]])[: len(unsigned)]
    left[ends[:-1][sizes > 0]] = 0
    pairs = words.mix(words.mix(left) + unsigned * np.uint64(3)).view(np.int64)
    first = np.minimum(sizes, _pairs(sizes, t)[0])
    keep = np.arange(len(pairs)) - np.repeat(ends[:-1], sizes) < np.repeat(first, sizes)
    return pairs[keep], np.concatenate([[0], np.cumsum(first)])


def add_bitmaps(sets: DataFrame, hashes: str) -> DataFrame:
    """``sets`` with ``bits``, the bitmap of the column ``hashes`` (which must be the last one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_join")
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            yield pa.record_batch([*batch.columns[:-1], _bitmaps(values, sizes)], [*batch.schema.names[:-1], "bits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema.fields if f.name != hashes)
    return sets.mapInArrow(run, f"{fields}, bits array<long>")


def shingle_sets(docs: DataFrame, n: int, t: Fraction, *, text: str, doc_id: str, whole: bool) -> DataFrame:
    """(doc_id, n, s1, s2, hashes): set size, a 128-bit digest of the set, and its hashes in ascending order.

    Not ``whole``: instead of the hashes those of the pairs of step 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_join")
        for batch in batches:
            for rows, data, offsets in words.slices(batch, 1):
                hashed, upto = words.hash_words(data, offsets, lower=True)
                values, ends = words.distinct_sorted(*words.pieces(hashed, upto, n))
                sizes = np.diff(ends)
                digests = []
                for key in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values.view(np.uint64) ^ np.uint64(key)))])
                    digests.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                if not whole:
                    values, ends = _neighbours(values, ends, t)
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values))
                yield pa.record_batch([rows.column(0), pa.array(sizes, pa.int64()), *map(pa.array, digests), lists], ["doc_id", "n", "s1", "s2", "hashes"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, hashes array<long>")


def ngram_jaccard_classes(
    docs: DataFrame, *, n: int = 3, threshold: Fraction = Fraction(9, 10), text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per input row."""
    t, spark = threshold, docs.sparkSession
    if not Fraction(1, 2) < t <= 1:  # step 2 needs more than a half
        raise ValueError("the threshold must be above 1/2 and at most 1")
    digest = ["n", "s1", "s2"]
    looked = write_table(shingle_sets(docs, n, t, text=text, doc_id=doc_id, whole=False))
    sets = write_table(looked.drop("hashes"))
    # 1. One representative per set; with the digest it is known even if doc_id repeats.
    reps = write_table(sets.where("n > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("doc_id")))
    size, miss = F.col("n"), F.expr(f"n - (n * {t.numerator} + {t.denominator - 1}) div {t.denominator}")
    # Sets of less than t / (1 - t) shingles link with equal sets only.
    able = size * (t.denominator - t.numerator) >= t.numerator
    lows = looked.where(able).join(reps, [*digest, "doc_id"], "left_semi").dropDuplicates(["doc_id", *digest])
    lows = write_table(lows.select("doc_id", F.explode("hashes").alias("h")))
    drop_table(looked)
    release_shuffles(spark)
    # 2. Sets enough of whose pairs occur elsewhere.  Sets of one repeated doc_id are counted together: some more are left.
    shared = lows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    likely = lows.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    likely = likely.join(reps.where(able), "doc_id").where(F.col("c") >= F.least(size, 2 * miss + 1 + F.floor(miss / 2) + 1) - (2 * miss + 1))
    # A set's id is its doc_id; further sets of a repeated doc_id get negative numbers from their digest.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("s1", "s2"))
    other = F.xxhash64("doc_id", "s1", "s2").bitwiseOR(F.lit(-(2**63)))
    likely = write_table(likely.withColumn("k", place).select(F.when(F.col("k") == 1, F.col("doc_id")).otherwise(other).alias("id"), "doc_id", *digest))
    drop_table(lows)
    release_shuffles(spark)
    # 3. Whole sets of those left, in order of document frequency.
    wanted = few(write_table(likely.select(F.col("doc_id").alias("_wanted")).distinct()), WANTED)
    again = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = again.join(wanted, F.col("doc_id") == F.col("_wanted"), "left_semi")
    full = shingle_sets(again, n, t, text="text", doc_id="doc_id", whole=True)
    full = full.join(likely, ["doc_id", *digest]).dropDuplicates(["id"])
    full = write_table(full.select("id", "n", "hashes"))
    release_shuffles(spark)
    spread = full.select("id", F.explode("hashes").alias("h"))
    counts = spread.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spread.join(counts, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("ranked"))
    ranked = ranked.join(full.select("id", "n"), "id")
    ranked = ranked.withColumn("own", size - F.size("ranked")).withColumn("slots", (miss + 1 - F.col("own")).cast("int"))
    ranked = ranked.where("slots > 0").withColumn("prefix", F.transform(F.slice("ranked", 1, F.col("slots")), lambda x: x["h"]))
    # 4. Groups by prefix and size.  Shingles of frequency 1 are in no other set; bitmaps are of the others.
    ranked = ranked.select("id", "n", F.col("own").cast("int").alias("own"), "prefix", F.xxhash64("n", "prefix").alias("gid"), F.transform("ranked", lambda x: x["h"]).alias("hashes"))
    members = write_table(add_bitmaps(ranked, "hashes"))
    release_shuffles(spark)
    groups = write_table(members.groupBy("gid").agg(
        F.first("n").alias("n"), F.min("own").alias("own"), F.first("prefix").alias("prefix"), F.min(F.struct("own", "id")).alias("pivot"),
        F.array(*[F.bit_and(F.col("bits")[i]) for i in range(BITMAP)]).alias("every"),
        F.array(*[F.bit_or(F.col("bits")[i]) for i in range(BITMAP)]).alias("some")))

    def sizes_fit(a: Column, b: Column) -> Column:
        return (a * t.denominator >= b * t.numerator) & (b * t.denominator >= a * t.numerator)

    def near(apart: Column, a: Column, b: Column) -> Column:
        """Sets that differ in at least so many shingles can still reach the threshold."""
        return apart * (t.denominator + t.numerator) <= (a + b) * (t.denominator - t.numerator)

    def lacking(a: Column, b: Column) -> Column:
        """Bits of a that b lacks: each stands for another shingle."""
        return sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(BITMAP)), F.lit(0))

    def verify(pairs: DataFrame) -> DataFrame:
        one = full.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
        two = full.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
        both = F.size(F.array_intersect("ha", "hb"))
        union = F.size("ha") + F.size("hb") - both
        return pairs.join(one, "a").join(two, "b").where(both * t.denominator >= union * t.numerator).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def pair(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    kept = members.select("id", "n", "own", "bits")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and bitmaps let pass."""
        one, two = (kept.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "own", "bits")]) for side in "ab")
        apart = F.col("own_a") + F.col("own_b") + lacking(F.col("bits_a"), F.col("bits_b")) + lacking(F.col("bits_b"), F.col("bits_a"))
        both = pairs.join(one, "a").join(two, "b")
        return both.where(sizes_fit(F.col("n_a"), F.col("n_b")) & near(apart, F.col("n_a"), F.col("n_b"))).select("a", "b")

    # Each group meets the pivot with which it shares most keys, each member its group's pivot; other pivots follow
    # only where that leaves them in different classes, so most sets are read once.
    postings = groups.select(F.explode("prefix").alias("key"), "pivot")
    pivots = postings.groupBy("key").agg(F.min("pivot").alias("first"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    star = postings.join(pivots, "key").where(F.col("pivot.id") != F.col("first.id")).groupBy(F.col("pivot.id").alias("p"), F.col("first.id").alias("f")).agg(F.count(F.lit(1)).alias("c"))
    star = write_table(star)
    release_shuffles(spark)
    best = star.groupBy("p").agg(F.max(F.struct("c", (-F.col("f")).alias("f"))).alias("m")).select("p", (-F.col("m.f")).alias("f"))
    own = members.join(groups.select("gid", "pivot"), "gid").where(F.col("id") != F.col("pivot.id")).select(*pair("id", "pivot.id"))
    links = write_table(verify(write_table(bounded(best.select(*pair("p", "f")).union(own).distinct()))))
    release_shuffles(spark)
    classes = write_table(components(links))
    named = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    other = star.select(*pair("p", "f")).distinct().join(named("a"), "a", "left").join(named("b"), "b", "left")
    other = other.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    found = write_table(verify(write_table(bounded(other))))
    drop_table(star)
    release_shuffles(spark)
    if not found.isEmpty():
        links = write_table(classes.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")).union(found))
        classes = write_table(components(links))
    plain, members = members, write_table(members.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component", "prefix"))
    drop_table(plain)
    span = members.groupBy("gid").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    spread = spread_table = write_table(groups.join(span, "gid").select(F.explode("prefix").alias("key"), "gid", "n", "own", "every", "some", "lo", "hi"))
    # Keys whose groups are all in one class are done.
    open_keys = spread.groupBy("key").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("key")
    spread = spread.join(open_keys, "key", "left_semi")
    x, y = spread.alias("x"), spread.alias("y")
    done = (F.col("x.lo") == F.col("y.hi")) & (F.col("x.hi") == F.col("y.lo"))
    apart = F.col("x.own") + F.col("y.own") + lacking(F.col("x.every"), F.col("y.some")) + lacking(F.col("y.every"), F.col("x.some"))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.gid") <= F.col("y.gid")) & ~done
    meet = meet & sizes_fit(F.col("x.n"), F.col("y.n")) & near(apart, F.col("x.n"), F.col("y.n"))
    release_shuffles(spark)
    meetings = write_table(x.join(y, meet).select(F.col("x.gid").alias("gx"), F.col("y.gid").alias("gy")).distinct())
    drop_table(groups)
    drop_table(spread_table)
    release_shuffles(spark)
    p = members.select(F.col("gid").alias("gx"), F.col("id").alias("ix"), F.col("n").alias("nx"), F.col("class").alias("cx"), F.col("own").alias("ox"), F.col("bits").alias("bx"))
    q = members.select(F.col("gid").alias("gy"), F.col("id").alias("iy"), F.col("n").alias("ny"), F.col("class").alias("cy"), F.col("own").alias("oy"), F.col("bits").alias("by"))
    apart = F.col("ox") + F.col("oy") + lacking(F.col("bx"), F.col("by")) + lacking(F.col("by"), F.col("bx"))
    cross = meetings.join(p, "gx").join(q, (meetings["gy"] == q["gy"]) & (F.col("cx") != F.col("cy")) & near(apart, F.col("nx"), F.col("ny")))
    more = write_table(verify(write_table(cross.select(*pair("ix", "iy")).distinct())))
    if not more.isEmpty():
        classes = components(links.union(more))
    # 5. Classes are named by their smallest document.
    linked = likely.join(classes, "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = linked.join(least, "component").select("doc_id", *digest, F.col("least").alias("component"))
    named = reps.join(linked, ["doc_id", *digest], "left").select(*digest, F.coalesce("component", "doc_id").alias("component"))
    out = sets.join(named, digest, "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))

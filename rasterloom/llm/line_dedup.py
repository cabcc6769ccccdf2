"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line is what stands between line feeds, without white space at its ends.  Its
shingles are all runs of ``k`` characters (a shorter line is one shingle as a
whole).  Lines are near-duplicates if the Jaccard similarity of their distinct
shingles is at least ``threshold``; classes are connected components, and of
every class only the first line in order of (doc_id, place) stays.

1. Signatures.  Every shingle of every line is hashed to 64 bits, and an
   aggregation keeps, for ``rows * bands`` fixed masks, the least hash under
   each mask (hash XOR mask).  Equal lines (128 bits of hash) collapse in the
   same aggregation, before the shuffle.  A band is ``rows`` of those minima:
   lines of similarity s share one with a chance of 1 - (1 - s ** rows) ** bands,
   0.99 at 0.8 with 3 rows and 7 bands, 0.9997 at 0.9.
2. Band keys that two different lines have are counted out; only their lines,
   few, are read again, with their number of shingles and a bitmap of those.
3. Lines that share a key are verified on all their shingles exactly, and
   linked by distributed union-find (``components.py``): pairs are first
   bounded by size and bitmap, and a key's pairs within one class never listed.

Edge cases: null and empty texts have no lines to drop and come back as they
are; blank lines always stay; rows with a null doc_id come back as they are and
are no copies of others; of equal first lines, from repeated rows, each row
keeps its own; rows of one doc_id with different texts lose only the lines that
are no first ones in each; very long lines are taken whole; an empty table gives
an empty result; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from operator import or_
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, few, fresh_name, release_shuffles, write_table
from .components import cluster

FEED = "\n"
#: What is taken off the ends of a line.
BLANK = " \t\r\x0b\x0c"
#: Longs in the bitmap of a line's shingles; with 32 the conditions of a join grow beyond what the JVM compiles.
BITMAP = 16
#: Longs in the bitmap of a line in a key of many, where few lines are left: each a column of its own.
DEEP = 48
#: Rows of a table of a few numbers that is broadcast to all lines or documents instead of shuffling those: 20 MB or so.
FEW = 300_000
#: Bytes of a character as ``encode`` writes it: fixed, so that any shingle is found at once.
WIDE, CODE = 4, "UTF-32"
#: Shingles of a line that are signed in one row.
RUN = 4


def trimmed(line: Column) -> Column:
    """``line`` without white space at its ends; few lines have any, and a trim by a set of characters looks at all of a line."""
    odd = reduce(or_, [line.startswith(F.lit(c)) | line.endswith(F.lit(c)) for c in BLANK])
    return F.when(odd, F.trim(line, F.lit(BLANK))).otherwise(line)


def _places(wide: Column, k: int) -> Column:
    """Where the shingles of an encoded line begin (from 1)."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - WIDE * k + 1, F.lit(1)), F.lit(WIDE))


def _shingle(wide: Column, place: Column, k: int) -> Column:
    return F.xxhash64(F.substring(wide, place, F.lit(WIDE * k)))


def _runs(line: Column, k: int) -> Column:
    """Hashes of all runs of k characters, repeated ones too."""
    return _let(F.encode(line, CODE), lambda wide: F.transform(_places(wide, k), lambda at: _shingle(wide, at, k)))


def shingles(line: Column, k: int) -> Column:
    """Hashes of all distinct runs of k characters; of the whole line if it is shorter."""
    return F.array_distinct(_runs(line, k))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _lower(a: Column, b: Column) -> Column:
    # Not F.least: which of two hashes is lower can't be predicted, and only a plain choice compiles to code without a jump.
    return F.call_function("if", a < b, a, b)


def signatures(lines: DataFrame, *, k: int, rows: int, bands: int) -> DataFrame:
    """(h1, h2, keys): the band keys of each distinct line of ``lines`` (h1, h2, line)."""
    random = Random(31)
    masks = [F.lit(random.getrandbits(64) - (1 << 63)) for _ in range(rows * bands)]
    wide = lines.select("h1", "h2", F.encode("line", CODE).alias("wide"))
    wide = wide.select("h1", "h2", "wide", F.greatest(F.length("wide") - WIDE * k + 1, F.lit(1)).alias("last"))
    # RUN shingles a row, so that a row's way into the aggregation is paid for once; behind the last one that one again, which changes no minimum.
    each = wide.select("h1", "h2", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(WIDE * RUN))).alias("at"))
    run = [_shingle(F.col("wide"), _lower(F.col("at") + WIDE * j, F.col("last")), k).alias(f"g{j}") for j in range(RUN)]
    each = each.select("h1", "h2", *run)
    # The lowest of a row's RUN hashes under each mask, by two and two: a projection a round, as its columns are worked out once.
    low = [[F.col(f"g{j}").bitwiseXOR(mask) for j in range(RUN)] for mask in masks]
    while len(low[0]) > 1:
        pairs = [[_lower(*x[at : at + 2]) if at + 1 < len(x) else x[at] for at in range(0, len(x), 2)] for x in low]
        names = [[f"m{m}_{at}" for at in range(len(x))] for m, x in enumerate(pairs)]
        each = each.select("h1", "h2", *[c.alias(n) for x, y in zip(pairs, names) for c, n in zip(x, y)])
        low = [[F.col(n) for n in x] for x in names]
    least = each.groupBy("h1", "h2").agg(*[F.min(x[0]).alias(f"m{m}") for m, x in enumerate(low)])
    keys = [F.xxhash64(*[f"m{rows * b + r}" for r in range(rows)]) for b in range(bands)]
    return least.select("h1", "h2", F.array(*keys).alias("keys"))


def marked(lines: DataFrame, k: int, words: int) -> DataFrame:
    """(id, n, ones, b0, b1, ...): of each of ``lines`` (id, line) the number of shingles and a bitmap of them, of so many ``words``, with the number of its ones."""
    # BITMAP words an aggregation: with more of them it grows beyond what the JVM compiles.
    parts = [_marked(lines, k, words, range(at, min(at + BITMAP, words))) for at in range(0, words, BITMAP)]
    maps = reduce(lambda a, b: a.join(b.drop("n"), "id"), parts)
    names = [f"b{w}" for w in range(words)]
    return maps.select("id", "n", sum((F.bit_count(b) for b in names), F.lit(0)).cast("long").alias("ones"), *names)


def _marked(lines: DataFrame, k: int, words: int, some: range) -> DataFrame:
    sets = lines.select("id", shingles(F.col("line"), k).alias("s"))
    rows = sets.select("id", "s", F.size("s").alias("n"), F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(RUN))).alias("at"))
    rows = rows.select("id", "n", *[F.col("s")[_lower(F.col("at") + j, F.col("n") - 1)].alias(f"h{j}") for j in range(RUN)])
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(f"h{j}", 16).bitwiseAND(63).cast("int")).alias(f"t{j}") for j in range(RUN)]
    rows = rows.select("id", "n", *[F.pmod(f"h{j}", F.lit(words)).alias(f"w{j}") for j in range(RUN)], *bits)
    none = F.lit(0).cast("long")
    word = lambda w: reduce(Column.bitwiseOR, [F.call_function("if", F.col(f"w{j}") == w, F.col(f"t{j}"), none) for j in range(RUN)])
    return rows.groupBy("id").agg(F.max("n").cast("long").alias("n"), *[F.coalesce(F.bit_or(word(w)), none).alias(f"b{w}") for w in some])


def _packed(place: Column, h1: Column) -> Column:
    """A place and half of the line's hash in one number."""
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(h1.bitwiseAND(F.lit(0xFFFFFFFF)))


def gone_lines(
    docs: DataFrame, *, k: int = 10, rows: int = 3, bands: int = 7, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, gone): for each document with lines to drop, their places in it (from 0) and halves of their hashes, packed."""
    spark = docs.sparkSession
    # Whole numbers: in doubles, pairs at exactly the threshold would be lost.
    least = Fraction(str(threshold))
    part, whole = least.numerator, least.denominator
    pick = F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    exploded = docs.select(*pick).where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", FEED)).alias("place", "line"))
    exploded = exploded.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    exploded = exploded.select("doc_id", "place", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    # 1. Places of all lines, band keys of distinct ones.
    lines = write_table(exploded.drop("line"))
    signed = write_table(signatures(exploded, k=k, rows=rows, bands=bands))
    release_shuffles(spark)
    # 2. Keys that more than one line has, and the lines that have them.
    keys = signed.select("h1", "h2", F.explode(F.array_distinct("keys")).alias("key"))
    shared = write_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    release_shuffles(spark)
    found = write_table(keys.join(few(shared, FEW), "key", "left_semi"))
    drop_table(signed)
    drop_table(shared)
    release_shuffles(spark)
    some = found.select("h1", "h2").distinct()
    first = lines.join(some, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    some = write_table(first.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "at.*"))
    where = few(some, FEW).select("id", F.col("doc_id").alias("_d"), F.col("place").alias("_p"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    same = (F.col("doc_id") == F.col("_d")) & (F.col("place") == F.col("_p")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    texts = write_table(exploded.join(where, same).groupBy("id").agg(F.first("line").alias("line")))
    release_shuffles(spark)
    marks = write_table(marked(texts, k, BITMAP).select("id", "n", "ones", F.array(*[f"b{w}" for w in range(BITMAP)]).alias("bits")))
    plain, texts = texts, write_table(texts.join(marks.select("id", "n"), "id"))
    drop_table(plain)
    postings = found.join(some.select("id", "h1", "h2"), ["h1", "h2"]).select("key", "id")
    postings = write_table(postings.join(marks, "id").select("key", "id", "n", "bits", "ones"))
    drop_table(found)
    release_shuffles(spark)

    # 3. Sets of a and b can be near only if 2 * both * (whole + part) >= 2 * part * (a + b), so if what either
    # lacks is at most (whole - part) / (whole + part) of both sizes.
    def near(lacking: Column, na: Column, nb: Column) -> Column:
        return lacking * (whole + part) <= (na + nb) * (whole - part)

    def sizes(na: Column, nb: Column) -> Column:
        return (na * whole >= nb * part) & (nb * whole >= na * part)

    def enough(both: Column, one: Column, na: Column, other: Column, nb: Column) -> Column:
        """Whether ``both`` bits in common of ``one`` and ``other`` leave few enough alone: each of those stands for a shingle that the other side lacks."""
        a, b = 2 * one - na + nb, 2 * other - nb + na
        return near(F.call_function("if", a < b, b, a) - 2 * both, na, nb)

    def common(a: list[Column], b: list[Column]) -> Column:
        return sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b)), F.lit(0))

    def compatible(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        both = common(*[[F.col(f"{c}.bits")[w] for w in range(BITMAP)] for c in (a, b)])
        return sizes(na, nb) & enough(both, F.col(f"{a}.ones"), na, F.col(f"{b}.ones"), nb)

    def deep_compatible(a: str, b: str) -> Column:
        """Sharper bounds: by the bits and then by the lowest 16 bits of all hashes.  What is longer than this is not compiled by the JVM."""
        na, nb, sa, sb = F.col(f"{a}_n"), F.col(f"{b}_n"), F.col(f"{a}_low"), F.col(f"{b}_low")
        both = common(*[[F.col(f"{c}_b{w}") for w in range(DEEP)] for c in (a, b)])
        by_bits = enough(both, F.col(f"{a}_ones"), na, F.col(f"{b}_ones"), nb)
        return sizes(na, nb) & by_bits & near(F.size(sa) + F.size(sb) - 2 * F.size(F.array_intersect(sa, sb)), na, nb)

    def deep(ids: DataFrame) -> DataFrame:
        some = texts.join(ids.distinct(), "id", "left_semi").select("id", "line")
        low = F.array_distinct(F.transform(shingles(F.col("line"), k), lambda h: h.bitwiseAND(0xFFFF).cast("int")))
        return marked(some, k, DEEP).join(some.select("id", low.alias("low")), "id")

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("n").alias("na"))
        two = one.select(F.col("a").alias("b"), F.col("la").alias("lb"), F.col("na").alias("nb"))
        sets = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", _runs(F.col("la"), k).alias("ra"), _runs(F.col("lb"), k).alias("rb"))
        both = F.size(F.array_intersect("ra", "rb"))
        return sets.where(both * (whole + part) >= part * (F.col("na") + F.col("nb"))).select("a", "b")

    classes = cluster(postings, verify, order=F.struct("id"), compatible=compatible, extra=("n", "bits", "ones"), deep=deep, deep_compatible=deep_compatible)
    # A line goes if it isn't the first of its class; equal lines are a class, too.
    named = classes.join(some.select("id", "h1", "h2"), "id").select("h1", "h2", "component")
    named = write_table(named)
    copies = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    several = named.select("h1", "h2").union(copies).distinct()
    touched = lines.join(several, ["h1", "h2"]).join(named, ["h1", "h2"], "left")
    # A class is named by its number, or (of equal lines alone) by their hash.
    label = F.when(F.col("component").isNotNull(), F.struct(F.col("component").alias("x"), F.lit(None).cast("long").alias("y"))).otherwise(F.struct(F.col("h1").alias("x"), F.col("h2").alias("y")))
    touched = write_table(touched.select("doc_id", "place", "h1", label.alias("label")))
    drop_table(lines)
    release_shuffles(spark)
    keepers = touched.groupBy("label").agg(F.min(F.struct("doc_id", "place")).alias("keeper"))
    gone = touched.join(keepers, touched["label"].eqNullSafe(keepers["label"]))
    gone = gone.where((F.col("doc_id") != F.col("keeper.doc_id")) | (F.col("place") != F.col("keeper.place")))
    return gone.groupBy("doc_id").agg(F.collect_set(_packed(F.col("place"), F.col("h1"))).alias("gone"))


def dedup_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", dropped: str | None = None, **options,
) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text``; ``dropped`` names a column for their number."""
    places = write_table(gone_lines(docs, text=text, doc_id=doc_id, **options))
    n, numbers = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    key, gone = fresh_name(docs, "dedup_id"), fresh_name(docs, "dedup_gone")
    small = n <= FEW and numbers <= 8 * FEW
    places = (F.broadcast(places) if small else places).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    rows = docs.join(places, F.col(f"`{doc_id}`").cast("long") == F.col(key), "left")
    # A projection a step, as each of its columns is worked out once: only texts with lines to drop are split.
    split, stay = fresh_name(docs, "dedup_lines"), fresh_name(docs, "dedup_stay")
    rows = rows.select("*", F.when(F.col(gone).isNotNull(), F.split(F.col(f"`{text}`"), FEED)).alias(split))
    marks = F.transform(split, lambda line, at: _packed(at, F.xxhash64(trimmed(line))))
    rows = rows.select("*", F.array_except(marks, F.col(gone)).alias(stay))
    kept = F.transform(stay, lambda x: F.col(split)[F.shiftright(x, 32).cast("int")])
    changed = F.when(F.col(stay).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, FEED))
    columns = [changed.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns]
    if dropped:
        columns.append(F.when(F.col(stay).isNull(), F.lit(0)).otherwise(F.size(split) - F.size(stay)).cast("long").alias(dropped))
    return rows.select(*columns)

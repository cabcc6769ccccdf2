"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets.  The sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
and share all words by weight.  No target may pass ``cap`` times the words of
its source; the excess goes to the others by weight.  The fixed point of that
resharing is a water level L with ``target = min(cap * words, weight * L)``,
found in closed form over one row per source.

Copies.  A document of x words has the inclusion measure ``g(x) = floor(sqrt(x))``
(longer documents are somewhat likelier; 0 for documents without words) and
expects ``min(cap, c * g(x))`` copies, with c of its source such that the
expected words meet the target.  The whole part is taken for certain.  The
fraction p is an inclusion probability: the documents of a source are ranked by
Pareto's ``(u / (1 - u)) / (p / (1 - p))`` with u a keyed hash of doc_id and text,
and taken in that order while the words taken come nearer to the target.  Two
rounds of histograms over all documents find where each source's order ends, so
no source is ever sorted as a whole.

Edge cases: null or empty texts have size 0 and take nothing; null and repeated
doc_ids are documents of their own by their texts; ties of the rank go by
doc_id, and of rows equal in doc_id and text as many are taken as the target
asks for, whichever; very long texts count whole; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, write_table

BINS = 1024
UNIT = float(1 << 52)


def unit_hash(key: Column, seed: str) -> Column:
    """A double in (0, 1) from the first 52 bits of md5(seed:key), the same on every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(UNIT)


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size); one row per source.

    The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # Capped sources are those with the least room per weight.  Walk them in that order:
    # with the first k capped the level is (all - caps of those k) / (weights of the rest).
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    zero = F.lit(0).cast("long")
    per = per.select(
        "*",
        (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), zero)).alias("_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).alias("_open"),
    )
    # The first source in this order that is not capped fixes the level; the caps together always suffice.
    level = F.col("_left") / F.col("_open")
    per = per.withColumn("_level", F.when(cap * F.col("source_size") >= F.col("weight") * level, level))
    per = per.withColumn("_level", F.max("_level").over(whole))
    capped = (cap * F.col("source_size")).cast("double")
    target = F.least(capped, F.coalesce(F.col("weight") * F.col("_level"), capped))
    return per.select("source", "source_size", "weight", target.alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source, size, target, copies): expected copies of a document by source and size.

    Works on one row per source and distinct size.  ``copies = min(cap, c * g)``
    grows with size, so the capped sizes are the largest ones; c is read off at
    the largest size that is not capped.
    """
    g = F.floor(F.sqrt(F.col("size").cast("double"))).cast("long")
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", g)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("source")
    by_size = by_size.select(
        "*",
        F.sum(F.col("_n") * F.col("size")).over(up).alias("_words_up"),
        F.sum(F.col("_n") * F.col("size")).over(every).alias("_words"),
        F.sum(F.col("_n") * F.col("size") * F.col("_g")).over(up).alias("_mass_up"),
    )
    t = targets.select(F.col("source").alias("_source"), "target")
    by_size = by_size.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # With this size the largest one that is not capped:
    c = (F.col("target") - cap * (F.col("_words") - F.col("_words_up"))) / F.col("_mass_up")
    by_size = by_size.withColumn("_c", F.when((c > 0) & (c * F.col("_g") <= cap), c))
    found = F.max(F.when(F.col("_c").isNotNull(), F.struct("size", "_c"))).over(every)["_c"]
    return by_size.select("source", "size", F.least(F.lit(float(cap)), F.coalesce(found * F.col("_g"), F.lit(float(cap)))).alias("copies"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(rows: DataFrame, bounds: DataFrame, level: str) -> DataFrame:
    """Per source, the bin of ``level`` in which the words taken in order reach what is left to take."""
    joined = _with(rows, bounds.select(F.col("source").alias("_s"), "_rest"), _same("source", "_s"), "_s").drop("_s")
    bins = joined.groupBy("source", level, "_rest").agg(F.sum("size").alias("_bin_words"))
    upto = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_before", F.sum("_bin_words").over(upto) - F.col("_bin_words"))
    return bins.where("_before <= _rest").groupBy("source").agg(
        F.max(F.struct(level, (F.col("_rest") - F.col("_before")).alias("_rest"))).alias("_m")
    ).select("source", F.col(f"_m.{level}").alias(f"_cut_{level}"), F.col("_m._rest").alias("_rest"))


#: A table of few rows is broadcast up to so many rows and bytes of its source names.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 24
#: Parts into which a source's rows are dealt where its one row is too much to broadcast.
SALTS = 32


def _with(rows: DataFrame, few: DataFrame, on: Column, source: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row a source, or a source and size, without a shuffle of ``rows`` if it is small."""
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(source).cast("string"))), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), on, how)
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int"))
    return rows.join(few, on & (F.col("_deal") == F.col("_salt")), how).drop("_salt", "_deal")


def _sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: str) -> DataFrame:
    """``docs`` with _id, _source, _size and _u, a hash of doc_id and text in (0, 1)."""
    key = F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("null")))
    return docs.select(
        "*", F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("_size"), unit_hash(key, seed).alias("_u"))


def _ranked(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """With certain copies, the Pareto rank q of the rest, and the two bins of q."""
    few = rates.select(F.col("source").alias("_rs"), F.col("size").alias("_rz"), F.col("copies").alias("_copies"))
    rows = _with(sized, few, _same("_source", "_rs") & (F.col("_size") == F.col("_rz")), "_rs", "left").drop("_rs", "_rz")
    copies = F.coalesce("_copies", F.lit(0.0))
    p, u = copies - F.floor(copies), F.col("_u")
    rows = rows.withColumn("_certain", F.floor(copies).cast("long")).withColumn("_q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))).drop("_copies")
    # q / (1 + q) lies in (0, 1) and keeps the order; its binary digits are the bins of the two rounds.
    place = F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * float(BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    return rows.withColumn("_bin", F.floor(place / BINS).cast("long")).withColumn("_sub", place % BINS)


def _limits(sized: DataFrame, cap: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Expected copies by source and size, and where each source's order ends: one row a source.

    ``_end`` is the last (q, id) taken; of the ``_tied`` rows that have it (rows
    equal in id and text) ``_take`` are taken.
    """
    sizes = sized.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    targets = write_table(source_targets(sizes, cap, weights))
    rates = write_table(expected_copies(sizes, targets, cap))
    ranked = write_table(_ranked(sized, rates).select(
        "_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "_u", "_certain", "_q", "_bin", "_sub"))
    taken = ranked.groupBy("source").agg(F.sum(F.col("_certain") * F.col("size")).alias("_taken"))
    rest = write_table(targets.join(taken.select(F.col("source").alias("_s"), "_taken"), _same("source", "_s")).select(
        "source", "source_size", "target", (F.col("target") - F.col("_taken")).alias("_rest")))
    open_rows = ranked.where("_q is not null")
    first = write_table(_cut(open_rows, rest, "_bin"))
    inside = _with(open_rows, first.select(F.col("source").alias("_s"), "_cut__bin"), _same("source", "_s") & (F.col("_bin") == F.col("_cut__bin")), "_s").drop("_s", "_cut__bin")
    second = write_table(_cut(inside, first, "_sub"))
    last = _with(inside, second.withColumnRenamed("source", "_s"), _same("source", "_s") & (F.col("_sub") == F.col("_cut__sub")), "_s").drop("_s")
    order = Window.partitionBy("source").orderBy("_q", F.col("_id").asc_nulls_first(), "size")
    last = last.withColumn("_run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The document that crosses the target is taken if that ends nearer to it than without.
    goes = F.col("_run") - F.col("size") / 2.0 <= F.col("_rest")
    tied = last.groupBy("source", _rank().alias("_end")).agg(F.count(F.when(goes, 1)).alias("_take"), F.count(F.lit(1)).alias("_tied"))
    ends = tied.where("_take > 0").groupBy("source").agg(F.max(F.struct("_end", "_take", "_tied")).alias("_m")).select("source", "_m.*")
    limits = (
        rest.join(first.select(F.col("source").alias("_s1"), "_cut__bin"), _same("source", "_s1"), "left")
        .join(second.select(F.col("source").alias("_s2"), "_cut__sub"), _same("source", "_s2"), "left")
        .join(ends.withColumnRenamed("source", "_s3"), _same("source", "_s3"), "left")
        .select(F.col("source").alias("_s"), F.col("source_size").alias("_words"), F.col("target").alias("_target"), "_cut__bin", "_cut__sub", "_end", "_take", "_tied"))
    return rates, write_table(limits)


def _rank() -> Column:
    return F.struct(F.col("_q").alias("q"), F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63))).alias("id"))


def _thin(sized: DataFrame) -> DataFrame:
    """Four values a document, written once: texts are not read again for sums, rates and limits."""
    return write_table(sized.select("_id", "_source", "_size", "_u"))


def _mixed(sized: DataFrame, thin: DataFrame, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """``sized`` with _words and _target of the source, and _copies; ``thin`` are the same rows."""
    rates, limits = _limits(thin, cap, weights)
    rows = _with(_ranked(sized, rates), limits, _same("_source", "_s"), "_s")
    at_end = F.coalesce(_rank() == F.col("_end"), F.lit(False))
    before = (F.col("_bin") < F.col("_cut__bin")) | ((F.col("_bin") == F.col("_cut__bin")) & (
        (F.col("_sub") < F.col("_cut__sub")) | ((F.col("_sub") == F.col("_cut__sub")) & (_rank() <= F.col("_end")))))
    before = F.coalesce(before, F.lit(False))
    split = at_end & (F.col("_take") < F.col("_tied"))
    whole = rows.where(~split).withColumn("_copies", F.col("_certain") + before.cast("long"))
    if limits.where("_take < _tied").isEmpty():
        return whole
    # Equal rows at the very end: it is all the same which of them are taken, so they are numbered in any order.
    number = F.row_number().over(Window.partitionBy("_source").orderBy("_u"))
    tied = rows.where(split).withColumn("_copies", F.col("_certain") + (number <= F.col("_take")).cast("long"))
    return whole.unionByName(tied)


def mix_sources(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix",
) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies) per input row; see the module."""
    thin = _thin(_sized(docs, text, source, doc_id, seed))
    mixed = _mixed(thin, thin, cap, weights)
    return mixed.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_words").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"))


def mix_documents(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it."""
    # Under names of our own, so that no other column of docs can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    sized = _sized(docs.toDF(*names), of[text.lower()], of[source.lower()], of[doc_id.lower()], seed)
    mixed = _mixed(sized, _thin(sized), cap, weights)
    taken = mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return taken.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])

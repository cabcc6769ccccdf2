"""Near-duplicate classes from shared keys, in DataFrame operations only.

``components`` is distributed union-find by alternating large-star and
small-star steps (Kiveris et al., 2014): every step is a minimum by key and a
join, so a vertex with any number of links is never gathered in one place.  Two
numbers a step reach the driver, and up to FEW_EDGES edges, which are united there.

``cluster`` turns (key, id) postings into classes without listing all pairs of
a key: members are verified against pivots first, and then only members outside
a key's largest class against those of other classes.  Which members share a
class is exactly what verifying all pairs of each key would give.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Link u[k] with v[k] in ``root``, which names the smallest place linked with each, before and after."""
    while True:
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, further := root[root]):
            root[:] = further


def _fingerprint(edges: DataFrame) -> tuple:
    # A sum of 64-bit hashes as decimal never overflows and does not depend on order.
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


#: Up to so many edges are united on the driver (up to 7 MB of them): dozens of small jobs would cost it more memory and time.
FEW_EDGES = 200_000
#: Pairs of a key that meet in one place, where a key has many.
PAIRS_A_CELL = 1 << 21


def _united(edges: DataFrame) -> DataFrame:
    """:func:`components` of few edges, on the driver."""
    table = edges.toArrow()
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks], table.schema.field("u").type).combine_chunks()
    parts = ends.flatten() if pa.types.is_struct(ends.type) else [ends]
    order = pc.sort_indices(pa.table(parts, list(map(str, range(len(parts))))), [(str(k), "ascending") for k in range(len(parts))])
    new = np.zeros(len(ends), bool)
    new[:1] = True
    for part in parts:
        sorted_part = part.take(order)
        new[1:] |= pc.not_equal(sorted_part[1:], sorted_part[:-1]).to_numpy(zero_copy_only=False)
    order = order.to_numpy()
    place = np.empty(len(ends), np.int64)
    place[order] = np.cumsum(new) - 1
    vertices = ends.take(pa.array(order[new]))
    root = np.arange(len(vertices))
    unite(root, place[: len(table)], place[len(table) :])
    return edges.sparkSession.createDataFrame(pa.table([vertices, vertices.take(pa.array(root))], ["id", "component"]))


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (u, v); the component is its smallest vertex."""
    edges = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _fingerprint(edges)
    for _ in range(max_steps):
        if not state[0]:
            break
        if state[0] <= FEW_EDGES:
            found = _united(edges)
            drop_table(edges)
            return found
        # Large star: each larger neighbour of u joins the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: each smaller neighbour of u, and u, joins the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        following = write_table(small)
        drop_table(edges)
        edges, before, state = following, state, _fingerprint(following)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def cluster(
    postings: DataFrame, verify: Callable[[DataFrame], DataFrame], *,
    order: Column, compatible: Callable[[str, str], Column], extra: tuple[str, ...] = (),
    deep: Callable[[DataFrame], DataFrame] | None = None, deep_compatible: Callable[[str, str], Column] | None = None, few: int = 32, pivots: int = 4,
) -> DataFrame:
    """Classes (id, component) of the ids in ``postings`` (key, id, *extra); ids without a link are left out.

    ``order`` ranks members as first pivots (smallest first; it must end with the
    id); ``compatible(a, b)`` is a cheap necessary condition on the struct
    columns a and b of two members; ``verify`` filters pairs (a, b) down to true
    links.  Every pair that shares a key and is compatible is verified, unless
    both are in one class already:

    1. Every member meets its key's pivot.
    2. In keys where more than ``few`` members are outside the largest class,
       every member meets ``pivots`` more of those.
    3. Members outside the largest class of their key meet all members of other
       classes.  In keys with more than ``few`` of them a sharper necessary
       condition, ``deep_compatible("x", "y")`` on the columns of ``deep(ids)`` (id, ...) as x_id, ... and y_id, ...,
       takes the place of ``compatible``, so that what cannot be a link never becomes a row.
    """
    member = F.struct("id", *extra)
    met: list[DataFrame] = []

    def meet(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
        pairs = left.join(right, condition).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
        for earlier in met:  # what was no link when it was verified is none now
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        met.append(write_table(pairs))
        return write_table(verify(met[-1]).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def labelled(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their classes, of keys with several; and of those keys the largest class and how many are outside."""
        every = postings.join(classes, "id", "left").select("key", member.alias("m"), F.coalesce("component", "id").alias("c"))
        every = write_table(every)
        sizes = every.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
        keys = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
        keys = write_table(keys.select("key", F.col("top.c").alias("largest"), (F.col("all") - F.col("top.n")).alias("others"), "all").where("others > 0"))
        return every.join(keys, "key"), keys

    first = postings.groupBy("key").agg(F.min_by(member, order).alias("q"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = postings.select("key", member.alias("p"))
    links = meet(star, first.select(F.col("key").alias("k"), "q"), (F.col("key") == F.col("k")) & (F.col("p.id") != F.col("q.id")) & compatible("p", "q"))
    classes = write_table(components(links))
    every, keys = labelled(classes)
    if not keys.where(F.col("others") > few).isEmpty():
        many = every.where(F.col("others") > few)
        outside = many.where("c <> largest").groupBy("key")
        some = outside.agg(F.array(*[F.min_by(F.struct("m", "c"), F.struct(F.xxhash64(F.lit(j), "m.id"), "m.id")) for j in range(pivots)]).alias("some"))
        some = some.select(F.col("key").alias("k"), F.explode(F.array_distinct("some")).alias("x")).select("k", F.col("x.m").alias("q"), F.col("x.c").alias("d"))
        new = meet(many.withColumnRenamed("m", "p"), some, (F.col("key") == F.col("k")) & (F.col("c") != F.col("d")) & compatible("p", "q"))
        stars = classes.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        classes = write_table(components(stars.union(new)))
        every, keys = labelled(classes)
    # Both sides outside the largest class meet once.
    across = (F.col("key") == F.col("k")) & (F.col("c") != F.col("d")) & ((F.col("d") == F.col("largest")) | (F.col("p.id") < F.col("q.id")))
    left, right = every.where("c <> largest").withColumnRenamed("m", "p"), every.select(F.col("key").alias("k"), F.col("m").alias("q"), F.col("c").alias("d"), F.col("others").alias("o"))
    if deep is None:
        more = meet(left, right, across & compatible("p", "q"))
    else:
        more = meet(left.where(F.col("others") <= few), right.where(F.col("o") <= few), across & compatible("p", "q"))
        if not keys.where(F.col("others") > few).isEmpty():
            many = keys.where(F.col("others") > few)
            known = write_table(deep(postings.join(many.select("key"), "key", "left_semi").select("id")))
            # Flat columns: a condition reads them at once, those of a struct anew for each mention.
            # Numbers are told to be no nulls, which a table read from files doesn't know: each test for one is code in the condition.
            sure = lambda c: F.coalesce(c, F.lit(0).cast("long")) if known.schema[c].dataType.typeName() == "long" else F.col(c)
            own, other = (known.select(*[sure(c).alias(f"{side}_{c}") for c in known.columns]) for side in "xy")
            # Their pairs are dealt by hand: rows with these columns are large, and adaptive execution would cut both sides
            # of a skewed key into pieces of a size and make a task of every two.  A grid of ``down`` by ``along`` cells
            # has each pair of a key in one cell, with about PAIRS_A_CELL pairs in each.
            cells = F.ceil(F.col("others") * F.col("all") / PAIRS_A_CELL)
            down = F.greatest(F.lit(1), F.least(F.col("others"), F.round(F.sqrt(cells * F.col("others") / F.col("all"))).cast("long")))
            along = F.ceil(cells / down)
            upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
            place = lambda m, n: F.pmod(F.xxhash64(F.col(m)), n)
            left = every.where("c <> largest").where(F.col("others") > few).select("key", "c", "largest", F.struct("m.id").alias("p"), place("m.id", down).alias("at"), along.alias("n"), upto(along).alias("to"))
            left = left.select("key", "c", "largest", "p", (F.col("at") * F.col("n") + F.col("to")).alias("cell")).join(own, F.col("p.id") == F.col("x_id"))
            right = every.where(F.col("others") > few).select("key", F.col("c").alias("d"), F.struct("m.id").alias("q"), place("m.id", along).alias("at"), along.alias("n"), upto(down).alias("to"))
            right = right.select(F.col("key").alias("k"), "d", "q", (F.col("to") * F.col("n") + F.col("at")).alias("cell_q")).join(other, F.col("q.id") == F.col("y_id"))
            tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            left, right = left.repartition(tasks, "key", "cell"), right.repartition(tasks, "k", "cell_q")
            more = more.union(meet(left, right, (F.col("cell") == F.col("cell_q")) & across & deep_compatible("x", "y")))
    if more.isEmpty():
        return classes
    return components(classes.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")).union(more))

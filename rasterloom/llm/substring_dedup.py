"""Removal of repeated passages by De Bruijn compaction.

Nodes are runs of ``span - 1`` consecutive words, edges the windows of ``span``
words between two of them; an edge is the pair of its nodes' hashes.  An edge is
repeated in a document if the same words also start in a document of smaller
doc_id; every word under such an edge goes.  What is repeated is judged on the
input.

1. Sieve.  Each window has a minimizer: the smallest hash among its runs of
   ``seed`` words.  Equal windows have equal minimizers, so only windows whose
   minimizer occurs in two documents can be repeated; the others, mostly nearly
   all, never become rows.
2. Edges.  The windows left are kept as runs of node hashes.  Slice by slice
   (``slices`` parts of all edges by hash, so that no more than one part is ever
   shuffled at once) an aggregation finds the distinct edges of two documents,
   with their source: the first document and a place of the edge in it.
3. Compaction.  In- and out-degrees of nodes are counted over those distinct
   edges.  A node with one edge in and one out joins these two; edges that also
   follow each other in one source become one piece at once, and pieces are
   linked to paths by pointer doubling: each join doubles the reach of a piece
   towards the first of its path.
4. Spans.  Slice by slice, edges of documents are joined with the compacted
   ones.  Those on one path that follow each other both in the document and in
   the source are one span (document, place, length, source, place in it).
5. Verification.  The words of every span are read at its place in the source
   and hashed by SHA-256; a span is applied only if the document's own words at
   its place give the same.  If any span fails (two different windows with equal
   hashes), everything is done again with cryptographic hashes of the words.

Edge cases: null and empty texts have no words; texts shorter than a window and
rows with a null doc_id lose nothing and are no source; rows that repeat a
doc_id are not sources of each other; very long texts are one row of numbers
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import claim_worker, drop_table, few, release_shuffles, write_table

#: Rounds of pointer doubling at most: paths of 2**40 pieces.
ROUNDS = 40
#: Branching nodes that are broadcast to the distinct edges instead of shuffling those.
FEW = 300_000


class Hashes:
    """Hashes of words and nodes; ``strong`` ones are cryptographic, ``bits`` keeps so many bits of a node's (to try collisions)."""

    def __init__(self, strong: bool = False, bits: int = 64) -> None:
        self.strong, self.mask = strong, np.uint64((1 << bits) - 1)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.strong:
            return words.hash_words(data, offsets)
        starts, stops, upto = words.spans(data, offsets)
        raw, known = data.tobytes(), {}
        out = np.empty(len(starts), np.uint64)
        for i, (a, b) in enumerate(zip(starts, stops, strict=True)):
            word = raw[a:b]
            if word not in known:
                known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            out[i] = known[word]
        return out, upto

    def nodes(self, hashed: np.ndarray, upto: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``span - 1`` words, and runs before each row's end."""
        found, starts, ends = words.windows(hashed, upto, span - 1)
        if self.strong:
            digest = lambda i: hashlib.blake2b(hashed[i : i + span - 1].tobytes(), digest_size=8).digest()
            return np.frombuffer(b"".join(map(digest, starts)), np.uint64), ends
        return found & self.mask, ends


def _minimizers(hashed: np.ndarray, upto: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window's minimizer, and windows before each row's end."""
    n = len(hashed) - seed + 1
    counts = np.maximum(np.diff(upto) - span + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    h = hashed[:n] * words._STEP[21]
    for j in range(1, seed):
        h = h + hashed[j : j + n] * words._STEP[21 + j]
    h = words.mix(h)
    starts = np.arange(ends[-1]) - np.repeat(ends[:-1], counts) + np.repeat(upto[:-1], counts)
    # Minima over spans of growing length, each from two shorter ones.
    width, have, least = span - seed + 1, 1, h
    while have < width:
        shift = min(have, width - have)
        least = np.minimum(least[: len(least) - shift], least[shift:])
        have += shift
    return least[starts], ends


def _slice(x: Column, y: Column, slices: int, which: int) -> Column:
    """If the edge from x to y is in this slice; the same as :func:`_dealt` says."""
    return F.pmod(x.bitwiseXOR(y), F.lit(slices)) == which


def _dealt(values: np.ndarray, slices: int) -> np.ndarray:
    return np.mod(values, slices)


def _lists(values: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The rows of ``values`` that end at ``ends``, with what ``keep`` marks of them."""
    upto = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(upto[ends].astype(np.int32), pa.array(values[keep]))


def sieve(docs: DataFrame, span: int, seed: int, hashes: Hashes, slices: int) -> list[DataFrame]:
    """Tables (doc_id, seeds): the distinct minimizers of each document that another row has as well, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("substring_dedup")
        for batch in batches:
            for rows, data, offsets in words.slices(batch, 1):
                least, ends = _minimizers(*hashes.words(data, offsets), span, seed)
                values, ends = words.distinct_sorted(least, ends)
                dealt = _dealt(values, slices)
                yield pa.record_batch([rows.column(0), *(_lists(values, ends, dealt == w) for w in range(slices))], ["doc_id", *names])

    names = [f"seeds{w}" for w in range(slices)]
    seeds = write_table(docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} array<long>" for name in names)))
    parts = []
    for which in range(slices):
        rows = seeds.select("doc_id", F.explode(names[which]).alias("seed"))
        shared = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
        both = rows.join(shared.hint("shuffle_hash"), "seed", "left_semi")
        parts.append(write_table(both.groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))))
        release_shuffles(docs.sparkSession)
    drop_table(seeds)
    return parts


def node_runs(docs: DataFrame, seeds: list[DataFrame], span: int, seed: int, hashes: Hashes, slices: int) -> DataFrame:
    """(doc_id, place, nodes, edges0, ...): runs of windows that the sieve lets pass, as the hashes of their nodes; and where in them the edges of each slice are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("substring_dedup")
        for batch in batches:
            seeds_of, done = batch.column(2), 0
            for rows, data, offsets in words.slices(batch, 1):
                hashed, upto = hashes.words(data, offsets)
                least, ends = _minimizers(hashed, upto, span, seed)
                nodes, node_ends = hashes.nodes(hashed, upto, span)
                keep = np.zeros(len(least), bool)
                for i in range(rows.num_rows):
                    if ends[i] < ends[i + 1]:
                        wanted = seeds_of[done + i].values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                        keep[ends[i] : ends[i + 1]] = np.isin(least[ends[i] : ends[i + 1]], wanted)
                done += rows.num_rows
                # Runs of windows kept, none across rows.
                edge = np.zeros(len(least) + 1, bool)
                edge[ends] = True
                begins = np.flatnonzero(keep & (edge[:-1] | ~np.concatenate([[False], keep[:-1]])))
                stops = np.flatnonzero(keep & (edge[1:] | ~np.concatenate([keep[1:], [False]]))) + 1
                which = np.searchsorted(ends, begins, "right") - 1
                place = begins - ends[which]
                sizes = stops - begins + 1  # a window more has a node more
                lists = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = nodes[np.arange(lists[-1]) + np.repeat(node_ends[which] + place - lists[:-1], sizes)].view(np.int64)
                # Each node of a run begins an edge, but the last one.
                dealt, at = _dealt(flat ^ np.append(flat[1:], 0), slices), np.arange(len(flat), dtype=np.int32) - np.repeat(lists[:-1], np.diff(lists))
                dealt[lists[1:] - 1] = -1
                yield pa.record_batch(
                    [rows.column(0).take(pa.array(which)), pa.array(place, pa.int32()), pa.ListArray.from_arrays(lists, pa.array(flat)), *(_lists(at, lists, dealt == w) for w in range(slices))],
                    ["doc_id", "place", "nodes", *names])

    wanted = seeds[0]
    for part in seeds[1:]:
        wanted = wanted.union(part)
    wanted = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("seeds").alias("seeds"))
    joined = docs.join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "seeds")
    names = [f"edges{w}" for w in range(slices)]
    return write_table(joined.mapInArrow(run, "doc_id long, place int, nodes array<long>, " + ", ".join(f"{name} array<int>" for name in names)))


def _edges(runs: DataFrame, which: int) -> DataFrame:
    """(x, y, doc_id, place): the edges from node x to node y of one slice."""
    each = runs.select("doc_id", "place", "nodes", F.explode(f"edges{which}").alias("i"))
    return each.select(F.col("nodes")[F.col("i")].alias("x"), F.col("nodes")[F.col("i") + 1].alias("y"), "doc_id", (F.col("place") + F.col("i")).alias("place"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``first`` and ``piece`` to edges in order of their sources: an edge that does not follow the one before it in its source begins a piece."""
    claim_worker("substring_dedup")
    context = TaskContext.get()
    last = (context.partitionId() if context else 0) << 40
    for batch in batches:
        source, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        follows = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        same = batch.column(4).fill_null(0).to_numpy() == source
        first = ~(follows & same & (batch.column(5).fill_null(0).to_numpy() == at - 1))
        piece = last + np.cumsum(first)
        last = int(piece[-1]) if len(piece) else last
        yield pa.record_batch([*batch.columns, pa.array(piece), pa.array(first)], [*batch.schema.names, "piece", "first"])


def compact(edges: DataFrame) -> DataFrame:
    """(x, y, source_id, at, path, first) from distinct edges (x, y, source_id, at): maximal paths over nodes of one edge in and one out.

    ``first`` marks edges that do not go on from the edge before them in their source.
    """
    place = [F.col("source_id").alias("s"), F.col("at").alias("p")]
    none = F.lit(None).cast("long")
    ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), "y", *place, none.alias("q"), none.cast("int").alias("r"))
    ends = ends.union(edges.select(F.col("y").alias("node"), F.lit(0), F.lit(1), none, none, none.cast("int"), *place))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), *[F.max(c).alias(c) for c in "yspqr"])
    # A node of one edge out says all of that edge, at place p of source s.  If it has one edge in, at place r of source q, that goes on with it.
    on = F.expr("into = 1 and not (s = q and p = r)")
    heads = degrees.where("out > 0").select(
        F.col("node").alias("x"), "y", F.col("s").alias("source_id"), F.col("p").alias("at"),
        F.when(on, F.col("q")).alias("before_id"), F.when(on, F.col("r")).alias("before_at"), "out")
    heads = write_table(heads)
    release_shuffles(edges.sparkSession)
    branching = few(heads.where("out > 1").select("x"), FEW)
    several = edges.join(branching, "x", "left_semi").select("x", "y", "source_id", "at", none.alias("before_id"), none.cast("int").alias("before_at"))
    linked = heads.where("out = 1").drop("out").union(several)
    # Pieces: edges that follow each other in one source, named by their first edge.
    linked = linked.repartition("source_id").sortWithinPartitions("source_id", "at", "x", "y")
    pieces = write_table(linked.mapInArrow(_pieces, "x long, y long, source_id long, at int, before_id long, before_at int, piece long, first boolean"))
    drop_table(heads)
    release_shuffles(edges.sparkSession)
    # A piece whose first edge follows an edge of another piece hangs on that one.
    links = pieces.where("first and before_id is not null").select("piece", "before_id", "before_at")
    holders = pieces.select(F.col("source_id").alias("before_id"), F.col("at").alias("before_at"), F.col("piece").alias("to"))
    state = write_table(links.join(holders, ["before_id", "before_at"]).groupBy("piece").agg(F.min("to").alias("to")).where("piece <> to"))
    going, before = state.count(), None
    for _ in range(ROUNDS):
        if not going or going == before:  # what never ends is a cycle
            break
        further = state.select(F.col("piece").alias("to"), F.col("to").alias("next"))
        jumped = write_table(state.join(further, "to", "left").select("piece", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        before, going = going, jumped.where("moved").count()
        drop_table(state)
        state = jumped
    paths = pieces.join(state.select("piece", "to"), "piece", "left")
    return paths.select("x", "y", "source_id", "at", F.coalesce("to", "piece").alias("path"), "first")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from edges in order of (doc_id, source_id, shift, place): one ends where a place is missing or a first edge comes."""
    claim_worker("substring_dedup")

    def made(doc, source, shift, start, end) -> pa.RecordBatch:
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end - start + 1, pa.int32()), pa.array(source, pa.int64()), pa.array(start + shift, pa.int32())]
        return pa.record_batch(columns, ["doc_id", "place", "length", "source_id", "at"])

    left = None  # the span that may go on in the next batch: its line, place and end
    for batch in batches:
        if not batch.num_rows:
            continue
        *line, place, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        begins = first.astype(bool)
        begins[1:] |= place[1:] > place[:-1] + 1
        for c in line:
            begins[1:] |= c[1:] != c[:-1]
        begins[0] |= left is None or any(c[0] != x for c, x in zip(line, left, strict=False)) or place[0] > left[4] + 1
        at = np.flatnonzero(begins)
        goes_on = int(at[0]) if len(at) else len(place)
        if goes_on:
            left = *left[:4], place[goes_on - 1]
        if not len(at):
            continue
        ends = place[np.append(at[1:], len(place)) - 1]
        columns = [*(c[at] for c in line), place[at], ends]
        if left is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(left, columns, strict=True)]
        left = tuple(c[-1] for c in columns)
        yield made(*(c[:-1] for c in columns))
    if left is not None:
        yield made(*(np.array([x]) for x in left))


def repeated_spans(docs: DataFrame, *, span: int = 13, seed: int = 5, slices: int = 4, hashes: Hashes | None = None) -> DataFrame:
    """(doc_id, place, length, source_id, at): runs of ``length`` repeated edges on one path, unverified."""
    spark, hashes = docs.sparkSession, hashes or Hashes()
    seeds = sieve(docs, span, seed, hashes, slices)
    runs = node_runs(docs, seeds, span, seed, hashes, slices)
    for part in seeds:
        drop_table(part)
    release_shuffles(spark)
    parts = []
    for which in range(slices):
        first = _edges(runs, which).groupBy("x", "y").agg(
            F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id"), F.min_by("place", "doc_id").alias("at"))
        parts.append(write_table(first.where("source_id < last_id").drop("last_id")))
        release_shuffles(spark)
    distinct = parts[0]
    for part in parts[1:]:
        distinct = distinct.union(part)
    paths = write_table(compact(distinct))
    for part in parts:
        drop_table(part)
    release_shuffles(spark)
    marked = []
    for which in range(slices):
        known = paths.where(_slice(F.col("x"), F.col("y"), slices, which))
        found = _edges(runs, which).join(known, ["x", "y"]).where("doc_id > source_id")
        marked.append(write_table(found.select("doc_id", "place", "source_id", "at", "first")))
        release_shuffles(spark)
    drop_table(runs)
    drop_table(paths)
    marks = marked[0]
    for part in marked[1:]:
        marks = marks.union(part)
    # Edges that follow each other in the document and in the source are on one path until a first one comes.
    # Rows that repeat a doc_id may have an edge at the same place; it counts once.
    line = ["doc_id", "source_id", "shift"]
    marks = marks.select("doc_id", "source_id", (F.col("at") - F.col("place")).alias("shift"), "place", "first")
    # One number is sorted by radix: half of the line's hash and the place.  Lines that share that half in a task come mixed, which only cuts spans shorter.
    key = F.shiftleft(F.xxhash64(*line), 32).bitwiseOR(F.col("place").cast("long"))
    marks = marks.repartition(*line).withColumn("key", key).sortWithinPartitions("key").drop("key")
    spans = write_table(marks.mapInArrow(_spans, "doc_id long, place int, length int, source_id long, at int"))
    for part in marked:
        drop_table(part)
    release_shuffles(spark)
    return spans


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(parts)).digest()


def with_sources(docs: DataFrame, spans: DataFrame, span: int) -> DataFrame:
    """``spans`` with ``words``: the SHA-256 of their words as they stand in the source."""
    wanted = spans.select("source_id", "at", "length").distinct().groupBy(F.col("source_id").alias("_id")).agg(F.collect_list(F.struct("at", "length")).alias("spans"))
    joined = docs.join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("substring_dedup")
        for batch in batches:
            for d, t, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                parts = (t.as_py() or "").encode().split()
                got = [(x["at"], x["length"], _digest(parts[x["at"] : x["at"] + x["length"] + span - 1])) for x in found.as_py()]
                at, length, digest = zip(*got, strict=True)
                columns = [pa.array([d.as_py()] * len(got), pa.int64()), pa.array(at, pa.int32()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())]
                yield pa.record_batch(columns, ["source_id", "at", "length", "words"])

    digests = joined.mapInArrow(run, "source_id long, at int, length int, words binary")
    return spans.join(digests, ["source_id", "at", "length"])


def _apply(docs: DataFrame, spans: DataFrame, span: int, digest: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, failed) for every row; ``spans`` have their sources' ``words``."""
    paths = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("place", "length", "words")).alias("spans"))
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("substring_dedup")
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column(2)
            places, lengths, digests = (lists.flatten().field(name).to_pylist() for name in ("place", "length", "words"))
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).tolist()
            for d, t, first, last in zip(batch.column(0), batch.column(1), upto, upto[1:], strict=False):
                parts = (t.as_py() or "").encode().split()  # of bytes: at the six ASCII spaces only
                n, kept, failed = len(parts), parts, 0
                if first < last:
                    begins, ends = [], []
                    for place, length, words_there in zip(places[first:last], lengths[first:last], digests[first:last], strict=True):
                        end = place + length + span - 1
                        if end <= n and _digest(parts[place:end]) == words_there:
                            begins.append(place)
                            ends.append(end)
                        else:
                            failed += 1
                    gone = np.bincount(np.array(begins, np.int64), minlength=n + 1) - np.bincount(np.array(ends, np.int64), minlength=n + 1)
                    kept = [parts[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                left = b" ".join(kept)
                out.append((d.as_py(), n, n - len(kept), hashlib.sha256(left).hexdigest() if digest else left.decode(), failed))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", name, "failed"])

    joined = docs.join(paths, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string, failed long")


def remove_repeats(
    docs: DataFrame, *, span: int = 13, seed: int = 5, slices: int = 4, text: str = "text", doc_id: str = "doc_id", digest: bool = False, bits: int = 64,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space; or the SHA-256 of that as ``kept_sha256``."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    able = rows.where("doc_id is not null")
    # Rows of one doc_id with different texts fail each other's spans; that is no collision.
    repeats = able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    for hashes in (Hashes(bits=bits), Hashes(strong=True)):
        spans = with_sources(able, repeated_spans(able, span=span, seed=seed, slices=slices, hashes=hashes), span)
        spans = write_table(spans.select("doc_id", "place", "length", "words"))
        release_shuffles(docs.sparkSession)
        out = write_table(_apply(rows, spans, span, digest))
        failed = out.where("failed > 0").select("doc_id")
        if hashes.strong or failed.isEmpty() or failed.join(repeats, "doc_id", "left_anti").isEmpty():
            break
    return out.drop("failed")

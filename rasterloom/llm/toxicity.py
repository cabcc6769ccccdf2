"""Toxicity: a counterfactually regularised linear classifier of whole texts.

Features of a text are the distinct hashed words and word beginnings it holds
(ASCII and Unicode letters lowered), so one use of a telling word counts the
same in ten words or in ten thousand.  Slots whose document frequency
does not depend on the label are set aside, those of identity terms are not;
on what is left training minimises

    log loss + l1 * |w| + cf * (score(text) - score(counterpart)) ** 2

Every labelled text has a counterpart.  Identity terms that it holds are swapped
for others of their group (women -> men, muslim -> christian, ...).  A text
without any gets a term placed in it, and its counterpart holds another term of
the group or none: mentions of a group that nobody wrote into the training data
are penalised as well.  So neither the terms themselves, where scraped labels
speak against them, nor beginnings that they share with insults (``tra`` of
trash and transgender) raise the score of a neutral mention.

Fitting runs on the driver over a sample of at most ``max_train`` labelled rows,
half of each label where there are enough, chosen by a hash of doc_id, one row
for each doc_id.  Texts stay on the executors: their whole words become slot numbers
there, slots are counted in Spark, and of every row only its numbers among the at most
``max_slots`` telling slots and those of identity terms reach the driver.  Scoring
runs on the executors over every row.  Labels, language, source and doc_id are
never inputs of a score.

Edge cases: null and empty texts get the score of the bias alone; no labelled
rows give 0.5 everywhere; labels that are null or other than 0 and 1, and rows
with a null doc_id, are left out of training but scored; repeated rows get equal
scores, and of rows of one doc_id with different texts one, by a hash, is
trained on; very long texts are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_worker, drop_table, write_table

#: Weights of the model: words and their beginnings hash into so many slots.
SLOTS = 1 << 20
#: Lengths of the word beginnings that count as features beside the words.
BEGINNINGS = (3, 4, 5, 6)
MEMO_WORDS = 100_000

# Identity terms by group and language; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("disabled", "deaf", "blind"), ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("old", "young"), ("american", "mexican", "chinese", "indian", "arab"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus"), ("schwarze", "weiße", "asiaten"), ("schwul", "lesbisch", "hetero"),
    ("ausländer", "flüchtlinge", "bürger"), ("türken", "polen", "deutsche", "araber"), ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous"), ("noirs", "blancs", "asiatiques"), ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("étrangers", "réfugiés", "citoyens"), ("arabes", "africains", "européens"), ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("negros", "blancos", "asiáticos"), ("homosexuales", "lesbianas", "heterosexuales"),
    ("inmigrantes", "refugiados", "ciudadanos"), ("gitanos", "mexicanos", "españoles"), ("discapacitados", "sordos", "ciegos"),
)

_WORD = re.compile(r"[^\W_]+")


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> dict[str, str]:
    return {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}


def _slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & (SLOTS - 1)


class _Slots(dict):
    """Word -> its feature slots."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = (_slot("w" + word), *(_slot("b" + word[:n]) for n in BEGINNINGS if len(word) >= n))
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str], memo: _Slots) -> np.ndarray:
    out: set[int] = set()
    for w in words:
        out.update(memo[w])
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    bias: float = 0.0

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, rows)])
        flat = self.weights[np.concatenate(rows)] if ends[-1] else np.zeros(0, np.float32)
        sums = np.concatenate([[0.0], np.cumsum(flat, dtype=np.float64)])
        return sums[ends[1:]] - sums[ends[:-1]] + self.bias


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


@dataclass
class Example:
    """Slots of a text, and of its counterfactual pair: ``own`` and ``placed`` against ``own`` without ``lost`` and with ``swapped``."""

    own: np.ndarray
    placed: np.ndarray
    lost: np.ndarray
    swapped: np.ndarray


def example(text: str | None, swap: dict[str, str], memo: _Slots) -> Example:
    words = distinct_words(text)
    own = features(words, memo)
    none = own[:0]
    if not words.isdisjoint(swap):
        other = features({swap.get(w, w) for w in words}, memo)
        return Example(own, none, np.setdiff1d(own, other), np.setdiff1d(other, own))
    pick = xxhash.xxh64_intdigest(text or "")
    terms = sorted(swap)
    term = terms[pick % len(terms)]
    placed = np.setdiff1d(features({term}, memo), own)
    swapped = np.setdiff1d(features({swap[term]}, memo), own) if pick >> 40 & 1 else none
    return Example(own, placed, none, swapped)


def identity_slots(groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> np.ndarray:
    """Slots of the terms as whole words; beginnings, which other words share, must be telling themselves."""
    return np.unique(np.array([_slot("w" + term) for group in groups for term in group], np.int32))


def _ratio(seen: np.ndarray, both: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much the document frequency of slots depends on the label: twice the log of a likelihood ratio.

    ``seen`` and ``both`` count the rows of label 1 and of either that have the slot; ``n`` the rows of labels 0 and 1.
    """
    out = np.zeros(len(both))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, with_slot in ((0, both - seen), (1, seen)):
            share = n[k] / n.sum()
            for count, total in ((with_slot, both), (n[k] - with_slot, n.sum() - both)):
                out += np.where(count > 0, 2 * count * np.log(count / (total * share)), 0)
    return out


def telling(slots: np.ndarray, seen: np.ndarray, both: np.ndarray, n: np.ndarray, false_slots: float, max_slots: int) -> np.ndarray:
    """Of ``slots`` (each of two rows at least) those whose frequency depends on the label; about ``false_slots`` of all pass by chance."""
    if not len(slots):
        return slots
    ratio = _ratio(seen, both, n)
    passed = np.flatnonzero(ratio >= max(3.84, 2 * np.log(max(1, len(slots)) / false_slots)))
    return np.sort(slots[passed[np.argsort(-ratio[passed], kind="stable")][:max_slots]])


def fit(
    texts: list[str | None], labels: list[int], *, false_slots: float = 20.0, max_slots: int = 1 << 16,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, **options,
) -> Model:
    """A model of texts in memory."""
    if not texts:
        return Model()
    memo, swap = _Slots(), swaps(groups)
    examples = [example(t, swap, memo) for t in texts]
    y = np.asarray(labels, np.int64)
    slots, both = np.unique(np.concatenate([e.own for e in examples]), return_counts=True)
    seen = np.zeros(len(slots), np.int64)
    for e, label in zip(examples, y, strict=True):
        if label:
            seen[np.searchsorted(slots, e.own)] += 1
    keep = both >= 2
    told = telling(slots[keep], seen[keep], both[keep], np.array([(y == 0).sum(), (y == 1).sum()]), false_slots, max_slots)
    return fit_examples(examples, y, np.union1d(told, identity_slots(groups)), **options)


def fit_examples(
    examples: list[Example], labels: np.ndarray, usable: np.ndarray, *,
    epochs: int = 24, rate: float = 0.4, l1: float = 1e-4, cf: float = 2.0, seed: int = 0,
) -> Model:
    """Adagrad with a proximal l1 step over shuffled mini-batches; the same rows give the same model."""
    model = Model()
    y = np.asarray(labels, np.float64)

    def places(slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(usable, slots[np.isin(slots, usable)])

    rows = [places(e.own) for e in examples]
    left = [np.concatenate([r, places(e.placed)]) for r, e in zip(rows, examples, strict=True)]
    right = [np.concatenate([np.setdiff1d(r, places(e.lost)), places(e.swapped)]) for r, e in zip(rows, examples, strict=True)]
    # Both labels weigh the same in the loss, whatever their share.
    share = np.array([(y == 0).mean(), (y == 1).mean()]).clip(1e-9)
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
    values, bias = np.zeros(len(usable)), 0.0
    history, bias_history = np.full(len(usable), 1e-6), 1e-6
    order = np.random.default_rng(seed)

    def logits(part: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, part)])
        sums = np.concatenate([[0.0], np.cumsum(values[np.concatenate(part)])])
        return sums[ends[1:]] - sums[ends[:-1]] + bias

    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(batch):
                continue
            part = [rows[i] for i in batch]
            slope = (_probability(logits(part)) - y[batch]) * weight[batch] / len(batch)
            grads = [(part, slope)]
            if cf:
                a, b = [left[i] for i in batch], [right[i] for i in batch]
                p, q = _probability(logits(a)), _probability(logits(b))
                gap = 2 * cf * (p - q) / len(batch)
                grads += [(a, gap * p * (1 - p)), (b, -gap * q * (1 - q))]
            at = np.concatenate([r for part, _ in grads for r in part])
            each = np.concatenate([np.repeat(g, [len(r) for r in part]) for part, g in grads])
            total = np.bincount(at, each, len(values)) if len(at) else np.zeros(len(values))
            moved = np.flatnonzero(total)
            history[moved] += total[moved] ** 2
            step = rate / np.sqrt(history[moved])
            new = values[moved] - step * total[moved]
            values[moved] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            g = slope.sum() + 0.005 * bias  # a small bias lets a single telling word decide
            bias_history += g * g
            bias -= rate * g / np.sqrt(bias_history)
    model.weights[usable] = values
    model.bias = float(bias)
    return model


def training_examples(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(h, id, toxic, own, placed, lost, swapped): at most ``max_train`` rows, half of each label if there are enough, by a hash of doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    marked = marked.where(usable).groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("_id"))
    half = max_train // 2
    few = [marked.where(f"toxic = {k}").orderBy("_h", "_id").limit(half) for k in (0, 1)]
    few = F.broadcast(few[0].union(few[1]))  # at most max_train rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    rows = texts.join(few, F.col("_doc") == F.col("_id")).select("_h", "_id", "toxic", "text")
    swap = swaps(groups)
    arrays = ("own", "placed", "lost", "swapped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("toxicity")
        memo = _Slots()
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(3)[k].as_py()
                e = example(text, swap, memo)
                chosen = xxhash.xxh64_intdigest(text or "") >> 1
                lists = [pa.array([getattr(e, name)], pa.list_(pa.int32())) for name in arrays]
                yield pa.record_batch([*(batch.column(i).slice(k, 1) for i in range(3)), pa.array([chosen], pa.int64()), *lists], ["h", "id", "toxic", "chosen", *arrays])

    found = rows.mapInArrow(run, "h long, id long, toxic int, chosen long, " + ", ".join(f"{a} array<int>" for a in arrays))
    one = found.groupBy("id").agg(F.min_by(F.struct("h", "toxic", *arrays), "chosen").alias("e"))
    return one.select("id", "e.*")


def train(
    docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, max_train: int = 8000, max_slots: int = 1 << 16, false_slots: float = 20.0,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, **options,
) -> Model:
    """A model of the labelled rows for which ``usable`` (a condition on ``_id``) holds."""
    rows = write_table(training_examples(docs, labels, F.lit(True) if usable is None else usable, max_train, groups))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model()
    each = rows.select("toxic", F.explode("own").alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("seen"), F.count(F.lit(1)).alias("both"))
    counts = each.where("both >= 2").toArrow().sort_by("slot")  # three numbers for each of at most SLOTS slots
    columns = [counts.column(c).to_numpy() for c in ("slot", "seen", "both")]
    told = telling(*columns, np.array([n.get(0, 0), n.get(1, 0)]), false_slots, max_slots)
    keep = np.union1d(told, identity_slots(groups)).astype(np.int32)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0), batch.column(1), batch.column(2)]
            for i in range(3, 7):
                lists = [np.asarray(x, np.int32) for x in batch.column(i).to_pylist()]
                out.append(pa.array([x[np.isin(x, keep)] for x in lists], pa.list_(pa.int32())))
            yield pa.record_batch(out, batch.schema.names)

    few = rows.select("h", "id", "toxic", "own", "placed", "lost", "swapped").mapInArrow(only, "h long, id long, toxic int, own array<int>, placed array<int>, lost array<int>, swapped array<int>")
    held = few.toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    drop_table(rows)
    examples = [Example(*(np.asarray(held.column(i)[k].as_py(), np.int32) for i in range(3, 7))) for k in range(held.num_rows)]
    return fit_examples(examples, held.column("toxic").to_numpy(), keep, **options)


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", into: str = "score") -> DataFrame:
    """The columns of ``keep`` and the score of every row, from its whole text."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("toxicity")
        slots, values, bias = shared.value
        own = Model(bias=bias)
        own.weights[slots] = values
        known = set(slots.tolist())

        class Telling(_Slots):
            """Only the slots that weigh anything."""

            def __missing__(self, word: str) -> tuple[int, ...]:
                found = tuple(s for s in _Slots.__missing__(self, word) if s in known)
                if word in self:
                    self[word] = found
                return found

        memo = Telling()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows = [features(distinct_words(t.as_py()), memo) for t in part.column(part.num_columns - 1)]
                scores = _probability(own.logits(rows))
                yield pa.record_batch([*part.columns[:-1], pa.array(scores)], [*part.schema.names[:-1], into])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields + ', ' if fields else ''}`{into}` double")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

"""Byte-level BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

1. Count the pre-tokens of all texts (partial counts per batch, summed by Spark).
2. Merge the ``lexicon_size`` most frequent ones once and compile them with
   their ids into a minimal acyclic transducer (``lexicon.py``), a file that
   Spark ships to the executors, where it is memory-mapped.
3. Encode every text: known words by the transducer, others by exact merging.

Ids equal those of the tokenizers library for the same file with
``add_special_tokens=False``; decoding equals its ``decode(ids,
skip_special_tokens=False)``.

Edge cases: null and empty texts encode to no ids and decode to the empty
string; rows may repeat; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim_worker, keep_memo, scratch_root, write_bytes
from .lexicon import Transducer, compile_transducer

Batches = Iterator[pa.RecordBatch]

#: Segments, and pre-tokens of those that are no plain words, in a generation of what one worker keeps at hand (about 200 bytes each).
MEMO_SEGMENTS, MEMO_WORDS = 400_000, 60_000
#: Distinct words counted in one worker before it hands on what it has.
COUNTED_WORDS = 300_000
#: The rank of pairs that don't merge.
NEVER = 1 << 30

# White space of the pre-tokenizer (Unicode White_Space) and its pattern.
_S = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+"
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary of this name lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file of this kind writes each byte: printable ones as themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary: its merges, its added tokens and exact merging of one word."""

    def __init__(self, spec: dict) -> None:
        import regex

        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        by_bytes = {raw(t): i for t, i in vocab.items()}
        self.byte_ids = [by_bytes.get(bytes([b])) for b in range(256)]
        #: The rank of a pair of ids, and the id that a rank makes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = regex.compile(_PATTERN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for token, i in by_bytes.items():
            pieces[i] = token
        for content, i in self.added.items():
            pieces[i] = content.encode()
        self.pieces = pa.array(pieces, pa.large_binary())

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: join the pair of lowest rank, leftmost first, until none is left."""
        rank, made = self.ranks.get, self.made
        ids = list(map(self.byte_ids.__getitem__, word))
        if len(ids) > 64:
            return self._merge_long(ids)
        row = list(map(rank, zip(ids, ids[1:]), repeat(NEVER)))
        row.append(NEVER)  # the last id has none behind it
        while (best := min(row)) != NEVER:
            k = row.index(best)
            ids[k] = new = made[best]
            del ids[k + 1], row[k]
            if k < len(row) - 1:
                row[k] = rank((new, ids[k + 1]), NEVER)
            if k:
                row[k - 1] = rank((ids[k - 1], new), NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and links, for words of thousands of bytes."""
        import heapq

        n, ranks = len(ids), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            m = after[k] if alive[k] else n
            if not alive[k] or m >= n or ids[k] != left or ids[m] != right:
                continue
            ids[k], alive[m], after[k] = self.made[rank], False, after[m]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return tuple(i for i, live in zip(ids, alive, strict=True) if live)

    def parts(self, text: str) -> list[str]:
        """Text between added tokens and, at odd places, the added tokens."""
        return self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]


@lru_cache(maxsize=4)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(json.loads(spec))


@lru_cache(maxsize=4)
def _transducer(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


def plain_words(segment: str) -> tuple[str, ...]:
    """The pre-tokens of a space and ``segment`` if that is letters, with a mark behind them or not; else nothing."""
    if segment.isalpha():
        return (" " + segment,)
    if segment[:-1].isalpha() and segment[-1] in ".,;:!?":
        return " " + segment[:-1], segment[-1]
    return ()


class _Generations(dict):
    """A memo of bounded size: when it is full it becomes the old generation, from which what is used again returns."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = ids
        return ids


class _Memo(_Generations):
    """Pre-token -> its ids as 32-bit numbers, from the transducer, else by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer) -> None:
        super().__init__(MEMO_WORDS)
        self.vocabulary, self.lexicon = vocabulary, lexicon
        #: Words of one id share its bytes.
        self.single: dict[bytes, bytes] = {}

    def make(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.lookup(raw)
        made = array("i", self.vocabulary.merge(raw) if ids is None else ids).tobytes()
        return self.single.setdefault(made, made) if len(made) == 4 else made


class _Segments(_Generations):
    """What stands after a single space, up to the next -> ids of the space and it."""

    def __init__(self, memo: _Memo) -> None:
        super().__init__(MEMO_SEGMENTS)
        self.memo, self.pattern = memo, memo.vocabulary.pattern

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def make(self, segment: str) -> bytes:
        if segment.isalpha():  # kept here, so not in the memo as well
            return self.memo.make(" " + segment)
        if plain_words(segment):
            return self[segment[:-1]] + self.memo[segment[-1]]
        return self.whole(" " + segment)

    def encode(self, text: str) -> bytes:
        """A space between two other characters always begins a pre-token, so text splits there; runs of spaces do not."""
        if "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def _segments(spec: str, name: str) -> _Segments:
    return _Segments(_Memo(_vocabulary(spec), _transducer(name)))


keep_memo("bpe", lambda: (_segments.cache_clear(), _transducer.cache_clear(), _vocabulary.cache_clear()))


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file; it is read into tables on the executors only."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_words(docs: DataFrame, shared: Broadcast, text: str = "text") -> DataFrame:
    """(word, n): how often each pre-token occurs in all texts; ``shared`` is the text of the tokenizer file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe")
        vocabulary, segments, others = _vocabulary(shared.value), Counter(), Counter()

        def hand_on() -> pa.RecordBatch:
            for segment, n in segments.items():
                for word in plain_words(segment) or vocabulary.pattern.findall(" " + segment):
                    others[word] += n
            out = pa.record_batch([pa.array(others.keys(), pa.string()), pa.array(others.values(), pa.int64())], ["word", "n"])
            segments.clear()
            others.clear()
            return out

        for batch in batches:
            for t in _texts(batch.column(0)):
                for part in vocabulary.parts(t)[::2]:
                    if "  " in part:
                        others.update(vocabulary.pattern.findall(part))
                    else:
                        first, *rest = part.split(" ")
                        others.update(vocabulary.pattern.findall(first))
                        segments.update(rest)
                if len(segments) + len(others) > COUNTED_WORDS:
                    yield hand_on()
        yield hand_on()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, spec: str, *, text: str = "text", lexicon_size: int = 1 << 16) -> str:
    """Compile the most frequent words; returns the name under which executors find the file.

    ``lexicon_size`` bounds what reaches the driver and the size of the file (about 30 bytes a word).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    top = count_words(docs, shared, text).where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(lexicon_size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe")
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(map(vocabulary.merge, words), pa.list_(pa.int32()))], ["word", "ids"])

    merged = top.select("word").mapInArrow(merge, "word binary, ids array<int>").toArrow()
    shared.destroy()
    merged = merged.sort_by("word")
    words, ids = merged.column("word").to_pylist(), merged.column("ids").to_pylist()
    name = f"rasterloom-{uuid.uuid4().hex}.mast"
    path = f"{scratch_root(spark)}/rasterloom/{name}"
    write_bytes(spark, path, compile_transducer(zip(words, map(tuple, ids), strict=True)))
    spark.sparkContext.addFile(path)
    return name


def _encoder(docs: DataFrame, tokenizer_path: str, text: str, lexicon_size: int) -> Callable[[Batches], Batches]:
    """What turns batches (doc_id, text) into (doc_id, ids) on the executors."""
    spec = read_tokenizer(tokenizer_path)
    name = build_lexicon(docs, spec, text=text, lexicon_size=lexicon_size)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Batches) -> Batches:
        claim_worker("bpe")
        segments = _segments(shared.value, name)
        vocabulary, encode_part = segments.memo.vocabulary, segments.encode
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = []
                for t in _texts(part.column(1)):
                    pieces = vocabulary.parts(t)
                    ids = encode_part(pieces[0])
                    for k in range(1, len(pieces), 2):
                        ids += array("i", [vocabulary.added[pieces[k]]]).tobytes() + encode_part(pieces[k + 1])
                    rows.append(ids)
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
                flat = np.frombuffer(b"".join(rows), np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])

    return run


def _decoder(spark: SparkSession, tokenizer_path: str) -> Callable[[Batches], Batches]:
    """What adds the decoded text to batches whose last column is ids."""
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Batches) -> Batches:
        claim_worker("bpe")
        pieces = _vocabulary(shared.value).pieces
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column(part.num_columns - 1)
                flat = pieces.take(lists.flatten())
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                sizes = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
                ends = sizes[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), flat.buffers()[2]])
                try:
                    texts = raw.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # ids that end within a character
                    texts = pa.array([t.as_py().decode("utf-8", "replace") for t in raw], pa.string())
                yield pa.record_batch([*part.columns, texts], [*part.schema.names, "text"])

    return run


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", doc_id: str = "doc_id", lexicon_size: int = 1 << 16) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    run = _encoder(docs, tokenizer_path, text, lexicon_size)
    return _rows(docs, text, doc_id).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns of ``keep``, ``ids`` and the decoded ``text`` of every row."""
    run = _decoder(encoded.sparkSession, tokenizer_path)
    rows = encoded.select(*keep, ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, *, text: str = "text", doc_id: str = "doc_id", lexicon_size: int = 1 << 16) -> DataFrame:
    """(doc_id, ids, text): ``decode`` of ``encode`` in one Python worker a task; one after the other they take two, and each comes to keep the memos of both."""
    to_ids, to_text = _encoder(docs, tokenizer_path, text, lexicon_size), _decoder(docs.sparkSession, tokenizer_path)
    return _rows(docs, text, doc_id).mapInArrow(lambda batches: to_text(to_ids(batches)), "doc_id long, ids array<int>, text string")

"""A minimal acyclic transducer from byte strings to id sequences, in one flat file.

States of the automaton share suffixes (Daciuk's incremental construction over
sorted words).  Every arc carries the number of words that sort before those
reached through it, so the sum along a path is the word's index, and the index
selects its ids.  The file is memory-mapped: processes on one machine share its
pages and open it without parsing.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable

_HEAD = struct.Struct("<8sIIIII")
_MAGIC = b"RLMAST01"


def compile_transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """Compile (word, ids) pairs, sorted by word without repeats, into the file's bytes."""
    # A state under construction is [final, {label: state}]; a registered one is a number.
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def register(state: list) -> int:
        key = (state[0], tuple(state[1].items()))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, {}]]
    previous = b""
    offsets, ids, n_words = array("I", [0]), array("I"), 0

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1][previous[len(path) - 1]] = register(done)

    for word, word_ids in entries:
        if n_words and word <= previous:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        for label in word[common:]:
            path[-1][1][label] = -1
            path.append([False, {}])
        path[-1][0] = True
        previous, n_words = word, n_words + 1
        ids.extend(word_ids)
        offsets.append(len(ids))
    close(0)
    root = register(path[0])

    below: list[int] = []
    for final, arcs in states:  # children are registered before their parents
        below.append(int(final) + sum(below[t] for _, t in arcs))
    first, label, target, skip, final_flags = array("I", [0]), array("B"), array("I"), array("I"), array("B")
    for final, arcs in states:
        seen = int(final)
        for c, t in arcs:
            label.append(c)
            target.append(t)
            skip.append(seen)
            seen += below[t]
        first.append(len(target))
        final_flags.append(final)
    head = _HEAD.pack(_MAGIC, root, len(states), len(target), n_words, len(ids))
    parts = [a.tobytes() for a in (first, target, skip, offsets, ids, label, final_flags)]
    return head + b"".join(parts)


#: Bytes of a word by which the way into the transducer is kept, and how many such ways.
HEAD, HEADS = 3, 1 << 16


class Transducer:
    """Lookup in a memory-mapped file of :func:`compile_transducer`."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, self._root, n_states, n_arcs, self.n_words, n_ids = _HEAD.unpack_from(self._map)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no transducer file")
        view, at = memoryview(self._map), _HEAD.size
        self._views = []
        for n in (n_states + 1, n_arcs, n_arcs, self.n_words + 1, n_ids):
            self._views.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._label = bytes(view[at : at + n_arcs])  # a few hundred kB, searched by ``bytes.find``
        #: Where words that begin alike go on: state and number after their first HEAD bytes, a negative state if no word does.
        self._heads: dict[bytes, tuple[int, int]] = {}
        self._final = view[at + n_arcs : at + n_arcs + n_states]
        self.n_states = n_states

    def _walk(self, state: int, index: int, word: bytes) -> tuple[int, int]:
        """State and number after the bytes of ``word``; a negative state if there is no way."""
        first, target, skip = self._views[:3]
        find = self._label.find
        for c in word:
            arc = find(c, first[state], first[state + 1])
            if arc < 0:
                return -1, 0
            index += skip[arc]
            state = target[arc]
        return state, index

    def lookup(self, word: bytes) -> tuple[int, ...] | None:
        head = word[:HEAD]
        begin = self._heads.get(head)
        if begin is None:
            begin = self._walk(self._root, 0, head)
            if len(self._heads) < HEADS:
                self._heads[head] = begin
        if begin[0] < 0:
            return None
        state, index = self._walk(*begin, word[HEAD:])
        if state < 0:
            return None
        offsets, ids = self._views[3:]
        if not self._final[state]:
            return None
        return tuple(ids[offsets[index] : offsets[index + 1]])

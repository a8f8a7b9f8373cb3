"""Periodic runs of words, found with a suffix automaton and link-cut access.

Only stretches of a text in which every three-word string occurs three times can hold a run of four periods, so
texts are first cut at all other places; ordinary prose leaves nothing. Of each stretch a suffix automaton is
built. Its suffix links form a tree, and the states of the strings that end at a word are the path from that
word's state to the root. Words are taken in order: an access makes the path of the next word one preferred path
of that colour, and meets the segments of paths that earlier words left. A segment of colour ``e`` holds strings
that occurred last with their end at ``e``; where its longest one is no shorter than the distance from there to
the present word, a square of that period ends here. Squares are extended to runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches, slices, words

#: A run has this many periods and words at least.
PERIODS, SHORTEST = 4, 6


class Automaton:
    """Suffix automaton of a sequence of numbers: ``link`` and ``length`` of every state, ``state`` of every prefix.

    State 1 is the root; 0 is no state. Most states have one transition, which needs no dictionary.
    """

    def __init__(self, sequence: list[int]):
        self.link, self.length, self.state = [0, 0], [0, 0], []
        link, length = self.link, self.length
        word, target, more = [-1, -1], [0, 0], {}

        def go(state: int, x: int) -> int:
            if word[state] == x:
                return target[state]
            return more[state].get(x, 0) if state in more else 0

        def put(state: int, x: int, to: int) -> None:
            if word[state] in (-1, x):
                word[state], target[state] = x, to
            else:
                more.setdefault(state, {})[x] = to

        def new(size: int) -> int:
            link.append(0), length.append(size), word.append(-1), target.append(0)
            return len(link) - 1

        last = 1
        for x in sequence:
            state, p = new(length[last] + 1), last
            while p and not (q := go(p, x)):
                put(p, x, state)
                p = link[p]
            if not p:
                link[state] = 1
            elif length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = new(length[p] + 1)
                word[copy], target[copy], link[copy] = word[q], target[q], link[q]
                if q in more:
                    more[copy] = dict(more[q])
                while p and go(p, x) == q:
                    put(p, x, copy)
                    p = link[p]
                link[q] = link[state] = copy
            self.state.append(state)
            last = state


class Paths:
    """Preferred paths of a tree given by parents, as splay trees ordered by depth; each path has one colour."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.left, self.right = list(parent), [0] * n, [0] * n
        self.colour = [-1] * n  # of a path, at the top of its splay tree

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):
                self._rotate(y)
                self._rotate(x)
            else:
                self._rotate(x)
                if inner:
                    self._rotate(x)
            if not inner:
                colour[x] = colour[y]
            elif not ((w := up[x]) and (left[w] == x or right[w] == x)):
                colour[x] = colour[z]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from a node to the root the colour; returns the segments met: deepest node, colour before."""
        up, right, met = self.up, self.right, []
        below, v = 0, node
        while v:
            self._splay(v)
            before = self.colour[v]
            met.append((v, before))
            if right[v]:
                self.colour[right[v]] = before
            right[v] = below
            below, v = v, up[v]
        self.colour[below] = colour
        return met


def runs(sequence: list[int]) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence by start and period."""
    automaton = Automaton(sequence)
    paths, length, n = Paths(automaton.link), automaton.length, len(sequence)
    found, ends = [], {}  # where the last run of each period ends
    for i, state in enumerate(automaton.state):
        for node, before in paths.access(state, i):
            period = i - before
            if before < 0 or period > length[node] or ends.get(period, 0) > i:
                continue
            start, end = i + 1 - 2 * period, i + 1
            while start > 0 and sequence[start - 1] == sequence[start - 1 + period]:
                start -= 1
            while end < n and sequence[end] == sequence[end - period]:
                end += 1
            ends[period] = end
            if end - start >= max(SHORTEST, PERIODS * period):
                found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of places that can hold runs, in sequences that lie one behind the other; ``owner`` numbers them.

    In a run of four periods every string of three words occurs three times. Places whose string occurs less often
    within their stretch cut it, until little changes.
    """
    if len(ids) < SHORTEST:
        return []
    at = np.flatnonzero(owner[2:] == owner[:-2])
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True)
    part = owner[at].astype(np.int64)
    while len(at):
        _, which, count = np.unique(part * len(ids) + triple[at], return_inverse=True, return_counts=True)
        often = count[which] >= PERIODS - 1
        here, part = at[often], part[often]
        fresh = np.r_[True, (np.diff(here) > 1) | (np.diff(part) != 0)] if len(here) else np.zeros(0, bool)
        part = np.cumsum(fresh) - 1
        sizes = np.bincount(part) if len(part) else np.zeros(0, int)
        long_enough = sizes[part] >= SHORTEST - 2
        dropped = len(at) - long_enough.sum()
        at, part = here[long_enough], part[long_enough]
        if 16 * dropped <= len(at):
            break
    starts = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(at) else []
    ends = [*starts[1:], len(at)] if len(at) else []
    return [(int(at[s]), int(at[e - 1]) + 3) for s, e in zip(starts, ends, strict=True)]


class _Numbers(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def runs_of(sequences: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several word sequences."""
    numbers = _Numbers()
    sizes = np.array([len(s) for s in sequences], np.int64)
    ids = np.fromiter((numbers[w] for s in sequences for w in s), np.int64, int(sizes.sum()))
    owner, first = np.repeat(np.arange(len(sequences)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    for start, end in stretches(ids, owner):
        k = owner[start]
        shift = start - int(first[k])
        out[k] += [(a + shift, size, period) for a, size, period in runs(ids[start:end].tolist())]
    return out


def collapse(sequence: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    kept = np.ones(len(sequence), bool)
    for start, size, period in found:
        kept[start + period : start + size] = False
    return [w for w, k in zip(sequence, kept.tolist(), strict=True) if k]


_RUNS = "array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of every document: runs by start and period, and the text without repeats.

    Needs ``doc_id, text``; other columns are left out. ``collapsed`` holds the words that no run contains after
    its first period, joined by one space. A null text, or one without words, has no runs and an empty result.
    Rows without ``doc_id`` and repeated rows are treated like any other; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sequences = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            found = runs_of(sequences)
            lists = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in each] for each in found], kind)
            left = pa.array([b" ".join(collapse(s, f) if f else s) for s, f in zip(sequences, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, left.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, runs {_RUNS}, collapsed string")


def longest(found: str = "runs"):
    """The run with the greatest length by period; of equals the first by start, then period. Null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(found, none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where some texts, chosen by the CRC-32 of their id, repeat a part of themselves to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    all_words = words(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.floor(h / 10).alias("_g"), (h % 10 == 0).alias("_looped"))
    rows = rows.withColumn("_words", F.when(F.col("_looped"), all_words))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    period = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    rows = rows.withColumn("_p", period)
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - F.col("_a"))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))

"""Periodic runs of words, by recompression: a run-length grammar whose common extensions decide a harmonic grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.common import columns, slices

#: Least words of a run, and least times that it holds its period.
WORDS, TIMES = 6, 4
#: Points of the grid that are looked at in one step, and words up to which the grid of a text is kept.
POINTS, SMALL = 1 << 20, 2048

KIND = T.StructType(
    [
        T.StructField(
            "runs",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


class Grammar:
    """Levels of a sequence of numbers, each of which names the blocks or the pairs of the level below.

    Blocks are maximal repetitions of one symbol. Pairs are a symbol of one half of the alphabet before one of the
    other, a half being a bit of a hash. Both depend on symbols alone, so equal stretches are named alike but at their ends.
    """

    def __init__(self, sequence: np.ndarray):
        #: Symbols; then where each level's symbols start in the level below, and the other way around.
        self.symbols, self.starts, self.parents, self.blocks = [sequence], [], [], []
        fresh = int(sequence.max(initial=-1)) + 1
        number = 0
        while True:
            now = self.symbols[-1]
            if len(now) < 2 or len(np.unique(now)) == len(now):
                return
            same = now[1:] == now[:-1]
            blocks = bool(same.any())
            if blocks:
                head = np.concatenate([[True], ~same])
            else:
                left = self._half(now, number)
                forward, backward = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
                head = np.concatenate([[True], ~(forward if forward.sum() >= backward.sum() else backward)])
                number += 1
                if head.all():
                    continue
            starts = np.flatnonzero(head)
            sizes = np.diff(np.append(starts, len(now)))
            many = sizes > 1
            upper = now[starts].copy()
            second = sizes[many] if blocks else now[starts[many] + 1]
            names = np.unique(upper[many] * (int(second.max()) + 1) + second, return_inverse=True)[1]
            upper[many] = fresh + names
            fresh += int(names.max()) + 1
            self.symbols.append(upper)
            self.starts.append(starts)
            self.parents.append(np.cumsum(head) - 1)
            self.blocks.append(blocks)

    @staticmethod
    def _half(symbols: np.ndarray, number: int) -> np.ndarray:
        mixed = (symbols.astype(np.uint64) + np.uint64(number * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(63)).astype(bool)

    def _ahead(self, level: int, at: np.ndarray) -> np.ndarray:
        """Symbols from `at` to the end of its block, itself included."""
        starts, block = self.starts[level], self.parents[level][at]
        end = np.append(starts, len(self.symbols[level]))[block + 1]
        return end - at

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the sequence has in common from i and from j on.

        The last symbol must occur once, so that no common stretch reaches the end. At each level on the way up at
        most one block is partly passed, as equal symbols name equal stretches; where symbols differ, the way down
        passes at most one equal part of theirs at each level.
        """
        a, b = i.copy(), j.copy()
        stopped = np.full(len(a), -1)  # the level where symbols differed
        some = np.arange(len(a))
        for level, symbols in enumerate(self.symbols):
            differ = symbols[a[some]] != symbols[b[some]]
            stopped[some[differ]] = level
            some = some[~differ]
            if not len(some) or level == len(self.starts):
                stopped[some] = level
                break
            starts, parents = self.starts[level], self.parents[level]
            inside = (starts[parents[a[some]]] != a[some]) | (starts[parents[b[some]]] != b[some])
            part = some[inside]
            if len(part):
                if self.blocks[level]:
                    ahead = self._ahead(level, a[part]), self._ahead(level, b[part])
                    step, uneven = np.minimum(*ahead), ahead[0] != ahead[1]
                else:
                    step, uneven = np.ones(len(part), dtype=np.int64), np.zeros(len(part), dtype=bool)
                a[part] += step
                b[part] += step
                stopped[part[uneven]] = level
                some = np.setdiff1d(some, part[uneven], assume_unique=True)
            a[some], b[some] = parents[a[some]], parents[b[some]]
        for level in range(len(self.starts) - 1, -1, -1):
            down = stopped > level
            if not down.any():
                continue
            down = np.flatnonzero(down)
            a[down], b[down] = self.starts[level][a[down]], self.starts[level][b[down]]
            symbols = self.symbols[level]
            equal = down[symbols[a[down]] == symbols[b[down]]]
            if len(equal):
                step = np.minimum(self._ahead(level, a[equal]), self._ahead(level, b[equal])) if self.blocks[level] else 1
                a[equal] += step
                b[equal] += step
        return a - i


def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (place, period) of the harmonic grid of up to n words, by the word that ends four periods' first words."""
    periods = np.arange(1, n // TIMES + 1)
    counts = np.maximum((n - 1) // periods - TIMES + 2, 0)
    period = np.repeat(periods, counts)
    step = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = step * period
    end = place + (TIMES - 1) * period
    order = np.argsort(end, kind="stable")
    return place[order], period[order], end[order]


def _candidates(words: np.ndarray, grid: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points (place, period) of the grid where the word is the same at four multiples of the period in a row.

    A stretch of four periods holds four such places, so every run has a point here.
    """
    n = len(words)

    def kept(place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for times in range(1, TIMES):
            same = words[place] == words[place + times * period]
            place, period = place[same], period[same]
        return place, period

    if n <= SMALL:
        upto = int(np.searchsorted(grid[2], n))
        yield kept(grid[0][:upto], grid[1][:upto])
        return
    first = 1
    while first <= n // TIMES:
        # As many periods as have about POINTS places on the grid together; one at least.
        last = min(n // TIMES, first + max(0, POINTS * first // n - 1))
        periods = np.arange(first, last + 1)
        counts = np.maximum((n - 1) // periods - TIMES + 2, 0)
        period = np.repeat(periods, counts)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        yield kept(place, period)
        first = last + 1


def find_runs(texts: list[np.ndarray], grid: tuple) -> list[np.ndarray]:
    """For each sequence of numbers its runs, as rows (start, length, period) by start and period.

    Sequences with points on the grid are joined, each before a number of its own, and one grammar of them
    and one of their reverse answer how far the period of each point goes on and back.
    """
    found = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    some = [d for d, words in enumerate(texts) if any(len(i) for i, _ in _candidates(words, grid))]
    if not some:
        return found
    fresh = max(int(texts[d].max()) for d in some) + 1
    # A number of its own before the first sequence too, which ends the reverse.
    whole = np.concatenate([np.array([fresh]), *(np.append(texts[d], fresh + 1 + k) for k, d in enumerate(some))])
    first = np.cumsum([1, *(len(texts[d]) + 1 for d in some)])
    on, back = Grammar(whole), Grammar(whole[::-1].copy())
    rows, waiting, held = [], [], 0

    def extend() -> None:
        """Runs (sequence, start, length, period) of the waiting points."""
        owner, place, period = (np.concatenate(x) for x in zip(*waiting, strict=True))
        place = place + first[owner]
        behind = back.extension(len(whole) - place, len(whole) - place - period)
        length = behind + period + on.extension(place, place + period)
        long = length >= np.maximum(WORDS, TIMES * period)
        rows.append(np.unique(np.stack([owner, place - behind - first[owner], length, period], axis=1)[long], axis=0))
        waiting.clear()

    for k, d in enumerate(some):
        for place, period in _candidates(texts[d], grid):
            waiting.append((np.full(len(place), k), place, period))
            held += len(place)
            if held >= POINTS:
                extend()
                held = 0
    if waiting:
        extend()
    every = np.unique(np.concatenate(rows), axis=0)
    # Multiples of a run's period have the same stretch; the rows are sorted, so its least period comes first.
    least = np.ones(len(every), dtype=bool)
    least[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[least]
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    cuts = np.searchsorted(every[:, 0], np.arange(len(some) + 1))
    for k, d in enumerate(some):
        found[d] = every[cuts[k] : cuts[k + 1], 1:]
    return found


def collapse(words: list, runs: np.ndarray) -> list:
    """Words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _run_batches(batches: Iterator[pa.RecordBatch], text: str, out: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    grid = _grid(SMALL)
    for batch in batches:
        (texts,) = columns(batch, text)
        held = []
        for a, b in slices(texts):
            split = [(t or "").encode().split() for t in texts[a:b]]
            names: dict[bytes, int] = {}
            numbered = [np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64) for words in split]
            for words, own in zip(split, find_runs(numbered, grid), strict=True):
                kept = collapse(words, own) if len(own) else words
                held.append({
                    "runs": [{"start": s, "length": n, "period": p} for s, n, p in own.tolist()],
                    "collapsed": b" ".join(kept).decode(),
                })
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, kind)], names=[*batch.schema.names, out])


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """`docs` with a struct `out`: the text's runs (start, length, period), and the text with runs collapsed.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words that are the same
    one period later, its least period being that one, of at least four periods and six words, which no
    neighbouring word extends. Runs are ordered by start, then period. `collapsed` holds the words that no run
    contains after its first period, joined by one space.

    Texts are read whole, each by itself, in stretches of about a million characters; a longer text is a stretch alone.
    Texts that are null, empty or white space have no runs and collapse to the empty text. Repeated rows stay; a column
    named like `out` is replaced; no documents give no rows.
    """
    rest = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out, KIND)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        from beaconry.llm import runs

        yield from runs._run_batches(batches, text, out, to_arrow_type(KIND))

    return docs.select(*(F.col(c) for c in rest)).mapInArrow(run, schema)

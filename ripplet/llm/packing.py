"""Packing token streams into training windows by Karmarkar-Karp multiway differencing.

Every task packs its documents cell by cell, a cell being the next documents with about
``cell_tokens`` tokens, or fewer if they are very short; no text or token is shuffled and memory
is bounded by a cell. In a cell a document gives as many full windows as it can, and its rest
becomes an item. Differencing deals the items to ``ceil(tokens / capacity)`` windows: the two
partial partitions with the largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one is left, whose windows are near-equal. As long as a window
exceeds the capacity, the window count rises and the items are dealt anew. With ``cut`` the
emptiest windows are then cut up to fill the others, so that all but one are exactly full; that
one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker process remembers; documents that a cell holds at most (some 500 bytes each, besides their ids).
CACHE, CELL_DOCS = 1_000_000, 1 << 16
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of whole texts, by words between ASCII white space, at which this tokenizer never joins text.

    Nor does it join a letter or digit with the marks after it, if no apostrophe is among them; so
    the ids of a word's core and of the marks that end it are found apart, in lower case.
    """

    TAIL = re.compile(rb"(.*[A-Za-z0-9])([^A-Za-z0-9'\x80-\xff]+)", re.S)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, self.words, self.cores = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def __call__(self, texts: list[bytes | None], end: int) -> list[bytes]:
        """For each text its ids and ``end`` as little-endian unsigned 32-bit numbers."""
        last, split = np.uint32(end).tobytes(), [(text or b"").split() for text in texts]
        if len(self.words) > CACHE:
            self.words.clear()
        if missing := set().union(*split).difference(self.words):
            self._learn(missing)
        return [b"".join(map(self.words.__getitem__, words)) + last for words in split]

    def _learn(self, missing: set[bytes]) -> None:
        parts = {}
        for word in missing:
            special = b"<|" in word  # may hold a special token
            core = word if special else word.lower()
            tail = None if special else self.TAIL.fullmatch(core)
            parts[word] = tail.groups() if tail else (core,)
        if len(self.cores) > CACHE:
            self.cores.clear()
        cores = self.cores
        new = {p.decode(): p for ps in parts.values() for p in ps if p not in cores}
        letters = [w for w in new if w.isalpha()]
        if letters:  # as one text: each of its words ends where an id of a word's end stands
            ids = np.array(self.encode([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(letters):
                ids, at = ids.tobytes(), 0
                for word, stop in zip(letters, stops, strict=True):
                    cores[new.pop(word)] = ids[at:stop]
                    at = stop
        for part, got in zip(new.values(), self.encode(list(new), add_special_tokens=False), strict=True):
            cores[part] = np.array(got.ids, "<u4").tobytes()
        for word, ps in parts.items():
            self.words[word] = b"".join([cores[p] for p in ps])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, whose later tasks know the words of the earlier ones; a word's ids depend on the word alone."""
    return WordIds(path)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of ``k`` windows with near-equal sums of sizes.

    A partial partition is the list of its windows that hold items, in falling order of load, each
    as (load with a minus sign, node); its other windows are empty. A node is an item or, from
    ``len(sizes)`` on, a pair of nodes. Loads count from the emptiest window.
    """
    n, pairs = len(sizes), []
    heap = [(-size, i, [(-size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    age = n
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - k  # windows that hold items of both
        if shared > 0:
            at, to = len(a) - shared, len(b) - shared
            met = [(x + y, n + len(pairs) + j) for j, ((x, _), (y, _)) in enumerate(zip(a[at:], b[: to - 1 if to else None : -1], strict=True))]
            pairs += [(x, y) for (_, x), (_, y) in zip(a[at:], b[: to - 1 if to else None : -1], strict=True)]
            a = sorted(a[:at] + b[:to] + met)
        elif len(b) == 1:
            insort(a, b[0])
        else:
            a += b
            a.sort()
        if len(a) == k and (least := a[-1][0]):
            a = [(load - least, node) for load, node in a]
        age += 1
        heapq.heappush(heap, (a[0][0], age, a))
    windows = []
    for _, root in heap[0][2] if heap else []:
        items, stack = [], [root]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += pairs[x - n]
        windows.append(sorted(items))
    return windows + [[] for _ in range(k - len(windows))]


def pack_cell(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(document, start, length)`` for documents of these sizes."""
    full = [[(d, at, capacity)] for d, n in enumerate(sizes) for at in range(0, n - capacity + 1, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(sizes) if n % capacity]
    if not rest:
        return full
    windows = _least_windows([length for _, _, length in rest], capacity)
    pieces = [[rest[i] for i in items] for items in windows]
    return full + (_fill(pieces, capacity) if cut else [w for w in pieces if w])


def _least_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items of each window by differencing, with so many windows that none exceeds the capacity.

    The count starts at what sums and items above half a window ask for. Where a window exceeds, it rises
    by the excess and by twice the last rise at least; a last rise of over a sixteenth is halved back.
    """
    k = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
    low, step = k - 1, 0

    def tried(k: int) -> tuple[int, list[list[int]]]:
        windows = difference(lengths, k)
        return max(sum(lengths[i] for i in w) for w in windows) - capacity, windows

    over, windows = tried(k)
    while over > 0:
        low, step = k, max(2 * step, 1 + k * over // capacity)
        k += step
        over, windows = tried(k)
    while k - low > 1 + k // 16:
        middle = (low + k) // 2
        over, found = tried(middle)
        if over > 0:
            low = middle
        else:
            k, windows = middle, found
    return windows


def _take(spare: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The last ``n`` tokens of ``spare``, taken from it."""
    taken = []
    while n:
        d, at, length = spare.pop()
        used = min(n, length)
        if length > used:
            spare.append((d, at + used, length - used))
        taken.append((d, at, used))
        n -= used
    return taken


def _fill(windows: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Fill as many windows as there are tokens for from the emptiest ones; what is left is cut at powers of two."""
    loads = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: -loads[i])
    n = sum(loads) // capacity
    spare = [p for i in order[n:] for p in windows[i]]
    filled = [windows[i] + _take(spare, capacity - loads[i]) for i in order[:n]]
    total = sum(p[2] for p in spare)
    return filled + [_take(spare, 1 << bit) for bit in reversed(range(total.bit_length())) if total >> bit & 1]


def pack(docs: DataFrame, capacity: int = 2048, end: int = 1, tokenizer_path: str | None = None, cell_tokens: int = 1 << 20, cut: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)`` in sequences of at most ``capacity`` tokens (a power of two).

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit numbers, ``start`` the
    document's ids before it, ``doc_tokens`` all of them with ``end``; ``offset`` is its place in
    its sequence, gapless from 0. Each id lies in one piece. A null or empty text is the one id
    ``end``; repeated rows and null ids are documents of their own; an empty table gives no rows.
    ``sequence_id`` has the task's number in its upper half, so that a repeated task, which reads
    the same rows, gives the same ids. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, cell, tokens, at = word_ids(path), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            names = batch.column(0).to_pylist()
            for k in range(0, len(names), 64):
                for name, ids in zip(names[k : k + 64], ids_of(batch.column(1)[k : k + 64].to_pylist(), end), strict=True):
                    cell.append((name, ids))
                    tokens += len(ids) // 4
                    if tokens >= cell_tokens or len(cell) >= CELL_DOCS:
                        yield flush(cell, at)
                        at, cell, tokens = at + len(cell) + tokens, [], 0
        if cell:
            yield flush(cell, at)

    def flush(cell: list[tuple[int | None, bytes]], at: int) -> pa.RecordBatch:
        rows = []
        for s, window in enumerate(pack_cell([len(ids) // 4 for _, ids in cell], capacity, cut)):
            offset = 0
            for d, start, n in window:
                name, ids = cell[d]
                rows.append((name, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, at + s, offset))
                offset += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = tokenizer_path
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in the ids' place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

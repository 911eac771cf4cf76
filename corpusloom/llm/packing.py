"""Best-fit packing by bin completion with branch and bound.

Pieces are dealt at random into groups of about GROUP pieces; each group is packed by itself, so no task ever holds
more than a group, and the price of the cut is at most about one sequence a group. Within a group lengths form a
histogram. A sequence is opened for the largest piece left and filled up: maximal fillings are enumerated, those that
another one dominates are left out, and the search goes through the others in order of waste. The sum of waste may not
reach what the incumbent allows: (incumbent - 1) * capacity - total. The incumbent starts as best-fit decreasing and
is replaced by any better solution; the search ends when it meets a lower bound or its limits, and then the incumbent
stands. Small groups are packed in as few sequences as there can be; see complete() for the limits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches, table
from .tokens import batches, piece_table

CAPACITY, GROUP, STEPS, LOOKS, FILLINGS, DEPTH, DEALS = 2048, 20_000, 200_000, 1_000, 8, 12, 500


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # sorted (room left, bin)
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, (x, -1))
        if i == len(room):
            bins.append([x])
            left, b = capacity - x, len(bins) - 1
        else:
            left, b = room.pop(i)
            bins[b].append(x)
            left -= x
        if left:
            at = bisect_left(room, (left, b))
            room.insert(at, (left, b))
    return bins


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the pieces of b can be dealt to pieces of a so that no piece of a gets more than its own length.

    Then a packing with b in this bin can be changed into one with a, and b need not be tried (Martello and Toth).
    The test may take exponential time: after DEALS tries it says no, and b is tried as well.
    """
    if sum(b) > sum(a) or b and max(b) > max(a, default=0):
        return False

    left = DEALS

    def deal(i: int, room: tuple[int, ...]) -> bool:
        nonlocal left
        left -= 1
        return i == len(b) or left > 0 and any(deal(i + 1, (*room[:j], x - b[i], *room[j + 1 :])) for j, x in enumerate(room) if x >= b[i] and x not in room[:j])

    b = sorted(b, reverse=True)
    return deal(0, tuple(sorted(a, reverse=True)))


def fillings(sizes: list[int], count: dict[int, int], room: int, looks: int = LOOKS, most: int = FILLINGS, even: bool = False) -> tuple[list[list[int]], bool, int]:
    """(undominated fillings of `room` from the lengths still there (ascending `sizes`), least waste first; whether these are all; steps taken).

    Fillings are enumerated as falling lists of lengths, large ones first, or with `even` those near half the room first.
    Only maximal ones count: nothing left fits into what they waste. The search is cut off after `looks` steps, at `most`
    fillings without waste, or, below DEPTH pieces, by filling up from large to small; what stood then is compared.
    """
    found: dict[tuple[int, ...], int] = {}
    left, whole = [looks, most], [True]

    def have(x: int, taken: list[int]) -> int:
        return count[x] - taken.count(x)

    def full(room: int, taken: list[int]) -> bool:
        i = 0
        while i < len(sizes) and sizes[i] <= room:
            if have(sizes[i], taken):
                return False
            i += 1
        return True

    def go(top: int, room: int, taken: list[int]) -> None:
        left[0] -= 1
        if full(room, taken):
            if tuple(taken) not in found:
                found[tuple(taken)] = room
                left[1] -= room == 0
            return
        js = range(min(top, bisect_right(sizes, room)) - 1, -1, -1)
        if even and not taken:
            js = sorted(js, key=lambda j: abs(2 * sizes[j] - room))
        last = False  # of two last pieces the smaller one is dominated
        for j in js:
            if left[0] <= 0 or left[1] <= 0:
                whole[0] = False
                return
            if room - sizes[j] < sizes[0]:
                if last:
                    continue
                last = have(sizes[j], taken) > 0 and not (even and not taken)
            if have(sizes[j], taken):
                if len(taken) < DEPTH:
                    go(j + 1, room - sizes[j], [*taken, sizes[j]])
                else:
                    whole[0] = False
                    rest = [*taken]
                    while j >= 0:
                        if sizes[j] <= room and have(sizes[j], rest):
                            rest.append(sizes[j])
                            room -= sizes[j]
                        else:
                            j -= 1
                    found[tuple(rest)] = room
                    return

    go(len(sizes), room, [])
    if len(found) > 8 * most and not whole[0]:
        found = dict(sorted(found.items(), key=lambda f: f[1])[: 8 * most])
    ordered = [list(f) for f in sorted(found, key=lambda f: (found[f], [-x for x in f]))]
    kept: list[list[int]] = []
    for f in ordered:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept, whole[0], looks - left[0]


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The larger of total length over capacity and the same with pieces that can't share a bin counted as whole ones."""
    x = np.sort(np.asarray(lengths, np.int64))
    upto = np.append(0, np.cumsum(x))
    half = np.searchsorted(x, capacity // 2, "right")
    k = np.append(0, np.unique(x[:half]))
    big = np.searchsorted(x, capacity - k, "right").clip(half)
    rest = upto[big] - upto[np.searchsorted(x, k)]
    return int((len(x) - big - (-rest // capacity)).max())


def complete(lengths: list[int], capacity: int = CAPACITY, steps: int | None = None, looks: int = LOOKS) -> tuple[list[list[int]], bool]:
    """(bins of lengths, whether no packing has fewer). Lengths are from 1 to capacity.

    Branch and bound over the bin of the largest piece left, with best-fit decreasing as the first incumbent. It is
    exact until a limit cuts it off: `steps` of the enumeration of fillings and of the search (by default STEPS and 100 for
    each bin) in each of two runs, with fillings of large pieces first and with even ones first, and `looks` steps for
    the fillings of one bin; where there are more than 200 bins, the first filling without waste ends its enumeration.
    """
    best = best_fit(lengths, capacity)
    if len(best) <= lower_bound(lengths, capacity):
        return best, True
    full = [[x] for x in lengths if x == capacity]
    lengths, best = [x for x in lengths if x < capacity], [b for b in best if b[0] < capacity]
    total, bound, proved = sum(lengths), lower_bound(lengths, capacity), False
    for even in (False, True):
        best, proved = _search(lengths, capacity, best, total, bound, STEPS + 100 * len(best) if steps is None else steps, looks, even)
        if proved:
            break
    return full + best, proved


def _search(lengths, capacity: int, best: list[list[int]], total: int, bound: int, steps: int, looks: int, even: bool) -> tuple[list[list[int]], bool]:
    count: dict[int, int] = {}
    for x in lengths:
        count[x] = count.get(x, 0) + 1
    sizes, whole, most = sorted(count), True, FILLINGS if len(best) <= 200 else 1
    # one frame an open bin: [its fillings, the next of them, largest piece, filling taken]
    stack: list[list] = []
    waste, placed = 0, 0

    def take(bin_: list[int], sign: int) -> None:
        for x in bin_:
            count[x] -= sign
            if sign > 0 and not count[x]:
                sizes.pop(bisect_left(sizes, x))
            elif sign < 0 and count[x] == 1:
                sizes.insert(bisect_left(sizes, x), x)

    def open_bin() -> None:
        nonlocal whole, steps
        top = sizes[-1]
        take([top], 1)
        found, all_, used = fillings(sizes, count, capacity - top, looks, most, even) if sizes else ([[]], True, 1)
        stack.append([found, 0, top, None])
        take([top], -1)
        whole, steps = whole and all_, steps - used

    open_bin()
    while stack and len(best) > bound:
        if steps <= 0:
            return best, False
        frame = stack[-1]
        if frame[3] is not None:  # back from below: undo
            bin_ = [frame[2], *frame[3]]
            take(bin_, -1)
            waste -= capacity - sum(bin_)
            placed -= len(bin_)
            frame[3] = None
        if frame[1] >= len(frame[0]):
            stack.pop()
            continue
        filling = frame[0][frame[1]]
        frame[1] += 1
        bin_ = [frame[2], *filling]
        steps -= 1
        if waste + capacity - sum(bin_) > (len(best) - 1) * capacity - total:  # fillings come by rising waste: the rest is pruned as well
            frame[1] = len(frame[0])
            continue
        take(bin_, 1)
        waste += capacity - sum(bin_)
        placed += len(bin_)
        frame[3] = filling
        if placed == len(lengths):
            best = [[f[2], *f[3]] for f in stack]
        elif len(stack) < len(best) - 1:
            open_bin()
    return best, whole or len(best) <= bound


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces plus sequence_id long and offset long; columns of these names are replaced.

    length must be an integer from 1 to capacity; null lengths are refused by an error in the task. Pieces are dealt to
    groups by their row, so that neither null nor repeated keys meet in one. Equal rows are packed each on its own.
    Sequence ids are unique, not consecutive; offsets in a sequence are gapless from 0. Empty pieces give an empty result.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_g")]
    pieces = pieces.select(*own)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        sizes = np.asarray(rows.column(length).to_numpy(), np.int64)
        if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        order = np.argsort(sizes, kind="stable")
        first = {int(x): int(i) for x, i in zip(*np.unique(sizes[order], return_index=True), strict=True)}
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, bin_ in enumerate(complete(sizes.tolist(), capacity)[0]):
            at = 0
            for x in bin_:
                i = order[first[x]]
                first[x] += 1
                seq[i], off[i] = (int(key[0].as_py()) << 32) + b, at
                at += x
        return rows.drop_columns(["_g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    # a group is little data and much work: small partitions must not be put together
    return dealt.repartition(groups, "_g").groupBy("_g").applyInArrow(place, schema)


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, kind: str = "byte", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: documents as token ids with `end` after them, cut where longer than capacity.

    One row per piece. A longer document is cut into pieces of capacity tokens of which only the first may be shorter.
    Null text is the empty text: one piece that holds `end` alone. Null keys and repeated rows stay. ids_crc32 is over
    little-endian unsigned 32-bit ids.
    """
    of = df.schema[key].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_table(path, kind)
        for b in batches(source):
            ids, ends = encoder.encode(b.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(b.num_rows):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(own[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )
        encoder.known.clear()  # Python workers live on, and other stages need the memory

    small_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {of}, piece long, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces packed; the small table of pieces is written first, so that texts are encoded once."""
    pieces = materialise(token_pieces(df, path, capacity), "pieces")
    return pack(pieces, capacity=capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))

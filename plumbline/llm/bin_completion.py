"""Pack pieces of documents into few sequences by bin completion.

A sequence is opened for the largest piece left and completed by a set of others, its filling. A filling is dominated if
another could hold its pieces in larger ones that are left: only undominated fillings are tried, those that waste least first,
and a branch ends once its waste shows that it cannot beat the best solution so far. The first such solution is best-fit
decreasing. Only lengths matter to the search, so equal lengths are one kind with a count, and the lengths at hand are the bits of
one integer: a pair of a given sum is found by shifting that integer against its mirror image.

Groups of a few thousand pieces are packed in tasks of their own. A group keeps all but the least filled of its sequences; the
pieces of those meet in fewer groups in the next round, until one group is left. A task never holds more than a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, modest, width
from plumbline.llm.tokens import encoder
from plumbline.session import discard, settle

#: Pieces in a group on average; a group may give one in so many of its sequences to the next round.
GROUP_PIECES, GIVEN_UP = 8192, 16
#: Search effort: looks at a filling for one sequence; in all, for each sequence and besides; besides in the last group.
LOOKS, EFFORT, BESIDES, LAST = 500, 20, 20_000, 1_000_000
#: Fillings of more pieces than this begin with the largest ones.
WIDE = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


class Stock:
    """Lengths at hand with their counts. Bit n of `mask`: length n is there; bit capacity - n of `mirror` says the same."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.count = capacity, np.bincount(lengths, minlength=capacity + 1).tolist()
        self.mask = sum(1 << n for n, c in enumerate(self.count) if c)
        self.mirror = sum(1 << capacity - n for n, c in enumerate(self.count) if c)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n
            self.mirror ^= 1 << self.capacity - n

    def put(self, n: int) -> None:
        if not self.count[n]:
            self.mask ^= 1 << n
            self.mirror ^= 1 << self.capacity - n
        self.count[n] += 1

    def largest(self) -> int:
        return self.mask.bit_length() - 1

    def smallest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1

    def upto(self, n: int) -> int:
        """The largest length of at most n, -1 if there is none."""
        return (self.mask & (2 << n) - 1).bit_length() - 1

    def any_in(self, low: int, high: int) -> bool:
        return bool(self.mask >> low & (2 << high - low) - 1)

    def holds(self, lengths: tuple[int, ...]) -> bool:
        return all(lengths.count(n) <= self.count[n] for n in set(lengths))


def _sums(stock: Stock, total: int, most: int, k: int, left: list[int]) -> Iterator[tuple[int, ...]]:
    """Sets of k lengths, none over `most`, of exactly this sum; large lengths first but for the last two, which are alike."""
    left[0] -= 1
    if k == 1:
        if total <= most and stock.mask >> total & 1:
            yield (total,)
        return
    if k == 2:
        half = (total + 1) // 2
        both = (stock.mask & stock.mirror >> stock.capacity - total) >> half & (1 << max(0, min(most, total - 1) + 1 - half)) - 1
        while both and left[0] > 0:
            low = both & -both
            x = half + low.bit_length() - 1
            left[0] -= 1
            yield (x, total - x)
            both ^= low
        return
    x, least = stock.upto(min(most, total - (k - 1) * stock.smallest())), -(-total // k)
    while x >= least and left[0] > 0:
        for rest in _sums(stock, total - x, x, k - 1, left):
            yield (x, *rest)
        x = stock.upto(x - 1)


def dominated(stock: Stock, filling: tuple[int, ...], waste: int) -> bool:
    """Whether another filling is at least as good: one with a further piece, or with one piece left in the place of some of
    these whose lengths it reaches. Of long fillings only singles and pairs are tried, which leaves some dominated ones in."""
    for n in filling:
        stock.take(n)
    found = stock.any_in(1, waste) if waste else False
    for k in range(1, len(filling) + 1 if len(filling) <= 6 else 3):
        if found:
            break
        for some in set(combinations(filling, k)):
            low = sum(some) + (k == 1)
            if low <= sum(some) + waste and stock.any_in(low, sum(some) + waste):
                found = True
                break
    for n in filling:
        stock.put(n)
    return found


def fillings(stock: Stock, room: int, slack: int, effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` that waste at most `slack`, least waste first, then fewest pieces; the stock must be the same
    whenever the next one is asked for. The largest pieces that fit, one after the other, are the last filling: it is reached once
    `effort` or LOOKS are used up. Where more than WIDE of the largest pieces fit, they come first, in the only filling."""
    if not stock.mask or stock.smallest() > room:
        if room <= slack:
            yield ()
        return
    before, inner = _greedy(stock, room, WIDE)
    if before:
        for n in before:
            stock.take(n)
        inner = next(fillings(stock, room - sum(before), slack, effort), None)
        for n in before:
            stock.put(n)
        if inner is not None:
            yield (*before, *inner)
        return
    left = [min(LOOKS, effort[0])]
    small, large, start = stock.smallest(), stock.upto(room), left[0]
    for waste in range(min(slack, room - small) + 1):
        total = room - waste
        for k in range(max(1, -(-total // large)), min(total // small, WIDE + 2) + 1):
            for filling in _sums(stock, total, large, k, left):
                if stock.holds(filling) and (not waste and k <= 2 or not dominated(stock, filling, waste)):
                    effort[0] -= start - left[0]
                    yield filling
                    start = left[0]
                    if k == 1 and not waste:
                        return  # one piece that fits exactly dominates all else
            if left[0] <= 0:
                break
        if left[0] <= 0:
            break
    effort[0] -= start - left[0]
    greedy, room = _greedy(stock, room, 0)
    if room <= slack:
        yield tuple(greedy)


def _greedy(stock: Stock, room: int, beyond: int) -> tuple[list[int], int]:
    """The largest pieces that fit, one after the other, while more than `beyond` of them would; and the room that is left."""
    taken: list[int] = []
    while (n := stock.upto(room)) > 0 and room > beyond * n:
        taken.append(n)
        stock.take(n)
        room -= n
    for n in taken:
        stock.put(n)
    return taken, room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes where it leaves the least room. `lengths` come largest first."""
    rooms, bins, by_room = 0, [], [[] for _ in range(capacity + 1)]
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, []
            bins.append(b)
        b.append(n)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << room - n
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound: pieces over half the capacity need sequences of their own, and what others do not fit beside them needs more."""
    count = np.bincount(lengths, minlength=capacity + 1)
    size = count * np.arange(capacity + 1)
    n, total, half = np.cumsum(count), np.cumsum(size), capacity // 2
    best = -(-int(total[-1]) // capacity)
    for p in range(half + 1):
        alone = int(n[-1] - n[capacity - p])
        shared = int(n[capacity - p] - n[half])
        room = shared * capacity - int(total[capacity - p] - total[half])
        small = int(total[half] - (total[p - 1] if p else 0))
        best = max(best, alone + shared + max(0, -(-(small - room) // capacity)))
    return best


def complete(lengths: list[int], capacity: int, allowance: int, effort: list[int]) -> list[list[int]] | None:
    """Depth-first bin completion: the first solution that wastes at most `allowance`, None if `effort` looks do not show one."""
    stock, bins, waste = Stock(lengths, capacity), [], 0
    tried: list[Iterator[tuple[int, ...]]] = []
    filled = True
    while effort[0] > 0:
        if filled:
            if not stock.mask:
                return bins
            effort[0] -= 1
            bins.append([stock.largest()])
            stock.take(bins[-1][0])
            tried.append(fillings(stock, capacity - bins[-1][0], allowance - waste, effort))
        filling = next(tried[-1], None)
        filled = filling is not None
        if filled:
            for n in filling:
                stock.take(n)
            bins[-1] += filling
            waste += capacity - sum(bins[-1])
        else:  # back to the sequence before
            tried.pop()
            stock.put(bins.pop()[0])
            if not bins:
                return None
            waste -= capacity - sum(bins[-1])
            for n in bins[-1][1:]:
                stock.put(n)
            del bins[-1][1:]
            effort[0] -= 1
    return None


def pack_lengths(lengths: list[int], capacity: int, besides: int = BESIDES) -> list[list[int]]:
    """Few bins for lengths of 1 to `capacity`: best fit, then bin completion while the lower bound leaves hope and effort is left.

    Of two solutions with as many bins, the one whose waste lies in fewer of them is better, as a later round can use that.
    """
    lengths = sorted(lengths, reverse=True)
    if not lengths:
        return []
    least, total = least_bins(lengths, capacity), sum(lengths)
    rank = lambda bins: (len(bins), -sum(sum(b) ** 2 for b in bins))
    best = best_fit(lengths, capacity)
    greedy = complete(lengths, capacity, capacity * len(lengths), [LOOKS * len(lengths)])
    if greedy and rank(greedy) < rank(best):
        best = greedy
    effort = [EFFORT * len(best) + besides]
    while len(best) > least and effort[0] > 0:
        fewer = complete(lengths, capacity, (len(best) - 1) * capacity - total, effort)
        if fewer is None:
            break
        best = fewer
    return best


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, row): ids and `end_id`, cut from the end into full windows where longer.

    The first piece of a cut document may be shorter. `row` numbers pieces across the table. A null or empty text is its end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer, "kept"), TaskContext.get().partitionId() << 33
        for b in lean(batches):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.each(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc, k, s, e - s, zlib.crc32(ids[s:e]), row))
                    row += 1
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return modest(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


def pack_group(rows: pa.Table, window: int, last: bool) -> pa.Table:
    """One group's pieces with (sequence_id, offset, kept); a sequence is named by the row of its first piece."""
    length, row = rows.column("length").to_pylist(), rows.column("row").to_pylist()
    of: dict[int, list[int]] = {}
    for i, n in enumerate(length):
        of.setdefault(n, []).append(i)
    bins = sorted(pack_lengths(length, window, LAST if last else BESIDES), key=sum)
    given = 0 if last else sum(sum(b) < window for b in bins[: -(-len(bins) // GIVEN_UP)])
    sequence, offset, kept = ([None] * len(rows) for _ in range(3))
    for k, b in enumerate(bins):
        at, name = 0, None
        for n in b:
            i = of[n].pop()
            name = row[i] if name is None else name
            sequence[i], offset[i], kept[i] = name, at, k >= given
            at += n
    for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("kept", kept, pa.bool_())):
        rows = rows.append_column(name, pa.array(values, kind))
    return rows


def _round(left: DataFrame, n: int, window: int, group_pieces: int) -> DataFrame:
    groups = max(1, -(-n // group_pieces))
    out = f"{PIECES}, sequence_id long, offset long, kept boolean"
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b.column(b.schema.get_field_index("pack_group")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else []
            for at, end in zip(cuts, cuts[1:]):
                if held and held[-1].column("pack_group")[0].as_py() != g[at]:
                    yield from pack_group(pa.Table.from_batches(held).select(names), window, groups == 1).to_batches()
                    held = []
                held.append(b.slice(at, end - at))
        if held:
            yield from pack_group(pa.Table.from_batches(held).select(names), window, groups == 1).to_batches()

    dealt = left.select(*names, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("pack_group"))
    spread = dealt.repartition(min(groups, max(width(left.sparkSession), groups // 64)), "pack_group")
    return spread.sortWithinPartitions("pack_group", "row").mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in sequences of at most `window` ids.

    Documents of up to `window` ids, the end id included, stay whole. A null or empty text is its end id alone; rows with equal or
    null ids are separate documents, dealt to groups by a number of their own, so that any number of equal rows spreads; pieces of
    equal length are exchangeable. Very long texts are encoded whole. An empty table gives no rows. Other columns are ignored.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cut = settle(pieces(docs, tokenizer, window, end_id), "completion_pieces")
    done = cut.where(F.col("length") == window).select(*names[:5], F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < window)
    while n := left.count():
        packed = settle(_round(left, n, window, group_pieces), "completion_round")
        done = done.unionByName(packed.where("kept").select(names))
        left = packed.where("not kept")
    return done

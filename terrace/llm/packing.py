"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences by themselves. The
others are dealt evenly at random into groups of about ``GROUP`` pieces, and each group is packed on
its own: a group costs less than one sequence over the whole, and groups hold lengths only, so their number grows
with the input while their size does not.

In a group, best fit decreasing gives the first incumbent. If that is above the lower bound, bins are completed one
after another around the largest piece left. Fillings of any number of pieces come with the fullest first; a filling is left
out if another one dominates it. Those of many pieces are found over distinct lengths and their counts, along the sums that
bit sets show to be reachable. The search goes back where the waste so far, and what is left, cannot give fewer
sequences than the incumbent. It ends at the lower bound or after about ``STEPS`` steps, with the best
packing found: a complete one in any case, but not always the least one. What the two bounds cost is measured in the README.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Encoder, json_vocabulary, staged, text_of

CAPACITY, END, GROUP, STEPS = 2048, 0, 20_000, 200_000
ROWS = 20_000


def pack(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY,
         vocabulary: dict | None = None, end_id: int = END, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """One row per piece: ``ids``, piece, start, length, ids_crc32, sequence_id and offset.

    Each document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Documents over
    ``capacity`` are cut from the end into full pieces, so that only the first may be shorter. Repeated rows and null ids
    are packed as they are; other columns are left out; an empty table gives an empty one. With ``with_ids`` the
    tokens come along in ``token_ids``.
    """
    vocabulary = vocabulary or json_vocabulary()
    k = len(ids)
    id_schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ids)
    schema = f"{id_schema}piece int, start long, length long, ids_crc32 long, _slot long" + (", token_ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, encode = TaskContext.get().partitionId() << 33, Encoder.of(**vocabulary).array
        for batch in batches:
            at, piece, start, length, crc, tokens = [], [], [], [], [], []
            for i, value in enumerate(batch.column(k).to_pylist()):
                got = np.append(encode(value), np.uint32(end_id)).astype("<u4")
                stop = (len(got) - 1) % capacity + 1
                begin = n = 0
                while begin < len(got):
                    part = got[begin:stop]
                    at.append(i), piece.append(n), start.append(begin), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        tokens.append(part.astype("int32"))
                    begin, stop, n = stop, stop + capacity, n + 1
            index = pa.array(at, pa.int64())
            columns = [*(batch.column(j).take(index) for j in range(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(slot, slot + len(at)), pa.int64())]
            slot += len(at)
            yield pa.record_batch(columns + ([pa.array(tokens, pa.list_(pa.int32()))] if with_ids else []),
                                  names=[*batch.schema.names[:k], "piece", "start", "length", "ids_crc32", "_slot", *(["token_ids"] if with_ids else [])])

    pieces = staged(docs.select(*ids, text_of(docs, text).alias("_text")).mapInArrow(cut, schema))
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))

    def place(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        number = table["_group"][0].as_py()
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        rows: dict[int, list[int]] = {}
        for i in np.argsort(table["_slot"].to_numpy())[::-1].tolist():
            rows.setdefault(int(lengths[i]), []).append(i)
        for n, filling in enumerate(fill(lengths.tolist(), capacity)):
            at = 0
            for size in filling:
                i = rows[size].pop()
                sequence[i], offset[i] = (number << 32 | n) * 2, at
                at += size
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = (short.withColumn("_group", F.pmod(F.xxhash64("_slot"), F.lit(groups)))
              .groupBy("_group").applyInArrow(place, f"{schema}, sequence_id long, offset long"))
    whole = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("_slot") * 2 + 1, "offset": F.lit(0).cast("long")})
    out = placed.unionByName(whole)
    return out.select(*ids, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["token_ids"] if with_ids else []))


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's bound: pieces that cannot share, and the waste they force."""
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    total = sum(lengths)
    best = -(-total // capacity)
    over = [0] * (capacity + 2)  # pieces of at least this length, and their sum
    mass = [0] * (capacity + 2)
    for x in range(capacity, 0, -1):
        over[x], mass[x] = over[x + 1] + count[x], mass[x + 1] + x * count[x]
    half = capacity // 2 + 1
    for k in range(0, capacity // 2 + 1):
        alone = over[capacity - k + 1]
        large = over[half] - alone
        room = large * capacity - (mass[half] - mass[capacity - k + 1])
        rest = mass[max(k, 1)] - mass[half]
        best = max(best, alone + large + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each piece goes where the least room is left."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for x in sorted(lengths, reverse=True):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            i, room = len(bins), capacity
            bins.append([])
        bins[i].append(x)
        if room > x:
            by_room.setdefault(room - x, []).append(i)
            rooms |= 1 << (room - x)
    return bins


def _fillings(count: list[int], room: int, slack: int, capacity: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` that waste at most ``slack``, the fullest first, without dominated ones.

    One piece dominates several of the same sum. A set is dominated, too, if a piece that it leaves out could
    take the place of one of its own, or of two, and waste less.
    """
    have = sum(1 << x for x in range(1, room + 1) if count[x])
    turned = sum(1 << (capacity - x) for x in range(1, room + 1) if count[x])

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        both = have & (turned >> (capacity - total)) if total > 1 else 0
        both &= (1 << (min(most, total - 1) + 1)) - 1
        while both and steps[0] > 0:
            steps[0] -= 1
            a = both.bit_length() - 1
            if a * 2 < total:
                return
            if a * 2 > total or count[a] > 1:
                yield a, total - a
            both &= ~(1 << a)

    def sums(total: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if depth == 2:
            yield from pairs(total, most)
            return
        left = have & ((1 << (min(most, total - 1) + 1)) - 1)
        while left and steps[0] > 0:
            steps[0] -= 1
            a = left.bit_length() - 1
            if a * depth < total:
                return
            count[a] -= 1
            for rest in sums(total - a, a, depth - 1):
                if all(rest.count(x) <= count[x] for x in set(rest)):
                    count[a] += 1
                    yield (a, *rest)
                    count[a] -= 1
            count[a] += 1
            left &= ~(1 << a)

    lengths = [x for x in range(1, room + 1) if count[x]]
    reach: list[int] = []  # bit sets: sums of pieces of the shortest 0, 1, 2 ... lengths

    def reachable() -> list[int]:
        if not reach:
            steps[0] -= 1 + len(lengths) // 64
            sums_, mask = 1, (1 << (room + 1)) - 1
            reach.append(sums_)
            for x in lengths:
                left, take = min(count[x], room // x), 1
                while left > 0:
                    take = min(take, left)
                    sums_ |= sums_ << (x * take) & mask
                    left, take = left - take, take * 2
                reach.append(sums_)
        return reach

    def many(total: int, most: int, least: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly ``total`` with at least ``least`` pieces of the ``most`` shortest lengths, the largest pieces first."""
        if not total:
            if least <= 0:
                yield ()
            return
        for i in range(min(most, bisect_right(lengths, total)) - 1, -1, -1):
            if not reach[i + 1] >> total & 1 or steps[0] <= 0:
                return
            x = lengths[i]
            for n in range(min(count[x], total // x), 0, -1):
                if reach[i] >> (total - n * x) & 1:
                    steps[0] -= 1
                    for rest in many(total - n * x, i, least - n):
                        yield (x,) * n + rest

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        parts = {*filling, *(a + b for i, a in enumerate(filling) for b in filling[i + 1:])}
        low = [1 << x for x in filling]
        others = have & ~sum(set(low))
        return any(others >> (s + 1) & ((1 << waste) - 1) for s in parts) if waste else any(
            others >> (a + b) & 1 for i, a in enumerate(filling) for b in filling[i + 1:])

    for total in range(room, max(room - slack, 1) - 1, -1):
        if have >> total & 1:
            yield (total,)
            if total == room:
                return
        for depth in (2, 3, 4):
            for filling in sums(total, total, depth):
                if not dominated(filling, room - total):
                    yield filling
        # Five pieces or more, where so many of the shortest have room.
        if lengths and 5 * lengths[0] <= total and reachable()[-1] >> total & 1:
            for filling in many(total, len(lengths), 5):
                if not dominated(filling, room - total):
                    yield filling
    if room <= slack or not have:
        yield ()


def fill(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Pack lengths into few bins, each a list of lengths."""
    best, bound = best_fit(lengths, capacity), lower_bound(lengths, capacity)
    if len(best) <= bound:
        return best
    # Bins that waste nothing stay as they are; the search packs the rest, which has less to choose from.
    done = [x for x in best if sum(x) == capacity]
    open_ = [y for x in best if sum(x) < capacity for y in x]
    rest = _complete(open_, capacity, bound - len(done), steps // 2)
    if len(done) + len(rest) < len(best):
        best = done + rest
    if done and len(best) > bound:
        best = min(best, _complete(lengths, capacity, bound, steps // 2), key=len)
    return best


def _complete(lengths: list[int], capacity: int, bound: int, steps: int) -> list[list[int]]:
    """Bin completion, the deepest bin first, from best fit as the incumbent."""
    best = best_fit(lengths, capacity)
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    total, left, wasted = sum(lengths), [steps], 0
    bins: list[list[int]] = []
    tries: list[Iterator[tuple[int, ...]]] = []
    pieces = len(lengths)
    while left[0] > 0 and len(best) > bound:
        left[0] -= 1
        budget = (len(best) - 1) * capacity - total - wasted  # what a packing that beats the incumbent may still waste
        if pieces == 0 and len(bins) < len(best):
            best = [list(x) for x in bins]
        elif pieces and budget >= 0:
            first = next(x for x in range(capacity, 0, -1) if count[x])
            count[first] -= 1
            pieces -= 1
            bins.append([first])
            tries.append(_fillings(count, capacity - first, budget, capacity, left))
            wasted += capacity - first
        # The next filling of the deepest bin; without one, that bin is undone.
        while tries:
            own = bins[-1]
            for x in own[1:]:
                count[x] += 1
            pieces += len(own) - 1
            wasted += sum(own[1:])
            del own[1:]
            filling = next(tries[-1], None)
            if filling is not None:
                break
            tries.pop()
            bins.pop()
            count[own[0]] += 1
            pieces += 1
            wasted -= capacity - own[0]
        else:
            break
        own += filling
        for x in filling:
            count[x] -= 1
        pieces -= len(filling)
        wasted -= sum(filling)
    return best

"""Best-fit packing by bin completion.

Bins are filled one pattern at a time around the largest size left. The fillings of the remaining space are
enumerated up to dominance, the ones with least waste first; a branch is cut as soon as its waste exceeds what
a packing with one bin fewer than the best known one may waste. The best known packing starts as best-fit
decreasing, and each node given up is completed by best fit, which may replace it. The first search tries the best
few fillings of each node only, each as often as it can be; if it ends, a second one covers every packing with the
nodes left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm.common import materialise, table
from glyphloom.llm.pieces import Plan, cut, histogram, place
from glyphloom.llm.word_ids import vocabulary_path

CAPACITY = 4096
NODES = 8_000
_WIDTH = 12


def bins(plan: Plan) -> int:
    return sum(times for _, times in plan)


def _largest(active: np.ndarray, at_most: np.ndarray | int) -> np.ndarray:
    """Index of the largest active size up to ``at_most``, -1 if none."""
    return np.searchsorted(active, at_most, side="right") - 1


def _dominated(small: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be put into the items of ``by`` as if these were bins.

    Only tried for up to six items; keeping a dominated filling costs time, never a solution.
    """

    def fits(k: int, room: tuple[int, ...]) -> bool:
        if k == len(small):
            return True
        return any(fits(k + 1, (*room[:i], r - small[k], *room[i + 1 :])) for i, r in enumerate(room) if r >= small[k])

    return small != by and len(small) <= 6 and fits(0, by[:6])


def fillings(counts: np.ndarray, space: int) -> list[tuple[int, ...]]:
    """Up to 12 fillings of ``space`` from the sizes left, none dominated by another listed one, least waste first."""
    active = np.flatnonzero(counts[: space + 1])
    if not len(active):
        return [()]
    found: list[tuple[int, ...]] = [(int(active[-1]),)]
    if active[-1] == space:
        return found

    def pairs(room: int, most: int, taken: tuple[int, ...] = ()) -> list[tuple[int, int]]:
        own = active[active <= min(room, most)]
        partner = _largest(active, np.minimum(room - own, own))
        short = (partner >= 0) & (active[partner] == own)
        needs = 2 + (own == taken[0]) if taken else 2
        partner = np.where(short & (counts[own] < needs), partner - 1, partner)
        good = np.flatnonzero(partner >= 0)
        sums = own[good] + active[partner[good]]
        order = np.argsort(-sums, kind="stable")[:_WIDTH]
        return [(int(own[good[i]]), int(active[partner[good[i]]])) for i in order]

    two = pairs(space, space)
    found += two
    if not two or sum(two[0]) < space:
        for a in active[::-1][:_WIDTH].tolist():
            for b, c in pairs(space - a, a, (a,))[:2]:
                found.append((a, b, c))
                if sum(found[-1]) < space:
                    found.append((a, b, c, *fillings_of_rest(counts, (a, b, c), space)))
    legal = {x for x in found if sum(x) <= space and all(x.count(s) <= counts[s] for s in set(x))}
    ordered = sorted(legal, key=lambda x: (-sum(x), [-s for s in x]))[: 4 * _WIDTH]
    kept: list[tuple[int, ...]] = []
    for x in ordered:
        if not any(_dominated(x, y) for y in kept):
            kept.append(x)
    return kept[:_WIDTH]


def fillings_of_rest(counts: np.ndarray, taken: tuple[int, ...], space: int) -> tuple[int, ...]:
    """What best fit adds to a triple: each time the largest size that fits, as often as it does."""
    left, rest = space - sum(taken), []
    for size in np.flatnonzero(counts[: min(left, taken[-1]) + 1])[::-1].tolist():
        if size <= left:
            n = min(left // size, int(counts[size]) - taken.count(size))
            rest += [size] * n
            left -= n * size
        if not left:
            break
    return tuple(rest)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: bins with equal contents are handled together."""
    open_bins: dict[int, list[list]] = {}  # by space left: [contents, number]
    rooms = np.zeros(capacity + 1, dtype=np.int64)  # number of open bins by space left
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = size + int(np.argmax(rooms[size:] > 0)) if rooms[size:].any() else 0
            if not room:
                each = capacity // size
                full, rest = divmod(left, each)
                for contents, times in (((size,) * each, full), ((size,) * rest, 1 if rest else 0)):
                    if times:
                        space = capacity - sum(contents)
                        open_bins.setdefault(space, []).append([contents, times])
                        rooms[space] += times
                break
            contents, times = open_bins[room].pop()
            now = min(times, left)
            if times > now:
                open_bins[room].append([contents, times - now])
            rooms[room] -= now
            open_bins.setdefault(room - size, []).append([(*contents, size), now])
            rooms[room - size] += now
            left -= now
    return [(tuple(c), n) for own in open_bins.values() for c, n in own]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> Plan:
    """As few bins as ``nodes`` search nodes find; never more than best-fit decreasing takes.

    ``counts[s]`` is the number of items of size ``s``; sizes are 1 to ``capacity``. The result is optimal when
    it meets the bound of total size over capacity, or when both searches end within ``nodes`` in total.
    """
    counts = counts.astype(np.int64).copy()
    total = int((counts * np.arange(len(counts))).sum())
    lower = -(-total // capacity)
    best = best_fit(counts, capacity)
    if bins(best) == lower:
        return best
    best, seen, _ = _search(counts, capacity, best, lower, nodes, whole=False)
    if bins(best) > lower and seen < nodes:
        best, *_ = _search(counts, capacity, best, lower, nodes - seen, whole=True)
    return best


def _every(counts: np.ndarray, space: int, known: list[tuple[int, ...]]) -> Iterator[tuple[int, ...] | None]:
    """The listed fillings, then all others that nothing more fits into; None for each dead end on the way."""
    yield from known
    if known and len(known[0]) == 1 and known[0][0] == space:
        return
    listed = set(known)
    sizes = np.flatnonzero(counts[: space + 1])[::-1].tolist()
    # Depth first without recursion: (next size, space left, smallest passed-over size that still has an item, taken).
    todo = [(0, space, space + 1, ())]
    while todo:
        k, left, passed, taken = todo.pop()
        while k < len(sizes) and sizes[k] > left:
            k += 1
        if k == len(sizes):
            yield taken if left < passed and taken not in listed else None
            continue
        most = min(left // sizes[k], int(counts[sizes[k]]))
        for n in range(most + 1):
            todo.append((k + 1, left - n * sizes[k], passed if n == counts[sizes[k]] else min(passed, sizes[k]), taken + (sizes[k],) * n))


def _search(counts: np.ndarray, capacity: int, best: Plan, lower: int, nodes: int, whole: bool) -> tuple[Plan, int, bool]:
    """Depth-first search: the best plan, the nodes used, and whether the search ended.

    Unless ``whole``, a node's branches are its listed fillings, each as often as it can be; otherwise all fillings,
    each as often as it can be, half as often and so on down to once, which covers every packing.
    """
    counts = counts.copy()
    total, fewest = int((counts * np.arange(len(counts))).sum()), bins(best)
    # A level: its pattern and how often, the waste before it, the fillings not yet tried, the pattern to be repeated less, how often, and the size it is around.
    levels: list[list] = []
    waste, seen, going_down = 0, 0, True

    def completed() -> None:
        """Complete what is placed by best fit, unless it can't take fewer bins."""
        nonlocal best, fewest
        if waste > (fewest - 1) * capacity - total:
            return
        held = [(x[0], x[1]) for x in levels if x[0] is not None] + best_fit(counts, capacity)
        if bins(held) < fewest:
            best, fewest = held, bins(held)

    def undo(level: list) -> None:
        nonlocal waste
        if level[0] is not None:
            for size in level[0]:
                counts[size] += level[1]
            waste, level[0] = level[2], None

    while seen < nodes and fewest > lower:
        allowed = (fewest - 1) * capacity - total
        if going_down:
            seen += 1
            big = int(np.max(np.flatnonzero(counts), initial=0))
            if not big:
                best = [(x[0], x[1]) for x in levels]
                fewest = bins(best)
                going_down = False
                continue
            counts[big] -= 1
            own = counts.copy()
            counts[big] += 1
            known = fillings(own, capacity - big)
            levels.append([None, 0, waste, _every(own, capacity - big, known) if whole else iter(known), None, 0, big])
        level = levels[-1]
        undo(level)
        if level[5]:
            pattern, times = level[4], level[5]
        else:
            filling = next(level[3], "end")
            if filling is None:  # a dead end costs time as a node does
                seen += 1
                going_down = False
                continue
            if filling == "end":
                completed()
                levels.pop()
                if not levels:
                    return best, seen, True
                going_down = False
                continue
            pattern = (level[6], *filling)
            times = min(int(counts[s]) // pattern.count(s) for s in set(pattern))
        lost = capacity - sum(pattern)
        if lost:
            times = min(times, (allowed - waste) // lost)
        level[4], level[5] = pattern, max(times, 0) // 2 if whole else 0
        if times <= 0:
            going_down = False
            continue
        for size in pattern:
            counts[size] -= times
        level[0], level[1] = pattern, times
        waste += lost * times
        going_down = True
    while levels and fewest > lower:
        completed()
        undo(levels[-1])
        levels.pop()
    return best, seen, False


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``; other columns are ignored) into sequences of ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty and
    take one token; repeated rows are packed each; an empty table gives no rows.
    """
    pieces = materialise(cut(docs, vocabulary or vocabulary_path(), capacity), "pieces")
    counts = histogram(pieces, capacity)
    return place(pieces, bin_completion(counts, capacity), int(counts.sum()))


def op2_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

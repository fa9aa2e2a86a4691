"""Removal of repeated byte strings, by hash-compared suffix sorting.

Every byte covered by a string of `length` bytes that also starts anywhere else goes, be it in the same text or in any
other. Starts of such strings are called windows here.

1. Prefix sums of a polynomial over the bytes give the hash of any stretch by one subtraction. Each window is known by
   its least hash of `part` bytes (equal windows have equal ones); neighbours with the same one form a block. Windows
   that repeat in their own text are found and settled on the spot. Tasks send (least hash, hash of the block) with
   counts, in sorted runs, to buckets by least hash.
2. A block that occurs twice is repeated as a whole. Where one least hash has different blocks, these are open: one copy
   of each goes to the bucket of its least hash, where all their suffixes are sorted. Suffixes are compared by their
   longest common extension, a binary search over lengths on the prefix hashes, in a mergesort; neighbours in order
   that agree in `length` bytes are repeated, and each such agreement is verified on the bytes themselves.
   A least hash with more than `CROWD` blocks isn't sorted in one place: its windows are counted by a hash of 128 bits.
3. The texts are read once more, blocks are looked up in the sorted arrays of steps 1 and 2 (mapped into memory from the
   shared folder) and the covered bytes go.

Nothing but hashes, counts and one copy of each open block is sent; no step gathers the occurrences of anything.

Results: a null text is empty; texts shorter than `length` never match; empty tables give empty results. Rows that
repeat are copies of each other, so all their bytes in matches go. Texts of any length are walked in stretches. Other
columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugewright.llm.common import mix, partitions, shared_folder, text_packs
from gaugewright.llm.language import bucket_of, mapped, narrow, power_of_two, squeeze, store, unsqueeze

STRETCH = 1 << 20  # windows walked at a time
CROWD = 4096  # different blocks of one least hash that are sorted in one place
REPEATED, OPEN, CROWDED = 1, 2, 4

_BYTE = mix(np.arange(1, 257))
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, in wrapping arithmetic."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate((p, p * np.uint64(pow(base, len(p), 1 << 64))))
        out.append(p[:n])
    return out[0], out[1]


class Hashes:
    """Prefix hashes of some bytes."""

    def __init__(self, data: np.ndarray):
        size = power_of_two(len(data) + 1)
        self.up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        """Hash of the stretch that starts at each place."""
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def all(self, length: int) -> np.ndarray:
        """Hash of every stretch of one length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or largest) value of every run of `width`, by prefix and suffix extremes of fixed cells."""
    n = len(values) - width + 1
    pick = np.minimum if least else np.maximum
    fill = np.uint64(0xFFFFFFFFFFFFFFFF if least else 0)
    cells = np.full(-(-len(values) // width) * width, fill)
    cells[: len(values)] = values
    cells = cells.reshape(-1, width)
    ahead = pick.accumulate(cells, axis=1).ravel()
    behind = pick.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Blocks:
    """Blocks of the texts of a stretch, in places of their joined bytes, and the windows settled on the spot."""

    data: np.ndarray
    hashes: Hashes
    start: np.ndarray
    end: np.ndarray  # one past the last window
    least: np.ndarray
    digest: np.ndarray
    settled: np.ndarray  # windows that repeat in their own text


def same(data: bytes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at a and b agree, looked up in the bytes; runs of neighbours are compared as one."""
    ok = np.ones(len(a), bool)
    if not len(a):
        return ok
    new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1))))
    for i, j in zip(new.tolist(), np.append(new[1:], len(a)).tolist(), strict=True):
        n = j - i - 1 + length
        p, q = int(a[i]), int(b[i])
        if data[p : p + n] != data[q : q + n]:
            ok[i:j] = [data[x : x + length] == data[y : y + length] for x, y in zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)]
    return ok


def blocks(texts: list[bytes], length: int, part: int) -> Blocks:
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    hashes = Hashes(data)
    width = length - part + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Blocks(data, hashes, none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros(0, bool))
    grams = mix(hashes.all(part))
    least = sliding(grams, width, True)
    n = len(least)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    inside = np.zeros(n + 1, np.int64)  # windows that stay in one text
    long = sizes >= length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, np.minimum((ends - length + 1)[long], n), -1)
    live = np.cumsum(inside)[:n] > 0
    # Windows that may repeat in their own text: those whose least part stands there more than once.
    padded = np.zeros(n + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + n] = np.where(live, least, 0)
    chosen = np.flatnonzero(grams == sliding(padded, width, False)[: len(grams)])
    text_of = np.searchsorted(ends, chosen, side="right")
    both = np.unique(mix(grams[chosen] + text_of.astype(np.uint64)), return_counts=True)
    again = both[0][both[1] > 1]
    settled = np.zeros(n, bool)
    keep = live
    if len(again):
        place = np.flatnonzero(live)
        new = np.flatnonzero(np.concatenate(([True], (least[place][1:] != least[place][:-1]) | (np.diff(place) != 1))))
        owner = np.searchsorted(ends, place[new], side="right")
        mark = np.isin(mix(least[place[new]] + owner.astype(np.uint64)), again)
        suspect = place[np.repeat(mark, np.diff(np.append(new, len(place))))]
        whole = mix(hashes.of(suspect, length)) + np.searchsorted(ends, suspect, side="right").astype(np.uint64)
        order = np.argsort(whole, kind="stable")
        s, w = suspect[order], whole[order]
        head = np.concatenate(([True], w[1:] != w[:-1]))
        first = s[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
        later, first = s[~head], first[~head]
        by = np.argsort(later)
        later, first = later[by], first[by]
        ok = same(joined, first, later, length)
        settled[later[ok]] = True
        keep = live & ~settled
        settled[first[ok]] = True
    place = np.flatnonzero(keep)
    if not len(place):
        return Blocks(data, hashes, none, none, none.astype(np.uint64), none.astype(np.uint64), settled)
    new = np.flatnonzero(np.concatenate(([True], (least[place][1:] != least[place][:-1]) | (np.diff(place) != 1))))
    start, end = place[new], place[np.append(new[1:], len(place)) - 1] + 1
    size = end - start + length - 1
    digest = mix(mix(hashes.of(start, size)) + size.astype(np.uint64))
    return Blocks(data, hashes, start, end, least[start], digest, settled)


def stretches(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Texts or pieces of long texts, in bounded packs; a piece overlaps the next, so that no window is lost."""
    for _, pack in text_packs(batches, [], text, STRETCH):
        if len(pack) == 1 and len(pack[0]) > 2 * STRETCH:
            whole = pack[0]
            for at in range(0, len(whole) - length + 1, STRETCH):
                yield [whole[at : at + STRETCH + length - 1]], [(0, at)]
        else:
            yield pack, [(i, 0) for i in range(len(pack))]


def block_runs(text: str, length: int, part: int, buckets: int):
    """Task: (least hash, block hash, count), summed and sorted, in runs per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            least, digest = (np.concatenate(x) for x in zip(*held, strict=True))
            least, digest, times = summed(least, digest, np.ones(len(least), np.int64))
            own = np.searchsorted(bucket_of(least, buckets), np.arange(buckets + 1))
            parts = [(b, slice(own[b], own[b + 1])) for b in range(buckets) if own[b] < own[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in parts], pa.int32()),
                pa.array([squeeze(np.diff(least[s], prepend=np.uint64(0))) for _, s in parts], pa.binary()),
                pa.array([squeeze(digest[s]) for _, s in parts], pa.binary()),
                pa.array([squeeze(narrow(times[s])) for _, s in parts], pa.binary()),
            ], ["bucket", "a", "b", "c"])

        for pack, _ in stretches(batches, text, length):
            found = blocks(pack, length, part)
            # Where a least hash is spread over the hash space, its buckets fill evenly.
            held.append((mix(found.least), found.digest))
            size += len(found.least)
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def summed(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, with their counts."""
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.add.reduceat(times, new) if len(new) else times


def merge_blocks(folder: str):
    """Group: which blocks are repeated, open or crowded, as sorted arrays."""

    def run(rows: pa.Table) -> pa.Table:
        least = np.concatenate([np.cumsum(unsqueeze(x.as_py()), dtype=np.uint64) for x in rows["a"]])
        digest = np.concatenate([unsqueeze(x.as_py()) for x in rows["b"]])
        times = np.concatenate([unsqueeze(x.as_py()).astype(np.int64) for x in rows["c"]])
        least, digest, times = summed(least, digest, times)
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        kinds = np.diff(np.append(new, len(least)))
        kinds = np.repeat(kinds, kinds)
        state = REPEATED * (times > 1) + OPEN * (kinds > 1) + CROWDED * (kinds > CROWD)
        b = rows["bucket"][0].as_py()
        some = state > 0
        key = mix(least[some] ^ digest[some])
        order = np.argsort(key)
        store(folder, f"state-{b}", state[some][order].astype(np.uint8))
        store(folder, f"digest-{b}", digest[some][order])
        store(folder, f"blocks-{b}", key[order])
        return pa.table({"bucket": pa.array([b], pa.int32()), "open": [int((state & OPEN > 0).sum())]})

    return run


def lookup(folder: str, name: str, own: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array of its bucket, -1 if absent; the last copy of a key counts as its place."""
    at = np.full(len(key), -1, np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0, [True]))) if len(own) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[i:j]
        table = mapped(f"{folder}/{name}-{int(own[part[0]])}.npy")
        if not len(table):
            continue
        wanted = np.sort(key[part])
        back = np.argsort(np.argsort(key[part]))
        spot = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        at[part] = np.where(table[spot] == wanted, spot, -1)[back]
    return at


def values(folder: str, name: str, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values beside the places that lookup found; 0 where it found none."""
    out = np.zeros(len(at), np.uint64)
    for b in np.unique(own[at >= 0]).tolist():
        part = np.flatnonzero((own == b) & (at >= 0))
        out[part] = mapped(f"{folder}/{name}-{b}.npy")[at[part]]
    return out


def states(found: Blocks, folder: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State of each block, its bucket and its key."""
    least = mix(found.least)
    own, key = bucket_of(least, buckets), mix(least ^ found.digest)
    at = lookup(folder, "blocks", own, key)
    real = (at >= 0) & (values(folder, "digest", own, at) == found.digest)
    state = np.where(real, values(folder, "state", own, at), 0).astype(np.int64)
    return state, own, key


def open_runs(text: str, length: int, part: int, folder: str, buckets: int):
    """Task: one copy of each open block per bucket; of crowded ones the windows' hashes with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for pack, _ in stretches(batches, text, length):
            found = blocks(pack, length, part)
            state, own, key = states(found, folder, buckets)
            out = []
            some = np.flatnonzero((state & OPEN > 0) & (state & CROWDED == 0))
            fresh = [i for i in some.tolist() if int(key[i]) not in seen and not seen.add(int(key[i]))]
            if len(seen) > 1 << 21:
                seen.clear()
            fresh = np.array(fresh, np.int64)
            joined = found.data.tobytes()
            for b in np.unique(own[fresh]).tolist():
                rows = fresh[own[fresh] == b]
                size = found.end[rows] - found.start[rows]
                body = b"".join(joined[s : s + n + length - 1] for s, n in zip(found.start[rows].tolist(), size.tolist(), strict=True))
                out.append((b, 0, found.least[rows].tobytes(), found.digest[rows].tobytes(), size.tobytes(), body))
            crowd = np.flatnonzero(state & CROWDED > 0)
            if len(crowd):
                size = found.end[crowd] - found.start[crowd]
                at = np.repeat(found.start[crowd] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                times = np.repeat(1 + (state[crowd] & REPEATED > 0), size)
                one, two = window_hashes(found, at, length)
                one, two, times = summed(one, two, times)
                where = bucket_of(one, buckets)
                for b in np.unique(where).tolist():
                    s = where == b
                    out.append((b, 1, one[s].tobytes(), two[s].tobytes(), np.minimum(times[s], 2).tobytes(), b""))
            if out:
                names = ["bucket", "kind", "a", "b", "c", "body"]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def window_hashes(found: Blocks, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each window: of its whole, and of its halves in another mix."""
    half = length // 2
    whole = mix(found.hashes.of(at, length))
    halves = mix(mix(found.hashes.of(at, half)) * np.uint64(3) + found.hashes.of(at + half, length - half))
    return whole, halves


def common(hashes: Hashes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension of suffixes, up to `length`: binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    for _ in range(int(length).bit_length()):
        mid = (low + high + 1) // 2
        equal = hashes.of(a, mid) == hashes.of(b, mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def suffix_order(hashes: Hashes, data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Mergesort of suffixes inside groups (given in order): all pairs of neighbouring runs are merged at once."""
    n = len(at)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(begin, n))
    base, total = np.repeat(begin, size), np.repeat(size, size)
    order = np.arange(n)
    run = 1
    longest = int(size.max()) if n else 0
    while run < longest:
        inner = np.arange(n) - base
        number = inner // run
        partner = np.where(number % 2 == 0, number + 1, number - 1) * run  # where the other run starts
        active = np.flatnonzero((total > run) & (partner < total))
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        high[active] = np.minimum(run, total[active] - partner[active])
        todo = active
        second = number % 2 == 1
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            mine, other = at[order[todo]], at[order[base[todo] + partner[todo] + mid]]
            same_ = common(hashes, mine, other, length)
            stop = same_ >= length
            x = data[np.minimum(mine + same_, len(data) - 1)]
            y = data[np.minimum(other + same_, len(data) - 1)]
            # Equal suffixes keep the order of their runs.
            before = np.where(stop, second[todo], y < x)
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = np.arange(n)
        first = np.minimum(number * run, partner)
        place[active] = base[active] + first[active] + (inner[active] - number[active] * run) + low[active]
        moved = np.empty(n, np.int64)
        moved[place] = order
        order = moved
        run *= 2
    return order


def sort_open(folder: str, length: int, part: int):
    """Group: the repeated windows of a bucket's open blocks, as intervals of each block."""

    def run(rows: pa.Table) -> pa.Table:
        b, kind = rows["bucket"][0].as_py(), rows["kind"][0].as_py()
        if kind == 1:
            one, two, times = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows[c]]) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
            one, two, times = summed(one, two, times)
            one, two = one[times > 1], two[times > 1]
            store(folder, f"other-{b}", two)
            store(folder, f"windows-{b}", one)
            return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(one)]})
        distinct: dict[tuple[int, int], tuple[int, bytes]] = {}
        for row in rows.select(["a", "b", "c", "body"]).to_pylist():
            least, digest, size = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64), np.frombuffer(row["c"], np.int64)
            at = 0
            for m, d, n in zip(least.tolist(), digest.tolist(), size.tolist(), strict=True):
                if (m, d) not in distinct:
                    distinct[m, d] = (n, row["body"][at : at + n + length - 1])
                at += n + length - 1
        keys = sorted(distinct)
        least, digest = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64)
        windows = np.array([distinct[k][0] for k in keys], np.int64)
        found: list[list[tuple[int, int]]] = [[] for _ in keys]
        # Blocks of one least hash stay together; a part of the bucket at a time.
        edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        reach = np.concatenate(([0], np.cumsum(windows)))
        i = 0
        while i < len(keys):
            later = edge[(edge > i) & (reach[edge] >= reach[i] + (1 << 19))]
            j = int(later[0]) if len(later) else len(keys)
            for k, span in agreements(b"".join(distinct[x][1] for x in keys[i:j]), least[i:j], windows[i:j], length, part):
                found[i + k].append(span)
            i = j
        some = [k for k in range(len(keys)) if found[k]]
        key = mix(mix(least[some]) ^ digest[some]) if some else np.zeros(0, np.uint64)
        order = np.argsort(key)
        spans = [np.array(found[some[k]], np.uint32).reshape(-1, 2) for k in order.tolist()]
        store(folder, f"spans-{b}", np.concatenate(spans) if spans else np.zeros((0, 2), np.uint32))
        store(folder, f"until-{b}", np.cumsum([len(s) for s in spans]).astype(np.uint64))
        store(folder, f"body-{b}", digest[some][order] if some else np.zeros(0, np.uint64))
        store(folder, f"sorted-{b}", key[order])
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(some)]})

    return run


def agreements(joined: bytes, least: np.ndarray, windows: np.ndarray, length: int, part: int) -> Iterator[tuple[int, tuple[int, int]]]:
    """Intervals of windows (from, to) of each block that also start elsewhere in these blocks."""
    data = np.frombuffer(joined, np.uint8)
    hashes = Hashes(data)
    size = windows + length - 1
    begin = np.cumsum(size) - size
    block = np.repeat(np.arange(len(windows)), windows)
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    # Equal windows have their least part in the same place, so that place parts the groups further.
    grams = mix(hashes.all(part))
    owner = np.repeat(np.arange(len(windows)), size)[: len(grams)]
    spots = np.flatnonzero(grams == least[owner])
    away = spots[np.minimum(np.searchsorted(spots, at), len(spots) - 1)] - at
    order = np.lexsort((away, least[block]))
    at, block, group = at[order], block[order], (least[block][order], away[order])
    new = np.concatenate(([True], (group[0][1:] != group[0][:-1]) | (group[1][1:] != group[1][:-1])))
    number = np.cumsum(new)
    counts = np.bincount(number)
    busy = counts[number] > 1  # a group of one has nothing to agree with
    at, block, number = at[busy], block[busy], number[busy]
    if not len(at):
        return
    order = suffix_order(hashes, data, at, number, length)
    at, block, number = at[order], block[order], number[order]
    near = np.flatnonzero(number[1:] == number[:-1])
    near = near[common(hashes, at[near], at[near + 1], length) >= length]
    by = np.argsort(at[near])
    near = near[by]
    near = near[same(joined, at[near], at[near + 1], length)]
    hit = np.unique(np.concatenate((at[near], at[near + 1])))
    if not len(hit):
        return
    owner = np.searchsorted(begin, hit, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner) != 0))))
    last = np.append(new[1:], len(hit)) - 1
    for i, j in zip(new.tolist(), last.tolist(), strict=True):
        k = int(owner[i])
        yield k, (int(hit[i] - begin[k]), int(hit[j] - begin[k]) + 1)


def covered(texts: list[bytes], folder: str, buckets: int, length: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes and which of their windows are repeated."""
    found = blocks(texts, length, part)
    state, own, key = states(found, folder, buckets)
    marks = np.zeros(len(found.data) + 2, np.int64)
    whole = state & REPEATED > 0
    np.add.at(marks, found.start[whole], 1)
    np.add.at(marks, found.end[whole], -1)
    rest = np.flatnonzero((state & OPEN > 0) & ~whole & (state & CROWDED == 0))
    at = lookup(folder, "sorted", own[rest], key[rest])
    real = (at >= 0) & (values(folder, "body", own[rest], at) == found.digest[rest])
    rest, at = rest[real], at[real]
    until = values(folder, "until", own[rest], at).astype(np.int64)
    first = np.where(at > 0, values(folder, "until", own[rest], np.where(at > 0, at - 1, -1)), 0).astype(np.int64)
    for b in np.unique(own[rest]).tolist():
        s = own[rest] == b
        spans = mapped(f"{folder}/spans-{b}.npy")
        n = until[s] - first[s]
        rows = np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = np.repeat(found.start[rest[s]], n)
        np.add.at(marks, base + spans[rows, 0], 1)
        np.add.at(marks, base + spans[rows, 1], -1)
    crowd = np.flatnonzero((state & CROWDED > 0) & ~whole)
    if len(crowd):
        size = found.end[crowd] - found.start[crowd]
        place = np.repeat(found.start[crowd] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        one, two = window_hashes(found, place, length)
        where = bucket_of(one, buckets)
        spot = lookup(folder, "windows", where, one)
        hit = place[(spot >= 0) & (values(folder, "other", where, spot) == two)]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + 1, -1)
    starts = np.cumsum(marks)[: len(found.data)] > 0
    starts[: len(found.settled)] |= found.settled
    return found.data, starts


def spread(starts: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by the windows that start at the marked places."""
    edges = np.zeros(len(starts) + length + 1, np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    edges[at + length] -= 1
    return np.cumsum(edges)[: len(starts)] > 0


def index(docs: DataFrame, text: str = "text", length: int = 200, part: int = 64) -> tuple[str, int]:
    """Writes the sorted arrays of repeated and open blocks; returns their folder and the number of buckets."""
    spark = docs.sparkSession
    texts = docs.select(text)
    folder = shared_folder(spark, "repeats")
    buckets = min(1 << 16, power_of_two(2 * partitions(texts)))
    runs = texts.mapInArrow(block_runs(text, length, part, buckets), "bucket int, a binary, b binary, c binary")
    runs.groupBy("bucket").applyInArrow(merge_blocks(folder), "bucket int, open long").write.format("noop").mode("overwrite").save()
    opened = texts.mapInArrow(
        open_runs(text, length, part, folder, buckets), "bucket int, kind int, a binary, b binary, c binary, body binary"
    )
    opened.groupBy("bucket", "kind").applyInArrow(sort_open(folder, length, part), "bucket int, n long").write.format("noop").mode("overwrite").save()
    return folder, buckets


def dedupe(
    docs: DataFrame, text: str = "text", kept: list[str] | None = None, length: int = 200, part: int = 64, texts: bool = True,
) -> DataFrame:
    """The kept columns (all by default), n_bytes, n_removed, n_spans, kept_sha256; with texts also what is left.

    A cut may fall inside a character; the column `left` has the bytes that stay.
    """
    folder, buckets = index(docs, text, length, part)
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    added += [("left", T.BinaryType())] if texts else []
    names = [c for c in (kept or docs.columns) if c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in added])

    def result(data: bytes, starts: np.ndarray) -> tuple:
        gone = spread(starts, length)[: len(data)]
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        return (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), *([rest] if texts else []))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, pack in text_packs([batch], [], text, STRETCH):
            if len(pack) == 1 and len(pack[0]) > 2 * STRETCH:
                starts = np.zeros(len(pack[0]), bool)
                for piece, [(_, at)] in stretches([batch_of(pack[0], text)], text, length):
                    data, some = covered(piece, folder, buckets, length, part)
                    starts[at : at + len(data)] |= some
                yield result(pack[0], starts)
                continue
            _, starts = covered(pack, folder, buckets, length, part)
            at = 0
            for data in pack:
                yield result(data, starts[at : at + len(data)])
                at += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(rows(batch))
            if found:
                columns = [pa.array(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, *dict(added)])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def batch_of(data: bytes, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], [text])

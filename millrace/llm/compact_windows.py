"""Passages that repeat across documents, by compact windows of token min-hashes.

A text is its sequence of WIDTH-word shingles. Under one hash function, the Cartesian tree of the shingles' hashes
groups subsequences: a node and its span [l, r] stand for all the subsequences within the span that hold the node, and
they share its hash as their minimum. Only nodes whose span has room for the least passage matter, and those are the
runs of equal values in the sliding minimum over that many shingles, so they come without building the tree. The
intervals of HASHES functions are joined in bands of ROWS functions: where spans of a band's functions overlap by a
passage's length, the subsequences there share the band's signature, and a text has one entry for it.

Texts that share an entry are candidates: everyone with the entry's leader. Its rows are told apart into classes that
passages tie together, and rows of different classes are compared until no passage is left between two. Those whom no passage that holds one of the
entry's subsequences ties to it are compared with all that have the entry, around the entry's place, by a prefix join:
shingles are ordered by how many of the entry's rows have them, and two parts that have enough shingles in common for a
passage share one of the rarest of either. So a formula that thousands of texts have, too short for a passage, brings none
of them together, and rows that share a rare shingle are compared in blocks. Candidates are verified shingle by shingle:
runs of matches along a diagonal, long enough and THRESHOLD alike, are the passages.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import WordCodes, hold, materialise, mix64, shingle_codes, shuffle_partitions, text_or_empty
from millrace.llm.components import components

WIDTH = 5
#: Words of the shortest passage that counts.
LEAST_WORDS = 50
THRESHOLD = 0.8
HASHES, ROWS = 4, 2
#: Matches further apart than this, along the text or across diagonals, belong to different passages.
GAP, DRIFT = 12, 12
#: Rows of a signature that are compared at once with as many others.
BLOCK = 1024
#: Rows of a signature that are compared pair by pair.
FEW = 24

_U = np.uint64
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64))


@lru_cache(maxsize=1)
def _words() -> WordCodes:
    return WordCodes()


def sequence(text: str) -> np.ndarray:
    """The codes of the text's shingles in order; none if it has fewer words than a shingle."""
    return _shingles(_words().codes(text))


def _shingles(codes: np.ndarray) -> np.ndarray:
    codes = codes[codes != 0]
    return shingle_codes(codes, WIDTH) if len(codes) >= WIDTH else codes[:0]


def sliding_min(h: np.ndarray, room: int) -> np.ndarray:
    span = 1
    while span * 2 <= room:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - room + span], h[room - span :]) if span < room else h


def compact_windows(h: np.ndarray, room: int) -> list[tuple[int, int, int]]:
    """(l, r, minimum) of the Cartesian tree's nodes whose span holds `room` places or more: the part [l, r] of the span
    that subsequences of `room` places with the node in them cover."""
    if len(h) < room:
        return []
    m = sliding_min(h, room)
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    last = np.append(first[1:], len(m)) - 1
    return list(zip(first.tolist(), (last + room - 1).tolist(), m[first].tolist(), strict=True))


def entries(seq: np.ndarray, room: int = LEAST_WORDS - WIDTH + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, more): the signatures of the sequence's subsequences of `room` shingles, each run of equal ones once,
    with the place of its first subsequence and how many follow."""
    if len(seq) < room:
        return seq[:0], np.zeros(0, np.int32), np.zeros(0, np.int32)
    mins = [sliding_min(mix64(seq + _SEEDS[f]), room) for f in range(HASHES)]
    out = []
    for band in range(HASHES // ROWS):
        key = np.full(len(mins[0]), band + 1, np.uint64)
        for f in range(band * ROWS, band * ROWS + ROWS):
            key = mix64(key + mins[f])
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out.append((key[at], at, np.append(at[1:], len(key)) - at - 1))
    key, at, more = (np.concatenate(x) for x in zip(*out, strict=True))
    return key, at.astype(np.int32), more.astype(np.int32)


def _matched(one: np.ndarray, two: np.ndarray, kinds: int, pa_: np.ndarray, pb_: np.ndarray, room: int) -> list[tuple[int, int, int, int, float]]:
    """The passages along matches of places pa_ (ascending) and pb_ of two sequences of codes below `kinds`. A run of matches
    whose likeness falls short is cut where it jumps furthest, and its parts are looked at again."""
    if len(pa_) < THRESHOLD * room * 0.9:
        return []
    step = pa_[1:] - pa_[:-1]
    shift = np.abs(pb_[1:] - pb_[:-1] - step)
    cut = np.flatnonzero((step > GAP) | (shift > DRIFT))
    first, last = np.append(0, cut + 1), np.append(cut, len(pa_) - 1)
    long = pa_[last] - pa_[first] >= room - 1
    waiting = list(zip(first[long].tolist(), last[long].tolist(), strict=True))
    jump = step + shift
    out = []
    while waiting:
        i, j = waiting.pop()
        a0, a1 = int(pa_[i]), int(pa_[j]) + 1
        if a1 - a0 < room:
            continue
        b0, b1 = int(pb_[i : j + 1].min()), int(pb_[i : j + 1].max()) + 1
        if b1 - b0 < room:
            continue
        x, y = np.zeros(kinds, bool), np.zeros(kinds, bool)
        x[one[a0:a1]] = True
        y[two[b0:b1]] = True
        both = np.count_nonzero(x & y)
        likeness = both / (np.count_nonzero(x) + np.count_nonzero(y) - both)
        if likeness >= THRESHOLD - 1e-9:
            out.append((a0, a1, b0, b1, likeness))
        elif j > i:
            k = i + int(np.argmax(jump[i:j]))
            waiting += [(i, k), (k + 1, j)]
    return out


#: Offsets from a diagonal, the nearest first.
_NEAREST = np.array(sorted(range(-DRIFT, DRIFT + 1), key=abs))


def _beside(a: np.ndarray, around: np.ndarray, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a and the equal places of a sequence of n that lie nearest to diagonal d, at most DRIFT from it. around holds
    what lies about each of its places, from len(a) before the first on."""
    lo, hi = max(0, -d - DRIFT), min(len(a), n - d + DRIFT)
    same = (around[lo + d + len(a) : hi + d + len(a)] == a[lo:hi, None])[:, _NEAREST + DRIFT]
    first = same.argmax(1)
    here = np.flatnonzero(same[np.arange(hi - lo), first])
    return here + lo, here + lo + d + _NEAREST[first[here]]


def _seeded(one: np.ndarray, two: np.ndarray, values: np.ndarray, room: int, known: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Passages along every diagonal on which a min-hash of both has a place in each, unless all the windows of both
    places lie in passages already, known ones or such. Inside a stretch of one repeated shingle only the ends are such places.
    one and two are numbers of values."""
    kinds, n, m = len(values), len(one), len(two)
    seed = np.zeros(kinds, bool)
    for f in range(HASHES):
        order = np.argsort(mix64(values.astype(_U) + _SEEDS[f]))
        rank = np.empty(kinds, np.int32)
        rank[order] = np.arange(kinds, dtype=np.int32)
        x, y = np.zeros(kinds, bool), np.zeros(kinds, bool)
        x[sliding_min(rank[one], room)] = True
        y[sliding_min(rank[two], room)] = True
        seed[order[x & y]] = True

    def places(s):
        new = s[1:] != s[:-1]
        return np.flatnonzero((np.append(True, new) | np.append(new, True)) & seed[s])

    at, there = places(one), places(two)
    there = there[np.argsort(two[there], kind="stable")]
    lo, hi = np.searchsorted(two[there], one[at], "left"), np.searchsorted(two[there], one[at], "right")
    # for each place, the furthest end of a passage that holds it
    end_a, end_b = np.zeros(n, np.int64), np.zeros(m, np.int64)

    def cover(p):
        np.maximum(end_a[p[0] : p[1]], p[1], out=end_a[p[0] : p[1]])
        np.maximum(end_b[p[2] : p[3]], p[3], out=end_b[p[2] : p[3]])

    for p in known:
        cover(p)
    j0, j1 = np.maximum(0, there - room + 1), np.minimum(m, there + room)
    mark = np.zeros(kinds, bool)
    outside = np.full(n + DRIFT, -1)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([outside, two, outside]), 2 * DRIFT + 1)
    tried, out = np.zeros(n + m, bool), []
    for i, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        i0, i1 = max(0, i - room + 1), min(n, i + room)
        left = ~tried[there[x:y] - i + n] & ((end_a[i0] < i1) | (end_b[j0[x:y]] < j1[x:y]))
        for k in (np.flatnonzero(left) + x).tolist():
            j = int(there[k])
            if end_a[i0] >= i1 and end_b[j0[k]] >= j1[k]:
                continue
            near = two[max(0, j0[k] - DRIFT) : j1[k] + DRIFT]
            mark[near] = True
            found = np.count_nonzero(mark[one[i0:i1]])
            mark[near] = False
            if found < THRESHOLD * room * 0.9:
                continue
            tried[j - i + n] = True
            for p in _matched(one, two, kinds, *_beside(one, around, m, j - i), room):
                cover(p)
                out.append(p)
    return out


def passages(a: np.ndarray, b: np.ndarray, room: int = LEAST_WORDS - WIDTH + 1) -> list[tuple[int, int, int, int, float]]:
    """(start, end in a, start, end in b, likeness) of the passages two sequences share; places of shingles, end exclusive.

    A shingle's first place in a is matched with its first in b, its second with its second, and so on; where a shared
    shingle has several places in a or b, all of them are tried from those of the min-hashes. Codes are of 32 bits.
    """
    n, m = len(a), len(b)
    if min(n, m) < room:
        return []
    if n == m and (a == b).all():
        return [(0, n, 0, m, 1.0)]
    # both sequences' places by shingle, those of a first
    order = np.concatenate([a, b]).astype(_U) << _U(32) | np.arange(n + m, dtype=_U)
    order.sort()
    at, value = (order & _U(0xFFFFFFFF)).astype(np.int64), order >> _U(32)
    new = np.append(True, value[1:] != value[:-1])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    kinds = len(first)
    code = np.empty(n + m, np.int64)
    code[at] = group
    one, two = code[:n], code[n:]
    in_a, in_b = np.bincount(one, minlength=kinds), np.bincount(two, minlength=kinds)
    common = (in_a > 0) & (in_b > 0)
    # a passage has at least so many distinct shingles on either side
    least_a, least_b = (max(1, room - len(s) + np.count_nonzero(c)) for s, c in ((a, in_a), (b, in_b)))
    if np.count_nonzero(common) < _needed(least_a, least_b) - 1e-6:
        return []
    mine = np.flatnonzero(at < n)
    mine = mine[mine - first[group[mine]] < in_b[group[mine]]]
    mate = np.full(n, -1)
    mate[at[mine]] = at[mine + in_a[group[mine]]] - n
    pa_ = np.flatnonzero(mate >= 0)
    out = _matched(one, two, kinds, pa_, mate[pa_], room)
    whole = any(p[:4] == (0, n, 0, m) for p in out)
    if not whole and (common & (in_a + in_b > 2)).any():
        out = list(dict.fromkeys(_seeded(one, two, value[first], room, out) + out))
        spans = np.array([p[:4] for p in out]).reshape(-1, 4)
        inside = lambda p, k: ((spans[:, 0] <= p[0]) & (spans[:, 1] >= p[1]) & (spans[:, 2] <= p[2]) & (spans[:, 3] >= p[3]) & (np.arange(len(spans)) != k)).any()
        out = [p for k, p in enumerate(out) if not inside(p, k)]
    return sorted(out)


def _entries_of(docs: DataFrame) -> DataFrame:
    """(key, doc, at, more): the signatures of each row's text and their places."""

    def out(ids, found):
        key, at, more = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.repeat(np.array(ids, np.int64), [len(x[0]) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(at), pa.array(more)], ["key", "doc", "at", "more"])

    def run(batches):
        hold("windows", _words().clear)
        for batch in batches:
            ids, found, size = [], [], 0
            for doc_id, codes in zip(batch.column(0).to_pylist(), _words().of(batch.column(1)), strict=True):
                ids.append(doc_id)
                found.append(entries(_shingles(codes)))
                size += len(found[-1][0])
                if size > 200_000:
                    yield out(ids, found)
                    ids, found, size = [], [], 0
            if size:
                yield out(ids, found)

    return docs.mapInArrow(run, "key long, doc long, at int, more int")


def _held(docs: DataFrame) -> DataFrame:
    """(key, doc, at, more) of the signatures that more than one row has.

    Signatures are counted before they are joined, so of the many that only one text has nothing but a count is kept.
    """
    every = materialise(_entries_of(docs), "windows-entries")
    shared = every.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("key")
    shared = materialise(shared, "windows-shared")
    return materialise(every.join(shared.hint("merge"), "key"), "windows-held")


def _led(held: DataFrame) -> DataFrame:
    """(key, doc, at, more, to): each row of a signature beside the signature's leader, the least doc."""
    leaders = materialise(held.groupBy("key").agg(F.min("doc").alias("to")), "windows-leaders")
    return held.join(leaders.hint("merge"), "key")


SCHEMA = "a long, b long, a_start int, a_end int, b_start int, b_end int, likeness double"


def shared_passages(docs: DataFrame) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, likeness), a < b: passages that tie documents of equal signatures together.

    Places are words from 0, end exclusive; words are white-space chunks that hold a letter or digit. Passages have
    LEAST_WORDS words or more on both sides. Null texts are empty; rows with a null doc_id are left out; of rows that
    share a doc_id one text is compared; an empty table gives an empty one; other columns are left out.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).filter("id IS NOT NULL")
    held = _held(d)
    texts = _sequences(held.select(F.col("doc").alias("id")), d)
    led = materialise(_led(held).filter("doc <> to"), "windows-led")
    pairs = _new(led.select(F.least("doc", "to").alias("a"), F.greatest("doc", "to").alias("b")), None)
    links = materialise(_verified(pairs, texts), "windows-found")
    # rows whom no passage that holds one of the signature's subsequences ties to the leader
    sides = [links.select(F.col(x).alias("doc"), F.col(y).alias("to"), F.col(f"{x}_start").alias("start"), (F.col(f"{x}_end") - LEAST_WORDS).alias("last")) for x, y in ("ab", "ba")]
    ends = materialise(sides[0].unionByName(sides[1]).distinct(), "windows-ends").hint("merge")
    holds = F.greatest("at", "start") <= F.least(F.col("at") + F.col("more"), F.col("last"))
    lost = led.alias("l").join(ends.alias("e"), (F.col("l.doc") == F.col("e.doc")) & (F.col("l.to") == F.col("e.to")) & holds, "left_anti")
    lost = materialise(lost.select("key", "doc", "at", "more"), "windows-lost")
    met = _new(_across(held, lost, texts), pairs)
    return links.unionByName(materialise(_verified(met, texts), "windows-found")).distinct()


def _new(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """The distinct pairs (a, b) that aren't known."""
    pairs = pairs.distinct()
    return materialise(pairs if known is None else pairs.join(known.hint("merge"), ["a", "b"], "left_anti"), "windows-pairs")


def _least_distinct(s: np.ndarray, room: int) -> int:
    """A bound from below of how many distinct shingles a subsequence of `room` or more has."""
    return max(1, room - (len(s) - len(np.unique(s))))


def _reach(hit: np.ndarray, row: np.ndarray, room: int) -> np.ndarray:
    """The rows that have places `hit`, no two neighbours further apart than a passage's matches may be, over `room` places."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    cut = np.flatnonzero((np.diff(at) > GAP + DRIFT) | (row[at[1:]] != row[at[:-1]]))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return np.unique(row[first[last - first + 1 >= room]])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from lo to hi of each, and whose they are."""
    long = np.maximum(0, hi - lo)
    whose = np.repeat(np.arange(len(lo)), long)
    return np.arange(len(whose)) + (lo - np.cumsum(long) + long)[whose], whose


def _dense(hit: np.ndarray, size: np.ndarray, part: int, of: int, room: int) -> np.ndarray:
    """Of rows of so many places each, one after the other: whether `room` places or more in a row are hit by part / of."""
    total = np.append(0, np.cumsum(hit.astype(np.int64) * of - part))
    first = np.cumsum(size) - size
    at, whose = _spread(first, first + size - room + 1)
    apart = whose * (2 * of * (len(hit) + 1))
    enough = total[at + room] >= np.minimum.accumulate(total[at] - apart) + apart
    return np.bincount(whose[enough], minlength=len(size)) > 0


def _alike(parts: list[np.ndarray], room: int, meets) -> list[tuple[int, int]]:
    """The pairs of rows that meet and have enough distinct shingles in common for a passage, the most alike first."""
    size = np.array([len(s) for s in parts])
    value, code = np.unique(np.concatenate(parts), return_inverse=True)
    has = np.zeros((len(parts), len(value)), np.float32)
    has[np.repeat(np.arange(len(parts)), size), code] = 1
    common = has @ has.T
    least = np.maximum(1, room - (size - common.diagonal()))
    x, y = np.nonzero(np.triu(common >= _needed(least[:, None], least) - 1e-6, 1))
    near = meets(x, y) & (np.minimum(size[x], size[y]) >= room)
    x, y = x[near], y[near]
    order = np.argsort(-common[x, y], kind="stable")
    return list(zip(x[order].tolist(), y[order].tolist(), strict=True))


def across(doc: np.ndarray, open_: np.ndarray, own: np.ndarray, parts: list[np.ndarray], room: int = LEAST_WORDS - WIDTH + 1, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(a, b) docs, a < b: links that, with those known, make one class of all rows whose parts share passages, directly or
    through others.

    Known are the classes `group`, or one of all rows that aren't open. Only rows of different classes are compared, and each
    link makes one class of two, so none between two classes that are left is missed.
    Of up to FEW rows, all that have enough shingles in common for a passage are compared, the most alike first. Of more, rows
    that have `room` shingles in a row in common are told by sums of hashes over all places; for the others,
    shingles in common are counted for all rows that share one of their rarest shingles (see rarest), and those that have
    enough for a passage, near enough to each other, are compared, the most alike first.
    own is the block of a row; where there are two, rows meet those of the other block only.
    """
    two = len(np.unique(own)) > 1
    n, found = len(doc), []
    group = np.where(open_, np.arange(1, n + 1), 0) if group is None else np.unique(group, return_inverse=True)[1]

    def meets(x, y):
        return (doc[x] != doc[y]) & ((own[x] != own[y]) | (not two)) & (group[x] != group[y])

    def share(x, y):
        """Whether a passage is found as `_verified` looks for it, from the lesser doc: the other way round cuts may differ."""
        x, y = (x, y) if doc[x] < doc[y] else (y, x)
        return bool(passages(parts[x], parts[y], room))

    def tie(x, y):
        found.append((x, y))
        group[group == group[y]] = group[x]

    if n <= FEW:
        for x, y in _alike(parts, room, meets):
            if group[x] != group[y] and share(x, y):
                tie(x, y)
        return sorted({(int(min(doc[x], doc[y])), int(max(doc[x], doc[y]))) for x, y in found})
    sums, rows = [], []
    for r, s in enumerate(parts):
        if len(s) >= room:
            total = np.append(_U(0), np.cumsum(mix64(s.astype(_U) + _SEEDS[0]), dtype=np.uint64))
            sums.append(np.unique(total[room:] - total[:-room]))
            rows.append(np.full(len(sums[-1]), r))
    if not sums:
        return []
    value, row = np.concatenate(sums), np.concatenate(rows)
    order = np.lexsort((doc[row], own[row], value))
    value, row = value[order], row[order]
    first = np.maximum.accumulate(np.where(np.append(True, value[1:] != value[:-1]), np.arange(len(value)), 0))
    ends = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1]))[1:], len(value)) - 1
    last = ends[np.searchsorted(ends, np.arange(len(value)))]
    # rows of equal sums stand by block and doc, so if any other will do, the first or the last does
    for other in (row[first], row[last]):
        m = meets(row, other)
        for x, y in sorted(set(zip(row[m].tolist(), other[m].tolist(), strict=True))):
            if group[x] != group[y]:
                tie(x, y)
    most = np.bincount(group).argmax()
    waiting = group != most
    if waiting.any():
        size = np.array([len(s) for s in parts])
        begin = np.cumsum(size) - size
        _, seq = np.unique(np.concatenate(parts), return_inverse=True)
        of = np.repeat(np.arange(n), size)
        at, code = np.divmod(np.unique(of * (seq.max() + 1) + seq), seq.max() + 1)
        counts, kinds = np.bincount(code), np.bincount(at, minlength=n)
        start = np.cumsum(kinds) - kinds
        least = np.maximum(1, room - (size - kinds))
        enough = np.maximum(1, np.ceil(_needed(least, least.min()) - 1e-9))
        # the rarest shingles of each row, without those that it alone has
        order = np.lexsort((code, counts[code], at))
        rare = order[(np.arange(len(at)) - start[at] < (kinds - enough + 1)[at]) & (counts[code[order]] > 1)]
        rare_of = np.split(code[rare], np.searchsorted(at[rare], np.arange(1, n)))
        rare = rare[np.argsort(code[rare], kind="stable")]
        posted, poster = code[rare], at[rare]
        mine, plain = np.full(len(counts), -1), kinds == size
        for x in np.flatnonzero(waiting).tolist():
            lo, hi = np.searchsorted(posted, rare_of[x], "left"), np.searchsorted(posted, rare_of[x], "right")
            others = np.unique(poster[_spread(lo, hi)[0]])
            others = others[meets(x, others) & (~waiting[others] | (others > x))]
            if not len(others):
                continue
            own_codes, one = code[start[x] : start[x] + kinds[x]], seq[begin[x] : begin[x] + size[x]]
            mine[own_codes] = np.arange(kinds[x])
            all_, whose = _spread(start[others], start[others] + kinds[others])
            common = np.bincount(whose, mine[code[all_]] >= 0, len(others))
            near = common >= _needed(least[x], least[others]) - 1e-9
            others, common = others[near], common[near]
            if len(others):
                all_, whose = _spread(begin[others], begin[others] + size[others])
                theirs = mine[seq[all_]]
                near = np.isin(np.arange(len(others)), _reach(theirs >= 0, whose, room))
                # both sides of a passage are hit by THRESHOLD, 4 / 5, the shorter by 8 / 9; where shingles recur places don't tell
                held = np.zeros((len(others), kinds[x]), bool)
                held[whose[theirs >= 0], theirs[theirs >= 0]] = True
                sides = [(theirs >= 0, size[others], plain[others]), (held[:, mine[one]].ravel(), np.full(len(others), size[x]), np.full(len(others), plain[x]))]
                near &= np.logical_and.reduce([_dense(h, n_, 4, 5, room) | ~p for h, n_, p in sides])
                near &= np.logical_or.reduce([_dense(h, n_, 8, 9, room) | ~p for h, n_, p in sides])
                others, common = others[near], common[near]
            mine[own_codes] = -1
            for y in others[np.argsort(-common, kind="stable")].tolist():
                if group[x] != group[y] and share(x, y):
                    tie(x, y)
    return sorted({(int(min(doc[x], doc[y])), int(max(doc[x], doc[y]))) for x, y in found})


def _needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many distinct shingles two passages of x and y or more have in common at least."""
    return np.maximum(THRESHOLD * np.maximum(x, y), THRESHOLD / (1 + THRESHOLD) * (x + y))


def rarest(shingles: np.ndarray, shared: np.ndarray, counts: np.ndarray, least: int, least_other: int = 1) -> np.ndarray:
    """The prefix by which a part is found: of its distinct `shingles`, ordered by how many rows have them, as many as leave
    fewer than two passages of `least` and `least_other` shingles or more have in common, without those that no other row
    has. shared and counts are those that others have too."""
    need = max(1, math.ceil(float(_needed(least, least_other)) - 1e-9))
    room = len(shingles) - need + 1 - (len(shingles) - len(shared))
    return shared[np.lexsort((shared, counts))][: max(0, room)]


def _across(held: DataFrame, lost: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that, with the leaders' ties, make one class of all rows of a signature whose parts share passages, directly
    or through others; lost are the rows (key, doc, at, more) among held that no passage ties to the leader.

    A row comes with the part of its text that the signature's subsequences cover; rows of equal parts are one, with links to
    the least doc. The rows of a signature of up to BLOCK parts meet at once. In greater ones, rows that share one of their
    rarest shingles are dealt out in blocks, and each two blocks meet in one task.
    """
    counts = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    open_keys = materialise(counts.join(lost.select("key").distinct().hint("merge"), "key").select("key"), "windows-open-keys")
    rows = held.join(open_keys.hint("merge"), "key").join(lost.withColumn("lost", F.lit(True)).hint("merge"), ["key", "doc", "at", "more"], "left")
    rows = rows.select("doc", F.struct("key", "at", "more", F.coalesce("lost", F.lit(False)).alias("open")).alias("x"))
    by_doc = rows.groupBy("doc").agg(F.collect_list("x").alias("xs")).join(texts.withColumnRenamed("id", "doc").hint("merge"), "doc")
    room = LEAST_WORDS - WIDTH + 1

    def cut(batches):
        for batch in batches:
            for doc, xs, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(seq, "<u4")
                parts = [s[x["at"] : x["at"] + x["more"] + room].tobytes() for x in xs]
                least = [_least_distinct(np.frombuffer(x, "<u4"), room) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["key"] for x in xs], pa.int64()), pa.array([doc] * len(xs), pa.int64()), pa.array([x["open"] for x in xs]), pa.array(parts, pa.binary()), pa.array(least, pa.int32())],
                    ["key", "doc", "open", "part", "least"],
                )

    parts = by_doc.select("doc", "xs", "seq").mapInArrow(cut, "key long, doc long, open boolean, part binary, least int")
    parts = materialise(parts.withColumn("name", F.xxhash64("part")), "windows-parts")
    same = parts.groupBy("key", "name").agg(F.min("doc").alias("doc"), F.max("open").alias("open"), F.first("part").alias("part"), F.first("least").alias("least"), F.count("*").alias("n"))
    same = materialise(same, "windows-same")
    copies = parts.filter("open").select("key", "name", F.col("doc").alias("b")).join(same.filter("n > 1").select("key", "name", F.col("doc").alias("a")).hint("merge"), ["key", "name"]).filter("a <> b").select("a", "b")

    spark = held.sparkSession
    sizes = same.groupBy("key").agg(F.count("*").alias("parts"), F.max("open").alias("any")).filter("parts > 1 AND any")
    sizes = materialise(sizes.select("key", F.col("parts") > BLOCK), "windows-crowds").toDF("key", "crowd").hint("merge")
    small = same.join(sizes.filter("NOT crowd").select("key"), "key").select("key", "doc", "open", "part")
    small = small.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "doc")

    def meet(batches):
        key, rows = None, []

        def pairs():
            doc, open_, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.zeros(len(rows), int)
            met = across(doc, open_, own, [np.frombuffer(r[2], "<u4") for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in met], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and rows:
                    yield pairs()
                    rows = []
                key = k
                rows.append(row)
        if rows:
            yield pairs()

    copies = copies.unionByName(materialise(small.mapInArrow(meet, "a long, b long"), "windows-few"))
    same = same.join(sizes.filter("crowd").select("key"), "key")

    def spread(batches):
        for batch in batches:
            key, name = (batch.column(c).to_numpy() for c in (0, 1))
            found = [np.unique(np.frombuffer(x, "<u4")) for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, sizes)), pa.array(np.repeat(name, sizes)), pa.array(np.concatenate(found).view(np.int32))], ["key", "name", "sh"])

    each = same.select("key", "name", "part").mapInArrow(spread, "key long, name long, sh int")
    common = materialise(each.groupBy("key", "sh").agg(F.count("*").cast("int").alias("n")).filter("n > 1"), "windows-common")
    mine = each.join(common.hint("merge"), ["key", "sh"]).groupBy("key", "name").agg(F.collect_list(F.struct("sh", "n")).alias("xs"))
    mine = mine.join(same.select("key", "name", "doc", "open", "part", "least").hint("merge"), ["key", "name"])
    mine = mine.join(materialise(same.groupBy("key").agg(F.min("least").alias("other")), "windows-least").hint("merge"), "key")
    mine = mine.select("key", "name", "doc", "open", "part", "xs.sh", "xs.n", "least", "other")

    def prefixes(batches):
        for batch in batches:
            key, name, doc, open_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            found = []
            for part, sh, n, least, other in zip(*(batch.column(c).to_pylist() for c in range(4, 9)), strict=True):
                found.append(rarest(np.unique(np.frombuffer(part, "<u4")), np.array(sh, np.int32), np.array(n), least, other))
            sizes = [len(x) for x in found]
            if sum(sizes):
                columns = [pa.array(np.repeat(x, sizes)) for x in (key, name, doc, open_)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found))], ["key", "name", "doc", "open", "sh"])

    found = materialise(mine.mapInArrow(prefixes, "key long, name long, doc long, open boolean, sh int"), "windows-rarest")
    # an open row first meets a row of each of its rarest shingles: one that the leader ties, or the least doc
    heads = found.groupBy("key", "sh").agg(F.min(F.struct("open", "doc", "name")).alias("to"), F.max("open").alias("any"), F.count("*").alias("n")).filter("n > 1 AND any")
    heads = materialise(heads.select("key", "sh", F.col("to.doc").alias("led"), F.col("to.name").alias("to"), F.col("to.open").alias("loose")), "windows-heads")
    tries = found.filter("open").join(heads.hint("merge"), ["key", "sh"]).filter("doc <> led").select("key", "name", "doc", "to", "led", "loose").distinct()
    part = same.select("key", "name", "part")
    tries = materialise(tries, "windows-tries").join(part.hint("merge"), ["key", "name"]).withColumnRenamed("part", "x")
    tries = tries.join(part.select("key", F.col("name").alias("to"), F.col("part").alias("y")).hint("merge"), ["key", "to"]).select("x", "y", "key", "name", "doc", "led", "to", "loose")

    def tie(batches):
        for batch in batches:
            keep = [bool(passages(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), room)) for x, y in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in range(2, 8)], ["key", "name", "doc", "led", "to", "loose"])

    tied = tries.mapInArrow(tie, "key long, name long, doc long, led long, to long, loose boolean").groupBy("key", "name", "doc").agg(F.min(F.struct("loose", "led", "to")).alias("t"))
    tied = materialise(tied.select("key", "name", "doc", "t.*"), "windows-tied")
    met = copies.unionByName(tied.select(F.least("doc", "led").alias("a"), F.greatest("doc", "led").alias("b")))
    # rows that the leader ties are of class 0, others of that of the row they are tied to, or of their own. In signatures of
    # several classes all rows meet, or, where that is fewer pairs, the rows of each rarest shingle that a row outside the
    # largest class has
    alive = found.groupBy("key", "name", "doc").agg(F.max("open").alias("open")).join(tied.select("key", "name", "to", "loose").hint("merge"), ["key", "name"], "left")
    label = F.when(~F.col("open") | ~F.coalesce("loose", F.lit(True)), F.lit(0).cast("long")).otherwise(F.coalesce("to", "name"))
    alive = materialise(alive.select("key", "name", "doc", label.alias("label")), "windows-alive")
    further = alive.select("key", F.col("name").alias("label"), F.col("label").alias("further")).hint("merge")
    alive = alive.join(further, ["key", "label"], "left").select("key", "name", "doc", F.coalesce("further", "label").alias("label"))
    alive = materialise(alive, "windows-classes")
    left = alive.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels"))
    by_shingle = found.groupBy("key", "sh").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    left = left.filter("labels > 1").join(by_shingle.hint("merge"), "key").select("key", "most", (F.col("n") * F.col("n") <= F.col("pairs")).alias("whole"))
    left = materialise(left, "windows-left").hint("merge")
    few = alive.join(left.filter("whole"), "key").select("key", "name", "doc", "label", F.lit(0).alias("sh"))
    many = found.select("key", "name", "sh").join(left.filter("NOT whole"), "key").join(alive.hint("merge"), ["key", "name"])
    many = materialise(many.select("key", "name", "doc", "label", "sh", (F.col("label") != F.col("most")).alias("out")), "windows-many")
    many = many.join(many.filter("out").select("key", "sh").distinct().hint("merge"), ["key", "sh"]).select("key", "name", "doc", "label", "sh")
    met_in = materialise(few.unionByName(many), "windows-met")
    sizes = met_in.groupBy("key", "sh").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    sizes = materialise(sizes.select("key", "sh", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "windows-sizes")
    dealt = met_in.join(sizes.hint("merge"), ["key", "sh"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    dealt = dealt.join(part.hint("merge"), ["key", "name"])

    def compare(table):
        doc, own, group = (table.column(c).to_numpy() for c in ("doc", "own", "label"))
        if len(np.unique(own)) == 1 and table.column("one")[0] != table.column("two")[0]:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pairs = across(doc, np.ones(len(doc), bool), own, [np.frombuffer(x, "<u4") for x in table.column("part").to_pylist()], group=group)
        return pa.table({c: pa.array([x[k] for x in pairs], pa.int64()) for k, c in enumerate("ab")})

    # so many partitions whatever their bytes: the work is in comparing
    dealt = dealt.select("key", "sh", "one", "two", "doc", "label", "own", "part").repartition(shuffle_partitions(spark), "key", "sh", "one", "two")
    grouped = dealt.groupBy("key", "sh", "one", "two")
    return met.unionByName(materialise(grouped.applyInArrow(compare, "a long, b long"), "windows-across"))


def _sequences(needed: DataFrame, d: DataFrame) -> DataFrame:
    """(id, seq) of the texts of d whose id is needed (id)."""
    needed = materialise(needed.distinct(), "windows-needed")

    def read(batches):
        hold("windows", _words().clear)
        for batch in batches:
            found = [(_shingles(c) >> _U(32)).astype("<u4").tobytes() for c in _words().of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "seq"])

    texts = d.join(needed.hint("merge"), "id", "left_semi").mapInArrow(read, "id long, seq binary").groupBy("id").agg(F.min("seq").alias("seq"))
    return materialise(texts, "windows-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of pairs (a, b) of ids of texts (id, seq)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def verify(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a0, a1, b0, b1, likeness in passages(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")):
                    rows.append((a, b, a0, a1 + WIDTH - 1, b0, b1 + WIDTH - 1, likeness))
            if rows:
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    one, two = (texts.select(F.col("id").alias(x), F.col("seq").alias(f"seq_{x}")).hint("merge") for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(verify, SCHEMA)


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, representative, start, end, rep_start, rep_end, likeness, class_id): each document's passages that another has too.

    A passage is tied to the same passage of a representative, a document of smaller doc_id; the representative has a
    row of its own for it, with likeness 1. Documents without a repeated passage have no row. class_id is the least doc_id of
    those that passages tie to the document, directly or through others: not all pairs of a class have a row.
    """
    links = materialise(shared_passages(docs), "windows-links")
    classes = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    members = links.select(
        F.col("b").alias("doc_id"), F.col("a").alias("representative"), F.col("b_start").alias("start"), F.col("b_end").alias("end"),
        F.col("a_start").alias("rep_start"), F.col("a_end").alias("rep_end"), "likeness",
    )
    own = links.select(
        F.col("a").alias("doc_id"), F.col("a").alias("representative"), F.col("a_start").alias("start"), F.col("a_end").alias("end"),
        F.col("a_start").alias("rep_start"), F.col("a_end").alias("rep_end"), F.lit(1.0).alias("likeness"),
    ).distinct()
    rows = members.union(own)
    return rows.join(classes.hint("merge"), "doc_id").select(*rows.columns, "class_id")

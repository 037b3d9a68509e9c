"""Searches of long texts by tf-idf cosine that write no row for a pair: blocks of records meet blocks of entities.

Each text is one row of packed term codes and counts, some three bytes a term. Rows of a part are dealt into a grid of cells, its entities by
columns and its records by rows; a cell has an inverted index of its entities, adds up a record's cosines in one dense array
and yields its k best. So the scratch is the vectors, once for each row or column of the grid, instead of the pairs. All
pairs that share a term are scored.

Terms are told apart by 64-bit hashes with their part. Those of two texts or more go to the executors as arrays of 16
bytes a term, which grow with the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.blocking import FLOOR, best_in_group

#: Entities of a cell, which bound its memory; pairs of a cell, while a part has no more than MOST_SPLIT rows of cells for their sake.
CELL_ENTITIES, CELL_PAIRS, MOST_SPLIT = 64_000, 2e8, 4
#: Sums held at once, products worked out at once.
SUMS, PRODUCTS = 1 << 19, 1 << 20
_PACKED = "cell int, side int, id long, norm double, terms binary"


def _merged(docs: DataFrame) -> DataFrame:
    """Rows that share a part and id as one. Texts are shuffled only if there are any."""
    keys = ["part", "side", "id"]
    if docs.groupBy(*keys).count().filter("count > 1").isEmpty():
        return docs
    return docs.groupBy(*keys).agg(F.flatten(F.collect_list("terms")).alias("terms"))


def _packed(row: np.ndarray, codes: np.ndarray, counts: np.ndarray, rows: int) -> pa.Array:
    """Each row's codes (ascending, as steps) and counts in turn, in 7 bits a byte as far as they go."""
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    x = np.empty(2 * len(row), np.int64)
    x[::2] = np.where(first, codes, np.diff(codes, prepend=0))
    x[1::2] = counts
    sizes = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    begin = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(5):
        on = np.flatnonzero(sizes > k)
        data[begin[on] + k] = (x[on] >> 7 * k) & 127 | np.where(sizes[on] > k + 1, 128, 0)
    at = np.concatenate([[0], np.cumsum(np.bincount(row, sizes[::2] + sizes[1::2], rows))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and counts of all rows, one behind the other, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    last = np.flatnonzero(data < 128)
    begin = np.append(0, last[:-1] + 1)
    x = np.zeros(len(last), np.int64)
    for k in range(5):
        on = np.flatnonzero(begin + k <= last)
        x[on] += (data[begin[on] + k] & 127).astype(np.int64) << 7 * k
    upto = np.searchsorted(last, at - at[0]) // 2
    total = np.concatenate([[0], np.cumsum(x[::2])])
    sizes = np.diff(upto)
    return total[1:] - np.repeat(total[upto[:-1]], sizes), x[1::2], sizes


class _Index:
    """Postings of a cell's entities, by term; entities go by id."""

    def __init__(self, rows: list[tuple]):
        ids, norms, codes, weights, sizes = (np.concatenate(c) for c in zip(*rows, strict=True))
        self.ids = ids
        which = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(codes, kind="stable")
        self.terms, first = np.unique(codes[order], return_index=True)
        self.at = np.append(first, len(order))
        self.which, self.weight = which[order], (weights / norms[which])[order]

    def best(self, ids, norms, codes, weights, sizes, k: int, floor: float):
        """(id, entity_id, score) of each record's k best."""
        n = len(self.ids)
        row = np.repeat(np.arange(len(ids)), sizes)
        weights = weights / norms[row]
        spot = np.searchsorted(self.terms, codes)
        met = np.flatnonzero(self.terms[np.minimum(spot, len(self.terms) - 1)] == codes)
        row, spot, weights = row[met], spot[met], weights[met]
        begin, many = self.at[spot], self.at[spot + 1] - self.at[spot]
        upto = np.concatenate([[0], np.cumsum(many)])
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        step, first = max(1, SUMS // n), 0
        while first < len(ids):
            last = int(np.searchsorted(upto[bounds], upto[bounds[first]] + PRODUCTS, "right")) - 1
            last = min(max(last, first + 1), first + step, len(ids))
            a, end = int(bounds[first]), int(bounds[last])
            total = None
            while a < end:  # one round, but for a record with very many products
                b = min(max(int(np.searchsorted(upto, upto[a] + PRODUCTS, "right")) - 1, a + 1), end)
                lens = many[a:b]
                place = np.arange(upto[a], upto[b]) + np.repeat(begin[a:b] - upto[a:b], lens)
                spots = self.which[place] + np.repeat((row[a:b] - first) * n, lens)
                part = np.bincount(spots, self.weight[place] * np.repeat(weights[a:b], lens), (last - first) * n)
                total = part if total is None else total + part
                a = b
            if total is not None:
                hit = np.flatnonzero(total >= floor - 1e-6)
                score = np.floor(total[hit] * 1e6 + 0.5) / 1e6
                hit, score = hit[score >= floor], score[score >= floor]
                order = np.lexsort((hit, -score, hit // n))
                record = hit[order] // n
                order = order[np.arange(len(order)) - np.searchsorted(record, record) < k]
                yield ids[first + hit[order] // n], self.ids[hit[order] % n], score[order]
            first = last


def search(docs: DataFrame, max_df: float, k: int, floor: float = FLOOR) -> DataFrame:
    """(part, id, entity_id, score, rank): the k best entities of each record of docs (part, side, id, terms).

    Cosines of blocking.tf_idf's vectors, rounded to six decimals; from `floor` on, ties by entity, ranks from 0. Rows that
    share a part and id are one text; rows without a part or an id find nothing, and count for frequencies alone.
    """
    spark = docs.sparkSession
    docs = docs.filter("part IS NOT NULL")
    sides = docs.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "entity").alias("e")).orderBy("part").collect()
    cells, number = [], {}  # the part of each cell; first cell and rows of cells of each part
    for r in sides:
        grid = max(1, math.ceil(r.e / CELL_ENTITIES), min(MOST_SPLIT, math.ceil(math.sqrt(r.e * (r.n - r.e) / CELL_PAIRS))))
        number[r.part] = (len(cells), grid, r.n)
        cells += [r.part] * grid * grid
    of_part = F.col("part")
    rows = _merged(docs).select("part", "side", "id", F.transform("terms", lambda t: F.xxhash64(of_part, t)).alias("hashes"))
    n = spark.createDataFrame([(r.part, r.n) for r in sides], f"part {docs.schema['part'].dataType.simpleString()}, n long")
    df = rows.select("part", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("part", "hash").agg(F.count("*").alias("df")).filter("df > 1")
    idf = F.when(F.col("df") <= max_df * F.col("n"), F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).otherwise(0.0)
    known = df.join(F.broadcast(n), "part").select("hash", idf.alias("idf")).toArrow()
    hashes, weight = known["hash"].to_numpy(), known["idf"].to_numpy()
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], weight[order]))
    single = {p: math.log((n + 1) / 2) + 1 if max_df * n >= 1 else 0.0 for p, (_, _, n) in number.items()}

    def pack(batches):
        known, idf = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            seen, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pairs, count = np.unique(row * max(1, len(seen)) + code, return_counts=True)
            row, code = np.divmod(pairs, max(1, len(seen)))
            spot = np.minimum(np.searchsorted(known, seen), max(0, len(known) - 1))
            found = known[spot] == seen if len(known) else np.zeros(len(seen), bool)
            own = np.array([single[p] for p in batch.column(0).to_pylist()])
            x = (1 + np.log(count)) * np.where(found[code], idf[spot][code] if len(known) else 0.0, own[row])
            norm = np.sqrt(np.bincount(row, x * x, batch.num_rows))
            keep = found[code] & (x > 0)  # terms of one text alone count for its length only
            row, spot, count = row[keep], spot[code[keep]], count[keep]
            sizes = np.bincount(row, minlength=batch.num_rows)
            parts = [number[p] for p in batch.column(0).to_pylist()]
            ids, entity = batch.column(2), np.array(batch.column(1).to_pylist()) == "entity"
            usable = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0))
            place = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mixed = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            at, cell = [], []
            for i in usable:
                first, grid, _ = parts[i]
                b = int(mixed[i]) % grid
                at += [i] * grid
                cell += [first + (j * grid + b if entity[i] else b * grid + j) for j in range(grid)]
            columns = [pa.array(cell, pa.int32()), pa.array(np.where(entity, 0, 1).astype(np.int32)).take(at := pa.array(at, pa.int64()))]
            columns += [c.take(at) for c in (pa.array(place), pa.array(norm), _packed(row, spot, count, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "side", "id", "norm", "terms"])

    def meet(batches):
        now, entities, index = None, [], None
        idf = sent.value[1]
        for batch in batches:
            cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cell[a] != now:
                    now, entities, index = cell[a], [], None
                some = batch.slice(a, b - a)
                codes, counts, sizes = _unpacked(some.column(4))
                own = (some.column(2).to_numpy(), some.column(3).to_numpy(), codes, (1 + np.log(counts)) * idf[codes], sizes)
                if side[a] == 0:
                    entities.append(own)
                    continue
                if entities:
                    index, entities = _Index(entities), []
                if index is not None:
                    for found in index.best(*own, k, floor):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), now, np.int32)), *map(pa.array, found)], ["cell", "id", "entity_id", "score"])

    packed = rows.mapInArrow(pack, _PACKED).repartitionById(max(1, len(cells)), F.col("cell")).sortWithinPartitions("cell", "side", "id")
    best = packed.mapInArrow(meet, "cell int, id long, entity_id long, score double")
    named = F.element_at(F.array(*[F.lit(p) for p in cells] or [F.lit(None)]), F.col("cell") + 1).alias("part")
    best = best_in_group(best.select(named, "id", "entity_id", "score"), ["part", "id"], "score", "entity_id", k=k, rank="rank")
    return best.withColumn("rank", F.col("rank") - 1)

"""Exact top-k search in Hamming distance by incremental multi-index hashing.

Vectors become binary codes, the signs of their components. Equal codes are one entry that keeps its ``k`` least ids, so copies cost nothing. The index
is dealt into blocks of distinct codes; in each block, tables over segments of the code are probed with growing radii, one segment at a time, until the kth verified
distance is covered: once segments 0 to s of m have been searched to radius r, and the others to r - 1, every code within m * r + s has been met.
Blocks hand on k entries per query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stash

K = 10
#: Distinct codes of an index block, about; queries that are searched at once, and the fewest for which a block's index is copied to another core.
BLOCK, QUERIES, LEAST_QUERIES = 1 << 20, 1 << 13, 1 << 9
#: Probes that are looked up at once.
CHUNK = 1 << 17


def codes_of(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the vectors that are there, ``width`` 64-bit words each, and their places."""
    there = np.flatnonzero(~np.asarray(vectors.is_null()))
    kept = vectors.take(pa.array(there))
    sizes = np.asarray(kept.value_lengths().fill_null(0))
    flat = np.asarray(kept.flatten().fill_null(0), np.float64) > 0
    bits = np.zeros((len(there), width * 64), bool)
    rows = np.repeat(np.arange(len(there)), sizes)
    bits[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), there


def _entries(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            codes, there = codes_of(batch.column(1), width)
            if not len(there):
                continue
            ids = np.asarray(ids.take(pa.array(there)))
            _, group = np.unique(codes, axis=0, return_inverse=True)
            order = np.lexsort((ids, group.ravel()))
            group = group.ravel()[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            place = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))
            kept = order[place < k]
            counts = np.minimum(np.diff([*first, len(group)]), k)
            yield pa.RecordBatch.from_pydict({
                "code": pa.array([codes[i].tobytes() for i in order[first]], pa.binary()),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids[kept])),
            })

    return run


class Index:
    """Tables over the segments of distinct codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        #: Queries that were answered by looking at every code.
        self.scans = 0
        self.patterns: dict[tuple[int, int], np.ndarray] = {}
        bits = codes.shape[1] * 64
        # Segments of about log2 of the number of codes bits, so that a bucket holds about one; none much shorter than the others.
        parts = -(-bits // 20) if len(codes) >= 1 << 20 else max(-(-bits // 20), round(bits / max(np.log2(max(len(codes), 2)), 8)))
        edges = np.linspace(0, bits, parts + 1).astype(int).tolist()
        self.spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for a, n in self.spans:
            value = self.segment(codes, a, n)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << n))])))

    @staticmethod
    def segment(codes: np.ndarray, at: int, n: int) -> np.ndarray:
        word, shift = divmod(at, 64)
        value = codes[:, word] >> np.uint64(shift)
        if shift + n > 64 and word + 1 < codes.shape[1]:
            value = value | codes[:, word + 1] << np.uint64(64 - shift)
        return (value & np.uint64((1 << n) - 1)).astype(np.int64)

    def masks(self, width: int, radius: int) -> np.ndarray:
        """Every value of ``width`` bits, 20 at most, with ``radius`` of them set; made when a search first needs them."""
        if (width, radius) not in self.patterns:
            self.patterns[width, radius] = np.flatnonzero(np.bitwise_count(np.arange(1 << width)) == radius)
        return self.patterns[width, radius]

    def search(self, queries: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the codes, and their distances, that hold its ``k`` nearest entries, a code counting ``weights`` times; ties at the kth are all there."""
        n, bits = len(queries), self.codes.shape[1] * 64
        seen = np.zeros((n, bits + 1), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = np.arange(n)
        own = [self.segment(queries, a, w) for a, w in self.spans]
        radius = 0
        while len(active):
            for s, (_, w) in enumerate(self.spans):
                if radius > w:
                    continue
                masks = self.masks(w, radius)
                if len(masks) * 4 > len(self.codes) + 64:
                    self.scans += len(active)
                    # Looking at every code is less work than the probes: that covers all distances.
                    for q in active:
                        d = np.bitwise_count(self.codes ^ queries[q]).sum(1).astype(np.int64)
                        seen[q] = np.bincount(d, weights, bits + 1)
                        hit = np.flatnonzero(d <= np.argmax(np.cumsum(seen[q]) >= min(k, weights.sum())))
                        found.append((np.full(len(hit), -1 - q), hit, d[hit]))
                    active = active[:0]
                    break
                order, starts = self.tables[s]
                for q in self._portions(active, own[s], masks, starts):
                    probe = own[s][q][:, None] ^ masks[None, :]
                    lo, size = starts[probe], starts[probe + 1] - starts[probe]
                    who = np.repeat(np.repeat(q, len(masks)), size.ravel())
                    ends = np.cumsum(size.ravel())
                    code = order[np.arange(len(who)) + np.repeat(lo.ravel() - (ends - size.ravel()), size.ravel())]
                    # A code met before, by another segment or a smaller radius, isn't taken again.
                    fresh = np.ones(len(who), bool)
                    for t, (a, b) in enumerate(self.spans):
                        if t != s:
                            apart = np.bitwise_count(self.segment(self.codes[code], a, b) ^ own[t][who])
                            fresh &= apart > (radius if t < s else radius - 1)
                    who, code = who[fresh], code[fresh]
                    d = np.bitwise_count(self.codes[code] ^ queries[who]).sum(1).astype(np.int64)
                    np.add.at(seen, (who, d), weights[code])
                    # What is farther than the k nearest so far can't be in the answer.
                    near = d <= self._limits(seen[q], k)[np.searchsorted(q, who)]
                    found.append((who[near], code[near], d[near]))
                covered = len(self.spans) * radius + s
                active = active[seen[active, : covered + 1].sum(1) < k]
                if not len(active):
                    break
            radius += 1
        return self._collect(found, seen, n, k)

    @staticmethod
    def _portions(active: np.ndarray, values: np.ndarray, masks: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Queries whose probes, and what they find, fit into ``CHUNK`` together; one query at least."""
        step = max(1, CHUNK // len(masks))
        for at in range(0, len(active), step):
            q = active[at : at + step]
            probe = values[q][:, None] ^ masks[None, :]
            cost = np.cumsum((starts[probe + 1] - starts[probe]).sum(1))
            place = 0
            while place < len(q):
                end = max(place + 1, int(np.searchsorted(cost, (cost[place - 1] if place else 0) + CHUNK, side="right")))
                yield q[place:end]
                place = end

    @staticmethod
    def _limits(seen: np.ndarray, k: int) -> np.ndarray:
        """Distance of each query's kth entry so far, or the largest there is."""
        full = np.cumsum(seen, 1) >= k
        return np.where(full.any(1), full.argmax(1), seen.shape[1])

    @staticmethod
    def _collect(found: list, seen: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        limit = np.argmax(np.cumsum(seen, 1) >= np.minimum(k, seen.sum(1))[:, None], axis=1)
        who, code, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        # Queries that were answered by looking at every code have entries of their own, marked below zero.
        scanned = np.unique(-1 - who[who < 0])
        keep = (who < 0) | ~np.isin(who, scanned)
        who = np.where(who < 0, -1 - who, who)
        keep &= d <= limit[who]
        who, code, d = who[keep], code[keep], d[keep]
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(n + 1))
        return [(code[order[a:b]], d[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_NEAR = pa.schema([("query", pa.binary()), ("near", pa.list_(pa.struct([("distance", pa.int32()), ("id", pa.int64())])))])


class _Block:
    """The index of one block, built once from its rows; queries pass by in batches."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, pa.ListArray]] = []
        self.index: Index | None = None

    @staticmethod
    def codes(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((self.codes(rows.column("code")), rows.column("ids")))

    def answer(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        if self.index is None:
            self.index = Index(np.concatenate([c for c, _ in self.parts]))
            lists = pa.chunked_array([x for _, x in self.parts]).combine_chunks()
            self.sizes, self.ids = np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(lists.flatten())
            self.starts, self.parts = np.cumsum(self.sizes) - self.sizes, []
        out = []
        for codes, distances in self.index.search(self.codes(rows.column("code")), self.sizes, k):
            near = sorted((int(d), int(i)) for c, d in zip(codes, distances, strict=True) for i in self.ids[self.starts[c] : self.starts[c] + self.sizes[c]])[:k]
            out.append([{"distance": d, "id": i} for d, i in near])
        return pa.RecordBatch.from_arrays([rows.column("code"), pa.array(out, _NEAR.field("near").type)], schema=_NEAR)


def _search(k: int):
    """Rows come by block and share of the queries, a block's codes before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, _Block()
        for batch in batches:
            place = np.asarray(batch.column("place"))
            asks = np.asarray(batch.column("asks"))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if place[a] != current:
                    current, block = place[a], _Block()
                if not asks[a]:
                    block.add(batch.slice(a, b - a))
                    continue
                for at in range(a, b, QUERIES):
                    yield block.answer(batch.slice(at, min(QUERIES, b - at)), k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, vec_id, distance, rank``: for every row of ``queries`` its ``k`` nearest rows of ``vectors`` by distance, then id.

    Both have vec_id and embedding; other columns are ignored. A bit is set where the component is over 0 (null, NaN and missing components aren't). Rows without an embedding
    or id are in no result; a query that is also a vector finds itself. Repeated rows of ``vectors`` are found as often as they are there, up to ``k``; repeated queries are
    answered each. No vectors or no queries give an empty table.
    """
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.when(F.isnan(x), 0.0).otherwise(x).cast("double")).alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    vectors, queries = pick(vectors), pick(queries)
    size = vectors.unionByName(queries).agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-size // 64))
    entries = vectors.mapInArrow(_entries(width, k), "code binary, ids array<long>")
    entries = entries.groupBy("code").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
    entries = stash(entries, "hamming-index")
    asked = stash(queries.mapInArrow(_entries(width, 1 << 30), "code binary, ids array<long>").select(F.col("code"), F.explode("ids").alias("query_id")), "hamming-queries")
    distinct = stash(asked.select("code").distinct(), "hamming-codes")
    blocks = -(-entries.count() // BLOCK) or 1
    # Each block's index is sent and built once, and all queries pass it. Only while there are fewer blocks than cores are the queries shared out among copies of it.
    shares = max(1, min(vectors.sparkSession.sparkContext.defaultParallelism // blocks, -(-distinct.count() // LEAST_QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.withColumn("share", every(shares)).select((deal(blocks) * shares + F.col("share")).alias("place"), F.lit(False).alias("asks"), "code", "ids")
    right = distinct.withColumn("block", every(blocks)).select((F.col("block") * shares + deal(shares)).alias("place"), F.lit(True).alias("asks"), "code", F.lit(None).cast("array<long>").alias("ids"))
    rows = left.unionByName(right).repartitionById(blocks * shares, "place").sortWithinPartitions("place", "asks")
    near = rows.mapInArrow(_search(k), "query binary, near array<struct<distance:int,id:long>>")
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = asked.join(best, asked["code"] == best["query"]).select("query_id", F.posexplode("near").alias("place", "x"))
    return out.select("query_id", F.col("x.id").alias("vec_id"), F.col("x.distance").cast("long").alias("distance"), (F.col("place") + 1).cast("long").alias("rank"))

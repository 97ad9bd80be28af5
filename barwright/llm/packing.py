"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents become token pieces; only the histogram of piece lengths, bounded by the sequence length, goes to the driver. There lengths are
placed longest first, each into the shortest packs that still take it, as counts of packing patterns. Every piece then finds its place by
its rank among the pieces of its length; ranks come from counts per partition, so no length is gathered in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows, release, stash
from barwright.llm.tokens import default_path, encoder

END_ID = 0
LENGTH = 1024
#: Ranks are cut into so many stretches, about.
STRETCHES = 1 << 16

_PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, place long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full sequences, then the rest."""
    return [(a, min(most, n - a)) for a in range(0, n, most)]


def _pieces(path: str, most: int, keep_ids: bool, specials_as_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode_texts, seen = TaskContext.get().partitionId(), encoder(path, specials_as_text), [0] * (most + 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                columns: dict[str, list] = {name: [] for name in schema.names}
                for doc, ids in zip(piece.column(0).to_pylist(), encode_texts(piece.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for start, size in cut(len(ids), most):
                        own = ids[start : start + size]
                        for name, value in zip(schema.names, (doc, start, size, zlib.crc32(own), len(ids), part, seen[size], own), strict=False):
                            columns[name].append(value)
                        seen[size] += 1
                yield pa.RecordBatch.from_pydict(columns, schema)
            columns, ids, own = {}, None, None
            release()

    return run


def pattern_counts(hist: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as (count, lengths): longest lengths first, each into the packs with the most room.

    Equal packs are one entry, so the work follows the number of lengths and patterns, not of pieces.
    """
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []  # heap of -room

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((count, pattern))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, pattern = groups[room].pop()
                if not groups[room]:
                    heapq.heappop(rooms)
                    del groups[room]
                n = min(left, count)
                if n < count:
                    put(room, count - n, pattern)
                # Packs that got this length may take it again, once the shorter ones are served.
                put(room - length, n, (*pattern, length))
                left -= n
            else:
                per = most // length
                full, rest = divmod(left, per)
                if full:
                    put(most - per * length, full, (length,) * per)
                if rest:
                    put(most - rest * length, 1, (length,) * rest)
                left = 0
    return [x for room in sorted(groups) for x in groups[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, sequence of the first, offset)."""
    out, used, sequence = [], Counter(), 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = LENGTH, keep_ids: bool = False, specials_as_text: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if ``keep_ids``.

    ``docs``: doc_id and text; other columns are ignored. Null texts are empty; every document ends with id 0, so each has a piece.
    Repeated rows are packed as documents of their own; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    pieces = stash(source.mapInArrow(_pieces(tokenizer or default_path(), most, keep_ids, specials_as_text), schema), "packing-pieces")
    counts = stash(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    # At most one row for each length.
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(pattern_counts(hist, most))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    # Full pieces are sequences of their own. The others meet the slots of their length by stretches of ranks, so that no length is one key.
    columns = list(zip(*(x for x in places if x[0] < most), strict=True)) or [[]] * 5
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["length", "lo", "hi", "first", "offset"]))
    width = -(-sum(hist.values()) // STRETCHES) or 1
    table = table.withColumn("stretch", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    short = ranked.filter(F.col("length") < most).withColumn("stretch", F.expr(f"rank div {width}"))
    short = short.join(table, ["length", "stretch"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    out = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    ids = ["ids"] if keep_ids else []
    short = short.select(*out, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *ids)
    alone = next((first for length, _, _, first, _ in places if length == most), 0)
    return short.unionByName(ranked.filter(F.col("length") == most).select(*out, (F.col("rank") + alone).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids))


def padding(sequences: DataFrame, most: int = LENGTH) -> DataFrame:
    """``tokens`` and ``padded``, the total size once each sequence is padded to ``most``, but for those at a power of two."""
    used = sequences.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(F.sum("used").alias("tokens"), F.sum(F.when(power, F.col("used")).otherwise(most)).alias("padded"))

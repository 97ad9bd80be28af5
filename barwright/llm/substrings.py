"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, and removal of all but the first copy.

Documents are dealt into cells of neighbouring doc_ids, so an earlier cell means an earlier occurrence. Each cell sends the sorted set of
its window hashes, packed, to hash ranges; a range tells every cell which of its hashes an earlier cell has too, one bit each. Cells then
remove the words under those windows and under windows that they have had before. A window that many documents share reaches its range once
per cell, so no passage, however frequent, makes a group large.

Cells and hash ranges grow with the square root of the input, up to what a worker holds, so that the packed rows between them grow in proportion to it; beyond that
a row holds fewer hashes, down to about one at 100 TB, which is then the plain exchange of (hash, cell).

Windows count as equal when their 64-bit hashes are; among w windows about w * w / 2**65 pairs are expected to be so by chance.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows, hash_words, intern_words, mix, rolling, tidied, tidied_batches

WINDOW = 20
#: Bytes of text in a cell and windows in a hash range, about, for inputs of ``BASE`` bytes; both grow as its square root, up to ``MOST`` times.
CELL_BYTES, RANGE_WINDOWS, BASE, MOST = 8 << 20, 2 << 20, 1 << 29, 3.0
#: Words whose windows are hashed at once, about.
PART_WORDS = 1 << 18


def pack_table(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue()


def unpack_tables(blobs: pa.ChunkedArray) -> pa.Table:
    """All rows of some packed tables, by doc_id and text; null doc_ids come last."""
    table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs if b.is_valid])
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def deal(bounds: list[int]):
    """Cells of the documents in a batch, one packed table each."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            cell = np.searchsorted(edges, np.asarray(names.fill_null(0)), side="right")
            cell[np.asarray(names.is_null())] = len(edges) + 1
            table = pa.Table.from_batches([batch])
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            for c, rows in zip(cells, np.split(order, starts[1:]), strict=True):
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int64()), "docs": pa.array([pack_table(table.take(rows))], pa.binary())})

    return tidied_batches(run)


def window_hashes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Hash and first word of every window, the word numbers, each text's word count, and the vocabulary."""
    table, codes, sizes = intern_words(texts)
    vocabulary = list(table)
    values, ends = hash_words(vocabulary), np.cumsum(sizes)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # Windows are of one document, so some documents at a time give them all, and what that takes besides stays small.
    for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // PART_WORDS)) + 1):
        if len(own) and (stop := ends[own[-1]]) > (start := ends[own[0]] - sizes[own[0]]):
            # A window is of one document if it ends by its document's end.
            last = np.repeat(ends[own], sizes[own])
            at = np.flatnonzero(np.arange(start, stop) + n <= last)
            hashes.append(mix(rolling(values[codes[start:stop]], n))[at])
            places.append(at + start)
    return np.concatenate(hashes), np.concatenate(places), codes, sizes, vocabulary


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, without planes that are all zero."""
    planes = np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    keep = [k for k in range(8) if planes[k].any()]
    return bytes([len(keep), *keep]) + b"".join(planes[k].tobytes() for k in keep)


def unpack_sorted(data: bytes) -> np.ndarray:
    k = data[0]
    kept, raw = list(data[1 : 1 + k]), np.frombuffer(data, np.uint8, offset=1 + k)
    n = len(raw) // k
    planes = np.zeros((n, 8), np.uint8)
    planes[:, kept] = raw.reshape(k, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def _send(n: int, bits: int):
    """The distinct window hashes of a cell, by hash range."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.unique(window_hashes(unpack_tables(rows["docs"])["text"].to_pylist(), n)[0])
        ranges, starts = np.unique(found >> np.uint64(64 - bits), return_index=True)
        blobs = [pack_sorted(x) for x in np.split(found, starts[1:])] if len(found) else []
        return pa.table({"range": pa.array(ranges.astype(np.int64)), "cell": pa.array([key[0].as_py()] * len(ranges), pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    return tidied(run)


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """For each cell one bit per hash, set if an earlier cell has that hash; cells without such are left out."""
    rows = rows.sort_by("cell")
    parts = [unpack_sorted(x.as_py()) for x in rows["hashes"]]
    sizes = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    again = np.zeros(len(every), bool)
    ranked = every[order]
    again[order[1:]] = ranked[1:] == ranked[:-1]
    out: dict[str, list] = {"cell": [], "range": [], "bits": []}
    for cell, own in zip(rows["cell"].to_pylist(), np.split(again, np.cumsum(sizes)[:-1]), strict=True):
        if own.any():
            out["cell"].append(cell)
            out["range"].append(key[0].as_py())
            out["bits"].append(np.packbits(own).tobytes())
    return pa.table({"cell": pa.array(out["cell"], pa.int64()), "range": pa.array(out["range"], pa.int64()), "bits": pa.array(out["bits"], pa.binary())})


def removed_words(texts: list[str | None], n: int, bits: int, flags: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Which words go, for all texts in a row; the word numbers, each text's word count, and the vocabulary."""
    hashes, at, codes, sizes, vocabulary = window_hashes(texts, n)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    earlier = np.zeros(len(distinct), bool)
    ranges, starts = np.unique(distinct >> np.uint64(64 - bits), return_index=True)
    for r, a, b in zip(ranges, starts, [*starts[1:], len(distinct)][: len(starts)], strict=True):
        if int(r) in flags:
            earlier[a:b] = np.unpackbits(np.frombuffer(flags[int(r)], np.uint8), count=b - a)
    gone = at[earlier[inverse] | (first[inverse] != np.arange(len(at)))]
    edge = np.zeros(len(codes) + 1, np.int32)
    edge[gone] += 1
    edge -= np.bincount(gone + n, minlength=len(edge))[: len(edge)].astype(np.int32) if len(gone) else 0
    return np.cumsum(edge)[:-1] > 0, codes, sizes, vocabulary


def _finish(n: int, bits: int, digest: bool, columns: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = unpack_tables(left["docs"])
        flags = dict(zip(right["range"].to_pylist(), right["bits"].to_pylist(), strict=True))
        texts = docs["text"].to_pylist()
        gone, codes, sizes, vocabulary = removed_words(texts, n, bits, flags)
        ends = np.cumsum(sizes)
        counts = np.concatenate([[0], np.cumsum(gone)])
        removed = counts[ends] - counts[ends - sizes]
        out, spans = [], []
        for text, a, b, lost in zip(texts, ends - sizes, ends, removed, strict=True):
            if lost or digest:
                kept = codes[a:b][~gone[a:b]] if lost else codes[a:b]
                joined = b" ".join(map(vocabulary.__getitem__, kept.tolist()))
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
            else:
                out.append(text)
            if not digest:
                edges = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False)) if lost else np.zeros(0, int)
                spans.append(edges.tolist())
        if digest:
            return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(sizes), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array(out, pa.string())})
        table = docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(out, pa.string())).select(columns)
        return table.append_column("n_words", pa.array(sizes)).append_column("n_removed", pa.array(removed.astype(np.int64))).append_column("removed_spans", pa.array(spans, pa.list_(pa.int64())))

    return tidied(run)


def _run(docs: DataFrame, n: int, digest: bool) -> DataFrame:
    arrow_rows(docs.sparkSession)
    docs = docs.select("doc_id", "text") if digest else docs
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    size = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).agg(F.sum("bytes").alias("bytes"), F.count("doc_id").alias("ids")).first()
    total = size["bytes"] or 0
    growth = min(max((total / BASE) ** 0.5, 0.125), MOST)
    cells = max(2, min(int(total / (CELL_BYTES * growth)) + 1, size["ids"]))
    # Spark's range partitions of the ids alone; the least id of each, one number a cell, goes to the driver.
    ranges = docs.select("doc_id").filter("doc_id IS NOT NULL").repartitionByRange(cells, "doc_id")
    bounds = sorted(r.m for r in ranges.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("m")).collect())[1:]
    # A range is the top bits of a hash; a word takes about six bytes.
    bits = max(1, int(total / 6 / (RANGE_WINDOWS * growth)).bit_length())
    dealt = docs.mapInArrow(deal(bounds), "cell long, docs binary")
    sent = dealt.groupBy("cell").applyInArrow(_send(n, bits), "range long, cell long, hashes binary")
    flags = sent.groupBy("range").applyInArrow(tidied(_compare), "cell long, range long, bits binary")
    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, removed_spans array<long>"
    return dealt.groupBy("cell").cogroup(flags.groupBy("cell")).applyInArrow(_finish(n, bits, digest, docs.columns), schema)


def dedup_digest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, after the removal that :func:`dedup` describes."""
    return _run(docs, n, True)


def dedup(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without words that a window of ``n`` words covers whose words also start earlier, in a smaller doc_id or before in the same document.

    Texts that lose words become their kept words joined by one space; others stay as they are. ``removed_spans`` lists start and end, in
    words, of the maximal removed intervals, one after another. Columns n_words, n_removed and removed_spans of the input are replaced. Null texts have no
    words; a null doc_id comes after all others; rows with equal doc_id follow the order of their texts, and of equal rows all but one lose their windows. Other columns stay, whatever
    their names; an empty table gives an empty table; texts count whole, however long, and none is cut at a cell's border.
    """
    return _run(docs.drop("n_words", "n_removed", "removed_spans"), n, False)

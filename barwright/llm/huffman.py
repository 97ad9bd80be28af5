"""Token ids as canonical length-limited Huffman codes, in archives of independent blocks.

Archive: a folder with ``codebook/`` (one frame) and ``blocks/part=K/`` (files of frames, in ascending doc_id order over K and the
place in the file). Spark's text writer ends each frame with LF. A frame is a 4-byte mark, the length of its body (unsigned
32 bits, little-endian) and the body:

* ``BHC1``: zlib-packed code length of each id, one byte each (0: unused). Codes are canonical: by length, then id.
* ``BHB1``: the ids before the block's first document (int64), documents, ids, payload bits and ids between checkpoints (uint32 each), the
  doc_ids (int64 each), a byte each that is 1 for a null doc_id, the ids of each document (uint32), the bit offset of every checkpoint (uint32),
  and the codes, most significant bit first, with 8 bytes of padding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows, scale_partitions, scratch_path, stash
from barwright.llm.tokens import default_path, encoder

END_ID = 0
#: Ids of a block, about, and ids between two checkpoints.
BLOCK_IDS, CHECKPOINT = 1 << 20, 128
#: Ids packed at once, a multiple of ``CHECKPOINT``.
STRETCH = 1 << 15
#: Bytes of text in a partition, at most but for sampling: its file, about half as large, is read in one piece.
PART_BYTES = 64 << 20
_HEAD = struct.Struct("<qIIII")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n, lists, row = len(leaves), [], None
    for _ in range(limit):
        packages = np.zeros(0) if row is None else row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        row = both[place]
        lists.append(place < n)
    take, lengths = 2 * (n - 1), np.zeros(n, np.int64)
    for is_leaf in reversed(lists):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, from the code lengths alone."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    by_length = lengths[order]
    for length in np.unique(by_length):
        same = order[by_length == length]
        code <<= int(length) - last
        codes[same] = code + np.arange(len(same))
        code, last = code + len(same), int(length)
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Packed codes, the bit offset of every ``CHECKPOINT``-th id, and the number of bits."""
    packed, checkpoints, bits = np.zeros(int(lengths.max(initial=1)) * len(ids) // 32 + 2), [], 0
    # In stretches whose arrays fit a core's cache.
    for a in range(0, len(ids), STRETCH):
        some = ids[a : a + STRETCH]
        size = lengths[some].astype(np.int64)
        ends = np.cumsum(size) + bits
        at, bits = ends - size, int(ends[-1])
        checkpoints.append(at[::CHECKPOINT].astype(np.uint32))
        value = codes[some].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        # No two codes share a bit, so sums of halves are unions; they stay under 2**32 and are exact in doubles.
        place = at >> 5
        first, n = int(place[0]), int(place[-1] - place[0]) + 2
        place -= first
        packed[first : first + n] += np.bincount(place, (value >> np.uint64(32)).astype(np.float64), n)
        packed[first : first + n] += np.bincount(place + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return packed[: bits // 32 + 1].astype(">u4").tobytes()[: (bits + 7) // 8], np.concatenate(checkpoints) if checkpoints else np.zeros(0, np.uint32), bits


class Decoder:
    """Table-driven: the next ``limit`` bits index the id and the length of its code. All checkpoints of a block advance together."""

    def __init__(self, lengths: np.ndarray):
        self.limit = int(lengths.max(initial=1))
        codes = canonical_codes(lengths)
        self.ids, self.sizes = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spread = 1 << (self.limit - lengths[order].astype(np.int64))
        self.ids[: spread.sum()] = np.repeat(order, spread)
        self.sizes[: spread.sum()] = np.repeat(lengths[order], spread)
        assert len(order) == 0 or codes[order[0]] == 0

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        mask, top = np.uint32((1 << self.limit) - 1), 32 - self.limit
        last = (len(payload) + 4) * 8
        for k in range(CHECKPOINT):
            peek = window[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask
            out[k] = self.ids[peek]
            at = np.minimum(at + self.sizes[peek], last)
        return out.T.ravel()[:n]


def _frame(mark: bytes, body: bytes) -> bytes:
    return mark + struct.pack("<I", len(body)) + body


def frames(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Mark and body of each frame; raises on anything that is none."""
    at = 0
    while at < len(data):
        mark, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        end = at + 8 + size
        if mark not in (b"BHC1", b"BHB1") or data[end : end + 1] != b"\n":
            raise ValueError(f"no frame at byte {at}")
        yield mark, data[at + 8 : end]
        at = end + 1


def block_body(start: int, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, checkpoints, bits = encode(ids, codes, lengths)
    head = _HEAD.pack(start, len(doc_ids), len(ids), bits, CHECKPOINT)
    return b"".join((head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), checkpoints.astype("<u4").tobytes(), payload, b"\0" * 8))


def read_block(body: bytes, decoder: Decoder) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids before the block, doc_ids, which of them are null, ids of each document, and all ids."""
    start, docs, n, bits, every = _HEAD.unpack_from(body)
    if every != CHECKPOINT:
        raise ValueError("another checkpoint distance")
    at = _HEAD.size
    out = []
    for count, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u4"), (-(-n // every), "<u4")):
        out.append(np.frombuffer(body, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return start, out[0], out[1], out[2], decoder(body[at : at + (bits + 7) // 8], out[3], n)


_STASH = "part int, place long, first long, doc_ids binary, nulls binary, sizes binary, ids binary, seen array<int>, counts array<long>"


def _tokenize(path: str, specials_as_text: bool):
    """Blocks of a partition's documents in their order, then its count of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode_texts = TaskContext.get().partitionId(), encoder(path, specials_as_text)
        counts = np.zeros(encode_texts.tokenizer.get_vocab_size() + 1, np.int64)
        schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("first", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "nulls", "sizes", "ids")), ("seen", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        place, first, end = 0, 0, np.array([END_ID], encode_texts.width)

        def row(**values):
            return pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"part": part} | values], schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                got = encode_texts(piece.column(1))
                names = piece.column(0)
                keys, nulls = np.asarray(names.fill_null(0)), np.asarray(names.is_null())
                sizes = np.fromiter(map(len, got), np.int64, len(got)) + 1
                # Documents are dealt into blocks of about BLOCK_IDS; a longer document is a block of its own.
                block = np.cumsum(sizes) // BLOCK_IDS
                for b in np.unique(block):
                    own = np.flatnonzero(block == b)
                    lo, hi = own[0], own[-1] + 1
                    ids = np.concatenate([x for own_ids in got[lo:hi] for x in (own_ids, end)])
                    counts += np.bincount(ids, minlength=len(counts))
                    yield row(place=place, first=first, doc_ids=keys[lo:hi].astype("<i8").tobytes(), nulls=nulls[lo:hi].astype(np.uint8).tobytes(), sizes=sizes[lo:hi].astype("<u4").tobytes(), ids=ids.tobytes())
                    place, first = place + 1, first + len(ids)
        if place:
            seen = np.flatnonzero(counts)
            yield row(place=place, first=first, seen=seen.tolist(), counts=counts[seen].tolist())

    return run


def write_archive(docs: DataFrame, path: str, tokenizer: str | None = None, specials_as_text: bool = True) -> None:
    """Tokenize ``docs`` (doc_id, text; other columns are ignored) and write the archive under ``path``.

    Null texts are empty; every document ends with id 0. Documents stand in ascending doc_id order, null first; equal doc_ids follow their texts.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    tokenizer = tokenizer or default_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(scale_partitions(spark), -(-total // PART_BYTES))
    # The text's beginning orders like the text, and deals out rows without a doc_id, or with the same one.
    ordered = ordered.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    blocks = stash(ordered.mapInArrow(_tokenize(tokenizer, specials_as_text), _STASH), "huffman-ids")

    # One number for each id of the vocabulary and one for each partition: neither grows with the rows.
    tally = blocks.filter("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "counts")).alias("x"))
    tally = tally.groupBy("x.seen").agg(F.sum("x.counts").alias("n")).collect()
    counts = np.zeros(max((r.seen for r in tally), default=0) + 1, np.int64)
    for r in tally:
        counts[r.seen] = r.n
    limit = max(16, (len(counts) - 1).bit_length() + 1)
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    totals = sorted((r.part, r.first) for r in blocks.filter("seen IS NOT NULL").select("part", "first").collect())
    base, before = {}, 0
    for part, n in totals:
        base[part] = before
        before += n
    width = "<u2" if encoder(tokenizer, specials_as_text).width == "<u2" else "<u4"

    framed = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("frame", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in ("part", "place", "first", "doc_ids", "nulls", "sizes", "ids")}
                body = block_body(base[x["part"]] + x["first"], np.frombuffer(x["doc_ids"], "<i8"), np.frombuffer(x["nulls"], "u1"), np.frombuffer(x["sizes"], "<u4"), np.frombuffer(x["ids"], width), codes, lengths)
                yield pa.RecordBatch.from_pylist([{"part": x["part"], "place": x["place"], "frame": _frame(b"BHB1", body)}], framed)

    packed = blocks.filter("ids IS NOT NULL").drop("seen", "counts").mapInArrow(pack, "part int, place long, frame binary")
    # A string column hands its bytes to the text writer as they are.
    rows = packed.sortWithinPartitions("part", "place").select("part", F.col("frame").cast("string").alias("value"))
    rows.write.partitionBy("part").option("lineSep", "\n").text(f"{path}/blocks")
    book = spark.createDataFrame([(bytearray(_frame(b"BHC1", zlib.compress(lengths.tobytes(), 9))),)], "value binary")
    book.select(F.col("value").cast("string").alias("value")).coalesce(1).write.option("lineSep", "\n").text(f"{path}/codebook")


def read_archive(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Every document of an archive: doc_id, start, n_tokens, ids_crc32, and its ids if ``keep_ids``."""
    book = spark.read.format("binaryFile").load(f"{path}/codebook").select("content").collect()
    lengths = next(np.frombuffer(zlib.decompress(body), np.uint8) for r in book for _, body in frames(bytes(r.content)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for content in batch.column(0):
                for _, body in frames(content.as_py()):
                    start, docs, nulls, sizes, ids = read_block(body, decoder)
                    ends = np.cumsum(sizes, dtype=np.int64)
                    starts = ends - sizes
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                    out = {"doc_id": pa.array(docs, mask=nulls.astype(bool)), "start": starts + start, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(crc, np.int64)}
                    if keep_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    return spark.read.format("binaryFile").load(f"{path}/blocks").select("content").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False, specials_as_text: bool = True) -> DataFrame:
    """Write ``docs`` as an archive in the shared folder and return what the reader finds in it."""
    path = scratch_path(docs.sparkSession, "huffman")
    write_archive(docs, path, tokenizer, specials_as_text)
    return read_archive(docs.sparkSession, path, keep_ids)

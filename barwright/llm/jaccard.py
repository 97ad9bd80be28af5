"""N-gram Jaccard join: MinHash banding finds candidate pairs, full n-gram sets decide.

Documents with equal n-gram sets form one class, so copies never meet as pairs. Classes are shuffled on their band hashes. The few that share a band hash become
candidate pairs, each once however many bands it shares, and a pair's sets meet in one unit of work with those of its neighbours. A band hash that many classes share
(templates, large groups of near copies) gives no pairs: the classes that such hot bands connect are cut into blocks, and each pair of blocks is a unit that counts
its links and hands on one row per class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows, hash_words, intern_words, mix, rolling, stash, tidied, tidied_batches, unused
from barwright.llm.graph import components

N, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold shares a band, and the most hashes for that.
RECALL, HASHES = 0.9999, 128
#: Classes that share a band hash, beyond which they are compared in blocks instead of becoming pairs.
HOT = 32
#: Classes of a block, and n-grams of it, at most but for single larger sets; two blocks are compared in one piece.
BLOCK, BLOCK_GRAMS = 384, 2_000_000
#: Bytes of sets in a unit of candidate pairs, and pairs, about.
UNIT_BYTES, UNIT_PAIRS = 8 << 20, 2000


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which bands enough for the recall fit into ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach that recall")
    return best


def ngram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text. A text of fewer than ``n`` words is one gram; one without words has none."""
    table, codes, sizes = intern_words(texts)
    values = hash_words(list(table))[codes]
    grams = mix(rolling(values, n))
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:
            out.append(mix(rolling(values[at : at + size], size) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def set_key(grams: np.ndarray) -> bytes:
    """128-bit name of a set; sets with equal names are taken as equal."""
    return xxhash.xxh3_128_digest(grams.tobytes())


class MinHash:
    """Band hashes of a set: minima of multiply-add hashes of its members, ``rows`` at a time."""

    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 512):
            part = self.a[:, None] * low[None, at : at + 512]
            part += self.b[:, None]
            # Multiplication leaves the low bits weak: fold the high ones in before the minimum.
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x85EBCA6B)
            np.minimum(least, part.min(1), out=least)
        out = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in least.reshape(self.bands, self.rows).T:
            out = mix(out ^ column.astype(np.uint64)) + np.uint64(1)
        return out.view(np.int64)


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = ngram_sets(part.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "text_hash": part.column(2),
                        "key": pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        "size": pa.array([len(s) for s in sets], pa.int64()),
                        "bands": pa.array([minhash(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )

    return tidied_batches(run)


def _sets(n: int):
    """Recompute the sets of candidate classes, keeping rows whose set is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = ngram_sets(part.column("text").to_pylist(), n)
                keys = part.column("key").to_pylist()
                same = [k for k, s in enumerate(sets) if set_key(s) == keys[k]]
                kept = part.drop_columns(["text"]).take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([sets[k].tobytes() for k in same], pa.binary())], names=[*kept.schema.names, "grams"])

    return tidied_batches(run)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Binary values as arrays of 64-bit hashes, on the column's own memory."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of which sets of ``left`` and ``right`` have a Jaccard similarity of ``threshold`` or more.

    Only n-grams on both sides can be shared; they are taken some thousand at a time, so memory follows the sets' number.
    """
    sizes = [np.array([len(s) for s in side], np.float64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)
    rows, columns = [], []
    for side, values in zip((left, right), flat, strict=True):
        place = np.searchsorted(shared, values)
        place[place == len(shared)] = 0
        hit = shared[place] == values if len(shared) else np.zeros(len(values), bool)
        rows.append(np.repeat(np.arange(len(side)), [len(s) for s in side])[hit])
        columns.append(place[hit])
    for at in range(0, len(shared), 4096):
        dense = []
        for side, r, c in zip((left, right), rows, columns, strict=True):
            own = (c >= at) & (c < at + 4096)
            m = np.zeros((len(side), min(4096, len(shared) - at)), np.float32)
            m[r[own], c[own] - at] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common + 1e-9 >= threshold * union


def _labels(near: np.ndarray) -> np.ndarray:
    """Least member of each one's component in a symmetric matrix."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(1, initial=len(near))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])


def _counted(names: list[bytes], near: np.ndarray, copies: np.ndarray, out: dict[str, list]) -> None:
    """Add to ``out`` each name that ``near`` links to another: how many documents, and the least name that links connect it with here."""
    order = np.argsort(np.array(names, object), kind="stable")
    label, links = _labels(near[np.ix_(order, order)]), near @ copies
    for place, o in enumerate(order):
        if links[o]:
            out["key"].append(names[o])
            out["links"].append(int(links[o]))
            out["label"].append(names[order[label[place]]])


def _compare_pairs(threshold: float):
    """Candidate pairs of a unit, by the sets that the unit was sent once each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = dict(zip(left["key"].to_pylist(), zip(_arrays(left["grams"]), left["copies"].to_pylist(), strict=True), strict=True))
        wanted: dict[bytes, list[tuple]] = {}
        for anchor, a, b in zip(*(right[c].to_pylist() for c in ("anchor", "a", "b")), strict=True):
            if a in sets and b in sets:
                wanted.setdefault(anchor, []).append((a, b))
        out: dict[str, list] = {"key": [], "links": [], "label": []}
        for pairs in wanted.values():
            names = sorted({x for pair in pairs for x in pair})
            place = {x: k for k, x in enumerate(names)}
            listed = np.zeros((len(names), len(names)), bool)
            for a, b in pairs:
                listed[place[a], place[b]] = listed[place[b], place[a]] = True
            # An anchor's classes are few: a whole matrix in blocks costs less than one comparison after another.
            own, near = [sets[x][0] for x in names], np.zeros_like(listed)
            for i in range(0, len(names), BLOCK):
                for j in range(i, len(names), BLOCK):
                    if listed[i : i + BLOCK, j : j + BLOCK].any():
                        near[i : i + BLOCK, j : j + BLOCK] = linked(own[i : i + BLOCK], own[j : j + BLOCK], threshold)
            near = (near | near.T) & listed
            _counted(names, near, np.array([sets[x][1] for x in names]), out)
        return pa.table(out, schema=_LINKS)

    return tidied(run)


def _compare_blocks(threshold: float):
    """All pairs of two blocks, or of one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts: dict[tuple, dict[tuple, tuple]] = {}
        columns = [rows[c].to_pylist() for c in ("label", "i", "j", "block", "key", "copies")]
        for label, i, j, block, name, copies, grams in zip(*columns, _arrays(rows["grams"]), strict=True):
            # Rows that are equal in doc_id and text give the same set twice.
            parts.setdefault((label, i, j), {})[block, name] = (grams, copies)
        out: dict[str, list] = {"key": [], "links": [], "label": []}
        for (_, i, j), members in parts.items():
            sides = [sorted(k for b, k in members if b == x) for x in ((i,) if i == j else (i, j))]
            if not all(sides):
                continue
            sets = [[members[b, k][0] for k in side] for b, side in zip((i, j), sides, strict=False)]
            near = linked(sets[0], sets[-1], threshold)
            if i == j:
                np.fill_diagonal(near, False)
                every, names = near, sides[0]
            else:
                a, b = near.shape
                every = np.zeros((a + b, a + b), bool)
                every[:a, a:], every[a:, :a] = near, near.T
                names = sides[0] + sides[1]
            _counted(names, every, np.array([members[b, k][1] for b, side in zip((i, j), sides, strict=False) for k in side]), out)
        return pa.table(out, schema=_LINKS)

    return tidied(run)


def candidates(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (anchor, a, b) of ``classes`` (key, size, bands), and the groups (key, label) that hot bands connect.

    A pair is left out if its sizes alone put it under the threshold, or if both are in one hot group, which is compared in full.
    """
    bucketed = classes.select("key", "size", F.explode("bands").alias("band"))
    shared = bucketed.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("anchor")).filter("n > 1")
    members = stash(bucketed.join(shared, "band"), "jaccard-buckets")
    hot = members.filter(F.col("n") > HOT).select(F.col("key").alias("u"), F.col("anchor").alias("v"))
    groups = stash(components(hot).withColumnRenamed("node", "key"), "jaccard-hot")
    # At most HOT classes meet in a list here.
    lists = members.filter(F.col("n") <= HOT).groupBy("band").agg(F.min("anchor").alias("anchor"), F.sort_array(F.collect_list(F.struct("key", "size"))).alias("x"))
    least = F.lit(threshold - 1e-9)
    fits = lambda a: lambda b: (b["key"] > a["key"]) & (F.least(a["size"], b["size"]) >= least * F.greatest(a["size"], b["size"]))
    pairs = lists.select("anchor", "x", F.explode("x").alias("a")).select("anchor", "a", F.explode(F.filter("x", fits(F.col("a")))).alias("b"))
    pairs = pairs.groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(F.min("anchor").alias("anchor"))
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("key").alias(side), F.col("label").alias(f"group_{side}")), side, "left")
    return stash(pairs.filter("group_a IS NULL OR group_b IS NULL OR group_a <> group_b").select("anchor", "a", "b"), "jaccard-pairs"), groups


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, class_id, n_links, n_copies, group`` for every row of ``docs`` (doc_id, text; others are ignored).

    Two documents are linked if the Jaccard similarity of their sets of ``n`` words in a row is ``threshold`` or more. ``n_links`` counts the other
    documents a document is linked to, ``n_copies`` those with an equal set, itself included; ``class_id`` is the least doc_id among those that
    links connect, and ``group`` names them for rows without a doc_id. Texts without words, null ones too, are linked to nothing and stand alone; repeated rows are copies. An
    empty table gives an empty table. Texts count whole, however long.
    """
    arrow_rows(docs.sparkSession)
    bands, rows = band_shape(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = docs.mapInArrow(_sign(n, bands, rows), "doc_id long, text_hash long, key binary, size long, bands array<long>")
    signed = stash(signed, "jaccard-signed")
    worded = signed.filter("key IS NOT NULL").groupBy("key")
    classes = stash(worded.agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "jaccard-classes")
    pairs, groups = candidates(classes, threshold)

    # Sets go once to each unit that asks for them: an anchor's for pairs (at most one for each pair of a class), the pairs of blocks of a hot group.
    ends = pairs.select("anchor", F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    wanted = classes.drop("bands").join(ends, "key", "left").join(groups, "key", "left").filter("anchors IS NOT NULL OR label IS NOT NULL")
    wanted = stash(wanted.withColumnRenamed("first", "_id"), "jaccard-wanted")
    totals = wanted.agg(F.sum(F.size(F.coalesce("anchors", F.array())) * F.col("size"))).first()[0] or 0
    units = max(1, totals * 8 // UNIT_BYTES, pairs.count() // UNIT_PAIRS)
    sizes = wanted.filter("label IS NOT NULL").groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    asked = wanted.join(sizes, "label", "left")
    # Texts are dealt out by doc_id at every size, not only once the candidates are too many to broadcast.
    found = docs.select("doc_id", "text").hint("merge").join(asked, F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.select("text", "key", "copies", "anchors", "label", "blocks")
    sets = found.mapInArrow(_sets(n), "key binary, copies long, anchors array<binary>, label binary, blocks int, grams binary")
    sets = stash(sets, "jaccard-sets")

    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(units)).alias("unit")
    left = sets.filter("anchors IS NOT NULL").select("key", "copies", "grams", F.explode("anchors").alias("anchor")).select(unit("anchor"), "key", "copies", "grams")
    schema = "key binary, links long, label binary"
    cold = left.groupBy("unit").cogroup(pairs.select(unit("anchor"), "anchor", "a", "b").groupBy("unit")).applyInArrow(_compare_pairs(threshold), schema)
    blocked = sets.filter("label IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    work = blocked.select(F.xxhash64("label", "i", "j").alias("unit"), "label", "i", "j", "block", "key", "copies", "grams")
    links = stash(cold.unionByName(work.groupBy("unit").applyInArrow(_compare_blocks(threshold), schema)), "jaccard-links")

    joined = components(links.select(F.col("key").alias("u"), F.col("label").alias("v"))).withColumnRenamed("node", "key")
    totals = links.groupBy("key").agg(F.sum("links").alias("links"))
    names = classes.select("key", "first", "copies").join(totals, "key", "left").join(joined, "key", "left")
    names = stash(names.withColumn("label", F.coalesce("label", "key")), "jaccard-names")
    least = names.groupBy("label").agg(F.min("first").alias("class_id"))
    names = stash(names.join(least, "label").drop("first"), "jaccard-result")
    out = signed.select("doc_id", "text_hash", "key").join(names, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.col("label").alias("group"),
    )


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each linked group: the one with the least doc_id, the first by the hash of its text if several rows have that.

    All columns stay, whatever their names; texts without words, null ones too, stay all. Of rows equal in doc_id and text one stays. An empty table gives an empty table.
    """
    found = join(docs, n, threshold)
    kept = found.filter(F.col("group").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Of a group's rows with that doc_id one text is enough; only such rows meet here.
    one = kept.filter("group IS NOT NULL").groupBy("group").agg(F.min_by("doc_id", "text_hash").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    id_, hash_, own = unused(docs.columns, "id", "hash", "own")
    one = stash(one.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)), "jaccard-keep")
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rest = docs.filter(worded).withColumn(own, F.xxhash64(F.col("text").cast("string")))
    rest = rest.join(one, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return rest.unionByName(docs.filter(~worded))

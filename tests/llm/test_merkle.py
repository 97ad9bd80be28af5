import zlib
from hashlib import sha256

import pytest
from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value
from pyspark.sql import functions as F

from barwright.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        beside = at ^ 1
        out.append(("L" if at & 1 else "R") + nodes[beside] if beside < len(nodes) else "-")
        at >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    crown = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for at, (i, h) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((i, h, trees[g][-1][0], crown[-1][0], ",".join(siblings(trees[g], at) + siblings(crown, place))))
    return out


def rows_of(n):
    rows = [(k, None if k % 11 == 0 else f"text {k} é", [None, "en", "de", "", "=x", "日本"][k % 6 if k % 4 == 0 else 1], None if k % 13 == 0 else f"s{k % 3}", None if k % 7 == 0 else k) for k in range(n)]
    return rows + [(3, "same", "en", "s", 4)] * (n // 3) + [(None, "no id", "en", None, None), (5, "other", "en", "s", 1), (1, "x" * 200_000, "solo", "s", 1)]


def collected(df):
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("n", [1, 40, 2600])
def test_forest_and_proofs_by_brute_force(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("hash", F.lit(2)).repartition(5)
    want = sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    got = collected(merkle.manifest(df, COLUMNS))
    assert got == want


def test_folding_and_tampering(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, SCHEMA)
    made = merkle.manifest(df, COLUMNS, also={"changed": F.when(F.col("doc_id") % 2 == 0, merkle.digest(*[F.col(c) if c != "text" else F.lit("forged") for c in COLUMNS]))})
    for r in made.withColumn("back", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))).withColumn("beside", merkle.siblings_digest(F.col("proof"))).collect():
        assert (r.back == r.root) == (r.changed is None or r.changed == r.leaf)
        assert r.beside == H(*[s[1:] for s in r.proof.split(",")])


def test_coordinates_of_some_rows_and_stored_levels(spark, tmp_path):
    hashes = [H(str(k)) for k in range(2500)]
    df = spark.createDataFrame([("t", k, h) for k, h in enumerate(hashes)], "tree string, id long, hash string").repartition(4)
    forest = merkle.plant(df, ["id"], str(tmp_path / "m"))
    levels = tree(hashes)
    for k, nodes in enumerate(levels):
        assert [r.hash for r in forest.level(k).orderBy("pos").collect()] == nodes
    assert sorted(p.name for p in (tmp_path / "m" / "nodes").iterdir()) == ["band=0", "band=1"]
    got = forest.proofs(forest.tops().withColumn("path", F.lit("")), forest.leaves.filter("pos IN (0, 1023, 1024, 2499)")).collect()
    assert {r.pos: r.proof for r in got} == {p: ",".join(siblings(levels, p)) for p in (0, 1023, 1024, 2499)}


@pytest.mark.parametrize("sizes", [(1100, 513, 400), (1025, 1024, 700, 512, 1, 2), (2049, 1100, 600)])
def test_trees_that_end_where_a_stretch_of_others_begins(spark, sizes):
    rows = [(k, f"t{k}", f"l{t}", "s", 1) for t, n in enumerate(sizes) for k in range(n)]
    got = collected(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), COLUMNS))
    assert got == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_ends_of_trees_in_every_band(spark, monkeypatch):
    """With bands of two levels, trees of 1 to 70 leaves have one to four of them."""
    monkeypatch.setattr(merkle, "BAND", 2)
    rows = [(k, f"t{k}", f"l{n}", "s", 1) for n in [*range(1, 19), 32, 33, 64, 65, 70] for k in range(n)]
    register_pickle_by_value(merkle)  # else the workers import the module, with bands of ten
    try:
        got = collected(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), COLUMNS))
    finally:
        unregister_pickle_by_value(merkle)
    assert got == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_empty_and_single(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), COLUMNS).collect() == []
    r = merkle.manifest(spark.createDataFrame([(1, "a", None, None, None)], SCHEMA), COLUMNS).first()
    assert r.leaf == r.subroot == r.root == leaf(1, "a", None, None, None) and r.proof == ""
    assert zlib.crc32(b"1") % 7 != 0

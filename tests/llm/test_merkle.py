import zlib

from pyspark.sql import functions as F

from memscan.llm import common, merkle, queries

from . import brute
from .conftest import SF

FIELDS = list(merkle.FIELDS)


def lowered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return None
    return (*r[:4], brute.low(r[4]) if r[4] is not None else None)


def run(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    full = [(*r, 5, "k", b"d", 1) for r in rows]
    (spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, rank long,"
                           " tree string, digest binary, height int").write.parquet(f"{path}/documents.parquet"))
    return sorted(map(str, (tuple(r) for r in queries.op12_merkle_manifest(spark, path).collect())))


def want(rows):
    got = brute.merkle(rows, lowered)
    return sorted(str((*r, r[-1] == r[3])) for r in got)


def test_query(spark, documents):
    rows = [tuple(r) for r in documents.select(*FIELDS).collect()]
    got = sorted(map(str, (tuple(r) for r in queries.op12_merkle_manifest(spark, SF).collect())))
    assert got == want(rows)
    assert 0 < sum(x.endswith("False)") for x in got) < len(rows) / 4


def test_odd_tables(spark, tmp_path):
    one = [(1, "s", None, 3, "Abc")]
    nulls = [(None, None, None, None, None), (5, None, "en", None, "T"), (0, "", "", 0, ""), (5, "é", "en", 2, "Ü A")]
    twice = [(i % 3, "hot", "en", i % 2, "Same") for i in range(40)] + [(9, "z", "en", 1, "Z")] * 17
    tall = [(i, "hot" if i % 3 else f"s{i % 60}", "en", i, f"Text {i}") for i in range(700)]
    for n, rows in enumerate((one, nulls, twice, tall)):
        assert run(spark, f"{tmp_path}/{n}", rows) == want(rows)
    assert run(spark, f"{tmp_path}/none", []) == []


def test_proofs_of_some_leaves(spark):
    rows = [(i, "a" if i < 300 else "b", "en", 1, f"t{i}") for i in range(320)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(common.stage(merkle.leaf_rows(d), "t-rows"), ["id"], "t")
    a = m.names.filter("source = 'a'").first().tree
    asked = spark.createDataFrame([(a, r) for r in (0, 17, 255, 256, 299)], "tree long, rank long")
    got = merkle.proofs(m, asked, "t")
    assert sorted(r.member.id for r in got.collect()) == [0, 17, 255, 256, 299]
    ok = got.withColumn("back", merkle.fold(F.col("member.digest"), F.col("proof"))).collect()
    assert all(bytes(r.back) == m.root for r in ok)
    wrong = got.withColumn("back", merkle.fold(F.unhex(F.sha2(F.lit("x"), 256)), F.col("proof"))).collect()
    assert all(bytes(r.back) != m.root for r in wrong)
    # a descent looks up digests: a record that is not the node's content breaks it
    levels = brute.merkle_levels([brute.merkle_leaf(r) for r in rows[:300]])
    kids = {bytes(r.digest).hex(): [bytes(c).hex() for c in r.children] for r in m.sources.records.collect()}
    assert kids[levels[-1][0]] == levels[-2]


def test_equal_subtrees_are_one_record(spark):
    leaf = spark.createDataFrame([(t, r, b"x") for t in (1, 2, 3) for r in range(32)], "tree long, rank long, digest binary")
    f = merkle.build(leaf, [], "t")
    assert f.records.count() == 2 and f.roots.count() == 3
    assert len({bytes(r.digest) for r in f.roots.collect()}) == 1

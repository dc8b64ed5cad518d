"""What stages leave on disk and what meets in one task."""

import time

from pyspark.sql import functions as F

from memscan.llm import common, katz, linededup, neardup, repeats, setjoin

from .conftest import frame


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stage_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(common, "release", lambda spark: None)      # garbage collection may be a stage too late
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    before = _shuffle_files(spark)
    out = common.stage(rows.groupBy("k").count().repartition(3, "k"), "counts")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert {(r["k"], r["count"]) for r in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert spark.conf.get(common.CLEANUP) == "false"                # the user's setting is as before


def test_katz_keeps_blocks_once(spark, monkeypatch):
    gone = []
    discard = common.discard
    monkeypatch.setattr(common, "discard", lambda *tables: (gone.extend(t.columns for t in tables), discard(*tables)))
    d = frame(spark, [(i, f"the cat {i % 5} sat on the mat {i}") for i in range(60)])
    out = katz.katz_scores(d, F.col("doc_id") % 7 == 2)
    assert ["block", "docs", "held", "n_tokens", "words", "tokens", "train", "size"] in gone
    assert out.count() == 60 and len({r["doc_id"] for r in out.collect()}) == 60


def _parts_of_tasks(found, parts):
    """The parts that each task's rows (key) belong to."""
    rows = found.select("key", F.spark_partition_id().alias("task")).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r["task"], set()).add(r["key"] % 2**64 % parts)
    return list(tasks.values())


def test_each_part_has_its_own_task(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "ENTRIES", 1000)
    sigs = linededup.signatures(spark.range(1200).select("id", F.expr("md5(string(id div 2))").alias("line")))
    parts = 1200 * linededup.BANDS // 1000 + 1
    tasks = _parts_of_tasks(setjoin.meet(sigs), parts)
    assert len(tasks) == parts and all(len(t) == 1 for t in tasks)


def test_each_part_of_repeats_has_its_own_task(spark):
    rows = spark.range(400).select(F.col("id").alias("doc"), F.lit(0).cast("long").alias("base"),
                                   F.expr("concat_ws('', transform(sequence(1, 9), i -> md5(concat(id % 200, '-', i))))").alias("text"))
    tasks = _parts_of_tasks(repeats.repeated_blocks(rows, 7, 32).filter("kind = 'whole'"), 7)
    assert len(tasks) > 1 and all(len(t) == 1 for t in tasks)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_dealt_stage_is_not_shuffled_again(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (2, None), (3, "c"), (None, "d")]
    d = spark.createDataFrame(rows, "id long, text string")
    dealt, plain = common.stage_dealt(d, "dealt", "id"), common.stage(d, "plain")
    asked = common.stage(spark.createDataFrame([(2,), (3,), (9,)], "id long"), "asked").hint("merge")
    joined = asked.join(dealt, "id")
    assert _plan(joined).count("Exchange hashpartitioning") == 1
    assert _plan(asked.join(plain, "id")).count("Exchange hashpartitioning") == 2
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, joined.collect()), key=key) == [(2, None), (2, "b"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, dealt.collect()), key=key) == sorted(rows, key=key)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
    _, path = common._folders[id(dealt)]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(hadoop)
    common.discard(dealt)
    assert not fs.exists(hadoop)


def test_texts_that_meet_are_read_by_shuffle(spark, monkeypatch):
    plans, links = [], setjoin.links

    def watched(sigs, texts_of, *rest):
        def texts(ids):
            plans.append(_plan(out := texts_of(ids)))
            return out
        return links(sigs, texts, *rest)

    monkeypatch.setattr(setjoin, "links", watched)
    words = " ".join(f"w{i}" for i in range(40))
    d = frame(spark, [(1, words), (2, words + " tail"), (3, "another text"), (5, None)])
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 5: 5}
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)

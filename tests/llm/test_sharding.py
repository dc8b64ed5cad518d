import collections
import zlib

import numpy as np
import pytest

from memscan.llm import common, queries, sharding
from memscan.llm.sharding import MapStore, drain, grow, initial_map, rebalance

from .conftest import SF, frame


def test_query(spark, documents):
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    got = queries.op11_virtual_slots(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    mean, most = sum(load.values()) / 24, max(r.size for r in got)
    assert max(load.values()) <= max(1.05 * mean, most)


def test_odd_rows(spark, odd, nothing):
    d = odd.unionByName(odd).unionByName(frame(spark, [(None, "no key"), (None, "no key"), (None, None), (None, "x")]))
    d = d.unionByName(frame(spark, [(7, f"text {i} of one key") for i in range(50)] + [(8, "same")] * 300))
    got = sharding.shard_documents(d, 5, 64).collect()
    want = collections.Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8)
                               for r in d.collect())
    assert collections.Counter((r.doc_id, r.text_crc32, r.size) for r in got) == want
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    again = sharding.shard_documents(d.repartition(7), 5, 64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_documents(nothing, 5).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_maps(seed):
    rng = np.random.default_rng(seed)
    size = rng.lognormal(8, 1 + seed / 2, 512).astype(np.int64) * (rng.random(512) < 0.8)
    m = rebalance(initial_map(12, 512), size)
    load = m.loads(size)
    assert m.version == 1 and load.sum() == size.sum()
    assert load.max() <= max(1.1 * load.mean(), size.max())
    same = rebalance(m, size)       # balanced already: few slots move, and small ones
    assert size[m.moved(same)].sum() <= 0.2 * size.sum()
    g = grow(m, size)
    assert set(g.shard[m.moved(g)]) == {12} and g.n_shards == 13 and g.version == 2
    assert g.loads(size)[12] <= size.sum() / 13
    less = drain(g, size, 3)
    assert set(g.shard[g.moved(less)]) == {3} and not (less.shard == 3).any()


def test_versions_are_written_once(spark, tmp_path):
    store = MapStore(spark, f"{tmp_path}/maps")
    m = initial_map(3, 16)
    store.save(m)
    edited = rebalance(m, np.arange(16))
    store.save(edited)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.save(edited)
    assert store.versions() == [0, 1] and store.latest().version == 1
    assert store.latest().shard.tolist() == edited.shard.tolist()
    assert store.load(0).shard.tolist() == m.shard.tolist()
    with pytest.raises(ValueError):
        initial_map(17, 16)


def test_latest_map_is_edited(spark, tmp_path, documents):
    store = MapStore(spark, f"{tmp_path}/maps")
    store.save(initial_map(4, 64))
    first = sharding.shard_documents(documents, 4, 64, store=store).collect()
    second = sharding.shard_documents(documents, 4, 64, store=store).collect()
    assert {r.map_version for r in first} == {1} and {r.map_version for r in second} == {2}
    moved = {r.virtual_slot for r in first} - {r.virtual_slot for r in first if r.shard ==
                                               {s.doc_id: s.shard for s in second}[r.doc_id]}
    assert len(moved) <= 16


def test_files_of_shards(spark, tmp_path, documents):
    recs = common.stage(sharding.records(documents, 64), "t-recs")
    m = rebalance(initial_map(4, 64), sharding.slot_bytes(sharding.slot_sizes(recs), 64))
    sharding.write_shards(documents, m, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == documents.count()
    slot = {r.doc_id: r.virtual_slot for r in recs.collect()}
    assert all(m.shard[slot[r.doc_id]] == r.shard for r in back.select("doc_id", "shard").collect())

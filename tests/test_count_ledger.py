"""Versioned counts against a recount of the documents that are in."""

import uuid
from collections import Counter

import pytest

from memscan.operators import ngram
from memscan.session import checkpoint_root
from memscan.sources.count_ledger import CountLedger

SCHEMA = "doc_id long, toks array<string>"
A = [(1, ["a", "b", "a", "b"]), (2, ["b"]), (3, []), (4, None), (None, ["q", "q"])]
B = [(2, ["b"]), (5, ["a", "b", "c"]), (6, ["c", "c", "c"])]


def recount(docs):
    out = Counter()
    for _, toks in docs:
        for i, t in enumerate(toks or []):
            out[t, toks[i + 1] if i + 1 < len(toks) else None] += 1
    return dict(out)


def rows(df):
    return {(r["ctx"], r["tok"]): r["cnt"] for r in df.collect()}


@pytest.fixture
def ledger(spark):
    return CountLedger(spark, f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_versions_equal_recounts(spark, ledger):
    assert ledger.counts().count() == 0 and ledger.versions() == []
    assert ledger.add(frame(spark, A)) == 1
    assert ledger.add(frame(spark, B)) == 2              # document 2 is there already
    assert ledger.add(frame(spark, B)) == 3              # a batch that is run again
    assert ledger.remove(frame(spark, [A[0], (5, ["other"]), (99, ["a"])])) == 4
    assert ledger.compact() == 5
    assert ledger.add(frame(spark, [])) == 6
    both = A[:4] + B[1:]
    want = {1: recount(A[:4]), 2: recount(both), 3: recount(both), 4: recount(both[1:])}
    want[5] = want[6] = want[4]
    for v, counts in want.items():
        assert rows(ledger.counts(v)) == counts, v
    assert rows(ledger.counts()) == want[6]
    assert {r["doc_id"] for r in ledger.documents().collect()} == {2, 3, 4, 5, 6}
    assert ledger.add(frame(spark, [A[0]])) == 7         # back again after its removal
    assert rows(ledger.counts()) == want[2]


def test_refusals(spark, ledger):
    with pytest.raises(ValueError):
        ledger.compact()
    with pytest.raises(ValueError):
        ledger.add(frame(spark, [(1, ["a"]), (1, ["b"])]))
    with pytest.raises(ValueError):
        ledger.counts(3)
    ledger.add(frame(spark, A))
    with pytest.raises(RuntimeError):                    # of two writers one is refused
        ledger._commit("delta", "none", 1)
    assert len(ledger.versions()) == 1


def test_model_of_merged_counts_is_the_refitted_one(spark, ledger):
    ledger.add(frame(spark, A))
    ledger.add(frame(spark, B))
    ledger.remove(frame(spark, A[:1]))
    merged = ngram.fit_from_counts(spark, ledger.counts())
    again = ngram.fit_bigram(spark, frame(spark, A[1:4] + B[1:]))
    assert merged.s == again.s
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(merged.contexts) == key(again.contexts)
    assert key(merged.bigram) == key(again.bigram)


def test_all_versions_in_one_pass(spark, ledger):
    ledger.add(frame(spark, A))
    ledger.add(frame(spark, B))
    ledger.remove(frame(spark, A[:1]))
    ledger.compact()
    ledger.remove(frame(spark, [A[0]]))                  # nothing to take out
    got = {}
    for r in ledger.counts([1, 2, 3, 4, 5]).collect():
        got.setdefault(r["version"], {})[r["ctx"], r["tok"]] = r["cnt"]
    assert got == {v: rows(ledger.counts(v)) for v in (1, 2, 3, 4, 5)} and got[4] == got[5] == recount(A[1:4] + B[1:])
    plan = ledger.counts([1, 2, 3, 4])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in ledger.counts(4)._jdf.queryExecution().executedPlan().toString()     # a snapshot alone

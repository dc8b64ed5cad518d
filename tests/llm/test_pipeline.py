import corpus_pipeline
from memscan.llm import common, packing, quality
from memscan.llm.linededup import SHINGLE
from memscan.llm.queries import queries, vocabulary_file

from . import brute
from .conftest import SF


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    state = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = common.stage(f(spark, docs, SF), f"t-{name}")
        assert out.columns == cols and out.schema == docs.schema
        before = [(r.doc_id, r.text) for r in docs.collect()]
        state[name] = (before, {r.doc_id: r.text for r in out.collect()})
        docs = out
    before, after = state["quality_rules"]
    assert all(before_text == after[i] for i, before_text in before if i in after)
    bad = {i for i, t in before if (b := brute.quality_base(t))[0] < 20 or 100 * b[4] > 30 * b[0]}
    assert not bad & set(after)
    before, after = state["line_dedup"]
    want = brute.fuzzy_lines(before, SHINGLE)
    kept = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if want[i, n] == (i, n)) for i, t in before}
    assert after == {i: t for i, t in kept.items() if t.strip()}
    before, after = state["near_dedup"]
    comp = brute.near_duplicates(before)
    assert set(after) == {c for _, c in comp.values()}
    before, after = state["repeat_dedup"]
    gone = brute.without_repeats(before)
    for i, t in after.items():
        assert len(t.encode()) >= gone[i][0] - gone[i][1]
        assert len(t.encode()) <= gone[i][0] - gone[i][1] + 6 * gone[i][2]


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.sequence_id for r in rows}) >= sum(r.length for r in rows) / 4096
    assert all(r.offset + r.length <= packing.CAPACITY for r in rows)


def test_empty_table(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        docs_out = f(spark, docs, SF)
        assert docs_out.count() == 0


def test_each_operator_has_a_query():
    names = set(queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 14)}
    assert quality.COMMON_WORDS and vocabulary_file("word_bpe_49k.json")

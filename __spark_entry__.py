"""

Every query reads the driver's tables under ``sf_dir`` (whole tables, whole
texts) and returns a DataFrame; ``oracle_sql()`` gives DuckDB SQL with the
same column names for each query that SQL can express.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memscan.functions.text import clean_text, word_count
from memscan.operators import profile as prof
from memscan.operators import report as rep
from memscan.operators import lm_batches as lm
from memscan.operators import roc
from memscan.fixtures import DecayModel, MeanModel, ToyModel
from memscan.operators.infill import infill_ratios, parity
from memscan.plans import model_path as mp
from memscan.operators import scores as sc
from memscan.plans import catalog as cat
from memscan.plans import oracle as sql
from memscan.session import by_shuffle
from memscan.sources import benchmark_snippets, documents_snippets, table

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _llm():
    """The training-data operators' queries; None where that subpackage is
    not installed.  Errors inside an installed one are not swallowed."""
    spec = importlib.util.find_spec("memscan.llm")
    if spec is None or spec.origin is None:
        return None
    from memscan.llm import queries as llm_queries
    return llm_queries


def _r(c, n):
    return F.round(F.col(c), n).alias(c)


# ---------------------------------------------------------------- flagship
def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rep.result_table(cat.metrics(spark, sf_dir))
    return t.select("method", "method_order", _r("auroc", 6), _r("fpr95", 6), _r("tpr05", 6),
                    "auroc_pct", "fpr95_pct", "tpr05_pct")


def entry(spark: SparkSession) -> DataFrame:
    """All 122 scores of sf0.001 documents evaluated by AUROC / FPR95 / TPR05."""
    cat.store(spark)        # session settings and the package for Python workers
    return method_metrics(spark, FLAGSHIP_DIR)


# ---------------------------------------------------------------- queries
def q_clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = clean_text(F.col("text"))
    return d.select("doc_id", c.alias("clean"),
                    F.size(F.filter(F.split(c, " "), lambda t: t != "")).alias("n_clean_words"),
                    word_count(F.col("text")).alias("n_words"))


def q_token_counts(spark, sf_dir):
    from memscan.operators.tokens import tokens
    return tokens(cat.docs(spark, sf_dir)).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt"))


def q_vocabulary(spark, sf_dir):
    u = cat.model(spark, sf_dir).unigram
    return u.select("tok", "cnt", _r("q", 12))


def q_bigram_counts(spark, sf_dir):
    return cat.model(spark, sf_dir).bigram.select("ctx", "tok", "cnt")


def q_bigram_model(spark, sf_dir):
    m = cat.model(spark, sf_dir)
    return (m.bigram.join(by_shuffle(m.contexts.select("ctx", "lam")), "ctx")
            .select("ctx", "tok", "cnt", _r("lam", 12), _r("p", 12)))


def q_merged_model(spark, sf_dir):
    """The model after documents were added and others taken out again."""
    m = cat.merged_model(spark, sf_dir)
    return (m.bigram.join(by_shuffle(m.contexts.select("ctx", "lam", "mu", "xhat")), "ctx")
            .select("ctx", "tok", "cnt", _r("lam", 12), _r("p", 12), _r("mu", 5), "xhat"))


def q_count_versions(spark, sf_dir):
    """Documents, tokens and distinct pairs as of each version of the counts."""
    ledger = cat.count_ledger(spark, sf_dir)
    none = F.lit(0).cast("long")
    versions = [x["version"] for x in ledger.versions()]
    parts = [ledger.counts(versions).groupBy("version").agg(F.sum("cnt").alias("n_tokens"), F.count("tok").alias("n_pairs"))
             .select(none.alias("n_docs"), "n_tokens", "n_pairs", "version")]
    for v in versions:
        parts.append(ledger.documents(v).agg(F.count(F.lit(1)).alias("n_docs"), none.alias("n_tokens"), none.alias("n_pairs"))
                     .withColumn("version", F.lit(v).cast("long")))
    rows = reduce(DataFrame.unionAll, parts)
    return rows.groupBy("version").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_pairs")])


def q_context_moments(spark, sf_dir):
    c = cat.model(spark, sf_dir).contexts
    return c.select("ctx", "n_c", "d_c", _r("lam", 12), _r("mu", 5), _r("var", 5), "xhat", _r("p_xhat", 12))


def q_peaked_contexts(spark, sf_dir):
    """Moments of the hundred most peaked contexts, to relative precision."""
    c = cat.model(spark, sf_dir).contexts.filter("d_c = 1").orderBy(F.col("n_c").desc(), "ctx").limit(100)
    return c.select("ctx", "n_c", F.round(F.ln(-F.col("mu")), 8).alias("ln_minus_mu"), F.round(F.ln("var"), 8).alias("ln_var"))


def q_trigram_counts(spark, sf_dir):
    return cat.backoff(spark, sf_dir).top.grams.select("ctx", "tok", "cnt", _r("p", 12))


def q_trigram_moments(spark, sf_dir):
    c = cat.backoff(spark, sf_dir).top.contexts
    return c.select("ctx", "n_c", "d_c", _r("lam", 12), _r("mu", 5), _r("var", 5), "xhat", _r("p_xhat", 12))


def q_trigram_log_probs(spark, sf_dir):
    from memscan.operators.backoff import log_probs
    return log_probs(cat.docs(spark, sf_dir), cat.backoff(spark, sf_dir)).select("doc_id", "pos", "tok", _r("lp", 6))


def q_token_stats(spark, sf_dir):
    ts = cat.token_stats(spark, sf_dir)
    return ts.select("doc_id", "pos", "tok", "next_tok", _r("lp", 5), _r("mu", 5), _r("var", 5), "xhat",
                     _r("lp_xhat", 5), _r("lp_alt", 5), _r("mu_alt", 5), _r("var_alt", 5))


def _family(prefix: str, clip: bool = False, exact: bool = False):
    def q(spark, sf_dir):
        s = cat.scores(spark, sf_dir, clip)
        cond = (F.col("method") == prefix) if exact else F.col("method").startswith(prefix)
        return s.filter(cond).select("doc_id", "method", _r("score", 4))
    return q


def q_infill_ratio(spark, sf_dir):
    pv = sc.position_values(cat.token_stats(spark, sf_dir), False)
    return pv.filter(F.col("T") >= 3).select(
        "doc_id", "pos", F.round("r0", 4).alias("ratio_l0"), F.round("r1", 4).alias("ratio_l1_500"))


def q_zlib_score(spark, sf_dir):
    s = cat.scores(spark, sf_dir).filter(F.col("method") == "zlib")
    d = cat.docs(spark, sf_dir).select("doc_id", "clen")
    bound = F.octet_length("text") + F.floor(F.octet_length("text") / 1000) + 64
    ok = F.col("clen").between(8, bound)
    t = table(spark, sf_dir, "documents").select("doc_id", "text")
    return s.join(by_shuffle(d), "doc_id").join(by_shuffle(t), "doc_id").select(
        "doc_id", F.round(F.col("score") * F.col("clen"), 4).alias("loss"), ok.alias("clen_in_bounds"))


def q_all_scores(spark, sf_dir):
    """All 122 scores; zlib times the compressed length, which SQL cannot know."""
    d = cat.docs(spark, sf_dir).select("doc_id", "clen")
    s = cat.scores(spark, sf_dir).join(by_shuffle(d, "shuffle_hash"), "doc_id")
    whole = F.when(F.col("method") == "zlib", F.col("score") * F.col("clen")).otherwise(F.col("score"))
    return s.select("doc_id", "method", F.round(whole, 4).alias("score"))


def q_scores_without_zlib(spark, sf_dir):
    return cat.scores(spark, sf_dir).filter(F.col("method") != "zlib").select(
        "doc_id", "method", _r("score", 4))


def q_roc_points(spark, sf_dir):
    p = roc.roc_points(cat.for_roc(cat.scores(spark, sf_dir)).filter(F.col("method") != "zlib"),
                       row_bound=cat.row_count(spark, sf_dir))
    return p.select("method", "threshold", _r("fpr", 9), _r("tpr", 9))


def q_method_metrics_no_zlib(spark, sf_dir):
    return method_metrics(spark, sf_dir).filter(F.col("method") != "zlib")


def q_top_methods(spark, sf_dir):
    return rep.top_methods(rep.result_table(cat.metrics(spark, sf_dir)), 5)


def q_raw_metrics(spark, sf_dir):
    raw = cat.for_roc(cat.raw_scores(spark, sf_dir)).filter(F.col("method") != "zlib")
    m = roc.evaluate_methods(raw, row_bound=cat.row_count(spark, sf_dir))
    return m.select("method", _r("auroc", 6), _r("fpr95", 6), _r("tpr05", 6))


def q_label_metrics(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    s = cat.for_roc(cat.scores(spark, sf_dir)).filter(F.col("method") != "zlib").drop("label").join(by_shuffle(lab, "shuffle_hash"), "doc_id")
    m = roc.evaluate_methods(s, label_col="quality", row_bound=cat.row_count(spark, sf_dir))
    return m.select("method", _r("auroc", 6), _r("fpr95", 6), _r("tpr05", 6))


def q_dataset_statistics(spark, sf_dir):
    s = prof.dataset_statistics(documents_snippets(spark, sf_dir))
    return s.select("total", "members", "non_members", _r("member_share", 9), _r("avg_words_first_100", 9))


def q_score_profile(spark, sf_dir):
    p = prof.score_profile(cat.raw_scores(spark, sf_dir).filter(F.col("method") != "zlib"))
    return p.select("method", "total", "finite", "inf", "nan", _r("min", 6), _r("max", 6), _r("mean", 6),
                    _r("std_pop", 6), _r("finite_share", 9), _r("inf_share", 9), _r("nan_share", 9))


def q_issue_report(spark, sf_dir):
    p = prof.score_profile(cat.raw_scores(spark, sf_dir).filter(F.col("method") != "zlib"))
    return prof.issue_report(p, roc.method_order(spark))


def q_benchmark_contamination(spark, sf_dir):
    s = cat.benchmark_scores(spark, sf_dir).filter(F.col("method") != "zlib")
    return s.select(F.col("doc_id").alias("item_id"), "method", _r("score", 4))


def _general(spark, sf_dir, clip):
    ts = cat.token_stats(spark, sf_dir)
    tok, alt = mp.ngram_as_model_stats(ts)
    return tok, alt


def q_score_parity(clip: bool):
    def q(spark, sf_dir):
        tok, alt = _general(spark, sf_dir, clip)
        general = infill_ratios(tok, alt, clip)
        special = mp.ngram_ratios_long(sc.position_values(cat.token_stats(spark, sf_dir), clip))
        return parity(special, general)
    return q


def q_general_path_scores(spark, sf_dir):
    tok, alt = _general(spark, sf_dir, False)
    d = cat.docs(spark, sf_dir).select("doc_id", "T")
    raw = mp.scores_from_stats(tok, alt, d, False)
    return sc.sanitize_scores(raw).select("doc_id", "method", _r("score", 4))


def _lm_stats(spark, sf_dir):
    def build():
        d = cat.docs(spark, sf_dir)
        tok, alt = lm.lm_score_batches(d, lambda: ToyModel(7), vocab=7, memory=ToyModel.memory)
        st = cat.store(spark)
        return (st.put(f"{cat.tag(spark, sf_dir)}/lm_token_stats", tok),
                st.put(f"{cat.tag(spark, sf_dir)}/lm_alt_stats", alt))
    return cat._memo(spark, ("lm_stats", sf_dir), build)


def q_lm_token_stats(spark, sf_dir):
    tok, _ = _lm_stats(spark, sf_dir)
    return tok.select("doc_id", "pos", _r("lp", 6), _r("mu", 6), _r("var", 6), _r("lp_xhat", 6), "T")


def q_lm_scores(spark, sf_dir):
    tok, alt = _lm_stats(spark, sf_dir)
    d = cat.docs(spark, sf_dir).select("doc_id", "T")
    return sc.sanitize_scores(mp.scores_from_stats(tok, alt, d, False)).select(
        "doc_id", "method", _r("score", 4))


def q_default_scores(spark, sf_dir):
    """Documents without a text have 0.0 under every name."""
    return cat.masked_scores(spark, sf_dir).filter(F.col("method") != "zlib").select("doc_id", "method", _r("score", 4))


def _squash(c):
    """Into (-1, 1), so that huge scores compare by relative size."""
    return F.round(c / (F.abs(c) + 1.0), 6)


def q_scaled(clip: bool):
    def q(spark, sf_dir):
        s = cat.scaled_scores(spark, sf_dir, clip).filter(~F.col("method").isin("zlib", "loss"))
        return s.select("doc_id", "method", _squash(F.col("score")).alias("score"))
    return q


def q_scaled_metrics(spark, sf_dir):
    """Clipped metrics on scores that reach the bounds (three decimals apart from ties)."""
    s = cat.scaled_scores(spark, sf_dir, True).filter(F.col("method").startswith("mink"))
    m = roc.evaluate_methods(s.withColumn("score", F.round("score", 3)))
    return m.select("method", _r("auroc", 6), _r("fpr95", 6), _r("tpr05", 6))


def q_guarded_metrics(spark, sf_dir):
    """Metrics of guarded inputs: one class, one finite score, none, and a sound one."""
    lp = cat.scores(spark, sf_dir).filter(F.col("method") == "loss").select("doc_id", "label", F.round("score", 6).alias("score"))
    nan = F.lit(float("nan"))
    rows = [lp.filter("label = 1").withColumn("method", F.lit("one_class")),
            lp.withColumn("method", F.lit("one_finite")).withColumn(
                "score", F.when(F.col("doc_id") == 3, F.col("score")).when(F.col("doc_id") % 3 == 0, F.lit(float("inf")))
                .otherwise(nan)),
            lp.withColumn("method", F.lit("none_finite")).withColumn("score", nan),
            lp.withColumn("method", F.lit("sound"))]
    s = rows[0]
    for x in rows[1:]:
        s = s.unionByName(x)
    names = spark.createDataFrame([(n, i) for i, n in enumerate(GUARDED)], "method string, method_order int")
    m = roc.all_methods(spark, roc.evaluate_methods(s), names)
    return m.select("method", _r("auroc", 6), _r("fpr95", 6), _r("tpr05", 6))


GUARDED = ["one_class", "one_finite", "none_finite", "sound"]


def q_lm_lookahead(spark, sf_dir):
    """Benchmark passages under a model whose look-aheads all differ, each
    document in one pass of the model hook."""
    cat.store(spark)
    from memscan.operators.tokens import doc_tokens
    d = doc_tokens(benchmark_snippets(spark, sf_dir), with_clen=False)
    d = d.select("doc_id", lm.token_ids("toks", 7).alias("ids"))
    stats = lm.lm_document_stats(d, lambda: lm.from_log_probs(DecayModel(7)), memory=DecayModel.memory)
    stats = cat.store(spark).put(f"{cat.tag(spark, sf_dir)}/lm_lookahead", stats)
    s = sc.sanitize_scores(mp.scores_from_documents(stats))
    return s.select(F.col("doc_id").alias("item_id"), "method", _r("score", 4))


def q_lm_unbounded(spark, sf_dir):
    """All documents under a model that remembers every token: each alternative
    goes on from the state before its replaced token."""
    d = cat.docs(spark, sf_dir).select("doc_id", lm.token_ids("toks", 4).alias("ids"))
    stats = lm.lm_document_stats(d, MeanModel, batch_size=64)
    stats = cat.store(spark).put(f"{cat.tag(spark, sf_dir)}/lm_unbounded", stats)
    return sc.sanitize_scores(mp.scores_from_documents(stats)).select("doc_id", "method", _r("score", 4))


def q_lm_padding(spark, sf_dir):
    """The batches of the forward pass over all documents: what is padded."""
    cat.store(spark)
    p = lm.padding(lm.lm_forward(cat.docs(spark, sf_dir), lambda: ToyModel(7), vocab=7, batch_size=16))
    return p.select("n_docs", "n_tokens", (F.col("padding_share") < 0.1).alias("padding_in_bounds"))


def q_stream_score(spark, sf_dir):
    """Documents streamed through a file source, scored per micro-batch."""
    import uuid

    from memscan.streaming import start_stream_score
    sink = f"{cat.store(spark).base}/stream/{uuid.uuid4().hex}"
    # the table is a file of its folder, or a folder of files with any names
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source, glob = (path.toString(), None) if folder else (sf_dir, "documents.parquet")
    q = start_stream_score(spark, source, cat.model(spark, sf_dir), sink, file_glob=glob,
                           select_expr=["CAST(doc_id AS BIGINT) AS doc_id", "text",
                                        "CAST(pmod(doc_id, 2) = 0 AS INT) AS label"])
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.filter(F.col("method") != "zlib").select("doc_id", "method", _r("score", 4))


def q_load_snippets(spark, sf_dir):
    """All documents through the named variants: short, middle and long texts
    in the plain source, with other vowels in the paraphrased one."""
    import uuid

    from memscan.constants import VARIANTS
    from memscan.sources import load_snippets
    base = f"{cat.store(spark).base}/snippets/{uuid.uuid4().hex}"
    n = F.length("text")
    size = F.when(n < 500, 32).when(n < 2000, 64).otherwise(128)
    raw = documents_snippets(spark, sf_dir).filter(F.col("text").isNotNull()).select(
        "doc_id", F.col("text").alias("input"), "label", size.alias("size"))
    out = None
    for v in VARIANTS:
        other = "paraphrased" in v
        part = raw.filter(F.col("size") == int(v.split("length")[1].split("_")[0])).drop("size")
        part = part.withColumn("input", F.translate("input", "e", "a")) if other else part
        part.write.parquet(f"{base}/{'other' if other else 'plain'}/{v}")
        got = load_snippets(spark, v, f"{base}/plain", f"{base}/other")
        out = got if out is None else out.unionByName(got)
    return out.select("variant", "doc_id", "label", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_results_csv(spark, sf_dir):
    """The result table through the sink: CSV (header, no index) read back."""
    from memscan.sources import write_results
    out = f"{cat.store(spark).base}/results/{cat.tag(spark, sf_dir)}"
    path = write_results(rep.result_table(cat.metrics(spark, sf_dir)), out, "org/ngram-bigram",
                         "documents", clip_inf=False)
    csv = spark.read.option("header", True).csv(path)
    return csv.filter(F.col("method") != "zlib").select("method", "auroc", "fpr95", "tpr05")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm = _llm()
    return _own_queries() | (llm.queries() if llm else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "clean_text": q_clean_text,
        "token_counts": q_token_counts,
        "vocabulary": q_vocabulary,
        "bigram_counts": q_bigram_counts,
        "bigram_model": q_bigram_model,
        "context_moments": q_context_moments,
        "merged_model": q_merged_model,
        "count_versions": q_count_versions,
        "token_stats": q_token_stats,
        "loss_score": _family("loss", exact=True),
        "mink": _family("mink_"),
        "mink_plus_plus": _family("mink++_"),
        "mink_plus_plus_clipped": _family("mink++_", clip=True),
        "infill_ratio": q_infill_ratio,
        "infill_score": _family("infill_"),
        "infill_score_clipped": _family("infill_", clip=True),
        "zlib_score": q_zlib_score,
        "all_scores": q_all_scores,
        "scores_without_zlib": q_scores_without_zlib,
        "roc_points": q_roc_points,
        "method_metrics": q_method_metrics_no_zlib,
        "top_methods": q_top_methods,
        "raw_metrics": q_raw_metrics,
        "label_metrics": q_label_metrics,
        "dataset_statistics": q_dataset_statistics,
        "score_profile": q_score_profile,
        "issue_report": q_issue_report,
        "benchmark_contamination": q_benchmark_contamination,
        "score_parity": q_score_parity(False),
        "score_parity_clipped": q_score_parity(True),
        "general_path_scores": q_general_path_scores,
        "lm_token_stats": q_lm_token_stats,
        "lm_scores": q_lm_scores,
        "default_scores": q_default_scores,
        "scaled_scores": q_scaled(False),
        "scaled_scores_clipped": q_scaled(True),
        "scaled_metrics_clipped": q_scaled_metrics,
        "guarded_metrics": q_guarded_metrics,
        "lm_lookahead": q_lm_lookahead,
        "lm_unbounded": q_lm_unbounded,
        "lm_padding": q_lm_padding,
        "load_snippets": q_load_snippets,
        "peaked_contexts": q_peaked_contexts,
        "trigram_counts": q_trigram_counts,
        "trigram_moments": q_trigram_moments,
        "trigram_log_probs": q_trigram_log_probs,
        "stream_score": q_stream_score,
        "results_csv": q_results_csv,
    }


# ---------------------------------------------------------------- oracle
def _scores_sel(where: str, clip: bool = False) -> str:
    return sql.chain(clip) + f"\nSELECT doc_id, method, round(score, 4) AS score FROM scores WHERE {where}"


def _metrics_sql(scores_src: str, label: str = "label", clip: bool = False) -> str:
    return sql.chain(clip) + "," + sql.metrics_cte(scores_src, label)


def oracle_sql() -> dict[str, str]:
    llm = _llm()
    return _own_oracle_sql() | (llm.oracle_sql() if llm else {})


def _own_oracle_sql() -> dict[str, str]:
    ws = ("'[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
          "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'")
    clean = "trim(regexp_replace(regexp_replace(text, '[^().,a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))"
    out = {
        "clean_text": f"""SELECT doc_id, {clean} AS clean,
            CAST(len(list_filter(string_split({clean}, ' '), lambda x: x <> '')) AS INTEGER) AS n_clean_words,
            CAST(len(list_filter(regexp_split_to_array(text, {ws}), lambda x: x <> '')) AS INTEGER) AS n_words
            FROM documents""",
        "token_counts": sql.chain(upto="docs") +
            "\nSELECT tok, count(*) AS cnt FROM (SELECT unnest(toks) AS tok FROM docs) GROUP BY tok",
        "vocabulary": sql.chain(upto="model") + "\nSELECT tok, cnt, round(q, 12) AS q FROM uni2",
        "bigram_counts": sql.chain(upto="model") + "\nSELECT ctx, tok, cnt FROM b0",
        "bigram_model": sql.chain(upto="model") +
            "\nSELECT ctx, tok, cnt, round(lam, 12) AS lam, round(p, 12) AS p FROM big2",
        "merged_model": sql.chain(upto="model") +
            "\nSELECT ctx, tok, cnt, round(lam, 12) AS lam, round(p, 12) AS p, round(mu, 5) AS mu, xhat"
            " FROM big2 JOIN (SELECT ctx, mu, xhat FROM ctxs) USING (ctx)",
        "count_versions": sql.chain(upto="docs") + """,
            v AS (SELECT unnest([1, 2, 3, 4]) AS version),
            m AS (SELECT version, doc_id, toks, T FROM docs, v
                  WHERE version = 2 OR (version = 1 AND label = 0) OR (version >= 3 AND label = 1)),
            n AS (SELECT version, count(*) AS n_docs, CAST(sum(T) AS BIGINT) AS n_tokens FROM m GROUP BY version),
            p AS (SELECT DISTINCT version, toks[i] AS a, toks[i + 1] AS b
                  FROM (SELECT version, toks, unnest(range(1, T)) AS i FROM m))
            SELECT CAST(n.version AS BIGINT) AS version, n_docs, n_tokens, count(*) AS n_pairs
            FROM n JOIN p ON n.version = p.version GROUP BY ALL""",
        "context_moments": sql.chain(upto="model") +
            "\nSELECT ctx, n_c, d_c, round(lam, 12) AS lam, round(mu, 5) AS mu, round(var, 5) AS var, xhat,"
            " round(p_xhat, 12) AS p_xhat FROM ctxs",
        "token_stats": sql.chain(upto="stats") +
            "\nSELECT doc_id, i AS pos, x1 AS tok, x2 AS next_tok, round(lp, 5) AS lp, round(mu, 5) AS mu,"
            " round(var, 5) AS var, xhat, round(lp_xhat, 5) AS lp_xhat, round(lp_alt, 5) AS lp_alt,"
            " round(mu_alt, 5) AS mu_alt, round(var_alt, 5) AS var_alt FROM ts",
        "loss_score": _scores_sel("method = 'loss'"),
        "mink": _scores_sel("starts_with(method, 'mink_')"),
        "mink_plus_plus": _scores_sel("starts_with(method, 'mink++_')"),
        "mink_plus_plus_clipped": _scores_sel("starts_with(method, 'mink++_')", clip=True),
        "infill_ratio": sql.chain() +
            "\nSELECT doc_id, i AS pos, round(r0, 4) AS ratio_l0, round(r1, 4) AS ratio_l1_500 FROM pv WHERE T >= 3",
        "infill_score": _scores_sel("starts_with(method, 'infill_')"),
        "infill_score_clipped": _scores_sel("starts_with(method, 'infill_')", clip=True),
        "scores_without_zlib": _scores_sel("method <> 'zlib'"),
        "roc_points": _metrics_sql("scores") +
            "\nSELECT method, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM tot"
            " WHERE P > 0 AND N > 0"
            "\nUNION ALL SELECT method, s AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM pts"
            " WHERE kept AND P > 0 AND N > 0",
        "method_metrics": _metrics_sql("scores") +
            "\nSELECT method, method_order, round(auroc, 6) AS auroc, round(fpr95, 6) AS fpr95,"
            " round(tpr05, 6) AS tpr05, printf('%.1f%%', auroc * 100) AS auroc_pct,"
            " printf('%.1f%%', fpr95 * 100) AS fpr95_pct, printf('%.1f%%', tpr05 * 100) AS tpr05_pct"
            " FROM metrics WHERE method <> 'zlib'",
        "dataset_statistics": f"""WITH h AS (SELECT text FROM documents ORDER BY doc_id LIMIT 100)
            SELECT CAST(count(*) AS BIGINT) AS total,
                   CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS members,
                   CAST(count(*) - sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_members,
                   round(CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS member_share,
                   round((SELECT avg(len(list_filter(regexp_split_to_array(text, {ws}), lambda x: x <> ''))) FROM h), 9)
                     AS avg_words_first_100
            FROM documents HAVING count(*) > 0""",
        "score_profile": sql.chain() + """
            SELECT method, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN isfinite(score) THEN 1 ELSE 0 END) AS BIGINT) AS finite,
                   CAST(sum(CASE WHEN isinf(score) THEN 1 ELSE 0 END) AS BIGINT) AS inf,
                   CAST(sum(CASE WHEN isnan(score) THEN 1 ELSE 0 END) AS BIGINT) AS nan,
                   round(min(CASE WHEN isfinite(score) THEN score END), 6) AS min,
                   round(max(CASE WHEN isfinite(score) THEN score END), 6) AS max,
                   round(avg(CASE WHEN isfinite(score) THEN score END), 6) AS mean,
                   round(stddev_pop(CASE WHEN isfinite(score) THEN score END), 6) AS std_pop,
                   round(CAST(sum(CASE WHEN isfinite(score) THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS finite_share,
                   round(CAST(sum(CASE WHEN isinf(score) THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS inf_share,
                   round(CAST(sum(CASE WHEN isnan(score) THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS nan_share
            FROM raw GROUP BY method""",
        "benchmark_contamination": sql.chain(source="benchmark") +
            "\nSELECT doc_id AS item_id, method, round(score, 4) AS score FROM scores WHERE method <> 'zlib'",
    }
    # raw_metrics: metrics on the unsanitised scores (NaN/inf filtered first)
    out["raw_metrics"] = (sql.chain() + ",\nrawnz AS (SELECT * FROM raw WHERE method <> 'zlib')," +
                          sql.metrics_cte("rawnz") +
                          "\nSELECT method, round(auroc, 6) AS auroc, round(fpr95, 6) AS fpr95,"
                          " round(tpr05, 6) AS tpr05 FROM m1")
    out["label_metrics"] = (sql.chain() + ",\nlscores AS (SELECT s.doc_id, s.method, s.score,"
                            " CAST(l.quality AS INTEGER) AS quality FROM scores s JOIN labels l"
                            " ON s.doc_id = l.doc_id WHERE s.method <> 'zlib')," +
                            sql.metrics_cte("lscores", "quality") +
                            "\nSELECT method, round(auroc, 6) AS auroc, round(fpr95, 6) AS fpr95,"
                            " round(tpr05, 6) AS tpr05 FROM m1")
    parity_sql = (sql.chain(upto="docs") + ",\n" + sql.ratios_cte().strip() +
                  "\nSELECT CAST(la_all.L AS INTEGER) AS L, CAST(sum(T - 1) AS BIGINT) AS n_compared,"
                  " CAST(sum(T - 1) AS BIGINT) AS n_close, true AS all_close FROM docs, la_all"
                  " WHERE T >= 3 GROUP BY la_all.L")
    out["score_parity"] = parity_sql
    out["score_parity_clipped"] = parity_sql
    out["zlib_score"] = (sql.chain() + "\nSELECT doc_id, round(score, 4) AS loss, true AS clen_in_bounds"
                         " FROM scores WHERE method = 'loss'")
    out["all_scores"] = (sql.chain() + "\nSELECT doc_id, method, round(score, 4) AS score FROM scores WHERE method <> 'zlib'"
                         " UNION ALL SELECT doc_id, 'zlib', round(score, 4) FROM scores WHERE method = 'loss'")
    out["default_scores"] = (sql.chain(source="masked") +
                             "\nSELECT doc_id, method, round(score, 4) AS score FROM scores WHERE method <> 'zlib'")
    squash = "\nSELECT doc_id, method, round(score / (abs(score) + 1.0), 6) AS score FROM scores WHERE method NOT IN ('zlib', 'loss')"
    out["scaled_scores"] = sql.chain(scaled=True) + squash
    out["scaled_scores_clipped"] = sql.chain(clip=True, scaled=True) + squash
    out["scaled_metrics_clipped"] = (
        sql.chain(clip=True, scaled=True) + ",\nsm AS (SELECT doc_id, method, round(score, 3) AS score, label FROM scores"
        " WHERE starts_with(method, 'mink'))," + sql.metrics_cte("sm") +
        "\nSELECT method, round(auroc, 6) AS auroc, round(fpr95, 6) AS fpr95, round(tpr05, 6) AS tpr05 FROM m1")
    guarded = ", ".join(f"('{n}')" for n in GUARDED)
    out["guarded_metrics"] = (
        sql.chain() + ",\nlo AS (SELECT doc_id, label, round(score, 6) AS score FROM scores WHERE method = 'loss'),"
        "\ngd AS (SELECT doc_id, label, 'one_class' AS method, score FROM lo WHERE label = 1"
        " UNION ALL SELECT doc_id, label, 'one_finite', CASE WHEN doc_id = 3 THEN score WHEN doc_id % 3 = 0"
        " THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END FROM lo"
        " UNION ALL SELECT doc_id, label, 'none_finite', 'nan'::DOUBLE FROM lo"
        " UNION ALL SELECT doc_id, label, 'sound', score FROM lo)," + sql.metrics_cte("gd") +
        f"\nSELECT g.method, round(coalesce(auroc, 0.0), 6) AS auroc, round(coalesce(fpr95, 1.0), 6) AS fpr95,"
        f" round(coalesce(tpr05, 0.0), 6) AS tpr05 FROM (VALUES {guarded}) g(method) LEFT JOIN m1 ON m1.method = g.method")
    out["general_path_scores"] = _scores_sel("method <> 'zlib'")
    out["stream_score"] = _scores_sel("method <> 'zlib'")
    out["results_csv"] = (sql.chain() + "," + sql.metrics_cte("scores") +
                          "\nSELECT method, printf('%.1f%%', auroc * 100) AS auroc,"
                          " printf('%.1f%%', fpr95 * 100) AS fpr95, printf('%.1f%%', tpr05 * 100) AS tpr05"
                          " FROM metrics WHERE method <> 'zlib'")
    toy = ToyModel(7)
    out["lm_scores"] = sql.lm_scores_sql(toy.A.tolist(), toy.B.tolist())
    out["lm_token_stats"] = (sql.chain(upto="docs") + "," + sql.lm_toy_cte(toy.A.tolist(), toy.B.tolist()) +
                             "\nSELECT doc_id, i AS pos, round(lp, 6) AS lp, round(mu, 6) AS mu,"
                             " round(var, 6) AS var, round(lp_xhat, 6) AS lp_xhat, T FROM lts")
    decay = DecayModel(7)
    out["lm_lookahead"] = sql.lm_decay_scores_sql(decay.A.tolist(), decay.e.tolist(), decay.w.tolist(), decay.fade, decay.trace)
    mean = MeanModel()
    out["lm_unbounded"] = sql.lm_mean_scores_sql(mean.A.tolist(), mean.e.tolist(), mean.w.tolist())
    out["lm_padding"] = (sql.chain(upto="docs") + "\nSELECT count(*)::BIGINT AS n_docs, sum(T)::BIGINT AS n_tokens,"
                         " true AS padding_in_bounds FROM docs")
    out["load_snippets"] = """SELECT 'WikiMIA_length' || CASE WHEN length(text) < 500 THEN 32 WHEN length(text) < 2000 THEN 64
            ELSE 128 END || suffix AS variant, doc_id, CAST(doc_id % 2 = 0 AS INTEGER) AS label,
            md5(CASE WHEN suffix = '' THEN text ELSE translate(text, 'e', 'a') END) AS text_md5
        FROM documents, (VALUES (''), ('_paraphrased')) s(suffix) WHERE text IS NOT NULL"""
    out["peaked_contexts"] = sql.peaked_contexts_sql()
    out["trigram_counts"] = (sql.chain(upto="model") + "," + sql.trigram_cte() + "\nSELECT ctx, tok, cnt, round(p, 12) AS p FROM tri")
    out["trigram_moments"] = sql.trigram_moments_sql()
    out["trigram_log_probs"] = sql.trigram_log_probs_sql()
    out["top_methods"] = (sql.chain() + "," + sql.metrics_cte("scores") + """,
        fm AS (SELECT method, method_order, printf('%.1f%%', auroc * 100) AS auroc,
                      printf('%.1f%%', fpr95 * 100) AS fpr95, printf('%.1f%%', tpr05 * 100) AS tpr05 FROM metrics)
        SELECT method, auroc, fpr95, tpr05, method_order FROM fm
        ORDER BY CAST(replace(auroc, '%', '') AS DOUBLE) DESC, method_order LIMIT 5""")
    out["issue_report"] = (sql.chain() + "," + sql.method_order_cte() + """,
        prof AS (SELECT method, CAST(count(*) AS BIGINT) AS total,
                        CAST(sum(CASE WHEN isfinite(score) THEN 1 ELSE 0 END) AS BIGINT) AS finite,
                        CAST(sum(CASE WHEN isinf(score) THEN 1 ELSE 0 END) AS BIGINT) AS inf,
                        CAST(sum(CASE WHEN isnan(score) THEN 1 ELSE 0 END) AS BIGINT) AS nan
                 FROM raw WHERE method <> 'zlib' GROUP BY method),
        bad AS (SELECT p.*, mo.method_order, row_number() OVER (ORDER BY mo.method_order) AS rk,
                       count(*) OVER () AS n_issues FROM prof p JOIN mo ON p.method = mo.method
                WHERE p.finite < p.total)
        SELECT method, CAST(method_order AS INTEGER) AS method_order, total, finite, inf, nan,
               CAST(greatest(n_issues - 5, 0) AS BIGINT) AS more FROM bad WHERE rk <= 5""")
    return out

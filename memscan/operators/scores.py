"""Per-document scores: loss, zlib, min-k, min-k++ and look-ahead (infill).

All 122 scores of a document come out of one plan:

  token_stats --(projection; next position by lookup, or a lead window
                 when the bigram table is not broadcast)--> per-position values
              --(one array per kind and document; sorted and summed in
                 Arrow batches)--> ten means each --> 122 scores, unpacked

The arrays are gathered over the hash partitioning by doc_id of the positions
(no shuffle, and no sort of rows).  Order statistics have three forms, chosen by
the size of a group alone and equal in result: arrays up to ARRAY_ROWS values;
a window sorted by value up to SPLIT_ROWS; beyond that, ranges of values,
equal ones collapsed, so that no task holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..constants import (LOOK_AHEADS, MIN_LOG_PROB, MIN_SD, MIN_VARIANCE, RATIO_CLIP,
                         RATIOS, Z_CLIP, method_names, ratio_name)
from ..functions.numeric import (clamp, clamp_min, dlit, finite_or, is_finite, k_of,
                                 nan_to_num, safe_div, safe_sqrt)
from ..session import checkpoint_root

NAN = float("nan")


def sd_floor(var: Column) -> Column:
    """Infill path: std = max(sqrt(nan_to_num(var)), 1e-6); sqrt(<0) stays NaN."""
    return clamp_min(safe_sqrt(nan_to_num(var)), MIN_SD)


def zscore_token(lp: Column, mu: Column, var: Column, clip_inf: bool) -> Column:
    """Min-k++ per-token score (lp - mu) / sqrt(var), with the clip options."""
    if clip_inf:
        lp, mu, var = clamp_min(lp, MIN_LOG_PROB), clamp_min(mu, MIN_LOG_PROB), clamp_min(var, MIN_VARIANCE)
    z = safe_div(lp - mu, safe_sqrt(var))
    return clamp(z, *Z_CLIP) if clip_inf else z


def _z_infill(lp: Column, mu: Column, sd: Column, clip_inf: bool) -> Column:
    if clip_inf:
        return clamp((clamp_min(lp, MIN_LOG_PROB) - clamp_min(mu, MIN_LOG_PROB)) / sd, *Z_CLIP)
    return (lp - mu) / sd


def infill_terms(df: DataFrame, clip_inf: bool, has_future: Column) -> DataFrame:
    """Look-ahead ratios r0 (L = 0) and r1 (L >= 1) at every position.

    base  = z_i(x[i+1]) - z_i(xhat)         (causal: alternative stats at i are the original's)
    term  = z_{i+1}(x[i+2]) - z'_{i+1}(x[i+2])   only while i+1 <= T-3
    clip off: a non-finite term is skipped; clip on: lp, mu >= -100, each z in
    [-50, 50], the ratio in [-200, 200], and NaN flows through.

    Every intermediate is its own column, so each NaN-aware clamp evaluates
    its input once and the projection stays small enough for codegen.
    """
    c = F.col
    df = df.withColumns({"_sd": sd_floor(c("var")), "_sd_next": sd_floor(c("var_next")),
                         "_sd_alt": sd_floor(c("var_alt"))})
    if clip_inf:
        # clamp each input once, as its own column, then z, then clamp z:
        # no clamp is ever expanded inside another (keeps codegen small)
        lo = MIN_LOG_PROB
        df = df.withColumns({"_lp": clamp_min(c("lp"), lo), "_mu": clamp_min(c("mu"), lo),
                             "_lpx": clamp_min(c("lp_xhat"), lo), "_lpn": clamp_min(c("lp_next"), lo),
                             "_mun": clamp_min(c("mu_next"), lo), "_lpa": clamp_min(c("lp_alt"), lo),
                             "_mua": clamp_min(c("mu_alt"), lo)})
        df = df.withColumns({"_zo0": (c("_lp") - c("_mu")) / c("_sd"), "_zx0": (c("_lpx") - c("_mu")) / c("_sd"),
                             "_za0": (c("_lpn") - c("_mun")) / c("_sd_next"),
                             "_zb0": (c("_lpa") - c("_mua")) / c("_sd_alt")})
        df = df.withColumns({"_zo": clamp(c("_zo0"), *Z_CLIP), "_zx": clamp(c("_zx0"), *Z_CLIP),
                             "_za": clamp(c("_za0"), *Z_CLIP), "_zb": clamp(c("_zb0"), *Z_CLIP)})
        df = df.withColumns({"_base": c("_zo") - c("_zx"),
                             "_term": F.when(has_future, c("_za") - c("_zb")).otherwise(dlit(0.0))})
        df = df.withColumn("_r1", c("_base") + c("_term"))
        df = df.withColumns({"r0": clamp(c("_base"), *RATIO_CLIP), "r1": clamp(c("_r1"), *RATIO_CLIP)})
        tmp = ["_lp", "_mu", "_lpx", "_lpn", "_mun", "_lpa", "_mua", "_zo0", "_zx0", "_za0", "_zb0", "_r1"]
    else:
        df = df.withColumns({
            "_zo": _z_infill(c("lp"), c("mu"), c("_sd"), False),
            "_zx": _z_infill(c("lp_xhat"), c("mu"), c("_sd"), False),
            "_za": _z_infill(c("lp_next"), c("mu_next"), c("_sd_next"), False),
            "_zb": _z_infill(c("lp_alt"), c("mu_alt"), c("_sd_alt"), False)})
        ok = has_future & is_finite(c("_za")) & is_finite(c("_zb"))
        df = df.withColumns({"_base": c("_zo") - c("_zx"),
                             "_term": F.when(ok, c("_za") - c("_zb")).otherwise(dlit(0.0))})
        df = df.withColumns({"r0": c("_base"), "r1": c("_base") + c("_term")})
        tmp = []
    return df.drop("_sd", "_sd_next", "_sd_alt", "_zo", "_zx", "_za", "_zb", "_base", "_term", *tmp)


def position_values(ts: DataFrame, clip_inf: bool = False) -> DataFrame:
    """Add lp_m (min-k), z (min-k++) and r0 / r1 (infill ratios).  When
    token_stats carries the next position's statistics this is a plain
    projection; otherwise they come from a lead over the document's
    positions (T is constant per document: partitioning by (doc_id, T) groups
    as by doc_id and lets filters on T reach the document scan)."""
    v = ts
    if "lp_next" not in ts.columns:
        keyed = "doc_key" in ts.columns      # rows of equal documents share a position: the next one, not the next row
        w = Window.partitionBy("doc_id", "T", *(["doc_key"] if keyed else [])).orderBy("pos")
        w, following = (w.rangeBetween(1, 1), F.first) if keyed else (w, F.lead)
        v = v.withColumns({f"{k}_next": following(k).over(w) for k in ("lp", "mu", "var")}).drop("doc_key")
    if clip_inf:
        v = v.withColumns({"lp_m": clamp_min(F.col("lp"), MIN_LOG_PROB),
                           "_mu_c": clamp_min(F.col("mu"), MIN_LOG_PROB),
                           "_var_c": clamp_min(F.col("var"), MIN_VARIANCE)})
        v = v.withColumn("_zraw", safe_div(F.col("lp_m") - F.col("_mu_c"), safe_sqrt(F.col("_var_c"))))
        v = v.withColumn("z", clamp(F.col("_zraw"), *Z_CLIP)).drop("_mu_c", "_var_c", "_zraw")
    else:
        v = v.withColumns({"lp_m": F.col("lp"), "_sqv": safe_sqrt(F.col("var"))})
        v = v.withColumn("z", safe_div(F.col("lp") - F.col("mu"), F.col("_sqv"))).drop("_sqv")
    return infill_terms(v, clip_inf, F.col("pos") <= F.col("T") - 4)


def _ratio_array() -> Column:
    return F.array(*[dlit(r) for r in RATIOS])


def _names(prefix: str) -> Column:
    return F.array(*[F.lit(f"{prefix}{ratio_name(r)}") for r in RATIOS])


ARRAY_ROWS = 32_768        # values of a group held as one array
SPLIT_ROWS = 4_000_000     # values of a range of a group


@F.arrow_udf(ArrayType(DoubleType()))
def k_means(values: pa.Array) -> pa.Array:
    """Of each array: ten means of its k = int(n * r) smallest values, NULL
    where k = 0.  One sort and one running sum for each array, in Arrow
    batches (an array function in SQL would box each value ten times)."""
    means, none = means_of_smallest(values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy()))
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(RATIOS))
    return pa.ListArray.from_arrays(offsets, pa.array(means.ravel(), mask=none.ravel()))


def means_of_smallest(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[groups, ratios] of groups of ``sizes`` values each, and where k = 0."""
    ks = np.floor(sizes[:, None] * np.asarray(RATIOS)).astype(np.int64)
    means = np.zeros(ks.shape)
    ends = np.cumsum(sizes)
    with np.errstate(all="ignore"):
        for row, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            if size:
                sums = np.cumsum(np.sort(flat[end - size:end]))
                means[row] = sums[ks[row] - 1] / ks[row]
    return means, ks == 0


def _kmean_arrays(values: DataFrame, n_col: str) -> DataFrame:
    rest = [c for c in values.columns if c not in ("v", "raw")]
    totals = [F.sum("raw").alias("tot")] if "raw" in values.columns else []
    g = values.groupBy(*rest).agg(k_means(F.collect_list("v")).alias("km"), *totals)
    g = g.select(*rest, *(["tot"] if totals else []), F.posexplode("km").alias("r_ix", "kmean"))
    return (g.filter(F.col("kmean").isNotNull())
            .withColumn("rn", k_of(F.col(n_col), F.get(_ratio_array(), F.col("r_ix")))))


def _hits(df: DataFrame, n_col: str) -> DataFrame:
    """Keep the rows whose rank equals some k = int(n * r); one row per hit."""
    n, rn = F.col(n_col), F.col("rn")
    ks = [k_of(n, dlit(r)) for r in RATIOS]
    hit_any = ks[0] == rn
    for k in ks[1:]:
        hit_any = hit_any | (k == rn)
    hits = F.array_compact(F.array(*[F.when(k == rn, F.lit(j)) for j, k in enumerate(ks)]))
    return (df.filter(hit_any)                  # about ten rows per group survive
            .withColumn("r_ix", F.explode(hits))
            .withColumn("kmean", F.col("cs") / F.col("rn").cast("double")))


def _kmean_window(values: DataFrame, key: list[str], n_col: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("v")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"rn": F.row_number().over(order), "cs": F.sum("v").over(w)}
    if "raw" in values.columns:     # whole-group total of raw, same window operator
        cols["tot"] = F.sum("raw").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _hits(values.withColumns(cols), n_col)


def _kmean_ranges(values: DataFrame, key: list[str], n_col: str, ranges: int) -> DataFrame:
    """The same ranks and running sums for very large groups without putting
    a group into one task: equal values collapse to (value, count) first, each
    group's value axis is cut into ranges at approximate quantiles
    (checkpointed so a retry sees the same cuts), each range computes local
    running sums, and offsets come from a window over the (group, range)
    summary.  A single value can hold most of a group: it is one row."""
    spark = values.sparkSession
    has_raw = "raw" in values.columns
    cols = [c for c in values.columns if c != "raw"]
    g = values.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"), *([F.sum("raw").alias("raw")] if has_raw else []))
    probs = F.array(*[dlit(j / ranges) for j in range(1, ranges)])
    cuts = g.filter(~F.isnan("v")).groupBy(*key).agg(F.percentile_approx("v", probs, 10000).alias("cuts"))
    checkpoint_root(spark)
    cuts = cuts.checkpoint(eager=True)
    g = (g.join(cuts, key, "left")
         .withColumn("rng", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("v"))), F.lit(0))).drop("cuts"))
    times = F.col("v") * F.col("c")
    summ = g.groupBy(*key, "rng").agg(F.sum("c").alias("r_cnt"), F.sum(times).alias("r_sum"),
                                      *([F.sum("raw").alias("r_raw")] if has_raw else []))
    before = Window.partitionBy(*key).orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum("r_raw").over(Window.partitionBy(*key)).alias("tot")] if has_raw else []
    summ = summ.select(*key, "rng", F.coalesce(F.sum("r_cnt").over(before), F.lit(0)).alias("off_cnt"),
                       F.coalesce(F.sum("r_sum").over(before), dlit(0.0)).alias("off_sum"), *total)
    prev = Window.partitionBy(*key, "rng").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    s = (g.join(summ, [*key, "rng"])
         .withColumns({"b_cnt": F.col("off_cnt") + F.coalesce(F.sum("c").over(prev), F.lit(0)),
                       "b_sum": F.col("off_sum") + F.coalesce(F.sum(times).over(prev), dlit(0.0))}))
    # the ratios whose k falls among the equal values of this row
    k = [k_of(F.col(n_col), dlit(r)) for r in RATIOS]
    hits = F.array_compact(F.array(*[
        F.when((x > F.col("b_cnt")) & (x <= F.col("b_cnt") + F.col("c")),
               F.struct(F.lit(j).alias("j"), x.cast("long").alias("k"))) for j, x in enumerate(k)]))
    s = s.withColumn("hit", F.explode(hits))
    s = s.withColumns({"rn": F.col("hit.k"), "r_ix": F.col("hit.j")})
    s = s.withColumn("cs", F.col("b_sum") + F.col("v") * (F.col("rn") - F.col("b_cnt")))
    return s.withColumn("kmean", F.col("cs") / F.col("rn").cast("double")).drop(
        "hit", "b_cnt", "b_sum", "off_cnt", "off_sum", "rng", "c")


def smallest_k_mean(values: DataFrame, key: list[str], n_col: str = "n", split_rows: int | None = None,
                    biggest: int | None = None, array_rows: int | None = None) -> DataFrame:
    """Mean of the k = int(n * r) smallest values of each group, for all ten
    ratios from one sort: rows (key..., r_ix, kmean).  NaN sorts last and
    -inf first, as in an ascending array sort.  Groups with k = 0 for a ratio
    give no row for it (the caller decides the default).

    A group of at most ``array_rows`` values is one array; a larger one is
    sorted by rows, in ranges of about ``split_rows`` values.  ``biggest`` is
    the size of the largest group, known from the table the groups come from.
    ``n_col`` and columns beside ``v`` and ``raw`` must be constant within a
    group, so filters on them can be pushed down to where it is produced."""
    split_rows = SPLIT_ROWS if split_rows is None else split_rows
    array_rows = min(ARRAY_ROWS if array_rows is None else array_rows, split_rows)
    if biggest is None:
        biggest = values.agg(F.max(n_col)).first()[0]
    biggest = biggest or 0
    parts = []
    if array_rows:
        parts.append(_kmean_arrays(values.filter(F.col(n_col) <= array_rows) if biggest > array_rows else values, n_col))
    if biggest > array_rows:
        mid = values.filter((F.col(n_col) > array_rows) & (F.col(n_col) <= split_rows))
        parts.append(_kmean_window(mid, key, n_col))
    if biggest > split_rows:
        parts.append(_kmean_ranges(values.filter(F.col(n_col) > split_rows), key, n_col, -(-int(biggest) // split_rows)))
    if not parts:
        return _kmean_window(values, key, n_col)
    names = [c for c in values.columns if c not in ("v", "raw")] + ["r_ix", "rn", "kmean"]
    names += ["tot"] if "raw" in values.columns else []
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out


def largest_group(docs: DataFrame) -> int:
    """Scored positions of the longest document: a scan of one column."""
    return max(0, (docs.agg(F.max("T")).first()[0] or 0) - 1)


# value kinds, as small integer codes so the per-document sort compares
# numbers only: 0 = lp (min-k), 1 = z (min-k++), 2 = r0 (infill L=0), 3 = r1
K_LP, K_Z, K_R0, K_R1 = 0, 1, 2, 3


def raw_scores(pv: DataFrame, docs: DataFrame, extra: list[str] | None = None, split_rows: int | None = None,
               array_rows: int | None = None) -> DataFrame:
    """Unsanitised scores (doc_id, *extra, method, score) from position values.

    ``docs`` has one row per document (doc_id, T, clen, *extra) and supplies
    the scores of empty selections (k = 0, or T < 2)."""
    extra = extra or []
    split_rows = SPLIT_ROWS if split_rows is None else split_rows
    array_rows = min(ARRAY_ROWS if array_rows is None else array_rows, split_rows)
    biggest = largest_group(docs)
    n = F.col("T") - 1
    out = empty_selection_scores(docs, extra)
    if array_rows:
        out = _array_scores(pv.filter(n <= array_rows) if biggest > array_rows else pv, extra).unionByName(out)
    if biggest > array_rows:
        out = _row_scores(pv.filter(n > array_rows), extra, split_rows, biggest).unionByName(out)
    return out


def _array_scores(pv: DataFrame, extra: list[str]) -> DataFrame:
    """Scores of documents whose values are held as arrays: one group and one
    row of 122 scores for each."""
    col = F.col
    kinds = {"m": col("lp_m"), "z": col("z"), "a": nan_to_num(col("r0")), "b": nan_to_num(col("r1"))}
    g = pv.groupBy("doc_id", "T", "clen", *extra).agg(
        F.sum("lp").alias("tot"), *[F.collect_list(v).alias(k) for k, v in kinds.items()])
    return scores_of_means(g.select("doc_id", *extra, "T", "clen", "tot", *[k_means(k).alias(k) for k in kinds]), extra)


def scores_of_means(g: DataFrame, extra: list[str]) -> DataFrame:
    """The scores of documents (doc_id, T, clen, *extra) from the sum ``tot`` of
    lp and ten means each of lp, z and both ratios (m, z, a, b)."""
    n, col = F.col("T") - 1, F.col
    g = g.select("doc_id", *extra, "T", "clen", (col("tot") / n.cast("double")).alias("loss"), "m", "z", "a", "b")
    none = F.array_repeat(F.lit(None).cast("double"), len(RATIOS))
    safe = [F.when(col("T") >= 3, F.transform(k, lambda x: F.when(x.isNotNull(), finite_or(x, 0.0)))).otherwise(none)
            for k in ("a", "b")]
    later = LOOK_AHEADS[1:]
    values = F.concat("m", "z", safe[0], F.flatten(F.array_repeat(safe[1], len(later))),
                      F.array(col("loss"), safe_div(col("loss"), col("clen").cast("double"))))
    names = [f"{p}{ratio_name(r)}" for p in ("mink_", "mink++_", *(f"infill_{L}_" for L in LOOK_AHEADS)) for r in RATIOS]
    g = g.select("doc_id", *extra, F.array(*map(F.lit, [*names, "loss", "zlib"])).alias("method"), values.alias("score"))
    return (g.select("doc_id", *extra, F.inline(F.arrays_zip("method", "score")))
            .filter(F.col("score").isNotNull()))


def _row_scores(pv: DataFrame, extra: list[str], split_rows: int, biggest: int) -> DataFrame:
    """Scores of documents that are too long for arrays, by sorted rows."""
    has_infill = F.col("T") >= 3
    def kv(code, v, raw=None):
        raw = raw if raw is not None else F.lit(None).cast("double")
        return F.struct(F.lit(code).cast("tinyint").alias("kind"), v.alias("v"), raw.alias("raw"))
    two = [kv(K_LP, F.col("lp_m"), F.col("lp")), kv(K_Z, F.col("z"))]
    four = two + [kv(K_R0, nan_to_num(F.col("r0"))), kv(K_R1, nan_to_num(F.col("r1")))]
    kinds = F.when(has_infill, F.array(*four)).otherwise(F.array(*two))
    long = pv.select("doc_id", "T", "clen", *extra, F.inline(kinds)).withColumn(
        "n", F.col("T") - 1)
    ks = smallest_k_mean(long, ["doc_id", "kind"], split_rows=split_rows, biggest=biggest, array_rows=0)
    ridx = F.col("r_ix")
    mink = F.get(_names("mink_"), ridx)
    minkpp = F.get(_names("mink++_"), ridx)
    inf0 = F.get(_names("infill_0_"), ridx)
    infill_val = finite_or(F.col("kmean"), 0.0)
    later = F.array(*[F.lit(L) for L in LOOK_AHEADS[1:]])
    r1_names = F.transform(later, lambda L: F.concat(F.lit("infill_"), L.cast("string"), F.lit("_"),
                                                     F.get(F.array(*[F.lit(ratio_name(r)) for r in RATIOS]), ridx)))
    entries = (
        F.when(F.col("kind") == K_LP, F.array(F.struct(mink.alias("method"), F.col("kmean").alias("score"))))
        .when(F.col("kind") == K_Z, F.array(F.struct(minkpp.alias("method"), F.col("kmean").alias("score"))))
        .when(F.col("kind") == K_R0, F.array(F.struct(inf0.alias("method"), infill_val.alias("score"))))
        .otherwise(F.transform(r1_names, lambda nm: F.struct(nm.alias("method"), infill_val.alias("score"))))
    )
    # loss (mean of the raw lp) and zlib ride on the whole-document row of kind lp
    whole = (F.col("kind") == K_LP) & (F.col("rn") == F.col("n")) & (ridx == len(RATIOS) - 1)
    loss = F.col("tot") / F.col("n").cast("double")
    extra_entries = F.when(whole, F.array(
        F.struct(F.lit("loss").alias("method"), loss.alias("score")),
        F.struct(F.lit("zlib").alias("method"), safe_div(loss, F.col("clen").cast("double")).alias("score")),
    )).otherwise(F.array().cast("array<struct<method:string,score:double>>"))
    return ks.select("doc_id", *extra, F.inline(F.concat(entries, extra_entries)))


def empty_selection_scores(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Scores of empty selections, straight from the per-document row:
    min-k / min-k++ with k = 0 are the mean of nothing (NaN); infill with k = 0
    is 0.0; a document with fewer than 2 tokens has NaN loss and zlib; a
    document with fewer than 3 tokens has no infill score at all; one without
    a text has 0.0 under all names."""
    n = F.greatest(F.col("T") - 1, F.lit(0))
    # most documents have no empty selection and are not looked at further
    docs = docs.filter(F.col("T").isNull() | (k_of(n, dlit(min(RATIOS))) == 0))
    idx = F.sequence(F.lit(0), F.lit(len(RATIOS) - 1))
    zero_k = F.filter(idx, lambda j: k_of(n, F.get(_ratio_array(), j)) == 0)
    nan = dlit(NAN)
    mk = F.transform(zero_k, lambda j: F.array(
        F.struct(F.get(_names("mink_"), j).alias("method"), nan.alias("score")),
        F.struct(F.get(_names("mink++_"), j).alias("method"), nan.alias("score"))))
    inf = F.transform(zero_k, lambda j: F.transform(
        F.array(*[F.lit(L) for L in LOOK_AHEADS]),
        lambda L: F.struct(F.concat(F.lit("infill_"), L.cast("string"), F.lit("_"),
                                    F.get(F.array(*[F.lit(ratio_name(r)) for r in RATIOS]), j)).alias("method"),
                           dlit(0.0).alias("score"))))
    short = F.when(F.col("T") < 2, F.array(
        F.struct(F.lit("loss").alias("method"), nan.alias("score")),
        F.struct(F.lit("zlib").alias("method"), nan.alias("score")),
    )).otherwise(F.array().cast("array<struct<method:string,score:double>>"))
    all_e = F.concat(F.flatten(mk),
                     F.when(F.col("T") >= 3, F.flatten(inf)).otherwise(
                         F.array().cast("array<struct<method:string,score:double>>")),
                     short)
    # no text at all: every score is missing and takes the default
    none = F.array(*[F.struct(F.lit(m).alias("method"), dlit(0.0).alias("score")) for m in method_names()])
    return docs.select("doc_id", *extra, F.inline(F.when(F.col("T").isNull(), none).otherwise(all_e)))


def sanitize_scores(raw: DataFrame) -> DataFrame:
    """Any non-finite score becomes 0.0."""
    return raw.withColumn("score", finite_or(F.col("score"), 0.0))

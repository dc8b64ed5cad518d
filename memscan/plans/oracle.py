"""Reference SQL for the correctness check (DuckDB dialect).

The same definitions as the Spark plans, written as one chain of common
table expressions over the driver's pre-registered tables.  Used only to
cross-check results; nothing in the Spark plans reads it.
"""

from __future__ import annotations

from ..constants import (FLOAT_MAX, LOOK_AHEADS, MIN_LOG_PROB, MIN_SD, MIN_VARIANCE,
                         RATIO_CLIP, RATIOS, ROC_SCORE_CLIP, SCORE_DECIMALS, UNK, Z_CLIP,
                         method_names, ratio_name)

NAN = "'nan'::DOUBLE"
INF = "'inf'::DOUBLE"


def d(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def fin(x: str) -> str:
    return f"isfinite({x})"


def clamp_min(x: str, lo: float) -> str:
    return f"(CASE WHEN isnan({x}) THEN {x} ELSE greatest({x}, {d(lo)}) END)"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN isnan({x}) THEN {x} ELSE least(greatest({x}, {d(lo)}), {d(hi)}) END)"


def safe_div(a: str, b: str) -> str:
    return (f"(CASE WHEN {b} <> 0 THEN {a} / {b} WHEN isnan({a}) THEN {NAN} "
            f"WHEN {a} > 0 THEN {INF} WHEN {a} < 0 THEN -{INF} ELSE {NAN} END)")


def safe_sqrt(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {NAN} ELSE sqrt({x}) END)"


def nan_to_num(x: str) -> str:
    return (f"(CASE WHEN isnan({x}) THEN 0.0::DOUBLE WHEN {x} = {INF} THEN {d(FLOAT_MAX)} "
            f"WHEN {x} = -{INF} THEN {d(-FLOAT_MAX)} ELSE {x} END)")


def finite_or0(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} ELSE 0.0::DOUBLE END)"


def sd_floor(var: str) -> str:
    return clamp_min(safe_sqrt(nan_to_num(var)), MIN_SD)


def z_token(lp: str, mu: str, var: str, clip: bool) -> str:
    if clip:
        lp, mu, var = clamp_min(lp, MIN_LOG_PROB), clamp_min(mu, MIN_LOG_PROB), clamp_min(var, MIN_VARIANCE)
    z = safe_div(f"({lp} - {mu})", safe_sqrt(var))
    return clamp(z, *Z_CLIP) if clip else z


def z_infill(lp: str, mu: str, sd: str, clip: bool) -> str:
    if clip:
        return clamp(f"(({clamp_min(lp, MIN_LOG_PROB)} - {clamp_min(mu, MIN_LOG_PROB)}) / {sd})", *Z_CLIP)
    return f"(({lp} - {mu}) / {sd})"


def infill_sql(clip: bool) -> tuple[str, str]:
    sd = sd_floor("var")
    base = f"({z_infill('lp', 'mu', sd, clip)} - {z_infill('lp_xhat', 'mu', sd, clip)})"
    a = z_infill("lp_next", "mu_next", sd_floor("var_next"), clip)
    b = z_infill("lp_alt", "mu_alt", sd_floor("var_alt"), clip)
    fut = "(i <= T - 4)"
    if clip:
        term = f"(CASE WHEN {fut} THEN {a} - {b} ELSE 0.0::DOUBLE END)"
        return clamp(base, *RATIO_CLIP), clamp(f"({base} + {term})", *RATIO_CLIP)
    term = f"(CASE WHEN {fut} AND {fin(a)} AND {fin(b)} THEN {a} - {b} ELSE 0.0::DOUBLE END)"
    return base, f"({base} + {term})"


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{Cc}]')"


def docs_cte(source: str = "documents") -> str:
    if source == "documents":
        sel = f"SELECT doc_id, CAST(doc_id % 2 = 0 AS INTEGER) AS label, {TOKENS} AS toks FROM documents"
    elif source == "benchmark":
        sel = f"SELECT item_id AS doc_id, CAST(NULL AS INTEGER) AS label, {TOKENS} AS toks FROM benchmark"
    elif source == "masked":      # text only where labels has a row
        sel = f"""SELECT doc_id, CAST(doc_id % 2 = 0 AS INTEGER) AS label, {TOKENS} AS toks FROM (
            SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.text END AS text FROM documents d
            LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)"""
    else:
        raise ValueError(source)
    return f"""
d0 AS ({sel}),
docs AS (SELECT doc_id, label, toks, CAST(len(toks) AS INTEGER) AS T FROM d0)"""


def positions_cte(src: str, name: str) -> str:
    return f"""
{name}_i AS (SELECT doc_id, label, T, toks, unnest(range(0, greatest(T - 1, 0))) AS i FROM {src}),
{name} AS (SELECT doc_id, label, T, CAST(i AS INTEGER) AS i, toks[i + 1] AS x0, toks[i + 2] AS x1,
           toks[i + 3] AS x2 FROM {name}_i)"""


def model_cte(train: str = "tdocs") -> str:
    """Bigram model tables from the training docs CTE ``train``."""
    return f"""
{positions_cte(train, 'tpos')},
uc AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest(toks) AS tok FROM {train}) GROUP BY tok),
sc0 AS (SELECT CAST(sum(cnt) AS DOUBLE) AS N, CAST(count(*) AS DOUBLE) AS V FROM uc),
sc1 AS (SELECT N, V, V / (N + V) AS lam0 FROM sc0),
uni AS (SELECT tok, cnt, (1.0::DOUBLE - lam0) * CAST(cnt AS DOUBLE) / N + lam0 / (V + 1) AS q FROM uc, sc1
        UNION ALL SELECT '{UNK}', 0, lam0 / (V + 1) FROM sc1),
uni2 AS (SELECT tok, cnt, q, ln(q) AS lnq FROM uni),
sc20 AS (SELECT sum(q * lnq) AS M1 FROM uni2),
sc2 AS (SELECT max(M1) AS M1, sum(q * (lnq - M1) * (lnq - M1)) AS var_u FROM uni2, sc20),
top AS (SELECT tok AS top1, q AS q_top1 FROM uni2 ORDER BY q DESC, tok LIMIT 1),
scal AS (SELECT sc1.*, sc2.*, top.*, sc1.lam0 / (sc1.V + 1) AS q_unk
         FROM sc1, sc2, top),
b0 AS (SELECT x0 AS ctx, x1 AS tok, count(*) AS cnt FROM tpos GROUP BY x0, x1),
c0 AS (SELECT ctx, CAST(sum(cnt) AS BIGINT) AS n_c, count(*) AS d_c FROM b0 GROUP BY ctx),
big AS (SELECT b0.ctx, b0.tok, b0.cnt, c0.n_c, c0.d_c,
               CAST(c0.d_c AS DOUBLE) / CAST(c0.n_c + c0.d_c AS DOUBLE) AS lam, u.q, u.lnq
        FROM b0 JOIN c0 ON b0.ctx = c0.ctx JOIN uni2 u ON u.tok = b0.tok),
big2 AS (SELECT *, (1.0::DOUBLE - lam) * CAST(cnt AS DOUBLE) / CAST(n_c AS DOUBLE) + lam * q AS p FROM big),
cagg AS (SELECT ctx, max(n_c) AS n_c, max(d_c) AS d_c, max(lam) AS lam,
                sum(p * ln(p)) AS s_plnp, sum(q) AS s_q, sum(q * lnq) AS s_qlnq,
                max(CASE WHEN tok = (SELECT top1 FROM top) THEN 1 ELSE 0 END) AS has_top1
         FROM big2 GROUP BY ctx),
cbest AS (SELECT ctx, tok AS btok, p AS bp FROM (
            SELECT ctx, tok, p, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, tok) AS rn FROM big2)
          WHERE rn = 1),
cm AS (SELECT a.*, b.btok, b.bp, ln(a.lam) AS ll, s.M1, s.var_u, s.top1, s.q_top1,
              1.0::DOUBLE - a.s_q AS rest_q, s.M1 - a.s_qlnq AS m1_rest,
              a.lam * s.q_top1 AS p_un
       FROM cagg a JOIN cbest b ON a.ctx = b.ctx, scal s),
cm2 AS (SELECT *, s_plnp + lam * (ll * rest_q + m1_rest) AS mu,
               (has_top1 = 0 AND (p_un > bp OR (p_un = bp AND top1 < btok))) AS use_top1 FROM cm),
cent AS (SELECT b.ctx, sum(p * (ln(p) - mu) * (ln(p) - mu)) AS s2, sum(q * (lnq - mu + ll) * (lnq - mu + ll)) AS sq2
         FROM big2 b JOIN cm2 ON cm2.ctx = b.ctx GROUP BY b.ctx),
ctxs AS (SELECT cm2.ctx, n_c, d_c, lam, mu,
                s2 + lam * greatest(var_u + (M1 - mu + ll) * (M1 - mu + ll) - sq2, 0.0) AS var,
                CASE WHEN use_top1 THEN top1 ELSE btok END AS xhat,
                CASE WHEN use_top1 THEN p_un ELSE bp END AS p_xhat FROM cm2 JOIN cent ON cent.ctx = cm2.ctx)"""


def trigram_cte() -> str:
    """Order 3 over the bigram model of ``tdocs``: probabilities of seen grams."""
    return """
g0 AS (SELECT toks[i - 1] AS w1, toks[i] AS w2, toks[i + 1] AS tok FROM (
         SELECT toks, unnest(range(2, greatest(len(toks), 2))) AS i FROM tdocs)),
g1 AS (SELECT w1 || ' ' || w2 AS ctx, w2, tok, count(*) AS cnt FROM g0 GROUP BY ALL),
g2 AS (SELECT ctx, CAST(sum(cnt) AS BIGINT) AS n_c, count(*) AS d_c FROM g1 GROUP BY ctx),
g3 AS (SELECT g1.*, g2.n_c, g2.d_c, CAST(g2.d_c AS DOUBLE) / CAST(g2.n_c + g2.d_c AS DOUBLE) AS lam, b.p AS q
       FROM g1 JOIN g2 ON g2.ctx = g1.ctx JOIN big2 b ON b.ctx = g1.w2 AND b.tok = g1.tok),
tri AS (SELECT *, (1.0::DOUBLE - lam) * CAST(cnt AS DOUBLE) / CAST(n_c AS DOUBLE) + lam * q AS p FROM g3)"""


def trigram_moments_sql() -> str:
    """Moments of order-3 contexts; the unseen part as weight, mean and squared
    spread of what the suffix's distribution leaves."""
    return chain(upto="model") + f""",{trigram_cte()},
t1 AS (SELECT ctx, w2, max(n_c) AS n_c, max(d_c) AS d_c, max(lam) AS lam, sum(p * ln(p)) AS a, sum(q) AS sq, sum(q * ln(q)) AS b
       FROM tri GROUP BY ctx, w2),
t2 AS (SELECT t1.*, c.mu AS mu_low, c.var AS var_low, c.xhat AS top_low, c.p_xhat AS q_top,
              a + t1.lam * (ln(t1.lam) * (1 - sq) + c.mu - b) AS mu FROM t1 JOIN ctxs c ON c.ctx = t1.w2),
t3 AS (SELECT t2.ctx, any_value(t2.n_c) AS n_c, any_value(t2.d_c) AS d_c, any_value(t2.lam) AS lam, any_value(mu) AS mu,
              any_value(mu_low) AS mu_low, any_value(var_low) AS var_low, any_value(top_low) AS top_low, any_value(q_top) AS q_top,
              sum(p * pow(ln(p) - mu, 2)) AS s2, sum(q * pow(ln(q) - mu + ln(t2.lam), 2)) AS sq2,
              max(CASE WHEN tok = top_low THEN 1 ELSE 0 END) AS has_top
       FROM t2 JOIN tri ON tri.ctx = t2.ctx GROUP BY t2.ctx),
tb AS (SELECT ctx, tok, p FROM (SELECT ctx, tok, p, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, tok) AS rn FROM tri) WHERE rn = 1),
t4 AS (SELECT t3.*, tb.tok AS btok, tb.p AS bp, (has_top = 0 AND (lam * q_top > tb.p OR (lam * q_top = tb.p AND top_low < tb.tok))) AS low
       FROM t3 JOIN tb ON tb.ctx = t3.ctx)
SELECT ctx, n_c, d_c, round(lam, 12) AS lam, round(mu, 5) AS mu,
       round(s2 + lam * greatest(var_low + pow(mu_low - mu + ln(lam), 2) - sq2, 0.0), 5) AS var,
       CASE WHEN low THEN top_low ELSE btok END AS xhat, round(CASE WHEN low THEN lam * q_top ELSE bp END, 12) AS p_xhat FROM t4"""


def trigram_log_probs_sql() -> str:
    return chain(upto="model") + f""",{trigram_cte()},
w AS (SELECT doc_id, pos, toks[pos + 1] AS tok, toks[pos] AS w2, CASE WHEN pos >= 2 THEN toks[pos - 1] || ' ' || toks[pos] END AS ctx
      FROM (SELECT doc_id, toks, unnest(range(1, greatest(len(toks), 1))) AS pos FROM docs))
SELECT w.doc_id, w.pos::INTEGER AS pos, w.tok, round(ln(coalesce(t.p, coalesce(g2.lam3, 1.0) * coalesce(b.p, coalesce(c.lam, 1.0)
       * coalesce(u.q, s.q_unk)))), 6) AS lp
FROM w LEFT JOIN uni2 u ON u.tok = w.tok LEFT JOIN big2 b ON b.ctx = w.w2 AND b.tok = w.tok LEFT JOIN ctxs c ON c.ctx = w.w2
     LEFT JOIN tri t ON t.ctx = w.ctx AND t.tok = w.tok
     LEFT JOIN (SELECT ctx, CAST(d_c AS DOUBLE) / CAST(n_c + d_c AS DOUBLE) AS lam3 FROM g2) g2 ON g2.ctx = w.ctx, scal s"""


def peaked_contexts_sql(k: int = 100) -> str:
    """Mean and variance of the most peaked contexts (one continuation, seen
    most often), summed over the whole vocabulary from the definition."""
    return chain(upto="model") + f""",
pk AS (SELECT ctx, tok, n_c, lam FROM big2 WHERE d_c = 1 ORDER BY n_c DESC, ctx LIMIT {k}),
pv AS (SELECT pk.ctx, pk.n_c, CASE WHEN u.tok = pk.tok THEN 1 - lam ELSE 0.0 END + lam * u.q AS p FROM pk, uni2 u),
pm AS (SELECT ctx, sum(p * ln(p)) AS mu FROM pv GROUP BY ctx)
SELECT pv.ctx, any_value(n_c) AS n_c, round(ln(-any_value(mu)), 8) AS ln_minus_mu, round(ln(sum(p * pow(ln(p) - mu, 2))), 8) AS ln_var
FROM pv JOIN pm ON pm.ctx = pv.ctx GROUP BY pv.ctx"""


def stats_cte() -> str:
    """Per-position statistics of ``docs`` under the model."""
    return f"""
{positions_cte('docs', 'pos')},
ts1 AS (SELECT p.doc_id, p.label, p.T, p.i, p.x0, p.x1, p.x2,
               ln(coalesce(b.p, coalesce(c.lam, 1.0::DOUBLE) * coalesce(u.q, s.q_unk))) AS lp,
               coalesce(c.mu, s.M1) AS mu, coalesce(c.var, s.var_u) AS var,
               coalesce(c.xhat, s.top1) AS xhat, ln(coalesce(c.p_xhat, s.q_top1)) AS lp_xhat
        FROM pos p LEFT JOIN ctxs c ON c.ctx = p.x0 LEFT JOIN uni2 u ON u.tok = p.x1
             LEFT JOIN big2 b ON b.ctx = p.x0 AND b.tok = p.x1, scal s),
ts AS (SELECT t.*,
              CASE WHEN t.x2 IS NOT NULL THEN
                ln(coalesce(b.p, coalesce(c.lam, 1.0::DOUBLE) * coalesce(u.q, s.q_unk))) END AS lp_alt,
              coalesce(c.mu, s.M1) AS mu_alt, coalesce(c.var, s.var_u) AS var_alt
       FROM ts1 t LEFT JOIN ctxs c ON c.ctx = t.xhat LEFT JOIN uni2 u ON u.tok = t.x2
            LEFT JOIN big2 b ON b.ctx = t.xhat AND b.tok = t.x2, scal s)"""


def ratios_cte() -> str:
    rows = ", ".join(f"({j}, {d(r)}, '{ratio_name(r)}')" for j, r in enumerate(RATIOS))
    la = ", ".join(f"({L})" for L in LOOK_AHEADS[1:])
    la_all = ", ".join(f"({L})" for L in LOOK_AHEADS)
    return f"""
rt AS (SELECT * FROM (VALUES {rows}) t(r_ix, r, rname)),
la AS (SELECT * FROM (VALUES {la}) t(L)),
la_all AS (SELECT * FROM (VALUES {la_all}) t(L))"""


SCALED = """
tsx AS (SELECT doc_id, label, T, i, x0, x1, x2, lp * 15 AS lp, mu, xhat, lp_xhat * 15 AS lp_xhat,
               CASE WHEN i % 7 = 0 THEN 0.0::DOUBLE WHEN i % 11 = 0 THEN -1e-9::DOUBLE ELSE var * 0.001::DOUBLE END AS var,
               lp_alt * 15 AS lp_alt, mu_alt, var_alt * 0.001::DOUBLE AS var_alt FROM ts)"""


def scores_cte(clip: bool, src: str = "ts") -> str:
    names = ", ".join(f"('{n}')" for n in method_names() if n != "zlib")
    r0, r1 = infill_sql(clip)
    lp_m = clamp_min("lp", MIN_LOG_PROB) if clip else "lp"
    cols = "doc_id, label, T, loss, T - 1 AS n"
    return f"""
{ratios_cte()},
pv0 AS (SELECT *, lead(lp) OVER (PARTITION BY doc_id ORDER BY i) AS lp_next,
               lead(mu) OVER (PARTITION BY doc_id ORDER BY i) AS mu_next,
               lead(var) OVER (PARTITION BY doc_id ORDER BY i) AS var_next,
               avg(lp) OVER (PARTITION BY doc_id) AS loss FROM {src}),
pv AS (SELECT *, {lp_m} AS lp_m, {z_token('lp', 'mu', 'var', clip)} AS z, {r0} AS r0, {r1} AS r1 FROM pv0),
lv AS (SELECT {cols}, 'lp' AS kind, lp_m AS v FROM pv
       UNION ALL SELECT {cols}, 'z', z FROM pv
       UNION ALL SELECT {cols}, 'r0', {nan_to_num('r0')} FROM pv WHERE T >= 3
       UNION ALL SELECT {cols}, 'r1', {nan_to_num('r1')} FROM pv WHERE T >= 3),
ks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY v) AS rn,
              sum(v) OVER (PARTITION BY doc_id, kind ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
       FROM lv),
km AS (SELECT ks.*, rt.r_ix, rt.rname, cs / CAST(rn AS DOUBLE) AS kmean
       FROM ks JOIN rt ON floor(CAST(ks.n AS DOUBLE) * rt.r) = ks.rn),
raw AS (SELECT doc_id, label, 'mink_' || rname AS method, kmean AS score FROM km WHERE kind = 'lp'
        UNION ALL SELECT doc_id, label, 'mink++_' || rname, kmean FROM km WHERE kind = 'z'
        UNION ALL SELECT doc_id, label, 'infill_0_' || rname, {finite_or0('kmean')} FROM km WHERE kind = 'r0'
        UNION ALL SELECT doc_id, label, 'infill_' || CAST(la.L AS VARCHAR) || '_' || rname, {finite_or0('kmean')}
                  FROM km, la WHERE kind = 'r1'
        UNION ALL SELECT doc_id, label, 'loss', loss FROM km WHERE kind = 'lp' AND rn = n AND r_ix = 9
        UNION ALL SELECT doc_id, label, nm.method, 0.0::DOUBLE FROM docs, (VALUES {names}) nm(method) WHERE T IS NULL
        UNION ALL SELECT doc_id, label, 'mink_' || rname, {NAN} FROM docs, rt
                  WHERE T IS NOT NULL AND floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, label, 'mink++_' || rname, {NAN} FROM docs, rt
                  WHERE T IS NOT NULL AND floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, label, 'infill_' || CAST(la_all.L AS VARCHAR) || '_' || rname, 0.0::DOUBLE
                  FROM docs, rt, la_all WHERE T >= 3 AND floor(CAST(T - 1 AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, label, 'loss', {NAN} FROM docs WHERE T < 2),
scores AS (SELECT doc_id, label, method, {finite_or0('score')} AS score FROM raw)"""


def chain(clip: bool = False, source: str = "documents", train_source: str = "documents",
          upto: str = "scores", scaled: bool = False) -> str:
    """WITH ... chain up to the named stage (docs, model, stats, scores)."""
    parts = [docs_cte(source)]
    if train_source == "documents" and source == "documents":
        parts.append("\ntdocs AS (SELECT * FROM docs WHERE label = 1)")
    else:
        parts.append(docs_cte("documents").replace("d0 AS", "td0 AS").replace("docs AS", "alld AS")
                     .replace("FROM d0", "FROM td0"))
        parts.append("\ntdocs AS (SELECT * FROM alld WHERE label = 1)")
    if upto in ("model", "stats", "scores", "metrics"):
        parts.append(model_cte())
    if upto in ("stats", "scores", "metrics"):
        parts.append(stats_cte())
    if upto in ("scores", "metrics"):
        if scaled:
            parts.append(SCALED)
        parts.append(scores_cte(clip, "tsx" if scaled else "ts"))
    return "WITH " + ",".join(p.lstrip("\n") for p in parts)


def method_order_cte() -> str:
    rows = ", ".join(f"('{n}', {i})" for i, n in enumerate(method_names()))
    return f"mo AS (SELECT * FROM (VALUES {rows}) t(method, method_order))"


def metrics_cte(scores: str = "scores", label: str = "label") -> str:
    c = d(ROC_SCORE_CLIP)
    return f"""
rs AS (SELECT method, round(least(greatest(score, -{c}), {c}), {SCORE_DECIMALS}) AS s, {label} AS label
       FROM {scores} WHERE isfinite(score) AND {label} IS NOT NULL),
g AS (SELECT method, s, CAST(sum(label) AS BIGINT) AS tp, CAST(sum(1 - label) AS BIGINT) AS fp
      FROM rs GROUP BY method, s),
tot AS (SELECT method, sum(tp) AS P, sum(fp) AS N FROM g GROUP BY method),
pts0 AS (SELECT g.*, sum(tp) OVER (PARTITION BY method ORDER BY s DESC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tp,
                sum(fp) OVER (PARTITION BY method ORDER BY s DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_fp,
                lead(tp) OVER (PARTITION BY method ORDER BY s DESC) AS ntp,
                lead(fp) OVER (PARTITION BY method ORDER BY s DESC) AS nfp FROM g),
pts AS (SELECT p.*, t.P, t.N,
               ((p.cum_tp = p.tp AND p.cum_fp = p.fp) OR p.ntp IS NULL OR p.ntp <> p.tp OR p.nfp <> p.fp) AS kept,
               CAST(p.cum_tp AS DOUBLE) / CAST(t.P AS DOUBLE) AS tpr,
               CAST(p.cum_fp AS DOUBLE) / CAST(t.N AS DOUBLE) AS fpr,
               CAST(p.cum_tp - p.tp AS DOUBLE) / CAST(t.P AS DOUBLE) AS tpr_prev,
               CAST(p.cum_fp - p.fp AS DOUBLE) / CAST(t.N AS DOUBLE) AS fpr_prev
        FROM pts0 p JOIN tot t ON p.method = t.method),
m0 AS (SELECT method, sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2.0::DOUBLE) AS auroc,
              min(CASE WHEN kept AND tpr >= 0.95::DOUBLE THEN fpr END) AS fpr95,
              max(CASE WHEN kept AND fpr <= 0.05::DOUBLE THEN tpr END) AS tpr05 FROM pts GROUP BY method),
m1 AS (SELECT t.method, CASE WHEN t.P + t.N >= 2 AND t.P > 0 AND t.N > 0 THEN m0.auroc ELSE 0.0 END AS auroc,
              CASE WHEN t.P + t.N >= 2 AND t.P > 0 AND t.N > 0 THEN coalesce(m0.fpr95, 1.0) ELSE 1.0 END AS fpr95,
              CASE WHEN t.P + t.N >= 2 AND t.P > 0 AND t.N > 0 THEN coalesce(m0.tpr05, 0.0) ELSE 0.0 END AS tpr05
       FROM tot t LEFT JOIN m0 ON t.method = m0.method),
{method_order_cte()},
metrics AS (SELECT mo.method, mo.method_order, coalesce(m1.auroc, 0.0) AS auroc,
                   coalesce(m1.fpr95, 1.0) AS fpr95, coalesce(m1.tpr05, 0.0) AS tpr05
            FROM mo LEFT JOIN m1 ON mo.method = m1.method)"""


def lm_toy_cte(A, B) -> str:
    """The toy model (logits A[x_p] + B[x_(p-1)], memory 2) over ``docs``:
    per-position statistics, the two alternative positions per i, and the
    look-ahead ratios for all ten L (absent alternative rows are zero)."""
    V = len(A)
    wa = ", ".join(f"({a}, {v}, {d(A[a][v])})" for a in range(V) for v in range(V))
    wb = ", ".join(f"({b}, {v}, {d(B[b][v])})" for b in range(V) for v in range(V))
    ids = ", ".join(f"({v})" for v in range(V))
    sd = sd_floor("var")
    return f"""
vv AS (SELECT * FROM (VALUES {ids}) t(v)),
wa AS (SELECT * FROM (VALUES {wa}) t(a, v, w)),
wb AS (SELECT * FROM (VALUES {wb}) t(b, v, w)),
combos AS (SELECT c.v AS cur, p.v AS prev FROM vv c, (SELECT v FROM vv UNION ALL SELECT NULL) p),
lg AS (SELECT k.cur, k.prev, vv.v, wa.w + coalesce(wb.w, 0.0::DOUBLE) AS logit
       FROM combos k CROSS JOIN vv JOIN wa ON wa.a = k.cur AND wa.v = vv.v
       LEFT JOIN wb ON wb.b = k.prev AND wb.v = vv.v),
lg2 AS (SELECT *, logit - max(logit) OVER (PARTITION BY cur, prev) AS zz FROM lg),
lg3 AS (SELECT *, zz - ln(sum(exp(zz)) OVER (PARTITION BY cur, prev)) AS lp FROM lg2),
cs AS (SELECT cur, prev, v, lp FROM lg3),
cm0 AS (SELECT cur, prev, sum(exp(lp) * lp) AS mu, sum(exp(lp) * lp * lp) AS m2raw FROM lg3 GROUP BY cur, prev),
cbest AS (SELECT cur, prev, v AS xh, lp AS lpx FROM (
            SELECT cur, prev, v, lp, row_number() OVER (PARTITION BY cur, prev ORDER BY lp DESC, v) AS rn FROM lg3)
          WHERE rn = 1),
cm AS (SELECT a.cur, a.prev, a.mu, a.m2raw - a.mu * a.mu AS var, b.xh, b.lpx FROM cm0 a JOIN cbest b
       ON a.cur = b.cur AND a.prev IS NOT DISTINCT FROM b.prev),
lmid AS (SELECT doc_id, label, T, list_transform(toks, lambda t: length(t) % {V}) AS ids FROM docs),
lmp0 AS (SELECT doc_id, label, T, ids, unnest(range(0, greatest(T - 1, 0))) AS i FROM lmid),
lmp AS (SELECT doc_id, label, T, CAST(i AS INTEGER) AS i, ids[i + 1] AS cur,
               CASE WHEN i >= 1 THEN ids[i] END AS prev, ids[i + 2] AS obs, ids[i + 3] AS obs2,
               ids[i + 4] AS obs3 FROM lmp0),
lts AS (SELECT p.*, s.lp, m.mu, m.var, m.xh, m.lpx AS lp_xhat
        FROM lmp p JOIN cs s ON s.cur = p.cur AND s.prev IS NOT DISTINCT FROM p.prev AND s.v = p.obs
        JOIN cm m ON m.cur = p.cur AND m.prev IS NOT DISTINCT FROM p.prev),
lz AS (SELECT *, {sd} AS sdv FROM lts),
lz2 AS (SELECT *, (lp - mu) / sdv AS z_o, (lp_xhat - mu) / sdv AS z_x FROM lz),
alt1 AS (SELECT p.doc_id, p.i, ((s.lp - m.mu) / {sd_floor('m.var')}) AS z_a FROM lz2 p
         JOIN cs s ON s.cur = p.xh AND s.prev = p.cur AND s.v = p.obs2
         JOIN cm m ON m.cur = p.xh AND m.prev = p.cur WHERE p.i <= p.T - 4),
alt2 AS (SELECT p.doc_id, p.i, ((s.lp - m.mu) / {sd_floor('m.var')}) AS z_a FROM lz2 p
         JOIN cs s ON s.cur = p.obs2 AND s.prev = p.xh AND s.v = p.obs3
         JOIN cm m ON m.cur = p.obs2 AND m.prev = p.xh WHERE p.i <= p.T - 5),
lrat AS (SELECT b.doc_id, b.label, b.T, b.i, b.z_o - b.z_x AS base,
                coalesce(CASE WHEN isfinite(n1.z_o) AND isfinite(a1.z_a) THEN n1.z_o - a1.z_a END, 0.0) AS d1,
                coalesce(CASE WHEN isfinite(n2.z_o) AND isfinite(a2.z_a) THEN n2.z_o - a2.z_a END, 0.0) AS d2
         FROM lz2 b LEFT JOIN alt1 a1 ON a1.doc_id = b.doc_id AND a1.i = b.i
              LEFT JOIN lz2 n1 ON n1.doc_id = b.doc_id AND n1.i = b.i + 1
              LEFT JOIN alt2 a2 ON a2.doc_id = b.doc_id AND a2.i = b.i
              LEFT JOIN lz2 n2 ON n2.doc_id = b.doc_id AND n2.i = b.i + 2
         WHERE b.T >= 3)"""


def lm_scores_sql(A, B) -> str:
    """All scores but zlib of the toy model, sanitised, like scores_from_stats."""
    la_all = ", ".join(f"({L})" for L in LOOK_AHEADS)
    rows = ", ".join(f"({j}, {d(r)}, '{ratio_name(r)}')" for j, r in enumerate(RATIOS))
    z = z_token("lp", "mu", "var", False)
    return chain(upto="docs") + "," + lm_toy_cte(A, B) + f""",
rt AS (SELECT * FROM (VALUES {rows}) t(r_ix, r, rname)),
la_all AS (SELECT * FROM (VALUES {la_all}) t(L)),
lv AS (SELECT doc_id, T - 1 AS n, 'mink_' AS fam, lp AS v FROM lts
       UNION ALL SELECT doc_id, T - 1, 'mink++_', {z} FROM lts
       UNION ALL SELECT r.doc_id, r.T - 1, 'infill_' || CAST(la_all.L AS VARCHAR) || '_',
                        {nan_to_num("(r.base + CASE WHEN la_all.L >= 1 THEN r.d1 ELSE 0.0 END + CASE WHEN la_all.L >= 2 THEN r.d2 ELSE 0.0 END)")}
                 FROM lrat r, la_all),
ks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fam ORDER BY v) AS rn,
              sum(v) OVER (PARTITION BY doc_id, fam ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
       FROM lv),
km AS (SELECT ks.*, rt.rname, cs / CAST(rn AS DOUBLE) AS kmean FROM ks JOIN rt
       ON floor(CAST(ks.n AS DOUBLE) * rt.r) = ks.rn),
raw AS (SELECT doc_id, fam || rname AS method,
               CASE WHEN starts_with(fam, 'infill_') THEN {finite_or0('kmean')} ELSE kmean END AS score FROM km
        UNION ALL SELECT doc_id, 'loss', avg(lp) FROM lts GROUP BY doc_id
        UNION ALL SELECT doc_id, 'mink_' || rname, {NAN} FROM docs, rt
                  WHERE floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, 'mink++_' || rname, {NAN} FROM docs, rt
                  WHERE floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, 'infill_' || CAST(la_all.L AS VARCHAR) || '_' || rname, 0.0::DOUBLE
                  FROM docs, rt, la_all WHERE T >= 3 AND floor(CAST(T - 1 AS DOUBLE) * r) = 0
        UNION ALL SELECT doc_id, 'loss', {NAN} FROM docs WHERE T < 2)
SELECT doc_id, method, round({finite_or0('score')}, 4) AS score FROM raw"""


def lm_decay_scores_sql(A, e, w, fade: float, trace: int) -> str:
    """All scores but zlib of the fading-trace model over ``benchmark``."""
    V = len(A)
    wa = ", ".join(f"({a}, {v}, {d(A[a][v])})" for a in range(V) for v in range(V))
    we = ", ".join(f"({v}, {d(e[v])}, {d(w[v])})" for v in range(V))
    rows = ", ".join(f"({j}, {d(r)}, '{ratio_name(r)}')" for j, r in enumerate(RATIOS))
    la_all = ", ".join(f"({L})" for L in LOOK_AHEADS)
    dist = lambda src: f"""SELECT t.*, a.v, a.w + v.w * t.s AS logit FROM {src} t JOIN wa a ON a.a = t.cur JOIN we v ON v.v = a.v"""
    return chain(source="benchmark", upto="docs") + f""",
wa AS (SELECT * FROM (VALUES {wa}) t(a, v, w)),
we AS (SELECT * FROM (VALUES {we}) t(v, e, w)),
rt AS (SELECT * FROM (VALUES {rows}) t(r_ix, r, rname)),
la_all AS (SELECT * FROM (VALUES {la_all}) t(L)),
di AS (SELECT doc_id, T, list_transform(toks, lambda t: length(t) % {V}) AS ids FROM docs),
dp AS (SELECT doc_id, T, ids, unnest(range(0, greatest(T - 1, 0))) AS p FROM di),
tr AS (SELECT doc_id, p, sum(pow({d(fade)}, k) * we.e) AS s FROM (
         SELECT doc_id, p, ids, unnest(range(1, least(p, {trace}) + 1)) AS k FROM dp WHERE p >= 1) q
       JOIN we ON we.v = q.ids[q.p - q.k + 1] GROUP BY doc_id, p),
st AS (SELECT dp.doc_id, dp.T, dp.p, dp.ids[dp.p + 1] AS cur, dp.ids[dp.p + 2] AS obs, coalesce(tr.s, 0.0) AS s
       FROM dp LEFT JOIN tr ON tr.doc_id = dp.doc_id AND tr.p = dp.p),
l1 AS ({dist("st")}),
l2 AS (SELECT *, logit - max(logit) OVER (PARTITION BY doc_id, p) AS zz FROM l1),
l3 AS (SELECT *, zz - ln(sum(exp(zz)) OVER (PARTITION BY doc_id, p)) AS lpv FROM l2),
mo1 AS (SELECT doc_id, T, p, cur, obs, s, sum(CASE WHEN v = obs THEN lpv ELSE 0.0 END) AS lp, sum(exp(lpv) * lpv) AS mu,
               sum(exp(lpv) * lpv * lpv) AS m2, max(lpv) AS lp_xhat FROM l3 GROUP BY ALL),
best AS (SELECT doc_id, p, v AS xh FROM (SELECT doc_id, p, v, row_number() OVER (PARTITION BY doc_id, p ORDER BY lpv DESC, v) AS rn
         FROM l3) WHERE rn = 1),
ts AS (SELECT m.doc_id, m.T, m.p, m.cur, m.obs, m.s, m.lp, m.mu, m.m2 - m.mu * m.mu AS var, m.lp_xhat, b.xh
       FROM mo1 m JOIN best b ON b.doc_id = m.doc_id AND b.p = m.p),
zz1 AS (SELECT *, (lp - mu) / {sd_floor('var')} AS z_o, (lp_xhat - mu) / {sd_floor('var')} AS z_x FROM ts),
al AS (SELECT i.doc_id, i.p AS i, p.p, p.obs, CASE WHEN p.p = i.p + 1 THEN i.xh ELSE p.cur END AS cur,
              CASE WHEN p.p = i.p + 1 THEN p.s ELSE p.s + pow({d(fade)}, p.p - i.p - 1) * (eh.e - eo.e) END AS s
       FROM zz1 i JOIN zz1 p ON p.doc_id = i.doc_id AND p.p > i.p AND p.p <= least(i.p + {trace} + 1, i.T - 3)
       JOIN we eh ON eh.v = i.xh JOIN we eo ON eo.v = i.obs),
a1 AS ({dist("al")}),
a2 AS (SELECT *, logit - max(logit) OVER (PARTITION BY doc_id, i, p) AS zz FROM a1),
a3 AS (SELECT *, zz - ln(sum(exp(zz)) OVER (PARTITION BY doc_id, i, p)) AS lpv FROM a2),
am AS (SELECT doc_id, i, p, sum(CASE WHEN v = obs THEN lpv ELSE 0.0 END) AS lp, sum(exp(lpv) * lpv) AS mu,
              sum(exp(lpv) * lpv * lpv) AS m2 FROM a3 GROUP BY ALL),
av AS (SELECT doc_id, i, p, lp, mu, m2 - mu * mu AS var FROM am),
df AS (SELECT a.doc_id, a.i, a.p, z.z_o - (a.lp - a.mu) / {sd_floor('a.var')} AS x FROM av a
       JOIN zz1 z ON z.doc_id = a.doc_id AND z.p = a.p),
rl AS (SELECT z.doc_id, z.T, z.p AS i, la_all.L, z.z_o - z.z_x AS base,
              coalesce((SELECT sum(CASE WHEN isfinite(df.x) THEN df.x ELSE 0.0 END) FROM df
                        WHERE df.doc_id = z.doc_id AND df.i = z.p AND df.p <= z.p + la_all.L), 0.0) AS later
       FROM zz1 z CROSS JOIN la_all WHERE z.T >= 3),
lv AS (SELECT doc_id, T - 1 AS n, 'mink_' AS fam, lp AS v FROM ts
       UNION ALL SELECT doc_id, T - 1, 'mink++_', {z_token("lp", "mu", "var", False)} FROM ts
       UNION ALL SELECT doc_id, T - 1, 'infill_' || CAST(L AS VARCHAR) || '_', {nan_to_num("(base + later)")} FROM rl),
ks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fam ORDER BY v) AS rn,
              sum(v) OVER (PARTITION BY doc_id, fam ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM lv),
sc AS (SELECT ks.doc_id, ks.fam || rt.rname AS method, cs / CAST(rn AS DOUBLE) AS score
       FROM ks JOIN rt ON floor(CAST(ks.n AS DOUBLE) * rt.r) = ks.rn
       UNION ALL SELECT doc_id, 'loss', avg(lp) FROM ts GROUP BY doc_id
       UNION ALL SELECT doc_id, f.fam || rname, {NAN} FROM docs, rt, (VALUES ('mink_'), ('mink++_')) f(fam)
                 WHERE floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
       UNION ALL SELECT doc_id, 'infill_' || CAST(la_all.L AS VARCHAR) || '_' || rname, 0.0 FROM docs, rt, la_all
                 WHERE T >= 3 AND floor(CAST(T - 1 AS DOUBLE) * r) = 0
       UNION ALL SELECT doc_id, 'loss', {NAN} FROM docs WHERE T < 2)
SELECT doc_id AS item_id, method, round({finite_or0('score')}, 4) AS score FROM sc"""


def lm_mean_scores_sql(A, e, w) -> str:
    """All scores but zlib of the running-mean model over ``documents``: every
    pair of a position and one of the 500 after it, from the definition."""
    V = len(A)
    rows = ", ".join(f"({j}, {d(r)}, '{ratio_name(r)}')" for j, r in enumerate(RATIOS))
    la_all = ", ".join(f"({L})" for L in LOOK_AHEADS)
    far = max(LOOK_AHEADS)
    wa = ", ".join("(" + ", ".join([str(a), *(d(x) for x in A[a]), d(e[a])]) + ")" for a in range(V))
    heads = ", ".join(f"a{v}" for v in range(V))
    vs = range(V)

    def dist(src: str) -> str:
        """lp of the observed token, mu, var of the rows (cur, obs, s)."""
        l0 = ", ".join(f"a{v} + {d(w[v])} * s AS l{v}" for v in vs)
        mx = "greatest(" + ", ".join(f"l{v}" for v in vs) + ")"
        lse = "ln(" + " + ".join(f"exp(l{v} - mx)" for v in vs) + ")"
        p = ", ".join(f"l{v} - mx - lse AS p{v}" for v in vs)
        mu = " + ".join(f"exp(p{v}) * p{v}" for v in vs)
        var = " + ".join(f"exp(p{v}) * (p{v} - mu) * (p{v} - mu)" for v in vs)
        lp = "CASE obs " + " ".join(f"WHEN {v} THEN p{v}" for v in vs) + " END"
        top = "CASE greatest(" + ", ".join(f"p{v}" for v in vs) + ") " + " ".join(f"WHEN p{v} THEN {v}" for v in vs) + " END"
        big = "greatest(" + ", ".join(f"p{v}" for v in vs) + ")"
        return f"""SELECT *, {lp} AS lp, {var} AS var, {top} AS xh, {big} AS lp_xhat FROM (
            SELECT *, {mu} AS mu FROM (SELECT *, {p} FROM (SELECT *, {lse} AS lse FROM (SELECT *, {mx} AS mx FROM (
            SELECT q.*, {l0} FROM {src} q JOIN wa ON wa.a = q.cur)))))"""

    return chain(upto="docs") + f""",
wa AS (SELECT * FROM (VALUES {wa}) t(a, {heads}, e)),
rt AS (SELECT * FROM (VALUES {rows}) t(r_ix, r, rname)),
la_all AS (SELECT * FROM (VALUES {la_all}) t(L)),
di AS (SELECT doc_id, T, list_transform(toks, lambda t: length(t) % {V}) AS ids FROM docs),
dp AS (SELECT doc_id, T, unnest(ids) AS cur, unnest(list_concat(ids[2:], [NULL])) AS obs, unnest(range(0, T)) AS p FROM di WHERE T > 0),
st AS (SELECT doc_id, T, p, cur, obs, e, sum(e) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS tot
       FROM dp JOIN wa ON wa.a = dp.cur),
s0 AS (SELECT *, tot / (p + 1) AS s FROM st WHERE p <= T - 2),
ts AS MATERIALIZED (SELECT doc_id, T, p, cur, obs, tot, lp, mu, var, xh, lp_xhat, (lp - mu) / {sd_floor('var')} AS z_o,
       (lp_xhat - mu) / {sd_floor('var')} AS z_x FROM ({dist("s0")})),
al AS (SELECT doc_id, p AS i, obs AS was, xh, unnest(range(1, least({far}, T - 3 - p) + 1)) AS k FROM ts WHERE p <= T - 4),
ap AS (SELECT al.doc_id, al.i, al.k, ts.z_o, ts.obs, CASE WHEN k = 1 THEN al.xh ELSE ts.cur END AS cur,
              (ts.tot + eh.e - eo.e) / (ts.p + 1) AS s
       FROM al JOIN ts ON ts.doc_id = al.doc_id AND ts.p = al.i + al.k JOIN wa eh ON eh.a = al.xh JOIN wa eo ON eo.a = al.was),
df AS (SELECT doc_id, i, k, z_o - (lp - mu) / {sd_floor('var')} AS x FROM ({dist("ap")})),
s0m AS MATERIALIZED (SELECT doc_id, i, CASE {" ".join(f"WHEN k <= {L} THEN {L}" for L in LOOK_AHEADS)} END AS b,
       sum(x) AS x FROM df GROUP BY ALL),
sm AS (SELECT doc_id, i, L, sum(x) AS later FROM s0m JOIN la_all ON b <= L GROUP BY ALL),
rl AS (SELECT ts.doc_id, ts.T, la_all.L, ts.z_o - ts.z_x + coalesce(later, 0.0) AS ratio
       FROM ts CROSS JOIN la_all LEFT JOIN sm ON sm.doc_id = ts.doc_id AND sm.i = ts.p AND sm.L = la_all.L WHERE ts.T >= 3),
lv AS (SELECT doc_id, T - 1 AS n, 'mink_' AS fam, lp AS v FROM ts
       UNION ALL SELECT doc_id, T - 1, 'mink++_', {z_token("lp", "mu", "var", False)} FROM ts
       UNION ALL SELECT doc_id, T - 1, 'infill_' || CAST(L AS VARCHAR) || '_', {nan_to_num("ratio")} FROM rl),
ks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fam ORDER BY v) AS rn,
              sum(v) OVER (PARTITION BY doc_id, fam ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM lv),
sc AS (SELECT ks.doc_id, ks.fam || rt.rname AS method, cs / CAST(rn AS DOUBLE) AS score
       FROM ks JOIN rt ON floor(CAST(ks.n AS DOUBLE) * rt.r) = ks.rn
       UNION ALL SELECT doc_id, 'loss', avg(lp) FROM ts GROUP BY doc_id
       UNION ALL SELECT doc_id, f.fam || rname, {NAN} FROM docs, rt, (VALUES ('mink_'), ('mink++_')) f(fam)
                 WHERE floor(CAST(greatest(T - 1, 0) AS DOUBLE) * r) = 0
       UNION ALL SELECT doc_id, 'infill_' || CAST(la_all.L AS VARCHAR) || '_' || rname, 0.0 FROM docs, rt, la_all
                 WHERE T >= 3 AND floor(CAST(T - 1 AS DOUBLE) * r) = 0
       UNION ALL SELECT doc_id, 'loss', {NAN} FROM docs WHERE T < 2)
SELECT doc_id, method, round({finite_or0('score')}, 4) AS score FROM sc"""

"""Fixed values of the membership scores.

These must equal the values the scores are defined with, so they are stated
here plainly and in their natural order.
"""

# --- fixed values: look-ahead lengths and order-statistic ratios -----------
LOOK_AHEADS = [0, 1, 3, 5, 10, 20, 50, 100, 200, 500]
RATIOS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

# --- fixed values: the six named snippet variants ----------------------------
VARIANTS = [
    "WikiMIA_length32",
    "WikiMIA_length64",
    "WikiMIA_length128",
    "WikiMIA_length32_paraphrased",
    "WikiMIA_length64_paraphrased",
    "WikiMIA_length128_paraphrased",
]

# --- fixed values: numeric safety bounds -------------------------------------
MIN_LOG_PROB = -100.0          # clip_inf: floor of log-probs and of mu
MIN_VARIANCE = 1e-6            # clip_inf, min-k++ path: floor of the variance
MIN_SD = 1e-6                  # infill path, always: floor of the std dev
Z_CLIP = (-50.0, 50.0)         # clip_inf: per-token standardised score
RATIO_CLIP = (-200.0, 200.0)   # clip_inf: final infill ratio
ROC_SCORE_CLIP = 1e10          # scores are clipped to +-1e10 before the ROC
FLOAT_MAX = 1.7976931348623157e308  # nan_to_num replacement of +-inf

# --- defaults of the job options ---------------------------------------------
DEFAULT_BATCH_SIZE = 16
DEFAULT_TOP_K = 5
UNK = "<unk>"

# The registered queries round scores to this many decimals before the ROC, so
# that float noise between two engines cannot reorder tied documents; the
# operators themselves do not round.
SCORE_DECIMALS = 9


def ratio_name(r: float) -> str:
    return repr(float(r))


def method_names() -> list[str]:
    """All 122 score names in their canonical order."""
    names = ["loss", "zlib"]
    names += [f"mink_{ratio_name(r)}" for r in RATIOS]
    names += [f"mink++_{ratio_name(r)}" for r in RATIOS]
    names += [f"infill_{L}_{ratio_name(r)}" for L in LOOK_AHEADS for r in RATIOS]
    return names

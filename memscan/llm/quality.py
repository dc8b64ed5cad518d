"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and over the common words of
its language is compared with the reference histograms of the language by
Jensen-Shannon distance.  A reference counts documents of equal histograms once
and withstands a third of bad ones: class shares are averaged over documents
that the medians of the shares accept, common-word shares over those of them
with a middling share of common words; documents below a minimum length skip the test that their length
cannot support.

Edge cases: null text counts as no words (base_failed, not kept); an empty
table gives an empty result; a null or unknown ``lang`` is compared with the
pooled histogram of all documents; repeated rows are judged one by one; other
columns pass through untouched (clashing names are overwritten only in the
operator's output columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memscan.llm import common

#: Frequent function words of the supported languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "with", "as", "by", "be"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
}

SPACES = r"[ \t-\r]+"
CLASSES = ("lower", "upper", "digit", "mark", "symbol", "other")
MIN_WORDS_CLASS = 20      # words a text needs for the character-class test
MIN_WORDS_COMMON = 80     # words a text needs for the common-word test
MAX_CLASS_DISTANCE = 0.33
MAX_COMMON_DISTANCE = 0.28
WINDOW = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed; ``_words`` is kept for the caller."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    d = docs.withColumn("_words", words(F.col(text))).withColumn("_lines", lines)
    d = (d.withColumn("n_words", F.size("_words").cast("long"))
         .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
         .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"))
         .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
         .drop("_lines"))
    # hashes of all windows of 8 words, in order
    d = d.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("_win", F.when(
        F.size("_wh") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_wh") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(F.col("_wh"), i, F.lit(WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")))
    rep = F.size("_win") > F.size(F.array_distinct("_win"))
    # only texts with a repeated window pay the sort: (hash, position) pairs
    # sorted by hash put equal windows side by side
    d = d.withColumn("_pairs", F.when(rep, F.sort_array(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_at", F.when(F.col("_pairs").isNotNull(), F.sort_array(F.transform(
        F.filter("_pairs", lambda x, j: (
            (x["h"] == F.get(F.col("_pairs"), j - 1)["h"]) | (x["h"] == F.get(F.col("_pairs"), j + 1)["h"]))),
        lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20)
                     | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.drop("_wh", "_win", "_pairs", "_at")


def histograms(d: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``_cls`` (characters per class, spaces left out) and ``_com``
    (count of each common word of the document's language, then all other
    words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    # each class is what its removal shortens; later passes see short rests
    d = d.withColumn("_r1", F.regexp_replace(t, r"[a-z]+", ""))
    d = d.withColumn("_r2", F.regexp_replace("_r1", r"[ \t-\r]+", ""))
    d = d.withColumn("_r3", F.regexp_replace("_r2", r"[A-Z]+", ""))
    d = d.withColumn("_r4", F.regexp_replace("_r3", r"[0-9]+", ""))
    d = d.withColumn("_r5", F.regexp_replace("_r4", r"[.,;:!?'\"()-]+", ""))
    d = d.withColumn("_r6", F.regexp_replace("_r5", r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", ""))
    size = lambda c: F.length(c).cast("double")
    d = d.withColumn("_cls", F.array(
        F.length(t) - size("_r1"), size("_r2") - size("_r3"), size("_r3") - size("_r4"),
        size("_r4") - size("_r5"), size("_r5") - size("_r6"), size("_r6")))
    # common words as they stand in a text: plain or capitalised, one mark at most after them
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    forms = sorted({f + m for w in every for f in (w, w.capitalize()) for m in ("", *".,;:!?")})
    d = d.withColumn("_low", F.filter("_words", lambda w: w.isin(*forms)))
    d = d.withColumn("_low", F.transform("_low", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))))

    def counts(ws):
        n = [(F.size("_low") - F.size(F.array_remove("_low", w))).cast("double") for w in ws]
        return F.array(*n)

    com = F.lit(None).cast("array<double>")
    for k, ws in COMMON_WORDS.items():
        com = F.when(F.col(lang) == k, counts(ws)).otherwise(com)
    d = d.withColumn("_hits", com)
    total = F.aggregate("_hits", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_com", F.concat("_hits", F.array(F.col("n_words").cast("double") - total)))
    return d.drop("_r1", "_r2", "_r3", "_r4", "_r5", "_r6", "_low", "_hits")


def references(h: DataFrame, lang: str = "lang") -> DataFrame:
    """Class and common-word shares of each supported language, and (with a
    null language) the class shares of all documents: at most
    len(COMMON_WORDS) + 1 rows.  Each distinct pair of histograms weighs the
    same, so neither one long text nor many copies can set the reference.
    Medians are exact on a grid of 0.001, so their buffers stay small."""
    n_cls = len(CLASSES)
    n_com = max(map(len, COMMON_WORDS.values())) + 1
    cls_sum = F.aggregate("_cls", F.lit(0.0), lambda a, x: a + x)
    ok = (h.filter((~F.col("base_failed")) & (F.col("n_words") >= MIN_WORDS_COMMON))
          .select(F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).alias("_own"), "_cls", "_com", "n_words").distinct())
    ok = ok.withColumn("_lang", F.explode(F.when(F.col("_own").isNull(), F.array(F.col("_own")))
                                          .otherwise(F.array(F.col("_own"), F.lit(None).cast("string")))))
    ok = ok.withColumn("_hit", F.round(1 - F.element_at("_com", -1) / F.col("n_words"), 3))
    # what a third of the documents at either end cannot move
    mid = ok.groupBy(F.col("_lang").alias("_of")).agg(
        *[F.percentile(F.round(F.get("_cls", F.lit(i)) / cls_sum, 3), F.lit(0.5)).alias(f"m{i}") for i in range(n_cls)],
        F.percentile("_hit", F.lit(0.35)).alias("_from"), F.percentile("_hit", F.lit(0.65)).alias("_to"))
    mid = mid.select("_of", "_from", "_to", F.array(*[f"m{i}" for i in range(n_cls)]).alias("_mid"))
    all_mid = F.aggregate("_mid", F.lit(0.0), lambda a, x: a + x)
    mid = mid.withColumn("_mid", F.transform("_mid", lambda x: F.when(all_mid > 0, x / all_mid).otherwise(x)))
    ok = ok.join(F.broadcast(mid), F.col("_lang").eqNullSafe(F.col("_of")))
    near = js_distance(F.col("_cls"), F.col("_mid"), cls_sum) <= MAX_CLASS_DISTANCE
    usual = near & F.col("_hit").between(F.col("_from"), F.col("_to"))
    mean = lambda x, of: F.coalesce(F.avg(F.when(of, x)), F.avg(x))
    cls = [mean(F.get("_cls", F.lit(i)) / cls_sum, near).alias(f"c{i}") for i in range(n_cls)]
    com = [mean(F.get("_com", F.lit(i)) / F.col("n_words"), usual).alias(f"w{i}") for i in range(n_com)]
    pick = lambda p, n: F.filter(F.array(*[F.col(f"{p}{i}") for i in range(n)]), lambda x: x.isNotNull())
    return ok.groupBy("_lang").agg(*cls, *com).select(
        "_lang", pick("c", n_cls).alias("_rcls"), F.when(F.col("_lang").isNotNull(), pick("w", n_com)).alias("_rcom"))


def js_distance(counts: Column, ref: Column, total: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms."""
    def term(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(counts, ref, lambda c, q: F.lit(0.5) * (
        term(c / total, (c / total + q) / 2) + term(q, (c / total + q) / 2)))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", stage=None) -> DataFrame:
    """Every input column plus the base columns, class_distance,
    common_distance (null where a guard skips the test) and kept.

    stage: writes a table and reads it back, so that one pass over the texts
    serves the references and the verdicts, and no filter on a verdict is
    pushed into the counting of words; by default all columns are written to
    the shared folder."""
    h = histograms(base_columns(docs, text), text, lang).drop("_words")
    h = stage(h) if stage is not None else common.stage(h, "quality")
    ref = references(h, lang)
    h = h.withColumn("_ref", F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)))
    cls_total = F.aggregate("_cls", F.lit(0.0), lambda a, x: a + x)
    out = h.join(F.broadcast(ref), F.col("_ref").eqNullSafe(F.col("_lang")), "left")
    out = out.withColumn("class_distance", F.when(
        (F.col("n_words") >= MIN_WORDS_CLASS) & F.col("_rcls").isNotNull(),
        js_distance(F.col("_cls"), F.col("_rcls"), cls_total)))
    out = out.withColumn("common_distance", F.when(
        (F.col("n_words") >= MIN_WORDS_COMMON) & F.col("_rcom").isNotNull() & F.col("_com").isNotNull(),
        js_distance(F.col("_com"), F.col("_rcom"), F.col("n_words").cast("double"))))
    bad = (F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False))
           | F.coalesce(F.col("common_distance") > MAX_COMMON_DISTANCE, F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~bad)
    return out.drop("_cls", "_com", "_ref", "_lang", "_rcls", "_rcom")

"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

#: Frequent short words of English, German, Spanish and French; fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "or",
    "der", "die", "das", "und", "ist", "nicht", "von", "zu", "mit", "ein", "eine", "im", "den", "auf", "für",
    "el", "la", "de", "que", "y", "en", "un", "una", "los", "las", "se", "no", "por", "con", "para", "su", "al", "del",
    "le", "les", "des", "et", "est", "une", "du", "dans", "qui", "pour", "pas", "sur", "au", "par", "avec", "elle", "il",
)

#: (measure, least, most): a document stays if each measure lies within its bounds; None is no bound.
THRESHOLDS = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_word_ratio", None, 0.5),
)


def _ratio(part: str | Column, whole: str | Column) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, part / whole).otherwise(0.0)


def compiled(thresholds=THRESHOLDS) -> Column:
    """One boolean expression of a threshold table."""
    held = F.lit(True)
    for measure, least, most in thresholds:
        if least is not None:
            held = held & (F.col(measure) >= least)
        if most is not None:
            held = held & (F.col(measure) <= most)
    return held


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that the table names; a null or empty text has zeros.

    Words found by their exact text: 3-word windows are sorted with their places, equal neighbours give the places of
    repeated windows, and these places the words they cover. The arrays are as long as the document has words. Columns
    of these names are replaced; all other columns pass through.
    """
    text, long = text_of(text_col), lambda c: c.cast("long")
    out = docs.withColumn("__ws_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", long(F.size("__ws_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("__ws_lines", lines).withColumn(
        "__ws_windows",
        F.when(
            F.col("n_words") >= 4,
            F.array_sort(
                F.transform(
                    F.slice("__ws_words", 1, F.size("__ws_words") - 2),
                    lambda w, i: F.struct(
                        F.concat_ws(" ", w, F.get("__ws_words", i + 1), F.get("__ws_words", i + 2)).alias("w"), i.alias("i")
                    ),
                )
            ),
        ),
    )
    again = F.filter(
        "__ws_windows",
        lambda x, k: (F.get("__ws_windows", k - 1)["w"] == x["w"]).eqNullSafe(True) | (F.get("__ws_windows", k + 1)["w"] == x["w"]).eqNullSafe(True),
    )
    out = out.withColumn("__ws_places", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "__ws_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
    )["n"]
    out = (
        out.withColumn("n_repeat_words", long(F.coalesce(covered, F.lit(0))))
        .withColumn("word_chars", long(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))))
        .withColumn("n_symbols", long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))))
        .withColumn("n_dup_lines", long(F.size("__ws_lines") - F.size(F.array_distinct("__ws_lines"))))
        .withColumn("__ws_stop", F.size(F.filter("__ws_words", lambda w: F.lower(w).isin(*STOP_WORDS))))
    )
    out = (
        out.withColumn("mean_word_chars", _ratio("word_chars", "n_words"))
        .withColumn("symbols_per_word", _ratio("n_symbols", "n_words"))
        .withColumn("stop_word_ratio", _ratio("__ws_stop", "n_words"))
        .withColumn("dup_line_ratio", _ratio("n_dup_lines", F.size("__ws_lines")))
        .withColumn("repeat_word_ratio", _ratio("n_repeat_words", "n_words"))
    )
    return out.drop("__ws_words", "__ws_lines", "__ws_windows", "__ws_places", "__ws_stop")


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with its measures, base_failed and kept.

    base_failed: under 50 words, or over half of the words repeat. kept: not base_failed, and all thresholds hold. No
    measure is null, so neither verdict is; null and empty texts fail.
    """
    out = text_measures(docs, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(thresholds))

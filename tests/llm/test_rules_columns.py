"""The quality rules over documents that have columns of the rules' own names."""

from pyspark.sql import functions as F

from wardstone.llm.quality_rules import quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_word_chars", "words", "text_sha256")


def test_own_columns_are_replaced_and_others_pass(spark):
    rows = [(1, "the words of a text " * 30), (2, None), (3, "a#b\na#b\n" * 40), (1, "the words of a text " * 30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain.select("*", *(F.lit("own").alias(x) for x in NAMES))
    want, got = quality_rules(plain), quality_rules(clash)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {(r["words"], r["text_sha256"]) for r in got.collect()} == {("own", "own")}

"""Quality rules: counting rules and the distance of a document's histograms from its language's.

All work is in-row array expressions plus one aggregation by language; nothing but the language
references (one row a language) is joined back, so no text is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import carried, materialise, small, space_words, table

#: Frequent function words of four languages: the buckets of the common-word histogram (fixed values).
COMMON_WORDS = ["the", "of", "and", "to", "in", "is"] + ["de", "la", "le", "et", "les", "que"] + ["der", "die", "und", "den", "von", "das"] + ["el", "en", "los", "se", "por", "con"]
#: Buckets of the character histogram. wide: the bytes that UTF-8 takes beyond one a character; other: letters and punctuation.
CHAR_BUCKETS = ["space", "symbol", "digit", "upper", "wide", "other"]
WINDOW = 8
#: Columns that assess() adds.
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist", "base_failed", "char_distance", "word_distance", "kept")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Documents under these lengths are not judged by their histograms.
    guard_chars: int = 300
    guard_words: int = 50
    #: References of fewer words than this judge nothing.
    guard_reference_words: int = 1000
    max_char_distance: float = 0.30
    max_word_distance: float = 0.45


def _without(text: Column, regex: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, regex + "+", ""))


def _repeated(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""

    def from_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.transform(F.array(F.sort_array(F.transform(again, lambda x: x["i"]))), covered)[0]

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.transform(F.array(pairs), from_sorted)[0]


def _pairs(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long as those hashed, which start step apart."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.lit(0), F.size(hashes) - step)), lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + step)))


def features(docs: DataFrame) -> DataFrame:
    """The columns of docs without text, and per row the counts that the rules and histograms need.

    Windows of 8 words are hashed by doubling (1, 2, 4, 8 words); those of 8 are needed only where one of 4 repeats.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    keep = [c for c in docs.columns if c not in ("text", "lang", *NEW)]
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"), lang.alias("_lang")).withColumn("_w", space_words(F.col("_t")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_h2", _pairs("_h", 1)).withColumn("_h4", _pairs("_h2", 2))
    d = d.withColumn("_h8", F.when(F.size(F.array_distinct("_h4")) < F.size("_h4"), _pairs("_h4", 4)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_c", F.filter("_w", lambda w: w.isin(COMMON_WORDS)))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *keep, "_lang", F.size("_w").cast("long").alias("n_words"), F.length("_t").cast("long").alias("_chars"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), _repeated(F.col("_h8"))).otherwise(0).cast("long").alias("n_repeat_words"),
        _without(F.col("_t"), "[#*$%&|<>]").cast("long").alias("n_symbols"), _without(F.col("_t"), "[0-9]").cast("long").alias("_digits"), _without(F.col("_t"), "[A-Z]").cast("long").alias("_upper"),
        (F.octet_length("_t") - F.length("_t")).cast("long").alias("_wide"), F.size("_c").cast("long").alias("_common"),
        F.array(*[(F.size("_c") - F.size(F.array_remove("_c", x))).cast("long") for x in COMMON_WORDS]).alias("_v"),
    )
    space, known = F.col("_chars") - F.col("word_chars"), F.col("n_symbols") + F.col("_digits") + F.col("_upper")
    return d.select(
        *keep, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars",
        F.array(space, F.col("n_symbols"), F.col("_digits"), F.col("_upper"), F.col("_wide"), F.col("word_chars") - known).alias("char_hist"),
        F.concat("_v", F.array(F.col("n_words") - F.col("_common"))).alias("word_hist"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, b: a + b)
    share = lambda h: F.transform(h, lambda x: x / total(h))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    half = lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2
    both = F.zip_with(share(p), share(q), half)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(both))))


def judge(feats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept. Reads feats twice: give a materialised table."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    d = feats.withColumn("base_failed", failed)
    n_char, n_word = len(CHAR_BUCKETS), len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(n_char)] + [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(n_word)]
    ref = d.filter(~F.col("base_failed")).groupBy("_lang").agg(F.sum("n_words").alias("_ref_words"), *sums)
    ref = ref.select(F.col("_lang").alias("_ref_lang"), "_ref_words", F.array(*[f"c{i}" for i in range(n_char)]).alias("_rc"), F.array(*[f"w{i}" for i in range(n_word)]).alias("_rw"))
    ref = small(materialise(ref, "language_references"))
    d = d.join(ref, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    as_doubles = lambda c: F.col(c).cast("array<double>")
    d = d.withColumn("_hc", as_doubles("char_hist")).withColumn("_hw", as_doubles("word_hist")).withColumn("_qc", as_doubles("_rc")).withColumn("_qw", as_doubles("_rw"))
    d = d.withColumn("char_distance", js_distance(F.col("_hc"), F.col("_qc"))).withColumn("word_distance", js_distance(F.col("_hw"), F.col("_qw")))
    usable = F.coalesce(F.col("_ref_words") >= rules.guard_reference_words, F.lit(False))
    odd = (usable & (F.col("_chars") >= rules.guard_chars) & F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False))) | (
        usable & (F.col("n_words") >= rules.guard_words) & F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False))
    )
    return d.withColumn("kept", ~F.col("base_failed") & ~odd).drop("_hc", "_hw", "_qc", "_qw", "_rc", "_rw", "_ref_words", "_ref_lang")


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs, with its counts, distances and verdict.

    Null or empty text: all counts 0, base_failed, not kept. Null lang forms a language of its own; a language whose
    accepted documents have under guard_reference_words words judges none by histogram. Repeated rows are judged each
    on its own and tie. An empty table gives an empty result. Text and lang are left out; other columns of docs stay, but
    for those named as in NEW, which are replaced.
    """
    rows, back = carried(docs, [c for c in ("doc_id", "text", "lang") if c in docs.columns], ("text", "lang", *NEW))
    return back(judge(materialise(features(rows), "quality_features"), rules), *NEW)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

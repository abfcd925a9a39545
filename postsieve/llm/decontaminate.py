"""Benchmark decontamination with a positional inverted index.

Terms of the test set are counted over the whole corpus; the rarest terms of each test window are its anchors, and
the index stores the (term, document, position) postings of anchors. Postings shifted by the anchor's place in its
item meet in one alignment (document, item, shift) where the passage occurs; alignments that show all anchors of a
window are verified on the document's own words. Every step is DataFrame work on rows of a few numbers; texts are
read four times; only those of documents with alignments, and the few others that pass the filter of sparse_join, move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import ascii_lower, carried, materialise, small, sparse_join, table, words_by

#: Characters outside words, after lower-casing A-Z, and before.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHORS = 2


def tokens(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return words_by(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of terms occurs in docs; terms that never occur are absent."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("term")).join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index: (term, doc_id, pos), stored in the shared folder; of the given terms, or of all."""
    rows = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        rows = rows.join(small(terms), "term", "left_semi")
    return materialise(rows.select("term", "doc_id", "pos").sortWithinPartitions("term", "doc_id", "pos"), "postings")


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of items with words; a window of an item is named by its first word's place."""
    rows = benchmark.filter("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return rows.select(F.xxhash64(F.col("item_id").cast("string"), "words").alias("item"), "item_id", "words")


def _span(words: Column, window: int) -> Column:
    return F.least(F.lit(window), F.size(words))


def alignments(docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, item, shift) where all anchors of some window of the item occur, shift being pos less item pos."""
    at = items.select("item", _span(F.col("words"), window).alias("len"), F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    terms = materialise(at.select("term").distinct(), "terms")
    counts = materialise(term_counts(docs, terms), "term_counts")
    at = at.join(small(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("at") - F.col("len") + 1)
    last = F.least(F.col("at"), F.col("size") - F.col("len"))
    in_window = at.withColumn("start", F.explode(F.sequence(first, last)))
    rarest = in_window.groupBy("item", "start").agg(F.min("n").alias("least"), F.slice(F.sort_array(F.collect_list(F.struct("n", "at", "term"))), 1, anchors).alias("rarest")).filter("least > 0")
    rarest = materialise(rarest.select("item", "start", "rarest"), "windows")
    heads = rarest.select("item", F.explode("rarest").alias("r")).select("item", F.col("r.at").alias("at"), F.col("r.term").alias("term")).distinct()
    heads = materialise(heads, "anchors")
    index = postings(docs, heads.select("term").distinct())
    met = index.join(small(heads), "term").groupBy("doc_id", "item", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("seen"))
    needs = rarest.groupBy("item").agg(F.collect_list(F.transform("rarest", lambda r: r["at"])).alias("needs"))
    met = met.join(small(materialise(needs, "needs")), "item")
    return met.filter(F.exists("needs", lambda n: F.size(F.array_except(n, F.col("seen"))) == 0)).select("doc_id", "item", "shift")


def phrase_hits(words: Column, found: Column, window: int = WINDOW) -> Column:
    """For found (array of item_id, words, shift): array of (item_id, at), at being word places inside windows that occur."""

    def of(f: Column) -> Column:
        same = F.transform(f["words"], lambda w, p: F.coalesce(F.get(words, f["shift"] + p) == w, F.lit(False)))

        def starts(m: Column) -> Column:
            n = _span(f["words"], window)
            ok = F.filter(F.sequence(F.lit(0), F.size(m) - n), lambda s: F.forall(F.slice(m, s + 1, n), lambda x: x))
            return F.flatten(F.transform(ok, lambda s: F.sequence(f["shift"] + s, f["shift"] + s + n - 1)))

        return F.struct(f["item_id"].alias("item_id"), F.transform(F.array(same), starts)[0].alias("at"))

    return F.filter(F.transform(found, of), lambda x: F.size(x["at"]) > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """All rows and columns of docs, with n_words, n_hit, item_ids (sorted as strings) and contaminated.

    Null and empty texts have no words and are clean. Items without an item_id or without words are no items; repeated
    items count once. Rows that repeat a doc_id are each held against their own words, null doc_ids too. Empty tables
    give an empty result or nothing but clean rows. Columns of docs with the names added here are replaced, others stay.
    """
    docs, back = carried(docs, ["doc_id", "text"], ("n_words", "n_hit", "item_ids", "contaminated"))
    items = materialise(_items(benchmark), "items")
    found = alignments(docs, items, window).join(small(items), "item")
    found = materialise(found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "shift")).alias("_found")), "alignments")
    d = sparse_join(docs, found, "doc_id")
    d = d.withColumn("_words", F.when(F.col("_found").isNotNull(), tokens(F.col("text"))))
    d = d.withColumn("_hits", F.coalesce(phrase_hits(F.col("_words"), F.col("_found"), window), F.array().cast(f"array<struct<item_id:{dict(items.dtypes)['item_id']},at:array<int>>>")))
    n_words = F.size(words_by(F.coalesce(F.col("text"), F.lit("")), RAW_BREAKS)).cast("long")
    d = d.withColumn("n_words", n_words).withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["at"])))).cast("long"))
    d = d.withColumn("item_ids", F.sort_array(F.array_distinct(F.transform("_hits", lambda h: h["item_id"].cast("string")))))
    d = d.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return back(d, "n_words", "n_hit", "item_ids", "contaminated")


def phrases(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, pos) of the exact occurrences of each query's (query_id, text) whole word sequence, listed once.

    Null and empty texts and queries give nothing; rows that repeat a doc_id are each held against their own words.
    """
    items = materialise(_items(queries.withColumnRenamed("query_id", "item_id")), "items")
    found = alignments(docs, items, window=1_000_000).join(small(items), "item")
    rows = docs.select("doc_id", tokens(F.col("text")).alias("_w")).join(found.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")))
    ok = F.slice("_w", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    return rows.filter((F.col("shift") >= 0) & ok).select(F.col("item_id").alias("query_id"), "doc_id", F.col("shift").alias("pos")).distinct()


def near(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, pos) where all terms of a query lie within `within` words of an occurrence of its rarest, at pos.

    Each row of docs is looked at on its own, also where rows repeat a doc_id or have none; ties for the rarest go to the
    least term. Null and empty texts and queries give nothing.
    """
    docs = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text")
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = materialise(asked.select("term").distinct(), "terms")
    counts = term_counts(docs, terms)
    asked = materialise(asked.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), "asked")
    per = asked.groupBy("query_id").agg(F.min_by("term", F.struct("n", "term")).alias("rarest"), F.count("*").alias("terms"))
    index = postings(docs, terms)
    head = index.join(small(materialise(per, "rarest")), index["term"] == F.col("rarest")).select("query_id", "terms", "doc_id", F.col("pos").alias("at"))
    rest = index.join(small(asked), "term").select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d"), "term", "pos")
    both = head.join(rest, (F.col("query_id") == F.col("_q")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.abs(F.col("pos") - F.col("at")) <= within))
    return both.groupBy("query_id", "doc_id", "at", "terms").agg(F.count_distinct("term").alias("met")).filter("met = terms").select("query_id", "doc_id.doc_id", F.col("at").alias("pos"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")

"""Benchmark decontamination with a positional inverted index.

Of every 13-word window of a benchmark item the KEYS terms that are rarest in
the corpus are looked up. The index holds their postings (term, document,
position) and nothing of the texts. A posting less the term's place in the item
is the place where the item would start in the document; lists shifted so are
intersected: only places where as many rare terms agree as a window has are
followed further. For these few the postings of all words of their documents
are intersected with the item's words in the same way, which gives the runs of
words that item and document share at that place, and so all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import by_text, named_by_text, small, small_ids, stored, texts, words

WINDOW, KEYS = 13, 3


def items_of(benchmark: DataFrame) -> DataFrame:
    """row (a key of its own, to be stored before use), item_id, item_words and n_item for the different items with words; rows may share an item_id."""
    split = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    return split.select(F.monotonically_increasing_id().alias("row"), "item_id", "item_words", F.size("item_words").alias("n_item"))


def placed_words(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0) and term for every word of the texts."""
    return texts(docs).select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: doc_id, pos and term for each place of a term in `terms`, with what else `terms` has; joined with a broadcast if `terms` is small."""
    return placed_words(docs).join(small(terms), "term")


def _length(n_item: str | Column, window: int) -> Column:
    return F.least(n_item, F.lit(window))


def anchors_of(items: DataFrame, counts: DataFrame, window: int = WINDOW, keys: int = KEYS) -> DataFrame:
    """term, row, item_pos and need for the `keys` rarest places of every window of an item; need is how many of them a window has.

    Windows with a term that the corpus lacks can't occur and have no anchor.
    """
    length = _length("n_item", window)
    starts = items.select("row", "n_item", "item_words", F.explode(F.sequence(F.lit(0), F.col("n_item") - length)).alias("start"))
    places = starts.select("row", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, length)).alias("at", "term"), length.alias("length"))
    place = F.struct("n", (F.col("start") + F.col("at")).alias("item_pos"), "term")
    ranked = places.join(counts, "term").groupBy("row", "start", "length").agg(F.sort_array(F.collect_list(place)).alias("places"))
    rarest = ranked.filter(F.size("places") == F.col("length")).select("row", F.least("length", F.lit(keys)).alias("need"), F.explode(F.slice("places", 1, keys)).alias("p"))
    return rarest.select("p.term", "row", "p.item_pos", "need").distinct()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every place where a window of an item stands in a document: doc_id, item_id, start, length (in words, from 0).

    An item of fewer words than `window`, but not none, is one window. Items
    without words match nothing, nor do documents without. Rows repeated with
    their doc_id give their matches once. Items of one item_id are matched each,
    and a place that several of them match is given once. Rows without doc_id are
    not looked at.
    """
    items = stored(items_of(benchmark), "items")
    counts = postings(docs, items.select(F.explode("item_words").alias("term")).distinct()).groupBy("term").agg(F.count("*").alias("n"))
    anchors = stored(anchors_of(items, counts, window), "anchors")
    shifted = postings(docs, anchors).select("doc_id", "row", (F.col("pos") - F.col("item_pos")).alias("shift"), "need")
    agreed = shifted.groupBy("doc_id", "row", "shift", "need").agg(F.count("*").alias("n")).filter("n >= need")
    candidates = stored(agreed.select("doc_id", "row", "shift"), "candidates")
    each = F.posexplode("item_words").alias("item_pos", "term")
    wanted = candidates.join(small(items), "row").select("doc_id", "row", "shift", each).withColumn("pos", F.col("shift") + F.col("item_pos"))
    there = placed_words(docs.join(small_ids(candidates.select("doc_id").distinct()), "doc_id", "left_semi"))
    met = wanted.join(there, ["doc_id", "pos", "term"]).groupBy("doc_id", "row", "shift").agg(F.sort_array(F.collect_set("item_pos")).alias("at"))
    n, length = F.size("at"), F.col("length")
    runs = F.filter(F.sequence(F.lit(0), n - length), lambda k: F.get("at", k + length - 1) - F.get("at", k) == length - 1)
    starts = F.explode(F.transform(runs, lambda k: F.get("at", k) + F.col("shift")))
    found = met.join(small(items.select("row", "item_id", _length("n_item", window).alias("length"))), "row").filter(n >= length)
    return found.select("doc_id", "item_id", starts.alias("start"), "length").distinct()


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int = 8) -> DataFrame:
    """Places where two terms stand at most `within` words apart, in either order.

    pairs: pair_id, term_a, term_b. Returns pair_id, doc_id, pos_a, pos_b. The
    rarer lists meet in the document's stretch of `within` words or the next one,
    so no two lists are multiplied.
    """
    terms = pairs.select(F.explode(F.array("term_a", "term_b")).alias("term")).distinct()
    index = stored(postings(docs, terms), "postings")
    stretch = F.floor(F.col("pos") / within)
    a = pairs.join(index.withColumnRenamed("term", "term_a"), "term_a").withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1))).withColumnRenamed("pos", "pos_a")
    b = index.select(F.col("term").alias("term_b"), "doc_id", F.col("pos").alias("pos_b"), stretch.alias("stretch"))
    near = F.abs(F.col("pos_a") - F.col("pos_b"))
    return a.join(b, ["term_b", "doc_id", "stretch"]).filter((near <= within) & (near > 0)).select("pair_id", "doc_id", "pos_a", "pos_b")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """contamination() of the rows of by_text(), whose doc_id it keeps."""
    matches = stored(phrase_matches(docs, benchmark, window), "matches")
    hit = matches.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("hit"))
    items = matches.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
    found = hit.join(items, "doc_id")
    counted = texts(docs).select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, "doc_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Per document doc_id, n_words, n_hit (words inside a match), n_items, items_sha256 and contaminated (at least one word in `one_in` is hit).

    Null texts and texts without words have no hits and are not contaminated. Every
    row is judged by its own text, also where rows share a doc_id or lack one;
    repeated rows are returned each time. Empty tables give no rows or no hits;
    columns beyond doc_id, item_id and text are not read.
    """
    return _judged(by_text(docs), benchmark, window, one_in).withColumn("doc_id", named_by_text())


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all their columns kept.

    Nulls, repeated rows and rows that share a doc_id count as in contamination();
    with an empty benchmark all documents stay.
    """
    bad = small_ids(stored(_judged(by_text(docs), benchmark).filter("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "contaminated"))
    key = by_text(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    return key.join(bad, key["doc_id"] == bad["bad"], "left_anti").select("row.*")

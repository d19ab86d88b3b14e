"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import by_text, lower_ascii, named_by_text, small, stored, texts, words

#: The phrases that are looked for word by word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Label and wording of the templates whose words a block must contain.
TEMPLATES = {
    "apache-2": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def template_sets(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """label, token: the distinct words of each template."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("wording")) for k, v in sorted(templates.items())])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.label", F.explode(F.array_distinct(words(F.col("t.wording")))).alias("token"))


def blocks_of(docs: DataFrame) -> DataFrame:
    """doc_id, block (number of the line, from 0) and its distinct words, for the lines with words."""
    lines = texts(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return lines.select("doc_id", "block", F.array_distinct(words(F.col("line"))).alias("tokens")).filter(F.size("tokens") > 0)


def passages_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, block (-1, -2, ... from the start of the text) and `ordered`, 2n words from every n-th word on, of texts of several lines.

    Any n consecutive words stand in one of them, over however many lines they go.
    """
    split = texts(docs).filter(F.contains("text", F.lit("\n"))).select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.ceil(F.size("w") / n).cast("int") - 2, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * n + 1, 2 * n))
    return split.select("doc_id", F.posexplode(cut).alias("at", "ordered")).select("doc_id", (-1 - F.col("at")).alias("block"), "ordered")


def similar_blocks(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every block that contains at least `threshold` of a template's distinct words: doc_id, block, label, containment.

    Blocks are the lines, and all runs of as many consecutive words as the longest
    template has, so that a notice wrapped over lines is found. Runs are looked up
    in passages of twice that length, which stand for the runs inside: these have
    negative numbers and the containment of their best run.

    Tokens are ordered from the globally rarest to the most frequent. A block
    that reaches the threshold shares a token with the template's prefix of
    |T| - ceil(threshold |T|) + 1 rarest tokens; blocks that meet it there must be
    long enough (length filter) and must still be able to reach the overlap from
    the first common place on (positional filter) before the sets are compared.
    Lines without words and empty tables give no rows.
    """
    spark = docs.sparkSession
    tokens = template_sets(spark, templates) if templates else None
    held = sorted({r["token"] for r in tokens.collect()}) if templates else []  # words of the templates alone
    if not held:
        return texts(docs).limit(0).select("doc_id", F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    vocabulary = F.array(*[F.lit(t) for t in held])
    longest = spark.range(1).select(F.greatest(F.lit(1), *[F.size(words(F.lit(v))) for v in templates.values()])).first()[0]
    least = max(tokens.groupBy("label").agg(F.ceil(F.lit(threshold) * F.count("*")).cast("int").alias("need")).agg(F.min("need")).first()[0], 1)
    # Words that no template has cannot change an overlap; each block keeps its template words and its length.
    lines = blocks_of(docs).select("doc_id", "block", F.size("tokens").alias("n_tokens"), F.array_intersect("tokens", vocabulary).alias("tokens"), F.lit(None).cast("array<string>").alias("ordered"))
    passages = passages_of(docs, longest).select("doc_id", "block", F.size("ordered").alias("n_tokens"), F.array_intersect("ordered", vocabulary).alias("tokens"), "ordered")
    known = stored(lines.union(passages).filter(F.size("tokens") >= least), "blocks")
    counts = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = tokens.join(counts, "token", "left").select("label", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token").alias("place"))
    need = F.greatest(F.ceil(F.lit(threshold) * F.size("t")).cast("int"), F.lit(1))
    sets = order.groupBy("label").agg(F.transform(F.sort_array(F.collect_list("place")), lambda x: x["token"]).alias("t")).withColumn("need", need)
    prefix = stored(sets, "templates").select("label", "t", "need", F.posexplode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("at", "token"))
    first = prefix.groupBy("token").agg(F.collect_list(F.struct("label", "t", "need", "at")).alias("met"))
    met = known.select("*", F.explode("tokens").alias("token")).join(small(first), "token").select("doc_id", "block", "n_tokens", "tokens", "ordered", F.explode("met").alias("m")).select("doc_id", "block", "n_tokens", "tokens", "ordered", "m.*")
    could = met.filter((F.col("n_tokens") >= F.col("need")) & (F.size("tokens") >= F.col("need")) & (F.size("t") - F.col("at") >= F.col("need")))
    # A template's tokens from the common place on bound the overlap, for its first common token stands there; only that one is compared.
    overlap = F.size(F.array_intersect("tokens", "t"))
    earliest = F.filter("t", lambda x: F.array_contains(F.col("tokens"), x))[0] == F.col("t")[F.col("at")]
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ordered") - longest, F.lit(0))), lambda i: F.size(F.array_intersect(F.slice("ordered", i + 1, longest), F.col("t"))))
    best = could.filter(earliest & (overlap >= F.col("need"))).withColumn("both", F.when(F.col("ordered").isNull(), overlap).otherwise(F.array_max(runs)))
    return best.filter(F.col("both") >= F.col("need")).select("doc_id", "block", "label", (F.col("both") / F.size("t")).alias("containment"))


def _phrase_starts(array: Column, phrase: str) -> Column:
    parts = phrase.split()
    same = lambda i: [F.get(array, i + F.lit(k)) == F.lit(p) for k, p in enumerate(parts)]

    def here(i: Column) -> Column:
        first, *rest = same(i)
        for r in rest:
            first = first & r
        return first

    return F.filter(F.sequence(F.lit(0), F.size(array) - F.lit(1)), lambda i: F.coalesce(here(i), F.lit(False)))


def phrase_places(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Per document doc_id, n_words and `places`, an array of (start, label), start being the number of words before the phrase.

    Only texts that hold all words of a phrase, and then the phrase by a pattern,
    are searched word by word.
    """
    pattern = "|".join("(?<!" + _WORD + ")" + _GAP.join(p.split()) + "(?!" + _WORD + ")" for p in phrases)
    here = reduce(or_, (reduce(and_, (F.contains("low", F.lit(w)) for w in p.split())) for p in phrases))
    cut = texts(docs).select("doc_id", lower_ascii(F.col("text")).alias("low"), words(F.col("text")).alias("w"))
    labelled = lambda starts, label: F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    places = F.concat(*[labelled(_phrase_starts(F.col("w"), p), label) for p, label in phrases.items()])
    none = F.array().cast("array<struct<start:int,label:string>>")
    return cut.select("doc_id", F.size("w").alias("n_words"), F.when(here & F.col("low").rlike(pattern), places).otherwise(none).alias("places"))


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is the largest containment of a template in a line or in a run of
    words as long as the longest template, and 1 where a phrase stands; 0 where
    nothing was found. Null texts count as empty, and empty texts have no words and
    no labels. Every row has the labels of its own text, also where rows share a
    doc_id or lack one; repeated rows are returned each time. An empty table gives
    no rows; columns beyond doc_id and text are not read.
    """
    docs = by_text(docs)
    blocks = similar_blocks(docs, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("near"), F.max("containment").alias("best"))
    base = phrase_places(docs, phrases)
    starts = F.transform("places", lambda x: x["start"])
    own = F.sort_array(F.array_distinct(F.transform("places", lambda x: x["label"])))
    near = F.coalesce("near", F.array().cast("array<string>"))
    return base.join(blocks, "doc_id", "left").select(
        named_by_text(), F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(own, near)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

"""License scans over notes: fixed phrases, and an exact containment join of word windows with license templates.

Only DataFrame functions run here."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"     # what stands between two words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Opening words of public license notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files"),
]
CONTAINMENT = 0.8


def _words(text: Column) -> Column:
    return F.split(text, GAP, -1)


def _size(words: Column) -> Column:
    """Words of a split text: the pieces less the empty ones, which only stand at its ends."""
    return F.size(words) - (F.element_at(words, 1) == "").cast("int") - (
        (F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def _array(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _phrase_columns(text: Column, n_words: Column) -> dict[str, Column]:
    """Per phrase: places, first and last start word. Words are set in spaces of their own, so that two places never
    share a character; the pieces between the places then give counts and words before the first and after the last."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, GAP, "  "), F.lit(" "))
    out = {}
    for i, (phrase, _) in enumerate(PHRASES):
        parts = phrase.split()
        maybe = text.rlike(GAP.join(parts))
        pieces = F.split(spaced, "".join(f" {w} " for w in parts), -1)
        count = lambda piece: F.regexp_count(piece, F.lit("[^ ]+"))
        found = F.size(pieces) - 1
        out[f"phrase{i}_"] = F.when(maybe, F.when(found > 0, F.struct(
            found.alias("n"), count(F.element_at(pieces, 1)).alias("first"),
            (n_words - count(F.element_at(pieces, -1)) - len(parts)).alias("last"))))
    return out


def template_order(positions: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, note: str = "note") -> list[str]:
    """The templates' words, rarest first: by the number of notes that hold them, over all notes. Bounded by the templates."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    text = F.translate(F.coalesce(F.col(note), F.lit("")), UPPER, LOWER)
    held = positions.select(F.explode(F.array_intersect(_words(text), _array(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(positions: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, note: str = "note",
                  threshold: float = CONTAINMENT) -> DataFrame:
    """`positions` (without the note) with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Base: places where the words of a phrase in PHRASES stand side by side. Beside them every window of a note's words, line
    ends ignored, is a set of words, and a template's label is given when a window of the template's length divided by
    `threshold` holds at least `threshold` of the template's words; words scattered over more than that do not count. The join
    is exact: words are ordered by frequency over all notes; a window and a template that meet the threshold share a word of
    the template's prefix, so only the words around these are paired with it (template side broadcast: it is bounded by the
    templates), then filtered by the template's words among them, then every window over the prefix word is verified.
    `score` is the largest share found, 0 without one.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A null or empty note has
    no words and no labels; repeated rows are scanned one by one; an empty table gives no rows; given columns named like a
    result are replaced."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in positions.columns if c != note and c not in made]
    order = template_order(positions, templates, note=note)
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted({*t.split()}, key=rank.get), int(len(t.split()) / threshold + 1e-9)) for label, t in templates]
    need = [math.ceil(threshold * len(words) - 1e-9) for _, words, _ in sets]
    prefixes = [(w, label, span, len(words), c, words) for (label, words, span), c in zip(sets, need)
                for w in words[:len(words) - c + 1]]
    reach = max((span for _, _, span in sets), default=1) - 1      # words before and after a prefix word that a window can hold
    spark = positions.sparkSession
    table = F.broadcast(spark.createDataFrame(
        prefixes, "word string, label string, span int, size int, need int, template array<string>"))
    rare = _array(sorted({p[0] for p in prefixes}))

    text = F.translate(F.coalesce(F.col(note), F.lit("")), UPPER, LOWER)
    base = (positions.withColumn("text_", text).withColumn("words_", _words(F.col("text_")))
            .withColumn("n_words", _size(F.col("words_")))
            .withColumn("maybe_", F.arrays_overlap("words_", rare)))
    phrases = _phrase_columns(F.col("text_"), F.col("n_words"))
    hits = F.filter(F.array(*[F.col(p) for p in phrases]), lambda p: p.isNotNull())
    named = F.filter(F.array(*[F.when(F.col(p).isNotNull(), F.lit(label)) for p, (_, label) in zip(phrases, PHRASES)]),
                     lambda x: x.isNotNull())
    # the words around every prefix word, and its place among them
    places = F.filter(F.transform("words_", lambda w, i: F.when(F.array_contains(rare, w), i + 1)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(i - reach, F.lit(1))
    near = F.transform(places, lambda i: F.struct(
        F.element_at("words_", i).alias("word"), (i - first(i) + 1).alias("at"),
        F.slice("words_", first(i), i - first(i) + 1 + reach).alias("words")))
    rows = (base.select(*kept, "n_words", "maybe_", "words_", *[c.alias(p) for p, c in phrases.items()])
            .select(*kept, F.col("n_words").cast("long").alias("n_words"),
                    F.aggregate(hits, F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
                    F.array_min(F.transform(hits, lambda p: p["first"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(hits, lambda p: p["last"])).cast("long").alias("last_word"),
                    named.alias("base_"),
                    F.when(F.col("maybe_"), near).alias("blocks_"))
            .withColumn("row_", F.monotonically_increasing_id()))
    tokens = rows.select("*", F.explode_outer("blocks_").alias("block_")).drop("blocks_")
    pairs = tokens.join(table, (F.col("block_.word") == table["word"]) & (
        F.size(F.array_intersect("template", "block_.words")) >= F.col("need")), "left")
    # windows over the prefix word; one that holds the most begins with a word of the template
    starts = F.filter(F.sequence(F.greatest(F.lit(1), F.col("block_.at") - F.col("span") + 1), F.col("block_.at")),
                      lambda k: F.array_contains("template", F.element_at("block_.words", k)))
    shared = lambda k: F.size(F.array_intersect("template", F.slice("block_.words", k, F.col("span"))))
    share = F.when(F.col("label").isNotNull(), F.array_max(F.transform(starts, shared)))
    found = F.when(share >= F.col("need"), F.struct((share / F.col("size")).alias("score"), F.col("label")))
    fields = [c for c in rows.columns if c not in ("blocks_", "row_")]
    whole = (pairs.withColumn("found_", found).groupBy("row_")
             .agg(F.first(F.struct(*fields)).alias("r"), F.collect_set("found_.label").alias("labels_"),
                  F.coalesce(F.max("found_.score"), F.lit(0.0)).alias("score")))
    return whole.select(*[F.col(f"r.{c}").alias(c) for c in kept], "r.n_words", "r.n_base", "r.first_word", "r.last_word",
                        F.array_join(F.array_sort("r.base_"), ",").alias("base_labels"),
                        F.array_join(F.array_sort(F.array_union("r.base_", "labels_")), ",").alias("labels"), "score")


def brute_places(text: str | None) -> list[tuple[int, str]]:
    """Start word and label of every phrase place, word by word (for tests)."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return [(i, label) for phrase, label in PHRASES for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]

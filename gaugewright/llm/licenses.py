"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, seen as sets of words. Words are put in one global order, rarest first, counted over
all blocks. A block that holds at least `least` of a template's words must share a word of the template's prefix (its
first words in that order, one more than may be missing); blocks and prefixes meet in an equi-join, length and
positional filters drop most pairs, and the rest is counted exactly. None of a template's `DECIDING` words may be
missing, however many others are there: 'Licensed under CC BY 4.0' isn't cc-by-nc. Only words of the templates can count, so blocks
are cut down to these before anything moves; the templates are a small fixed table, sent to every task.

With `wrapped`, line ends don't count: a template is found in any run of consecutive words of the text that is no
longer than the template and a quarter more. The join then gets overlapping stretches of the text's template words with
their places, each as long as two such runs of the longest template, and every run in a stretch that meets a template
is counted exactly.

Beside it, the phrases of `PHRASES` are found wherever their words stand consecutively.

Results: a null or empty text has no words, no place and no label (empty text columns, score 0). Repeated rows of one
doc_id, or null ids, are kept apart by nothing but their row, as results are joined back by doc_id and text hash:
equal rows get equal results. Empty tables give empty results. Other columns are not carried. Everything is DataFrame
work.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.session import materialize

# Phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening words of well-known notices with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

# Words that tell a label from other licenses; a block must hold those that the template has.
DECIDING = {
    "mit": {"mit"}, "apache": {"apache"}, "gpl": {"gnu", "general", "public"}, "cc-by-nc": {"cc", "by", "nc"},
    "cc-by-sa": {"creative", "commons", "attribution", "sharealike"}, "mpl": {"mozilla"},
}

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Lower case in which no character but A-Z becomes an ASCII letter; all else beyond ASCII is a word character."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.lower(safe)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAPS), "")


def required(size: int, least: float) -> int:
    """Words of a template of this size that a block must hold."""
    return max(1, -(-int(round(size * least * 1000)) // 1000))


def run_length(template: str) -> int:
    """Consecutive words of a text among which a wrapped template is looked for."""
    return -(-5 * len(template.split()) // 4)


def phrase_places(docs: DataFrame, kept: list[str]) -> DataFrame:
    """Kept columns, n_words, n_base, first_word, last_word, base (array of labels)."""
    tails = sorted({p.split()[-1] for p, _ in PHRASES})
    split = docs.select(*kept, words(F.col("_low")).alias("_w"))

    def stands(phrase: str) -> Callable[[Column], Column]:
        def found(at: Column) -> Column:
            same = [F.get("_w", at + i) == word for i, word in enumerate(phrase.split())]
            return F.coalesce(reduce(Column.__and__, same), F.lit(False))

        return found

    some = F.lit(False)
    for t in tails:
        some = some | F.array_contains("_w", t)
    none = F.array().cast("array<int>")
    spots = split.withColumn("n_words", F.size("_w").cast("long"))
    for i, (phrase, _) in enumerate(PHRASES):
        spots = spots.withColumn(f"_p{i}", F.when(
            some, F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0))), stands(phrase))
        ).otherwise(none))
    every = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    labels = F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])
    return spots.select(
        *kept, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_compact(labels).alias("base"),
    )


def template_hits(blocks: DataFrame, kept: list[str], least: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """Kept columns, number, label and share of every (block, template) pair that meets the threshold.

    blocks: the kept columns and `_set`, the block's distinct template words. Bounded on the driver: one count per
    word of the templates.
    """
    spark = blocks.sparkSession
    sets = [(label, frozenset(text.split())) for label, text in templates]
    counted = blocks.select(F.explode("_set").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counted}
    vocabulary = sorted({w for _, s in sets for w in s}, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(vocabulary)}
    rows, widest = [], 0
    for number, (label, s) in enumerate(sets):
        ranks = sorted(place[w] for w in s)
        need = required(len(s), least)
        prefix = ranks[: len(s) - need + 1]
        deciding = [place[w] for w in DECIDING.get(label, set()) & s]
        rows += [(number, label, r, j, len(s), need, ranks, deciding) for j, r in enumerate(prefix)]
        widest = max(widest, need)
    fewest = min(required(len(s), least) for _, s in sets)
    prefixes = spark.createDataFrame(rows, "template int, label string, rank int, at int, size int, need int, ranks array<int>, deciding array<int>")
    to_rank = F.create_map(*[F.lit(x) for w, i in place.items() for x in (w, i)])
    ranked = (
        blocks.filter(F.size("_set") >= fewest)
        .withColumn("_ranks", F.array_sort(F.transform("_set", lambda w: to_rank[w])))
        .select(*kept, "_ranks", F.posexplode(F.slice("_ranks", 1, F.size("_ranks") - fewest + 1)).alias("_i", "rank"))
    )
    n = F.size("_ranks")
    pairs = ranked.join(F.broadcast(prefixes), "rank").filter(
        (n >= F.col("need")) & (F.least(n - F.col("_i"), F.col("size") - F.col("at")) >= F.col("need") - F.least(F.col("_i"), F.col("at")))
    )
    shared = F.size(F.array_intersect("_ranks", "ranks"))
    decided = F.size(F.array_except("deciding", "_ranks")) == 0
    return pairs.withColumn("_shared", shared).filter((F.col("_shared") >= F.col("need")) & decided).select(
        *kept, F.col("template").alias("number"), "label", (F.col("_shared") / F.col("size")).alias("share")
    )


def stretches(own: DataFrame, kept: list[str]) -> DataFrame:
    """Kept columns, `_spots` (places and template words, in order) and `_set` of overlapping stretches of each text."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    step = max(run_length(t) for _, t in TEMPLATES)  # no run has more template words
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0))), lambda i: F.get("_w", i).isin(vocabulary))
    spots = own.select(*kept, words(F.col("_low")).alias("_w")).select(
        *kept, F.transform(places, lambda i: F.struct(i.alias("p"), F.get("_w", i).alias("w"))).alias("_all")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all"), F.lit(1)), F.lit(step))
    cut = spots.select(*kept, "_all", F.explode(starts).alias("_from")).select(
        *kept, F.slice("_all", F.col("_from"), F.lit(2 * step)).alias("_spots")
    )
    return cut.withColumn("_set", F.array_distinct(F.col("_spots.w")))


def wrapped_hits(blocks: DataFrame, kept: list[str], least: float) -> DataFrame:
    """Kept columns, label and share of every (stretch, template) pair with a run that meets the threshold."""
    rows = []
    for number, (label, t) in enumerate(TEMPLATES):
        s = set(t.split())
        rows.append((number, sorted(s), required(len(s), least), sorted(DECIDING.get(label, set()) & s), run_length(t)))
    looked = blocks.sparkSession.createDataFrame(rows, "number int, _t array<string>, _need int, _must array<string>, _run int")
    met = template_hits(blocks, [*kept, "_spots"], least).select(*kept, "_spots", "number", "label").join(F.broadcast(looked), "number")
    met = met.withColumn("_spots", F.filter("_spots", lambda s: F.array_contains("_t", s["w"])))

    def held(first: Column) -> Column:
        inside = F.filter("_spots", lambda s: (s["p"] >= first["p"]) & (s["p"] < first["p"] + F.col("_run")))
        return F.array_distinct(F.transform(inside, lambda s: s["w"]))

    full = F.filter(F.transform("_spots", held), lambda x: (F.size(x) >= F.col("_need")) & (F.size(F.array_except("_must", x)) == 0))
    best = F.array_max(F.transform(full, lambda x: F.size(x)))
    return met.select(*kept, "label", (best / F.size("_t")).alias("share")).filter("share is not null")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, wrapped: bool = False) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template; 1 with a phrase)."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in TEMPLATES for w in t.split()})])
    own = docs.select(
        F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), lowered(F.col(text)).alias("_low")
    )
    fewest = min(required(len(set(t.split())), least) for _, t in TEMPLATES)
    if wrapped:
        blocks = stretches(own, [key, "_h"])
    else:
        blocks = own.select(key, "_h", F.explode(F.split("_low", "\n")).alias("_line")).select(
            key, "_h", F.array_intersect(words(F.col("_line")), vocabulary).alias("_set")
        )
    # Counted for the order and joined afterwards: kept once, a few words per block.
    blocks = materialize(blocks.filter(F.size("_set") >= fewest))
    hits = (wrapped_hits if wrapped else template_hits)(blocks, [key, "_h"], least).groupBy(key, "_h").agg(
        F.collect_set("label").alias("_more"), F.max("share").alias("_share")
    )
    base = phrase_places(own, [key, "_h"])
    joined = base.alias("b").join(hits.alias("t"), F.col(f"b.{key}").eqNullSafe(F.col(f"t.{key}")) & (F.col("b._h") == F.col("t._h")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.select(
        F.col(f"b.{key}").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def oracle(least: float = 0.8) -> str:
    """DuckDB SQL for the same rows, block by block against every template; without the rule of DECIDING words, on
    which none of the given tables depends."""
    gaps = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}], {required(len(set(t.split())), least)})" for label, t in TEMPLATES
    )

    def stands(phrase: str) -> str:
        return " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))

    spots = ", ".join(f"[i - 1 FOR i IN range(1, len(w) + 1) IF {stands(p)}] AS p{k}" for k, (p, _) in enumerate(PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    base = "[x FOR x IN [" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "] IF x IS NOT NULL]"
    return re.sub(r"\s+", " ", f"""
WITH templates(label, words, need) AS (VALUES {values}),
low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '{gaps}') AS w FROM low),
spots AS (SELECT doc_id, w, {spots} FROM split),
base AS (SELECT doc_id, len(w) AS n_words, len({every}) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word, {base} AS base FROM spots),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{gaps}')) AS b FROM low),
hits AS (SELECT doc_id, label, len(list_intersect(b, words)) / len(words) AS share FROM blocks JOIN templates ON len(list_intersect(b, words)) >= need),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM hits GROUP BY doc_id)
SELECT base.doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more.labels, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM base LEFT JOIN more USING (doc_id)""").strip()


def wrapped_oracle(least: float = 0.8) -> str:
    """DuckDB SQL for the rows with `wrapped`: every run of words that starts with a template's word."""
    sets = [(number, label, t, sorted(set(t.split())), DECIDING.get(label, set())) for number, (label, t) in enumerate(TEMPLATES)]
    values = ", ".join(
        f"({number}, '{label}', {len(s)}, {required(len(s), least)}, {run_length(t)}, {len(must & set(s))})" for number, label, t, s, must in sets
    )
    singles = ", ".join(f"({number}, '{w}', {str(w in must).lower()})" for number, _, _, s, must in sets for w in s)
    hits = """spread AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM split),
own AS (SELECT doc_id, number, p, x, decides FROM spread JOIN singles USING (x)),
runs AS (SELECT a.doc_id, a.number, a.p, count(DISTINCT b.x) AS n, count(DISTINCT b.x) FILTER (b.decides) AS d
FROM own a JOIN templates t ON a.number = t.number JOIN own b ON a.doc_id = b.doc_id AND a.number = b.number AND b.p >= a.p AND b.p < a.p + t.run
GROUP BY a.doc_id, a.number, a.p),
hits AS (SELECT doc_id, label, n / size AS share FROM runs JOIN templates USING (number) WHERE n >= need AND d = must),"""
    sql = oracle(least)
    sql = f"WITH templates(number, label, size, need, run, must) AS (VALUES {values}), singles(number, x, decides) AS (VALUES {singles}), " + sql[sql.index("low AS ("):]
    first, last = sql.index("blocks AS ("), sql.index("more AS (")
    return re.sub(r"\s+", " ", sql[:first] + hits + " " + sql[last:])

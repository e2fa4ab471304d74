"""License scans by a positional index of rare words (DataFrame functions only).

A template is a passage of a license or of its usual notice: words in order, and the key
phrases that must stand in it word for word. The index holds, for each template, the
positions of its rarest words only; rarity is a word's inverse document frequency over all
documents. They are chosen from the rarest on until their weight is more than a passage
may lack (``1 - share`` of the template's), so a passage that agrees well enough holds at
least one of them, and none is missed.

A document's words that are in the index are looked up there. Word place less template
position is the place where the template would start; at that place the words of template and
text are laid beside each other, those that agree at the same relative position add their
weight, and the key phrases must agree in full. The text's words around a looked-up word
(``MOST_WORDS`` each side) go along with it, so the check needs no other look at the text, and
all of it is done where the text was read: per row, only counts, labels and scores are shuffled.

Weights are whole thousandths, so sums don't depend on their order.

Bounds: templates have up to ``MOST_WORDS`` words, the index up to ``MOST_POSTINGS`` rows
(it is broadcast); more are an error. Templates that hold repeated words, and texts of any
length, are fine.

Defined results: a null text is empty; documents are told apart by row, so repeated and null
ids keep their rows; of several passages with one label the best score counts; overlapping
passages all count; without a passage labels are the empty string and the score 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.common import ascii_lower

MOST_WORDS, MOST_POSTINGS = 64, 100_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a template's weight that must agree.
SHARE = 0.8

#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, passage of the license or its notice, key phrases in it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "licensed under the mit license", ("the mit license",)),
    ("mit", "spdx license identifier mit", ("identifier mit",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("apache-2", "spdx license identifier apache 2 0", ("identifier apache 2 0",)),
    ("gpl-2", "the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published", "version 2 of the license")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published", "version 3 of the license")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "authors be held liable for any damages arising")),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
)


POSTING = {"word": "string", "position": "int", "words": "array<string>", "weights": "array<bigint>", "keys": "array<boolean>", "total": "bigint", "least": "bigint", "label": "string", "base": "boolean"}


def license_words(text: Column) -> Column:
    """Words of digits, lower-case letters and characters beyond ASCII, after A to Z are lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def key_positions(passage: list[str], phrases: tuple[str, ...]) -> set[int]:
    """Positions of the key phrases, each at its first place in the passage."""
    found: set[int] = set()
    for phrase in phrases:
        wanted = phrase.split()
        at = next((i for i in range(len(passage)) if passage[i : i + len(wanted)] == wanted), None)
        if at is None:
            raise ValueError(f"the passage doesn't hold its key phrase {phrase!r}")
        found |= set(range(at, at + len(wanted)))
    return found


def weights(docs: DataFrame, vocabulary: list[str], text: str) -> dict[str, int]:
    """Inverse document frequency, in thousandths, of the templates' words over all documents; at least 1."""
    words = F.array_distinct(F.filter(license_words(F.col(text)), lambda w: w.isin(vocabulary)))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counted.collect()}  # a row for each word of the templates, a bounded vocabulary
    total = found.get("", 0)
    return {w: max(1, round(1000 * math.log((total + 1) / max(found.get(w, 0), 1)))) for w in vocabulary}


def index(templates: list[tuple[str, list[str], set[int], float, bool]], weight: dict[str, int]) -> list[tuple]:
    """Postings (word, position, words, weights, key flags, all weight, least weight, label, base) of each template's rarest words."""
    found = []
    for label, words, keys, share, base in templates:
        values = [weight[w] for w in words]
        least, held = (round(1000 * share) * sum(values) + 999) // 1000, 0
        for i in sorted(range(len(words)), key=lambda i: (-values[i], i)):
            found.append((words[i], i, words, values, [k in keys for k in range(len(words))], sum(values), least, label, base))
            held += values[i]
            if held > sum(values) - least:
                break
    return found


def prepared(templates, phrases, share: float) -> list[tuple[str, list[str], set[int], float, bool]]:
    made = [(label, w, set(range(len(w))), 1.0, True) for p, label in phrases for w in [p.split()]]
    made += [(label, w, key_positions(w, keys), share, False) for label, passage, keys in templates for w in [passage.split()]]
    if any(not 0 < len(m[1]) <= MOST_WORDS for m in made) or sum(len(m[1]) for m in made) > MOST_POSTINGS:
        raise ValueError(f"templates have 1 to {MOST_WORDS} words, {MOST_POSTINGS} in all")
    return made


def passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, share: float = SHARE) -> DataFrame:
    """rid, doc_id, n_words; and for each passage found label, base, start, agreed (a share from 0 to 1); a row of nulls where none is found."""
    made = prepared(templates, phrases, share)
    weight = weights(docs, sorted({w for m in made for w in m[1]}), text)
    postings = index(made, weight)
    rows = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(POSTING, p, strict=True)) for p in postings])), f"array<struct<{', '.join(f'{c}: {kind}' for c, kind in POSTING.items())}>>")))
    rare = sorted({p[0] for p in postings})
    split = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), license_words(F.col(text)).alias("all"))
    places = F.filter(F.transform("all", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    #: Each looked-up word with the words from MOST_WORDS before it to MOST_WORDS after it.
    around = lambda i: F.struct(i.alias("at"), F.greatest(i - MOST_WORDS, F.lit(0)).alias("from"), F.slice("all", F.greatest(i - MOST_WORDS, F.lit(0)) + 1, F.lit(2 * MOST_WORDS + 1)).alias("near"))
    looked = split.select("rid", "doc_id", F.size("all").cast("long").alias("n_words"), F.inline_outer(F.transform(places, around)))
    met = looked.withColumn("word", F.get("near", F.col("at") - F.col("from"))).join(F.broadcast(rows), "word", "left")
    start = F.col("at") - F.col("position")
    beside = F.zip_with(F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.size("words")), "words", lambda a, b: a.eqNullSafe(b))
    fit = met.withColumn("start", start).withColumn("beside", F.when(start >= 0, beside))
    agreed = F.aggregate(F.zip_with("beside", "weights", lambda same, w: F.when(same, w).otherwise(0)), F.lit(0).cast("long"), lambda held, w: held + w)
    whole = F.forall(F.zip_with("beside", "keys", lambda same, key: same | ~key), lambda ok: ok)
    found = fit.withColumn("agreed", agreed).withColumn("ok", F.coalesce(whole & (F.col("agreed") >= F.col("least")), F.lit(False)))
    when = lambda c: F.when(F.col("ok"), c)
    return found.select("rid", "doc_id", "n_words", when(F.col("label")).alias("label"), when(F.col("base")).alias("base"), when(F.col("start").cast("long")).alias("start"), when(F.col("agreed") / F.col("total")).alias("agreed"))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of ``docs``."""
    found = passages(docs, doc_id=doc_id, text=text, templates=templates, phrases=phrases, share=share)
    base = lambda c: F.when(F.col("base"), F.col(c))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    summed = found.groupBy("rid", "doc_id", "n_words").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"), listed(base("label")).alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max("agreed"), F.lit(0.0)).alias("score")
    )
    return summed.drop("rid")

"""Operator 3, licence scans: a positional index of rare template words.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.

* Base phrases are found wherever their words stand one after the other.
* Templates: for each, the words that the fewest documents hold are indexed with their positions
  (inverse document frequency over the whole corpus, one aggregate of at most as many rows as the
  templates have words).  Of these, a file's highest-IDF ones are looked up; each place of such a
  word and each posting give a place where the template would start.  Places on which three different
  words or more agree are kept, and there the template's mandatory key phrase must stand, within the
  template's length.  Texts that have the key phrase nowhere are left out before their words are walked.

Only column functions are used.  Words, phrases and templates are parameters of `license_scan`.

Results for odd inputs: null and empty texts have no words, no labels and score 0; long texts are
scanned whole, in time linear in their words but for sorting the places of indexed words; repeated
rows get equal results; an empty table gives no rows.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common licence notices: label, text, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    (
        "lgpl",
        "licensed under the terms of the gnu lesser general public license",
        "lesser general public license",
    ),
    ("cc-by-4.0", "licensed under cc by 4.0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0", "cc by sa 4 0"),
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
        "with or without fee is hereby granted",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "mozilla public license",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "free software foundation either version 3 of the license",
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your option "
        "any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "free software foundation either version 2 of the license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software",
        "to deal in the software without restriction",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "unencumbered software released into the public domain",
    ),
]

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEXED = 16
LOOKED_UP = 8
AGREEING = 3

_OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _spaces(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _words(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(ascii_lower(body), NOT_WORD, " "))
    docs = docs.withColumn("_plain", plain)
    return docs.withColumn(
        "_w",
        F.when(F.col("_plain") == "", F.array().cast("array<string>")).otherwise(
            F.split("_plain", " ")
        ),
    )


def document_frequency(worded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents with each word of the templates; no more rows than the templates have words."""
    held = F.array_intersect(F.col("_w"), _strings(vocabulary))
    counts = worded.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def license_scan(
    docs: DataFrame, *, text: str = "text", phrases=None, templates=None, indexed: int = INDEXED
) -> DataFrame:
    """`docs` with word count, base places and labels, all labels, and a score from 0 to 1.

    The score is 0 without a label, 0.5 for base labels alone, and above that by the largest share of
    the looked-up words of a template that agree on its place.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    worded = _words(without(docs, [*_OUT, "_plain", "_w", "_pad", "_held"]), text)
    split_up = [(label, template_words(t), template_words(key)) for label, t, key in templates]
    vocabulary = sorted({w for _, words, _ in split_up for w in words})
    frequency = document_frequency(worded, vocabulary)

    df = worded.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_pad", F.concat(F.lit(" "), F.col("_plain"), F.lit(" "))
    )
    df, base = _base_places(df, phrases)
    df, found = _template_places(df, split_up, frequency, indexed)
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[b for b in base]))))
    df = df.withColumn("_base_labels", base_labels)
    all_labels = F.array_sort(
        F.array_distinct(
            F.concat(
                "_base_labels",
                F.array_compact(F.array(*[F.when(s > 0, F.lit(label)) for label, s in found])),
            )
        )
    )
    best = F.greatest(*[s for _, s in found], F.lit(0.0))
    df = df.withColumn("_labels", all_labels)
    return df.withColumns(
        {
            "base_labels": F.array_join("_base_labels", ","),
            "labels": F.array_join("_labels", ","),
            "score": F.when(F.size("_labels") == 0, 0.0).otherwise(0.5 + 0.5 * best),
        }
    ).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _OUT], *_OUT)


def _base_places(df: DataFrame, phrases: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """Number of places, first and last start over all phrases; the label of each phrase found.

    What stands between the places of a phrase is cut out once; words before the first and behind
    the last piece give the places.
    """
    parts = {}
    for k, phrase in enumerate(phrases):
        pattern = f"(?<= ){re.escape(phrase).replace(chr(92) + ' ', ' ')}(?= )"
        parts[f"_p{k}"] = F.when(
            F.contains(F.col("_pad"), F.lit(f" {phrase} ")), F.split("_pad", pattern, -1)
        )
    df = df.withColumns(parts)
    firsts, lasts, counts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(phrases.items()):
        pieces = F.col(f"_p{k}")
        length = len(phrase.split(" "))
        counts.append(F.coalesce(F.size(F.when(pieces.isNotNull(), pieces)) - 1, F.lit(0)))
        firsts.append(F.when(pieces.isNotNull(), _spaces(F.element_at(pieces, 1)) - 1))
        lasts.append(
            F.when(
                pieces.isNotNull(),
                F.col("n_words") - length - (_spaces(F.element_at(pieces, -1)) - 1),
            )
        )
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    null = F.lit(None).cast("long")
    number = sum(counts[1:], counts[0])
    return df.withColumns(
        {
            "n_base": F.when(F.col("n_words") > 0, number).otherwise(0).cast("long"),
            "first_word": F.least(*[f.cast("long") for f in firsts], null),
            "last_word": F.greatest(*[f.cast("long") for f in lasts], null),
        }
    ), labels


def _template_places(df, split_up, frequency, indexed) -> tuple[DataFrame, list]:
    """For each template, the share of looked-up words that agree on a verified place, else 0.

    A text without a template's key phrase cannot be verified, and nearly all texts have none: these are done.
    The words of the others are met with the index once; each occurrence of an indexed word gives, for all
    postings of all templates, the place where the template would start.
    """
    found = []
    rarest = [
        sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:indexed] for _, words, _ in split_up
    ]
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, (_, words, _) in enumerate(split_up):
        for at, word in enumerate(words):
            if word in rarest[k]:
                postings.setdefault(word, []).append((k, at))
    posting = [F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in p]) for p in postings.values()]
    index = F.create_map(*[x for w, p in zip(postings, posting, strict=True) for x in (F.lit(w), p)])
    phrases = [" " + " ".join(key) + " " for _, _, key in split_up]
    df = df.withColumn("_said", F.array(*[F.contains(F.col("_pad"), F.lit(p)) for p in phrases]))

    def starts(pair):
        return F.transform(
            F.element_at(index, pair["w"]),
            lambda p: F.struct(p["k"].alias("k"), (pair["i"] - p["at"]).alias("d"), pair["w"].alias("w")),
        )

    met = F.filter(
        F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda p: F.array_contains(_strings(sorted(postings)), p["w"]),
    )
    df = df.withColumn("_spots", F.when(F.array_contains("_said", True), F.flatten(F.transform(met, starts))))
    for k, (label, words, _) in enumerate(split_up):
        mine, top, places = f"_mine{k}", f"_top{k}", f"_at{k}"
        df = df.withColumn(mine, F.when(F.get("_said", F.lit(k)), F.filter("_spots", lambda s: s["k"] == k)))
        # array_intersect keeps the order of its first side: rarest first.
        held = F.array_intersect(_strings(rarest[k]), F.transform(mine, lambda s: s["w"]))
        df = df.withColumn(top, F.slice(held, 1, LOOKED_UP))
        chosen = F.filter(mine, lambda s: F.array_contains(F.col(top), s["w"]))
        agreeing = F.transform(chosen, lambda s: F.struct(s["d"].alias("d"), s["w"].alias("w")))
        df = df.withColumn(
            places, F.when(F.size(top) >= AGREEING, F.sort_array(F.array_distinct(agreeing)))
        )

        def verified(x, i):
            ahead = F.get(places, i + (AGREEING - 1))["d"]
            start = F.greatest(x["d"], F.lit(0))
            stretch = F.slice("_w", start + 1, F.lit(len(words)) + F.least(x["d"], F.lit(0)))
            said = F.concat(F.lit(" "), F.array_join(stretch, " "), F.lit(" "))
            return (ahead == x["d"]) & (x["d"] + len(words) > 0) & F.contains(said, F.lit(phrases[k]))

        kept = f"_ok{k}"
        df = df.withColumn(kept, F.filter(places, verified))
        df = df.withColumn(
            f"_share{k}",
            F.when(
                F.size(kept) > 0,
                F.least(
                    (F.lit(AGREEING - 1) + _longest_run(F.col(kept))) / F.size(top), F.lit(1.0)
                ),
            ).otherwise(0.0),
        )
        found.append((label, F.col(f"_share{k}")))
    return df, found


def _longest_run(kept: Column) -> Column:
    """Most entries with one start; `kept` is sorted by the start."""
    zero = F.struct(
        F.lit(None).cast("int").alias("d"), F.lit(0).alias("n"), F.lit(0).alias("best")
    )

    def step(a, x):
        n = F.when(a["d"] == x["d"], a["n"] + 1).otherwise(1)
        return F.struct(x["d"].alias("d"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(kept, zero, step, lambda a: a["best"])


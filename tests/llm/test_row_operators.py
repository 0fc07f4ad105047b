"""Operators that look at one document at a time, against brute force in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from docrecords.llm import decontaminate, license_index, queries, weak_rules
from docrecords.llm.common import table

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

LONG = "alpha beta gamma delta " * 30_000 + "licensed under cc by-nc 4.0"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Mit License mit license"), (5, "x"), (5, "x"),
    (None, "Apache\nLicense, É License"), (7, LONG), (8, "a b c a b c\na b c a b c\n\x0b\n" * 20),
    (9, "#*$%&|<> !!! 123\r\nÀÉ Übung \U0001f600 " * 60),
]


def odd_documents(spark):
    """Rows with nulls, blanks, ties and repeats, and columns whose names operators use."""
    rows = [(d, t, 7, "old", True, 1.5, ["z"]) for d, t in ODD]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, n_words long, labels string, kept boolean, score double, item_ids array<string>",
    )


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def base_licences(text):
    words = ALNUM.findall((text or "").translate(UPPER))
    places, labels = [], set()
    for phrase, label in license_index.BASE_PHRASES.items():
        want = phrase.split(" ")
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check_licences(rows):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_licences(r.text), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_licences_whole_table(spark, sf):
    check_licences(license_index.license_scan(documents(spark, sf)).collect())


def test_licences_odd_rows(spark):
    rows = license_index.license_scan(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    check_licences(rows)
    assert next(r for r in rows if r.doc_id == 7).labels == "cc-by,cc-by-nc-4.0"
    assert license_index.license_scan(odd_documents(spark).limit(0)).count() == 0


def plain_template_labels(rows):
    """Labels and scores by a plain positional search over all templates."""
    texts = {i: ALNUM.findall((t or "").translate(UPPER)) for i, t in rows}
    held = Counter(w for words in texts.values() for w in set(words))
    out = {}
    for name, words in texts.items():
        labels, best = set(), 0.0
        for label, text, key in license_index.TEMPLATES:
            template, phrase = license_index.template_words(text), license_index.template_words(key)
            rare = sorted(set(template), key=lambda w: (held[w], w))[: license_index.INDEXED]
            top = [w for w in rare if w in words][: license_index.LOOKED_UP]
            agree = defaultdict(set)
            for i, w in enumerate(words):
                for at, x in enumerate(template):
                    if x == w and w in top:
                        agree[i - at].add(w)
            for d, agreed in agree.items():
                stretch = words[max(d, 0) : max(d + len(template), 0)]
                said = any(stretch[j : j + len(phrase)] == phrase for j in range(len(stretch)))
                if len(agreed) >= license_index.AGREEING and said:
                    labels.add(label)
                    best = max(best, len(agreed) / len(top))
        out[name] = (labels, best)
    return out


def test_licence_labels_are_those_of_a_plain_search(spark, sf):
    rows = [tuple(r) for r in documents(spark, sf).collect()]
    for k, (_, text, _) in enumerate(license_index.TEMPLATES):
        words = text.split(" ")
        variants = [text, "Foreword, and then: " + text.upper() + " end", " ".join(words[len(words) // 3 :]), " ".join(words[: len(words) // 2]),
                    " ".join(reversed(words)), text.replace(words[1], "changed"), f"{text} {text}", " ".join([*words[:5], "more", *words[5:]])]
        rows += [(10_000 + 10 * k + n, v) for n, v in enumerate(variants)]
    got = license_index.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_template_labels(rows)
    for r in got:
        labels, best = want[r.doc_id]
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base, r.doc_id
        assert r.score == pytest.approx((0.5 + 0.5 * best) if labels | base else 0.0), r.doc_id


def test_licence_templates(spark):
    texts = [
        (1, "Some code. Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (2, "free charge of granted hereby is permission"),
        (3, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        (4, "with license under the table we use source"),
    ]
    rows = license_index.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit", 2: "", 3: "bsd", 4: ""}


def brute_hits(texts, items, window):
    windows = {}
    for name, text in items:
        words = ALNUM.findall((text or "").translate(UPPER))
        for i in range(max(len(words) - window + 1, min(1, len(words)))):
            windows.setdefault(tuple(words[i : i + window]), set()).add(name)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in texts:
        words = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                got = windows.get(tuple(words[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), names))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 500])
def test_decontaminate_whole_table(spark, sf, block):
    docs, items = documents(spark, sf), table(spark, sf, "benchmark")
    got = decontaminate.decontaminate(docs, items, block_windows=block)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()]
    want = brute_hits([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(rows, key=str) == want
    assert any(r[2] for r in rows)


def test_decontaminate_odd_rows(spark):
    items = [(1, "alpha BETA"), (2, None), (3, ""), (None, "x"), (4, "b c a b c a b c a b c"), (4, "gamma")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(odd_documents(spark), frame)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()]
    assert sorted(rows, key=str) == brute_hits(ODD, items, 10)
    assert set(got.columns) >= {"labels", "kept", "score"}
    none = decontaminate.decontaminate(odd_documents(spark), frame.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.n_hit for r in none)
    assert decontaminate.decontaminate(odd_documents(spark).limit(0), frame).count() == 0


def test_decontaminate_query(spark, sf):
    rows = queries.op9_decontaminate(spark, sf).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == empty) == (r.n_items == 0) for r in rows)


def brute_quality(text):
    text = text or ""
    words = BLANK.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def check_quality(rows):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_quality(r.text), r.doc_id
        assert not (r.base_failed and r.kept) and 0 <= r.quality_posterior <= 1


def test_weak_rules_whole_table(spark, sf):
    rows = weak_rules.quality_votes(documents(spark, sf)).collect()
    check_quality(rows)
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.95 * len(good)


def test_weak_rules_odd_rows(spark):
    rows = weak_rules.quality_votes(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    check_quality(rows)
    assert weak_rules.quality_votes(odd_documents(spark).limit(0)).count() == 0


KINDS = [weak_rules.BOTH_WAYS, weak_rules.FAULT, weak_rules.FAULT, weak_rules.FAULT]


def test_rule_accuracies_are_learned():
    """A rule that goes with the others' faults gains weight; one that fires at random loses its."""
    none = (1, None, None, None)
    patterns = {none: 900, (1, None, None, 0): 100, (0, 0, 0, None): 90, (0, 0, None, 0): 10}
    start = weak_rules.fit({}, KINDS)[1]
    _, odds = weak_rules.fit(patterns, KINDS)
    assert odds[1][0] < start[1][0] and odds[3][0] > start[3][0]
    assert all(row[1] >= 0 >= row[0] for row in odds)


def test_rule_weights_do_not_depend_on_size():
    patterns = {(1, None): 90, (0, 0): 7, (None, 0): 3}
    grown = {k: 1000 * n for k, n in patterns.items()}
    assert weak_rules.fit(patterns, KINDS[:2])[0] == pytest.approx(weak_rules.fit(grown, KINDS[:2])[0])

import re

from tallymark.llm import licenses
from tests.llm.data import documents, near_copies

NOTICES = [
    "Released Under THE MIT License.", "x under the mit license under the mit license",
    "Apache License, Version 2.0 and cc-by-nc", "CC BY NC", "under the mit licence", "cc by", None, "",
    "This work is licensed under the GNU General Public License, version 3.",
    "gnu public general license", "Permission is hereby granted, free of charge, to any person obtaining "
    "a copy of this software and associated documentation files", "All rights reserved.", "rights all reserved",
    "under the M\u0130T license", "\u212a under the mit license \u212a", "under the mit",
]


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], []
    for label, phrase in licenses.BASE_PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += found
        labels += [label] * bool(found)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def scanned(spark, texts):
    docs = documents(spark, texts).withColumnRenamed("lang", "labels")
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs, licenses.build_index(docs)).collect()}


def test_base_against_brute_force(spark):
    texts = NOTICES + near_copies() + [" ".join(["pad"] * 5000 + ["cc", "by", "nc"])]
    rows = scanned(spark, texts)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_labels_of_the_method(spark):
    rows = scanned(spark, NOTICES + near_copies() * 4)
    by_text = {t: rows[i]["labels"] for i, t in enumerate(NOTICES)}
    assert by_text[NOTICES[8]] == "gpl-3"
    assert by_text[NOTICES[9]] == ""
    assert by_text[NOTICES[10]] == "mit"
    assert by_text["All rights reserved."] == "proprietary"
    assert by_text["rights all reserved"] == ""


def test_empty_table(spark):
    assert scanned(spark, []) == {}


def test_notice_of_a_third_of_the_rows(spark):
    notice = " ".join(next(b for label, b, _ in licenses.TEMPLATES if label == "bsd").split())
    texts = [f"w{i} {notice} w{i}" if i % 3 == 0 else f"w{i} all words of this file" for i in range(60)]
    rows = scanned(spark, texts)
    assert [rows[i]["labels"] for i in range(60)] == ["bsd" if i % 3 == 0 else "" for i in range(60)]
    assert all(rows[i]["score"] > 0.999 for i in range(0, 60, 3))
    few = scanned(spark, ["all rights reserved"] * 2 + ["w"] * 8)
    assert [few[i]["labels"] for i in range(3)] == ["proprietary", "proprietary", ""]


def test_file_with_all_notices(spark):
    every = " x ".join(body for _, body, _ in licenses.TEMPLATES)
    rows = scanned(spark, [every, *(body for _, body, _ in licenses.TEMPLATES), *near_copies()])
    assert rows[0]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in rows[1 + i]["labels"].split(",")

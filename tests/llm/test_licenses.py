import random
import re

import pytest

from quire.llm import licenses
from tests.llm.conftest import SF, is_native, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=licenses.TEMPLATES):
    """A row's result, from plain loops over words and templates."""
    w, base, scores, more = split(text), [], [0.0], set()
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    for label, template in templates:
        p = split(template)
        places = {}
        for t in range(len(p) - 2):
            places.setdefault(tuple(p[t : t + 3]), []).append(t)
        diagonals = {}
        for i in range(len(w) - 2):
            for t in places.get(tuple(w[i : i + 3]), []):
                diagonals.setdefault(i - t, []).append((i, t))
        copy, last = [], None
        for d in [*sorted(diagonals), None]:
            if last is not None and (d is None or d - last > licenses.SHIFT):
                covered = len({t + j for _, t in copy for j in range(3)}) / len(p)
                length = max(i for i, _ in copy) + 3 - min(i for i, _ in copy)
                if covered >= licenses.COVERED and length <= len(p) * licenses.LONGER + licenses.SHIFT:
                    more.add(label)
                    scores.append(covered)
                copy = []
            if d is not None:
                copy += diagonals[d]
            last = d
    labels = {label for _, label in base}
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if base else max(scores)


def told(df):
    order = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect())))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_odd_rows(odd_docs):
    df = licenses.license_labels(odd_docs)
    assert told(df) == sorted(repr((r[0], *brute(r[1]))) for r in odd_rows())


def test_no_rows_and_no_templates(spark, no_docs):
    assert licenses.license_labels(no_docs).count() == 0
    df = frame(spark, ["Released under the MIT License"])
    assert licenses.license_labels(df, templates=()).first().labels == ""
    assert licenses.license_labels(df, phrases={}).first().labels == "mit"


def test_only_functions_of_dataframes(spark):
    assert is_native(licenses.op11_license_scan(spark, SF))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("x released under the MIT licence", "mit"),
        ("released under the license", ""),
        ("Released, under THE mit-license!", "mit"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("This work is hereby licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("CC BY cc-by\nall rights  reserved", "cc-by,reserved"),
        ("all rights are reserved; Keep, ccby, cc bу", ""),
        ("Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ],
)
def test_notices(spark, text, labels):
    got = licenses.license_labels(frame(spark, [text])).first()
    assert got.labels == labels
    assert 0 <= got.score <= 1


def test_edited_copies_equal_plain_loops(spark):
    rng, texts = random.Random(11), []
    for n in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(licenses.TEMPLATES)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["the", "license"], ["of"]])
            w += [*["filler"] * rng.randint(0, 3), *t]
        texts.append(" ".join(w))
    df = licenses.license_labels(frame(spark, texts))
    assert told(df) == sorted(repr((n, *brute(t))) for n, t in enumerate(texts))
    assert len({r.labels for r in df.collect()}) > 5


def test_repeated_rows_do_not_add_votes(spark):
    text = "We say: released under the MIT License. And so on."
    df = spark.createDataFrame([(None, text)] * 50 + [(1, text)] * 3, "doc_id bigint, text string").repartition(4)
    spans = licenses.license_spans(df, (("mit", "Released under the MIT License"),)).collect()
    assert sorted((s.doc_id or 0, s.first_word, s.end_word, s.votes, s.coverage) for s in spans) == [(0, 2, 7, 3, 1.0), (1, 2, 7, 3, 1.0)]
    assert licenses.license_labels(df).count() == 53

"""Licence scans against plain searches."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewarden.llm import licence
from tests.llm.fixtures import edge_docs, empty_docs, sf, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=200, deadline=None)
def test_matching_statistics_and_places(templates, text):
    automaton = licence.Automaton(templates)
    for i, (state, size) in enumerate(automaton.statistics(text)):
        def places(n, i=i):
            part = text[i + 1 - n : i + 1]
            return [(t, e) for t, s in enumerate(templates) for e in range(n - 1, len(s)) if s[e + 1 - n : e + 1] == part]
        longest = max(n for n in range(i + 2) if n == 0 or places(n))
        assert size == longest
        if size:
            assert automaton.ends[state] == places(size)


def plain_base(text):
    words = WORD.findall(text.translate(LOWER))
    places, labels = [], set()
    for phrase, label in licence.BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns(spark):
    odd = ["MIT license MIT License x general public license", "the mit-licenseé mit license", "gnu GENERAL\npublic  license, apache_license", "mit mit license license"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string")
    for rows in (docs, sf(spark, at="0.01"), edge_docs(spark)):
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licence.scan_licences(rows).collect()]
        want = [(d, *plain_base(t)) for d, t in texts_of(rows)]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert licence.scan_licences(empty_docs(spark)).count() == 0


def test_template_spans(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice("alpha beta gamma the of delta".split()) for _ in range(n))
    bsd = min((t for label, t in licence.TEMPLATES if label == "bsd" and t.startswith("Redistribution")), key=len)
    broken = bsd.replace("or without modification", "or, alas, without modification")
    half = " ".join(bsd.split()[:8])
    rows = [(1, f"{noise(30)} {bsd.upper()} {noise(20)}"), (2, f"{noise(5)} {broken}"), (3, f"{half} {noise(9)}"), (4, noise(500)), (5, "Licensed under CC BY-NC 4.0.")]
    got = {x.doc_id: x for x in licence.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].score == 1 and got[1].spans[0].first_word == 30 and got[1].spans[0].words == len(bsd.split())
    assert got[2].labels == "bsd" and 0.8 < got[2].score <= 1
    assert got[3].labels == "" and 0 < got[3].score < 0.8
    assert (got[4].labels, got[4].score) == ("", 0.0) and got[5].labels == "cc-by-nc"


def plain_chain(scanner, matches):
    """Every match looks at every chain of its template."""
    spans = []
    for t in sorted({m[0] for m in matches}):
        chains = []
        for _, at, place, size in sorted((m for m in matches if m[0] == t), key=lambda m: (m[2], m[1])):
            fits = [c for c in chains if at + size > c[0] and place + size > c[2] and place - c[2] <= scanner.max_gap]
            if fits:
                c = max(fits, key=lambda c: c[3])
                c[:] = [at + size, c[1], place + size, c[3] + min(size, at + size - c[0], place + size - c[2])]
            else:
                chains.append([at + size, place, place + size, size])
        spans += [(t, c[1], c[2], min(1.0, c[3] / scanner.sizes[t])) for c in chains]
    return spans


def plain_best(scanner, spans):
    """The best span goes first; what shares a word with one that is taken goes."""
    taken = []
    for s in sorted(spans, key=lambda s: (-round(s[3] * scanner.sizes[s[0]]), -s[3], s[2] - s[1], s[1], s[0])):
        if not any(set(range(s[1], s[2])) & set(range(x[1], x[2])) for x in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s[1])


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=2, max_size=10), min_size=1, max_size=4), st.lists(st.sampled_from("abcdx"), max_size=60), st.integers(1, 3), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_chains_and_labels_equal_the_plain_ones(templates, text, min_match, max_gap):
    scanner = licence.Scanner([(f"l{i}", " ".join(t)) for i, t in enumerate(templates)], [], min_match, max_gap, 0.5)
    matches = scanner._matches(scanner._runs([w.encode() for w in text]))
    spans = plain_chain(scanner, matches)
    assert sorted(scanner._chain(matches)) == sorted(spans)
    want = plain_best(scanner, [s for s in spans if s[3] >= 0.5])
    found = scanner.scan(" ".join(text))
    assert [(x["template"], x["first_word"], x["words"]) for x in found[7]] == [(t, a, b - a) for t, a, b, _ in want]
    assert found[5] == ",".join(sorted({f"l{t}" for t, *_ in want})) and found[6] == max((s[3] for s in spans), default=0.0)


def test_every_licence_has_its_own_label():
    scanner = licence.Scanner(licence.TEMPLATES, licence.BASE, 4, 20, 0.8)
    for label, text in licence.TEMPLATES:
        found = scanner.scan(f"Some words before it. {text} And some after.")
        assert {x["label"] for x in found[7]} == {label} and set(found[5].split(",")) == {label, *filter(None, found[4].split(","))}, text
    assert scanner.scan("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License")[5] == "cc-by-nc"


def test_a_repeated_phrase_takes_linear_time():
    import time

    scanner = licence.Scanner(licence.TEMPLATES, licence.BASE, 4, 20, 0.8)
    took = []
    for n in (4_000, 16_000):
        start = time.perf_counter()
        scanner.scan("redistribution and use in source and binary forms " * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.2

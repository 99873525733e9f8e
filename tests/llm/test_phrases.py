"""Phrase collocations against a direct count."""

import random
import re
from collections import Counter, defaultdict

from tabforge.llm import phrases
from tabforge.llm.registry import ORACLES

from .conftest import ROWS, SCHEMA


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows, least):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            total[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(w[i:i + size] for i in range(len(w) - size + 1))
    out = []
    for lang, of in f.items():
        found = []
        often = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], a)
        for p, a in often.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:phrases.REPORTED], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def check(df, rows, least):
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.phrases(df).collect())
    assert got == brute_force(rows, least)
    return got


def test_phrases_equal_a_direct_count(docs, wide_docs, no_docs, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 2)
    assert check(docs, ROWS, 2)
    check(wide_docs, ROWS, 2)
    assert phrases.phrases(no_docs).count() == 0


def corpus(seed, texts, vocabulary):
    rng, rows = random.Random(seed), []
    for i in range(texts):
        text = ""
        for _ in range(rng.randrange(60)):
            # a few words make most of the text, so ranges begin inside their extensions
            text += rng.choice(vocabulary[:3] if rng.random() < 0.6 else vocabulary)
            text += rng.choice([" "] * 12 + ["  ", "\t", ", ", ".\n", ";", "!"])
        rows.append((i % 50, text, rng.choice(["en", "EN", None, "und", "fr"]), "s", 1))
    return rows


def test_ranges_may_begin_inside_a_frequent_word(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 3)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 500)
    rows = corpus(1, 400, ["the", "The", "a", "é", "The-end", "x\x00y", "東京", "a\x1f", "(b)", "thee"])
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, 3)
    assert len({r[0] for r in got}) == 4
    # many more ranges than first words
    kept, _ = phrases.counts(spark.createDataFrame(rows, SCHEMA))
    stream = kept.select("lang", phrases.F.concat("phrase", phrases.F.lit(" ")).alias("key"), "size", "f")
    cuts = phrases.limits(stream, 60)
    dealt = stream.mapInArrow(phrases.dealer(cuts), phrases.DEALT_SQL)
    assert len(cuts) > 30 and dealt.where("carried").count() > 30


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 3)
    monkeypatch.setattr(phrases, "REPORTED", 7)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "bitmap", lambda hashes: phrases.np.full(4096, 255, phrases.np.uint8))
    rows = corpus(2, 100, [f"w{i}" for i in range(12)])
    check(spark.createDataFrame(rows, SCHEMA), rows, 3)


def test_products_pass_64_bits(spark):
    """Counts of 10^13 and more, straight into the streams."""
    big = 10 ** 15
    kept = spark.createDataFrame([("en", 1, "a", 3 * big + 1), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)],
                                 "lang string, size int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    old = phrases.counts
    try:
        phrases.counts = lambda docs: (kept, totals)
        row = phrases.phrases(None).first()
    finally:
        phrases.counts = old
    assert (row.a, row.l, row.r, row.n, row.score) == (big, 3 * big + 1, 2 * big, 9 * big, 2000000 * big // (5 * big + 1))


def test_the_query_has_sql():
    assert "op12_phrase_streams" in ORACLES

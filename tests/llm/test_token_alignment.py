"""Cross-tokenizer alignment against a token-by-token version on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm import token_alignment as ta
from tabforge.llm.common import table
from tabforge.llm.registry import tokenizer_file

from .conftest import ROWS, SCHEMA

A = tokenizer_file("byte_bpe_50k.json").decode()
B = tokenizer_file("piece_bpe_32k.model")


def aligned(pair, text):
    """(ids of A, ids of B, groups as lists of both) of a whole text, or None."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(pair.bytes_a[i]) for i in a]), np.cumsum([len(pair.bytes_b[i]) for i in b])
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        here = [], []
        while i < len(a) and ends_a[i] <= cut:
            here[0].append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            here[1].append(b[j])
            j += 1
        groups.append(here)
    return a, b, groups


def brute_force(rows):
    pair, docs, held = ta.Pair(A, B), [], Counter()
    for doc_id, text, *_ in rows:
        found = aligned(pair, text)
        links = Counter((x, y) for g in (found[2] if found else []) for x in g[0] for y in g[1])
        held.update(links.keys())
        docs.append((doc_id, found, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc_id, found, links in docs:
        if not found:
            out[doc_id, 0, 0, 0, 0, "", 0, 0] += 1
            continue
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in found[2])
        out[doc_id, len(found[0]), len(found[1]), len(found[2]), sum(links.values()),
            hashlib.sha256(written.encode()).hexdigest(),
            sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items())] += 1
    return out


def check(df, rows, **more):
    got = Counter(tuple(r[c] for c in ta.RESULT) for r in ta.alignments(df, A, B, **more).collect())
    assert got == brute_force(rows)


TRICKY = [(100 + i, t, "en", "s", 1) for i, t in enumerate([
    " ", "\n", "a ", "a\n", "\n\na", "a  b", "a \n b", "a\n \n  b", "\ta\tb \t c", "a\x85 b\xa0 c  d", "\x1c a\x1f b",
    "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll 'tis  's", "1234567 12,345.67", "x▁y", "▁", "é́ 😀👍🏽",
    "don't   stop\r\nnow\r", "   lead", "trail   ", "東京 タワー\n\n東京", "\x00\x01 \x7f", "a b  c", "_" * 300,
    "ab" * 500, " " * 100 + "x", "the the the the", "﻿bom ​ zero"])]


def test_alignment_equals_whole_texts(docs, wide_docs, no_docs, spark):
    check(docs, ROWS)
    check(wide_docs, ROWS)
    check(spark.createDataFrame(TRICKY, SCHEMA).repartition(2), TRICKY)
    assert ta.alignments(no_docs, A, B).count() == 0


def test_beyond_the_broadcast_limit(docs):
    check(docs, ROWS, broadcast_bytes=0)


def test_documents_of_the_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


@settings(max_examples=150, derandomize=True, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(" \n\tab.'1é", max_size=30)), max_size=5))
def test_units_tokenise_as_whole_texts(texts):
    pair = ta.aligner(A, B).pair
    assert pair.by_unit and pair.ranked
    for text in filter(None, texts):
        units = [ta.whole_unit(k) for k in ta.units_of(text)]
        assert "".join(units) == " " + text
        order = sorted(range(len(units)), key=lambda i: not pair.plain(units[i]))
        flat, n = pair.ids_a([units[i] for i in order])
        found = dict(zip(order, np.split(flat, n.cumsum())))
        a = [x for i in range(len(units)) for x in found[i].tolist()]
        assert a == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(pair.ids_b(units), []) == pair.b.encode(text)


@settings(max_examples=100, derandomize=True, deadline=None)
@given(st.integers(0, 2**32))
def test_products_equal_dense_ones(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)

    def cut():
        ends = sorted({rng.randrange(1, n + 1) for _ in range(rng.randrange(1, 12))} | {n})
        return np.diff([0, *ends])

    def dense(x):
        out = np.zeros((len(x.at) - 1, x.columns), np.int64)
        np.add.at(out, (x.rows(), x.column), x.value)
        return out

    a, b = cut(), cut()
    left, right = dense(ta.token_bytes(a)), dense(ta.token_bytes(b))
    links = ta.overlaps(a, b)
    assert np.array_equal(dense(links), left @ right.T)
    group_a, group_b = ta.grouped(links)
    ends = np.intersect1d(a.cumsum(), b.cumsum())
    assert np.array_equal(group_a, np.searchsorted(ends, a.cumsum()))
    assert np.array_equal(group_b, np.searchsorted(ends, b.cumsum()))
    assert np.array_equal(dense(ta.shared_groups(group_a, group_b)), group_a[:, None] == group_b[None, :])

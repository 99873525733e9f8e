"""SuperMinHash near-duplicate groups against brute force; word and shingle hashes."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm import shingling, super_minhash

from .conftest import PASSAGE, ROWS, SCHEMA, words


def shingle_set(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_force(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = Counter()
    for i, (r, s) in enumerate(zip(rows, sets)):
        component = least.get(find(i)) if s else r[0]
        out[r[0], len(s), component, r[0] == component] += 1
    return out


def check(df, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in super_minhash.groups(df).collect())
    assert got == brute_force(rows)


def test_groups_equal_brute_force(docs, wide_docs, no_docs):
    check(docs, ROWS)
    check(wide_docs, ROWS)
    assert super_minhash.groups(no_docs).count() == 0


def test_chains_short_sets_and_shared_passages(spark):
    rows = []
    for k in range(40):                                   # chains of small edits, all sizes
        w = words(k, 4 + k).split()
        for step in range(6):
            rows.append((len(rows), " ".join(w), "en", "s", 1))
            w[(step * 5) % len(w)] = f"edit{k}x{step}"
    for k in range(60):                                   # one passage in unrelated texts
        rows.append((len(rows), words(1000 + k, 10 + k) + " " + PASSAGE, "en", "s", 1))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_a_group_that_its_hub_does_not_hold_together(spark, monkeypatch):
    monkeypatch.setattr(super_minhash, "BLOCK_ROWS", 16)
    rng, rows = np.random.default_rng(3), []
    base = words(500, 150).split()
    for k in range(120):                                  # random edits of one text, a third of the pairs link
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, 12), replace=False):
            w[at] = f"edit{k}x{at}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
    for k in range(30):                                   # and a ring of neighbours around it
        w = list(base)
        w[k * 4:k * 4 + 40] = words(700 + k, 40).split()
        rows.append((len(rows), " ".join(w), "en", "s", 1))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_slots_agree_as_often_as_sets_and_vary_less():
    rng, a, b = np.random.default_rng(1), [], []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 125, dtype=np.uint64)
        a.append(np.unique(pool[:100]))
        b.append(np.unique(pool[25:]))
    same = super_minhash.signatures(a) == super_minhash.signatures(b)
    assert abs(same.mean() - 0.6) < 0.01
    assert same.mean(1).std() < 0.9 * (0.6 * 0.4 / super_minhash.VALUES) ** 0.5


def test_early_stopping_and_chunks_change_no_signature(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 90, 3000)]

    def whole(s):                                         # every step of every shingle
        out = [None] * super_minhash.VALUES
        for x in s:
            order = list(range(super_minhash.VALUES))
            for j, step in enumerate(super_minhash._STEPS):
                draw = int(shingling.mix(np.asarray([x + step]))[0])
                k = j + ((draw >> 32) * (super_minhash.VALUES - j) >> 32)
                order[j], order[k] = order[k], order[j]
                offer = (j << 32) + (draw & 0xFFFFFFFF)
                out[order[j]] = offer if out[order[j]] is None else min(out[order[j]], offer)
        return out

    with np.errstate(over="ignore"):
        want = [whole(s) for s in sets[:4]]
    assert super_minhash.signatures(sets)[:4].tolist() == want
    once = super_minhash.signatures(sets)
    monkeypatch.setattr(super_minhash, "CHUNK", 50)
    assert np.array_equal(super_minhash.signatures(sets), once)


@settings(max_examples=200, derandomize=True, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbÉ东 \t\n\x0b .", max_size=200)), max_size=8), st.integers(1, 6))
def test_hashes_are_of_the_words_and_shingles(texts, width):
    hashes, counts = shingling.word_hashes(pa.array(texts, pa.string()))
    split = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    named = {}
    for w, h in zip(itertools.chain(*split), hashes.tolist()):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    flat, limits = shingling.shingle_sets(pa.array(texts, pa.string()), width)
    assert np.diff(limits).tolist() == [len(shingle_set(t, width)) for t in texts]
    every = {s for t in texts for s in shingle_set(t, width)}
    assert len(set(flat.tolist())) == len(every)

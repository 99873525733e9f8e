"""Exact dedup, the Jaccard join and repeated passages against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.llm import common, exact_dedup, jaccard_join, registry, sentencepiece_wfst, suffixes, super_minhash
from tabforge.llm.common import components, filter_rows

from .conftest import PASSAGE, ROWS, SCHEMA, words


def exact(rows):
    """(doc_id, keep_id, size, sha) of each row, and how many rows stay in each group."""
    groups = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        groups[text.encode().translate(None, b" \t\n\v\f\r")].append((-len(text), r[0] if r[0] is not None else 1 << 62, r[0]))
    out = Counter()
    for body, members in groups.items():
        for _, _, d in members:
            out[d, min(members)[2], len(members), hashlib.sha256(body).hexdigest()] += 1
    return out, len(groups)


def check_exact(df, rows, **more):
    got = exact_dedup.groups(df, **more).collect()
    want, n = exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_equals_brute_force(docs, wide_docs, no_docs):
    check_exact(docs, ROWS)
    check_exact(wide_docs, ROWS)
    assert exact_dedup.groups(no_docs).count() == 0


def test_exact_dedup_splits_heavy_prefixes(spark):
    head = "same head " * 30
    rows = [(i, head + words(i % 7, 20) * (i % 5 + 1), "en", "s", 1) for i in range(60)]
    check_exact(spark.createDataFrame(rows, SCHEMA).repartition(4), rows, leaf_bytes=300)


def test_exact_dedup_of_long_texts_with_long_common_prefixes(spark):
    head = words(40, 30) * 9000                           # 1.6 MB
    rows = [(i, head + str(i % 3) + " " * i, "en", "s", 1) for i in range(6)]
    rows += [(10 + i, head[:400_000 + i // 2], "en", "s", 1) for i in range(6)]
    check_exact(spark.createDataFrame(rows, SCHEMA).repartition(6), rows, leaf_bytes=256 << 10)


def test_levels_of_exact_dedup_do_not_repeat_each_other(spark):
    head = "same head " * 30
    df = spark.createDataFrame([(head + words(i % 7, 20),) for i in range(60)], "body string")
    made = exact_dedup.leaves(df.select(F.encode("body", "utf-8").alias("body")), 300)
    assert made.where("offset > 64").count() == 60
    # each level is read from a table of its own, so a plan holds one join a level
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6, plan


@settings(max_examples=50, derandomize=True, deadline=None)
@given(st.lists(st.text("ab", max_size=40)))
def test_radix_groups_are_the_equal_bodies(texts):
    bodies = [t.encode() for t in texts]
    got = {frozenset(g) for g in exact_dedup.radix_groups(bodies, width=2)}
    want = defaultdict(set)
    for i, b in enumerate(bodies):
        want[b].add(i)
    assert got == {frozenset(g) for g in want.values()}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(rows):
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
    return Counter((r[0], len(s), r[0] if not s else least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets)))


def check_jaccard(df, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.groups(df).collect())
    assert got == jaccard(rows)


def test_jaccard_components_equal_brute_force(docs, wide_docs, no_docs):
    check_jaccard(docs, ROWS)
    check_jaccard(wide_docs, ROWS)
    assert jaccard_join.groups(no_docs).count() == 0


def test_jaccard_chains_short_sets_and_shared_passages(spark):
    rows = []
    for k in range(40):                                   # chains of small edits, all sizes
        w = words(k, 5 + k).split()
        for step in range(6):
            rows.append((len(rows), " ".join(w), "en", "s", 1))
            w[(step * 5) % len(w)] = f"edit{k}x{step}"
    for k in range(60):                                   # one passage in unrelated texts
        rows.append((len(rows), words(1000 + k, 10 + k) + " " + PASSAGE, "en", "s", 1))
    check_jaccard(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


@settings(max_examples=200, derandomize=True, deadline=None)
@given(st.integers(1, 120), st.integers(0, 30), st.integers(0, 30), st.integers(0, 2**32), st.integers(0, 90))
def test_linked_sets_share_a_list(n, left, right, seed, common):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, n + left + right, dtype=np.uint64))
    a, b = np.sort(pool[left:]), np.sort(np.concatenate([pool[:left], pool[left + right:]]))
    both = len(np.intersect1d(a, b))
    hot = np.sort(rng.permutation(pool)[:common])
    if len(a) and len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
        light = jaccard_join.boundary()
        keys = [{(kind, family): (set(k.tolist()), least) for kind, k, family, least
                 in jaccard_join.list_keys(s, light, hot)} for s in (a, b)]
        found = [f for f in keys[0].keys() & keys[1].keys()
                 if len(keys[0][f][0] & keys[1][f][0]) >= max(keys[0][f][1], keys[1][f][1])]
        assert np.array_equal(a, b) or found


def test_components_of_a_star_a_chain_and_a_pair(spark):
    edges = [(1, k) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 230)] + [(7, 5), (5, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({k: 1 for k in [1, *range(100, 160)]} | {k: 200 for k in range(200, 231)} | {5: 5, 7: 5})


def test_repeated_passages(docs, no_docs, wide_docs):
    for df in (docs, wide_docs):
        got = {r.doc_id: [(p.start, p.end) for p in r.passages] for r in suffixes.repeats(df).collect()}
        assert set(got) == {1, 2, 3, 4, 8, 9}
        assert got[8] == [(80, 140)] and got[9] == [(30, 90)]
        assert got[1] == got[2] == got[3] == [(0, 120)] and got[4] == [(0, 119)]
    assert suffixes.repeats(no_docs).count() == 0


def test_repeated_passages_of_a_frequent_block_are_linked(spark):
    rows = [(i, words(500 + i, 20) + " " + PASSAGE, "en", "s", 1) for i in range(40)]
    got = suffixes.repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((r.doc_id, r.passages[0].start, r.passages[0].end) for r in got) == [(i, 20, 80) for i in range(40)]


def test_repeated_passages_of_equal_rows_and_rows_without_id(spark):
    """No id and -1 are two documents; equal rows are one, however many, and all get its result."""
    text = words(77, 90)
    got = suffixes.repeats(spark.createDataFrame([(None, text, "en", "s", 1), (-1, text, "en", "s", 1)], SCHEMA)).collect()
    assert {(r.doc_id, r.n_passages, r.repeated_words) for r in got} == {(None, 1, 90), (-1, 1, 90)}
    rows = [(None, text, "en", "s", 1)] * 300
    assert suffixes.repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).count() == 0
    got = suffixes.repeats(spark.createDataFrame([*rows, (5, text, "en", "s", 1)], SCHEMA).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_passages, r.repeated_words) for r in got) == {(None, 1, 90): 300, (5, 1, 90): 1}


def repeated_words(rows, n=50):
    """Passages by brute force: overlapping runs of ``n`` words that another text has too."""
    texts = {(r[0], r[1]): (r[1] or "").encode().lower().split() for r in rows}
    holders = defaultdict(set)
    for who, w in texts.items():
        for p in range(len(w) - n + 1):
            holders[tuple(w[p:p + n])].add(who)
    out = Counter()
    for r in rows:
        w, spans = texts[r[0], r[1]], []
        for p in range(len(w) - n + 1):
            if len(holders[tuple(w[p:p + n])]) > 1:
                if spans and p < spans[-1][1]:
                    spans[-1] = spans[-1][0], p + n
                else:
                    spans.append((p, p + n))
        if spans:
            out[r[0], tuple(spans)] += 1
    return out


def check_repeats(spark, rows):
    got = suffixes.repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = repeated_words(rows)
    assert Counter((r.doc_id, tuple((p.start, p.end) for p in r.passages)) for r in got) == want
    assert all(r.repeated_words == sum(p.end - p.start for p in r.passages) for r in got)
    return want


def test_pairs_behind_a_frequent_boilerplate_are_all_found(spark):
    """Over 1,000 documents open with the same 48 words, and two at a time go on alike: the
    old order of salted parts parted such pairs."""
    shared = words(7, 48)
    rows = [(i, f"{words(5000 + i, 9)} {shared} {words(9000 + i // 2, 6)} {words(20_000 + i, 30)}", "en", "s", 1)
            for i in range(1600)]
    assert len(check_repeats(spark, rows)) == 1600


def test_passages_that_hold_a_frequent_phrase_equal_brute_force(spark):
    """Frequent phrases of 24 to 49 words, of which documents share a part and go on alike on
    one or both sides: blocks of hashes differ there although 50 words or more are equal."""
    rng = np.random.default_rng(3)
    phrases = [words(100 + k, n).split() for k, n in enumerate((24, 31, 40, 45, 48, 49))]
    rows = []
    for i in range(600):
        phrase = phrases[i % len(phrases)]
        a, b = sorted(rng.integers(0, len(phrase) + 1, 2)) if i % 3 == 0 else (0, len(phrase))
        left, right = words(3000 + int(rng.integers(60)), 30).split(), words(4000 + int(rng.integers(60)), 30).split()
        w = [words(5000 + i, int(rng.integers(0, 30))), *left[30 - int(rng.integers(0, 28)):], *phrase[a:b],
             *right[:int(rng.integers(0, 28))], words(8000 + i, int(rng.integers(0, 30)))]
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [rows[5], (None, rows[7][1], "en", "s", 1), (1000, rows[8][1] + " more", "en", "s", 1)]
    assert len(check_repeats(spark, rows)) > 100


def test_neighbours_across_the_borders_of_ranges(spark, monkeypatch):
    """Ranges of a few entries: runs of one document that fill whole ranges, partners two ranges on."""
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 6)
    shared = words(7, 30)
    rows = [(i, f"{words(5000 + i, 9)} {shared} {words(9000 + i // 2, 25)} {words(20_000 + i, 30)}", "en", "s", 1)
            for i in range(60)]
    rows.append((500, " ".join(f"{shared} {words(30_000 + k, 40)}" for k in range(60)), "en", "s", 1))
    assert len(check_repeats(spark, rows)) == 60


def test_the_array_is_sorted_and_matches_are_the_longest(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 6)
    rows = [(i, f"{words(i, 26)} {words(70, 45)} {words(80 + i % 3, 12)} {words(900 + i, 40)}") for i in range(40)]
    texts = spark.createDataFrame(rows, "rid long, text string").repartition(3)
    seeds = texts.mapInArrow(suffixes.seed_rows, suffixes.SEEDS_SQL)
    shared = suffixes.in_two(seeds, "rid", "rid").join(seeds, "handle").where("after = 50")
    array = suffixes.sorted_entries(texts, shared)
    entries = array.collect()
    keys = [(e.handle, bytes(e.right), bytes(e.left)) for e in entries]
    assert array.rdd.getNumPartitions() > 3 and keys == sorted(keys) and len(keys) > 20

    def common(a, b):
        return next((k // 8 for k in range(0, len(a), 8) if a[k:k + 8] != b[k:k + 8]), len(a) // 8)

    longest = {(a.handle, a.around): max(24 + common(a.right, b.right) for b in entries
                                         if a.handle == b.handle and a.low != b.low) for a in entries}
    whole = {k for k, r in longest.items() if r == 50}
    found = {(r.handle, r.around): r.r for r in suffixes.repeated_around(array).collect()}
    assert whole and all(found[k] == 50 for k in whole)


@settings(max_examples=60, derandomize=True, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=8))
def test_entries_beyond_a_range_are_the_nearest_of_two_runs(parts):
    ranges = [[{"low": d, "high": d, "at": (p, k)} for k, d in enumerate(part)] for p, part in enumerate(parts)]

    def two_nearest(entries):                             # the nearest first
        out = entries[:1]
        return out + [e for e in entries if out and e["low"] != out[0]["low"]][:1]

    tails = {p: two_nearest(r[::-1]) for p, r in enumerate(ranges) if r}
    got = suffixes.beyond(tails, sorted(tails))
    for p in tails:
        assert got[p] == two_nearest([e for r in ranges[:p] for e in r][::-1])


def test_stage_keeps_one_of_each_group_whatever_the_ids(docs):
    kept = filter_rows(docs, exact_dedup.dropped_ids)
    assert kept.columns == docs.columns and kept.count() == exact(ROWS)[1]


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that are stars already take no round."""
    df = spark.createDataFrame([(i, 1) for i in range(2, 40)] + [(51, 50)], "a long, b long")
    kept = []
    real = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: (kept.append(1), real(self, *a))[1])
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 40), 1), 50: 50, 51: 50}
    assert len(kept) == 2


def test_components_of_random_edges(spark):
    random = np.random.default_rng(4)
    for nodes, many in ((30, 20), (200, 150), (60, 300)):
        edges = random.integers(0, nodes, (many, 2)).tolist()
        root = list(range(nodes))
        for _ in range(nodes):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_a_chunk_is_small_and_other_stages_memos_go():
    sentencepiece_wfst.compiled(registry.tokenizer_file("piece_bpe_32k.model"))
    rows = [(i, i, f"{i}" + "x" * 1_000_000) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["rid", "doc_id", "text"])
    out = list(exact_dedup.group_locally(iter([batch])))
    assert sum(b.num_rows for b in out) == 20
    assert max(b.nbytes for b in out) < 8 << 20
    assert list(common._HELD) == ["exact_dedup"]


def test_sets_are_made_by_one_python_worker_a_task(spark, docs, monkeypatch):
    for module, name in ((jaccard_join, "jaccard-sets"), (super_minhash, "superminhash-sets")):
        plans = []

        def spy(df, at, name=name, plans=plans):
            if at == name:
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return common.materialise(df, at)

        monkeypatch.setattr(module, "materialise", spy)
        module.groups(docs).collect()
        assert plans
        assert all(len(re.findall("ArrowEvalPython|MapInArrow", p)) == 1 for p in plans)


def test_marked_sets_have_every_wanted_text(spark):
    rows = [(i, words(i, 40)) for i in range(300)]
    texts = spark.createDataFrame(rows, "handle long, text string")
    for wanted in (set(), {7}, set(range(0, 300, 3))):
        frame = spark.createDataFrame([(i,) for i in wanted], "handle long")
        made = jaccard_join.marked_sets(texts, frame, jaccard_join.sets, jaccard_join.MEMBERS_SQL)
        passed = {r.handle for r in jaccard_join.marked(texts, frame).collect()}
        batch = pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in sorted(passed)], pa.string())], ["text"])
        want = Counter(x for b in jaccard_join.sets(iter([batch])) for x in b.column(0).to_pylist()) if passed else Counter()
        assert wanted <= passed
        assert Counter(r.sig for r in made.collect()) == want

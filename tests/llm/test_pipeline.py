"""The pipeline's stages, each held against brute force on its own input, and run()."""

import itertools
import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from tabforge.llm import decontaminate, registry, toxicity
from tabforge.llm.common import materialise

from .conftest import ROWS, SCHEMA
from .test_dedup_join import shingle_set


def copies_kept(rows):
    """doc_ids that stay of equal texts: most code points, then smallest id."""
    best = {}
    for r in rows:
        body = (r.text or "").encode().translate(None, b" \t\n\v\f\r")
        mine = (-len(r.text or ""), r.doc_id)
        best[body] = min(best.get(body, mine), mine)
    return {d for _, d in best.values()}


def near_kept(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    lists, root = defaultdict(list), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    for a, b in {p for docs in lists.values() for p in itertools.combinations(sorted(docs), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d for d in sets if find(d) == d}


def clean(rows, items):
    """doc_ids in which no window of an item agrees well enough on any alignment."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = [w for w in (split(i.text) for i in items) if len(w) >= decontaminate.MIN_WORDS]
    kept = set()
    for r in rows:
        doc, bad = split(r.text), False
        where = defaultdict(list)
        for i, w in enumerate(doc):
            where[w].append(i)
        for item in known:
            n = min(len(item), decontaminate.WINDOW)
            for shift in {i - j for j, w in enumerate(item) for i in where.get(w, ())}:
                same = [0 <= shift + j < len(doc) and doc[shift + j] == w for j, w in enumerate(item)]
                if any(sum(same[j:j + n]) >= n - decontaminate.MISSES[n] for j in range(len(item) - n + 1)):
                    bad = True
        if not bad:
            kept.add(r.doc_id)
    return kept


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input rows, output) of every stage on the smallest driver tables."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in P.STAGES:
        made = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = (docs.collect(), made)
        if name != P.STAGES[-1][0]:
            assert made.columns == docs.columns
        docs = made
    return out


def test_toxicity_stage_drops_what_scores_high(spark, sf_dir, stages):
    rows, made = stages["toxicity"]
    scored = toxicity.score(spark.createDataFrame(rows), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert {r.doc_id for r in made.collect()} == {r.doc_id for r in scored if not r.predicted}


def test_copy_stages_keep_one_of_each_group(stages):
    for name, expected in (("exact_dedup", copies_kept), ("near_dedup", near_kept)):
        rows, made = stages[name]
        assert sorted(r.doc_id for r in made.collect()) == sorted(expected(rows))
        assert made.count() < len(rows)


def test_contaminated_documents_go(spark, sf_dir, stages):
    rows, made = stages["decontamination"]
    want = clean(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())
    assert {r.doc_id for r in made.collect()} == want and len(want) < len(rows)


def test_last_stage_equals_the_library(stages):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=registry.tokenizer_file("piece_bpe_32k.model"))
    rows, made = stages["sentencepiece"]
    texts = {r.doc_id: r.text for r in rows}
    got = made.collect()
    assert len(got) == len(rows) and all(r.ids == library.encode(texts[r.doc_id]) and r.lossless for r in got)


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    assert sorted(P.run(spark, sf_dir).collect()) == sorted(stages["sentencepiece"][1].collect())


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    odd = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as __row", "2 as rid", "3 as sig")
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            made = materialise(stage(spark, docs, sf_dir), f"odd-{name}")
            if name == P.STAGES[-1][0]:
                assert made.count() == docs.count()
            else:
                assert made.columns == odd.columns and made.count() <= docs.count()
                docs = made
    left = materialise(P.drop_near_copies(spark, P.drop_copies(spark, odd, sf_dir), sf_dir), "odd-left").collect()
    assert sum(r.doc_id is None for r in left) == 1 and sum(r.doc_id == 9 for r in left) == 1
    assert {r.doc_id for r in left} >= {1, 8, 10, 12, 13, 14, 15} and not {r.doc_id for r in left} & {2, 3, 4}

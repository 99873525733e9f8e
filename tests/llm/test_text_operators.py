"""Tokenisers, token files, shards, personal data, contamination and the classifiers."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.llm import (decontaminate, pii, quality, registry, sentencepiece_wfst, sharding, token_files,
                          toxicity)

from .conftest import ROWS, SCHEMA, words

PIECES = registry.tokenizer_file("piece_bpe_32k.model")
BPE_JSON = registry.tokenizer_file("word_bpe_49k.json").decode()


# --- SentencePiece ------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=PIECES)


def encode(text, model=PIECES):
    return np.frombuffer(sentencepiece_wfst.compiled(model).encode(text), "<i4").tolist()


def test_pieces_equal_the_library_on_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.ids, r.lossless) for r in sentencepiece_wfst.encode(docs, PIECES).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (library.encode(r.text), True)


@settings(max_examples=300, derandomize=True, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst ABC.,\n\té東😀▁0123"), max_size=60))
def test_pieces_equal_the_library_on_any_text(text):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    ids = encode(text)
    assert ids == library.encode(text)
    assert sentencepiece_wfst.compiled(PIECES).decode(ids) == library.decode(ids)


def test_unigram_model_takes_the_path_of_least_weight():
    """The same pieces read as a unigram model, against every segmentation."""
    model = PIECES.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01")
    t = sentencepiece_wfst.compiled(model)
    assert not t.bpe

    def cheapest(unit):
        best = [0.0] + [float("inf")] * len(unit)
        for end in range(1, len(unit) + 1):
            for at in range(end):
                if unit[at:end] in t.id:
                    best[end] = min(best[end], best[at] - t.score[t.id[unit[at:end]]])
        return best[-1]

    for unit in ("▁thonerha", "▁in", "▁the", "tion", "▁reading"):
        assert sum(-t.score[i] for i in t.shortest(unit)) == pytest.approx(cheapest(unit))


def test_pieces_of_odd_rows(docs, no_docs, wide_docs, library):
    for df in (docs, wide_docs):
        got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.lossless) for r in sentencepiece_wfst.encode(df, PIECES).collect())
        want = Counter((d, tuple(i := library.encode(t or "")), len(i), "▁" not in (t or "")) for d, t, *_ in ROWS)
        assert got == want
    assert sentencepiece_wfst.encode(no_docs, PIECES).count() == 0
    back = docs.where("doc_id = 13").select(sentencepiece_wfst.encoder(PIECES)("text").ids.alias("i"))
    assert back.select(sentencepiece_wfst.decoder(PIECES)("i")).first()[0] == ROWS[15][1]


# --- token files --------------------------------------------------------------
@settings(max_examples=100, derandomize=True, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(1000, 1100), min_size=1, max_size=300))
def test_blocks_round_trip(values):
    ids = np.asarray(values, np.uint32)
    f = token_files.TokenFile(token_files.write_file([3, None], [len(ids), 0], ids, block=64))
    assert np.array_equal(f.ids(0, len(ids)), ids) and f.doc_ids == [3, None]
    a, b = sorted((len(ids) // 3, 2 * len(ids) // 3))
    assert np.array_equal(f.ids(a, b), ids[a:b])


def test_outliers_go_to_the_exception_list():
    ids = np.asarray([5] * 95 + [60_000] * 5, np.uint32)
    low, width, n, exceptions = token_files.BLOCK_HEAD.unpack_from(token_files.pack_block(ids))
    assert (low, width, n, exceptions) == (5, 0, 100, 5)
    assert np.array_equal(token_files.unpack_block(token_files.pack_block(ids), 0), ids)


def expected_tokens(rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(BPE_JSON)
    out, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, e in zip(order, tokenizer.encode_batch([r[1] or "" for r in order], add_special_tokens=False)):
        ids = np.asarray([*e.ids, 1], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return Counter(out)


def test_plain_words_go_to_the_model_alone(monkeypatch):
    """Words of printable ASCII skip the normaliser; their ids are those of whole texts."""
    token_files.encode_texts(BPE_JSON, ["seed"])
    tokenizer, _, *rest = token_files._TOKENIZERS[BPE_JSON]
    asked = []

    class Spy:
        def encode_batch_fast(self, xs, **kw):
            asked.extend(xs)
            return tokenizer.encode_batch_fast(xs, **kw)

    monkeypatch.setitem(token_files._TOKENIZERS, BPE_JSON, (Spy(), {}, *rest))
    texts = ["It's''s 'LL we've'd 'TIS 12a3--b,c.", "Caf\u00e9 A\x01B \x7f It'S x\x1cy", "<|startoftext|>A <|x B|> b<|endoftext|>", ""]
    got = token_files.encode_texts(BPE_JSON, texts)
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert got == [np.asarray([*e.ids, 1], "<u4").tobytes() for e in want]
    assert set(asked) == {"Caf\u00e9", "A\x01B", "\x7f", "x\x1cy", "<|startoftext|>A", "<|x", "b<|endoftext|>"}


def test_latin_words_are_cut_and_each_piece_encoded_once(monkeypatch):
    """Punctuation and digits around a word beyond ASCII make no further call of the tokenizer;
    signs, letters without one lower-case letter and apostrophes leave a word whole."""
    token_files.encode_texts(BPE_JSON, ["seed"])
    tokenizer, _, *rest = token_files._TOKENIZERS[BPE_JSON]
    asked = []

    class Spy:
        def encode_batch_fast(self, xs, **kw):
            asked.extend(xs)
            return tokenizer.encode_batch_fast(xs, **kw)

    monkeypatch.setitem(token_files._TOKENIZERS, BPE_JSON, (Spy(), {}, *rest))
    texts = ["caf\u00e9 (caf\u00e9), caf\u00e9!1 2caf\u00e9<", "\u010cas>X 12\u00c4|\u00c4V", "",
             "a\u00d7b \u0130x \u0149d 's\u017f caf\u00e9's e\u0301. \u6771."]
    got = token_files.encode_texts(BPE_JSON, texts)
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert got == [np.asarray([*e.ids, 1], "<u4").tobytes() for e in want]
    assert sorted(asked) == sorted(["caf\u00e9", "\u010cas", "\u00c4", "\u00c4V", "a\u00d7b", "\u0130x", "\u0149d", "'s\u017f",
                                    "caf\u00e9's", "e\u0301.", "\u6771."])


def test_token_files_round_trip(docs, no_docs, wide_docs):
    for df in (docs, wide_docs):
        got = token_files.round_trip(df, BPE_JSON)
        assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == expected_tokens(ROWS)
    assert token_files.round_trip(no_docs, BPE_JSON).count() == 0


def test_small_files_keep_the_order(spark, sf_dir):
    from tabforge.llm.common import materialise
    from tabforge.session import scratch_path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = "file://" + scratch_path(spark, "few").removeprefix("file:")
    manifest = materialise(token_files.write_files(docs, BPE_JSON, folder, file_ids=3000), "few")
    assert manifest.count() > 20
    got = token_files.read_files(spark, folder, manifest)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == expected_tokens(rows)


@settings(max_examples=200, derandomize=True, deadline=None)
@given(st.text(st.sampled_from("abcXYZ Σςİ'sé́H̱ 　\t\n<|endoftext|>#1½東"), max_size=50))
def test_word_by_word_encoding_equals_the_whole(text):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_str(BPE_JSON).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_files.encode_texts(BPE_JSON, [text])[0], "<u4").tolist() == [*whole, 1]


# --- shards -------------------------------------------------------------------
def test_shards_match_the_mixture(spark):
    rows = [(i, "t" * (i % 50), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(2000)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(5), range_rows=100).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(i, i % 50 + 16) for i in range(2000)]
    assert set(Counter(r.shard for r in got).values()) == {50}
    for shard in range(40):
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(50))
        for source, n in Counter(r[3] for r in rows).items():
            assert abs(sum(r.source == source for r in mine) - n / 40) < 2


def test_shards_equal_the_sql_on_odd_rows(docs, no_docs, wide_docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(sharding.ORACLE)
    names = [d[0] for d in want.description]
    want = Counter(want.fetchall())
    for range_rows in (1, 3, 1000):
        got = sharding.assign(wide_docs, range_rows=range_rows).select(names)
        assert Counter(map(tuple, got.collect())) == want
    assert sharding.assign(no_docs).count() == 0


def test_rows_without_id_or_equal_rows_are_ranked_in_many_ranges(spark):
    """Most rows have no doc_id, and most of these are equal: no range holds them all, ranks are gapless."""
    rows = [(None, "same", "en", "hot", 1)] * 300 + [(7, f"t{i}", "en", "hot", 1) for i in range(60)]
    rows += [(i, f"u{i}", "en", None, 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.assign(df, range_rows=50).collect()
    assert sorted(r.position for r in got) == list(range(400))
    assert Counter(r.shard for r in got) == {k: 10 for k in range(40)}
    assert Counter((r.shard, r.source) for r in got) == Counter({(k, s): n for k in range(40) for s, n in (("hot", 9), (None, 1))})
    ordered = sharding._positions(df.withColumn("row", F.monotonically_increasing_id()), 400, 50, "doc_id", "row")
    sizes = [p["n"] for p in ordered.groupBy(F.floor(F.col("position") / 50).alias("k")).agg(F.count("*").alias("n")).collect()]
    assert sizes == [50] * 8


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer
    assert token_files.by_words(BPE_JSON)
    model = registry.tokenizer_file("byte_bpe_50k.json").decode()
    texts = ["Hello  World\n said NASA", "", " a b"]
    want = [e.ids for e in Tokenizer.from_str(model).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist()[:-1] for x in token_files.encode_texts(model, texts)]
    assert got == want and not token_files.by_words(model)


# --- personal data ------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text)
            if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=500, derandomize=True, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123456789\n%"), max_size=60) | st.from_regex(EMAIL)
       | st.from_regex(IP) | st.from_regex(PHONE))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data_of_odd_rows(docs, no_docs, wide_docs):
    for df in (docs, wide_docs):
        got = pii.find(df).collect()
        assert Counter((r.doc_id, r.base) for r in got) == Counter(
            (d, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t or ""))) for d, t, *_ in ROWS)
    thirteen = next(r for r in got if r.doc_id == 13)
    assert (thirteen.n_email, thirteen.n_ip, thirteen.n_card, thirteen.n_phone) == (1, 1, 1, 1)
    assert pii.digests(no_docs).count() == 0


def test_revealing_terms_are_found_and_common_ones_left(spark):
    rows = [(i, f"{words(i, 30)} write to zorblatt at ceo@firm.example.com or call the desk {words(50 + i, 30)}",
             "en", "s", 1) for i in range(5)]
    rows += [(100 + i, f"write to the desk or call {words(200 + i, 20)}", "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i in range(5):
        found = {rows[i][1][t.start:t.end] for t in got[i].terms}
        assert "zorblatt" in found and not found & {"the", "desk", "write", "call"}
    assert not any(got[100 + i].spans for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "the desk" in clean[0]
    assert clean[100] == rows[5][1]


def test_terms_far_from_a_mention_of_a_rare_entity_are_found(spark):
    """Two documents of an entity, terms further off than any line, a name of two letters and
    one with digits, once in each document and again behind it."""
    filler = [" ".join(f"common{'abcdefghij'[(i * k) % 10]}" for k in range(1, 60)) for i in range(400)]
    rows = [(i, f"{filler[i]} Bo and k9unit say {filler[i]} mail ceo@firm.example.com {filler[i]} bo", "en", "s", 1)
            for i in range(2)]
    rows += [(i, f"{filler[i]} and say mail" + (" single@person.example.com lonely" if i == 50 else ""), "en", "s", 1)
             for i in range(2, 400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i in range(2):
        assert sorted(rows[i][1][t.start:t.end] for t in got[i].terms) == ["Bo", "bo", "k9unit"]
    assert not any(got[i].terms for i in range(2, 400))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not re.search(r"(?i)\bbo\b|k9unit", clean[0] + clean[1]) and "[EMAIL]" in clean[0]


def test_a_list_of_contacts_is_paired_with_its_terms_once(spark, monkeypatch):
    made, keep = {}, pii.materialise

    def counted(df, name):
        out = keep(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(pii, "materialise", counted)
    contacts = " ".join(f"person{i}@mail{i % 7}.example.org" for i in range(200))
    body = " ".join("".join(chr(97 + (k * 7 + j * (k + 3)) % 26) for j in range(6)) for k in range(400))
    rows = [(i, contacts + " " + body, "en", "s", 1) for i in range(8)]
    rows += [(10 + i, words(i, 60), "en", "s", 1) for i in range(60)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0].n_email == 200 and found[0].terms
    assert 0 < made["pii-pairs"] <= 8 * 450


def test_pairs_beyond_any_float_of_bits_are_judged(spark):
    """An entity and its term in 500 of 1,200 documents surprise by over 1,100 bits."""
    assert pii.least_bits({pii.MOST_BITS: 1}, 10 ** 12) == pii.MOST_BITS
    assert pii.least_bits({1500: 2, 30: 100, 3: 5}, 10 ** 9) == 30
    assert pii.least_bits({1023: 3, 0: 5}, 10 ** 400) == pii.MOST_BITS + 1
    rows = [(i, "mail" + (" quillfeather at ceo@firm.example.com" if i < 500 else " nobody at all"), "en", "s", 1)
            for i in range(1200)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all([rows[i][1][t.start:t.end] for t in got[i].terms] == ["quillfeather"] for i in range(500))
    assert not any(got[i].spans for i in range(500, 1200))


def test_sanitising_with_clashing_columns(docs, wide_docs):
    plain = {(r.doc_id, r.text) for r in pii.sanitise(docs).collect()}
    wide = pii.sanitise(wide_docs)
    assert wide.columns == wide_docs.columns and {(r.doc_id, r.text) for r in wide.collect()} == plain


def test_classifiers_with_clashing_columns(docs, wide_docs, spark):
    from pyspark.sql import functions as F
    marks = docs.where("doc_id is not null").select("doc_id").distinct().withColumns(
        {"quality": (F.col("doc_id") % 2).cast("int"), "toxic": (F.col("doc_id") % 2).cast("int")})
    for module in (quality, toxicity):
        rows = lambda df: sorted((str(r.doc_id), r.score) for r in module.score(df, marks).collect())  # noqa: B023, E731
        assert rows(wide_docs) == rows(docs)
    assert toxicity.reject(wide_docs, marks).columns == wide_docs.columns


# --- contamination ------------------------------------------------------------
def test_masks_are_lossless():
    """However the allowed words differ, some mask fits between them."""
    for n, misses in decontaminate.MISSES.items():
        for bad in itertools.combinations(range(n), misses):
            assert any(not {at + k for k in mask} & set(bad)
                       for mask in decontaminate.MASKS for at in range(n - mask[-1]))


def test_contamination_with_substitutions(spark, docs, no_docs, wide_docs):
    item = words(77, 30).split()
    changed = item.copy()
    for k in range(4, 30, 7):                             # at most 2 of any 13 words
        changed[k] = "other"
    spoiled = item.copy()
    for k in range(2, 30, 4):                             # 3 or more of any 13 words
        spoiled[k] = "other"
    short = words(78, 10).split()
    rows = [(1, words(1, 50) + " " + " ".join(item) + " " + words(2, 50), "", "", 1),
            (2, words(3, 50) + ", " + "; ".join(changed).upper(), "", "", 1),
            (3, words(4, 50) + " " + " ".join(spoiled), "", "", 1),
            (4, " ".join(item[8:22]), "", "", 1), (5, " ".join(item[8:18]), "", "", 1),
            (6, "x " + " ".join(short[:4] + ["other"] + short[5:]) + " y", "", "", 1),
            (7, "the cat", "", "", 1), (8, None, "", "", 1), (9, "", "", "", 1)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "the cat"), (4, None), (5, "")],
                                  "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (decontaminate.BROADCAST_BYTES, 0):      # broadcast and shuffled
        got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, items, limit).collect()}
        assert set(got) == {(1, 1), (2, 1), (4, 1), (6, 2)}
        assert got[1, 1].start == 50 and got[1, 1].agree == got[1, 1].compared == 13
    assert decontaminate.matches(no_docs, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.matches(wide_docs.union(wide_docs), docs.selectExpr("doc_id item_id", "text")).where(
        "doc_id <=> item_id").select("doc_id").distinct().count() == 10      # ids with a text of 9 words


def test_short_items_match_as_whole_sequences(spark):
    five, eight = words(80, 5), words(81, 8)
    rows = [(1, f"{words(5, 9)}, {five.upper()}. {words(6, 9)}", "", "", 1), (2, " ".join(five.split()[:4]), "", "", 1),
            (3, " ".join([*five.split()[:4], "other"]), "", "", 1), (4, eight, "", "", 1),
            (5, " ".join([*eight.split()[:7], "other"]), "", "", 1), (None, five, "", "", 1)]
    items = spark.createDataFrame([(1, five), (2, eight), (None, " ".join(five.split()[:4]))], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(spark.createDataFrame(rows, SCHEMA), items, limit).collect()}
        assert set(got) == {(1, 1), (4, 2), (None, 1)}
        assert got[1, 1].start == 9 and got[1, 1].compared == 5


def test_no_text_is_split_inside_a_lambda(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan
    for part in re.findall(r"lambdafunction\(.*", plan):
        assert "split(" not in part


def test_contamination_runs_without_python(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.matches(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- classifiers --------------------------------------------------------------
def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = [words(i * 10 + k, 9) for k in range(6)]
        if bad:
            body[i % 6] += " badword" + "xyz"[i % 3] * (i % 5)
        rows.append((i, ". ".join(body) + ".", "en", "s", 1))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 0), (5000, 0, 1), (1, None, None)]
    return (spark.createDataFrame(rows, SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))


def test_toxicity_finds_the_sentence(spark, docs, no_docs, wide_docs):
    df, labels = labelled(spark)
    got = toxicity.score(df, labels).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    hits = [r for r in held if r.predicted and r.doc_id % 4 == 0]
    assert all("badword" in texts[r.doc_id][r.worst_start:r.worst_end] for r in hits)
    for odd in (docs, wide_docs):
        scored = toxicity.score(odd, labels).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
        assert all(r.score == 0 for r in scored if r.doc_id in (5, 6, 7))
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_quality_on_the_held_out_fold(spark, docs, no_docs, wide_docs):
    df, labels = labelled(spark)
    df = df.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "a", "%%%")).otherwise(F.col("text")))
    got = quality.score(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    for odd in (docs, wide_docs):
        scored = quality.score(odd, labels).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(no_docs, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_never_read(spark):
    df, labels = labelled(spark)
    for module, folds, held in ((toxicity, 3, 1), (quality, 5, 0)):
        ids = {r[0] for r in module.training_rows(df, labels)}
        assert ids and all(zlib.crc32(str(i).encode()) % folds != held for i in ids)

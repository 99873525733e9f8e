"""Information-theoretic sanitisation of personal data.

Base entities are e-mail addresses, IP addresses, card numbers and phone numbers,
found by pattern and checked (see ``base_spans``).  Every distinct value is a
protected entity e.  Over the whole texts of the corpus, the documents that hold both
tell how strongly a term t (two letters or digits at least) reveals e:

    disclosure(e, t) = PMI(e; t) / IC(e)
    PMI(e; t) = log2(n_et * N / (n_e * n_t)),  IC(e) = log2(N / n_e)

with N documents, n_e that hold e, n_t that hold t, n_et that hold both.  It is 1
when t occurs only where e does.  In documents that hold e, every occurrence of a term
at REMOVE or more is removed and of one at GENERALISE or more replaced by a class word.

Chance makes such pairs too.  The chance that n_et or more of t's documents are e's is
C(n_t, n_et) * C(n_e, n_et) / C(N, n_et) at most; a pair counts where the pairs that
unlikely that chance alone would make, of all entities and terms of the corpus, are at
most FALSE of those found (Benjamini and Hochberg's rule).  That needs no given support:
two common documents can do.  One cannot: of a document's words that occur in no
other, none stands out, so an entity of a single document has no terms.  A document
without a base entity gets no span.

Defined results: null text counts as empty; documents without personal data have
zero counts and empty span lists; repeated rows count as documents of their own;
an entity that is in every document (IC 0) reveals nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from math import lgamma, log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, materialise, text_or_empty
from .jaccard_join import marked

KINDS = ("email", "ip", "card", "phone")
REVEALING = "term"
GENERALISE, REMOVE = 0.9, 0.98
FALSE = 0.01                    # share of chance pairs among those found
MOST_BITS = 4096
FLUSH_TERMS = 300_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match can only begin where a run of digits begins: were it to begin inside one, it
# could begin at the run's start
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base entities, ordered by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> int:
    """Id of a protected entity: kind and value without case and separators."""
    plain = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}") - (1 << 63)


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))}


def beside(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Words outside the mentions: term, start, end."""
    starts = [s for s, _, _ in spans]
    reach = list(accumulate((e for _, _, e in spans), max))         # furthest end so far
    out = []
    for m in WORD.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b) - 1              # the last mention that starts before b
        if before < 0 or reach[before] <= a:
            out.append({"term": term(m.group().lower()), "start": a, "end": b})
    return out


PLACES = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
ROWS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                  ("base", pa.string()), ("entities", pa.list_(pa.int64())),
                  ("held", pa.list_(pa.int64())), ("places", PLACES),
                  ("term", pa.int64()), ("n", pa.int64())])
ROWS_SQL = ("rid long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, "
            "entities array<long>, held array<long>, places array<struct<term:long,start:long,end:long>>, "
            "term long, n long")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) to a row per document, and rows (term, n): in how many of the
    task's documents a term occurs."""
    held: Counter[str] = Counter()

    def terms():
        return pa.RecordBatch.from_pylist([{"term": term(w), "n": n} for w, n in held.items()], ROWS)

    for b in batches:
        rows = []
        for rid, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            spans = base_spans(text)
            counts = Counter(k for _, k, _ in spans)
            words = terms_of(text)
            rows.append({
                "rid": rid, "doc_id": doc_id, **{f"n_{k}": counts[i] for i, k in enumerate(KINDS)},
                "base": ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans),
                "entities": sorted({entity(k, text[s:e]) for s, k, e in spans}),
                "held": [term(w) for w in words] if spans else [],
                "places": beside(text, spans) if spans else []})
            held.update(words)
        yield pa.RecordBatch.from_pylist(rows, ROWS)
        if len(held) > FLUSH_TERMS:
            yield terms()
            held.clear()
    yield terms()


def scanned(docs: DataFrame) -> DataFrame:
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
                           text_or_empty().alias("text"))
    return materialise(numbered.mapInArrow(scan, ROWS_SQL), "pii-scan")


def surprise(total: int):
    """Bits by which n_et common documents of n_e and n_t among ``total`` surprise, at least."""
    @F.arrow_udf(T.IntegerType())
    def bits(n_e: pa.Array, n_t: pa.Array, n_et: pa.Array) -> pa.Array:
        out = []
        for e, t, k in zip(n_e.to_pylist(), n_t.to_pylist(), n_et.to_pylist()):
            chance = (lgamma(t + 1) - lgamma(t - k + 1) - lgamma(k + 1) + lgamma(e + 1) - lgamma(e - k + 1)
                      - lgamma(total + 1) + lgamma(total - k + 1))
            out.append(min(MOST_BITS, max(0, int(-chance / log(2) + 1e-6))))
        return pa.array(out, pa.int32())
    return bits


def least_bits(found: dict[int, int], tests: int) -> int:
    """The fewest bits at which chance makes at most FALSE of the pairs found.  Compared
    exactly: a pair in some sixty documents or more has over 1023 bits, beyond any float."""
    least, n = MOST_BITS + 1, 0
    for b in sorted(found, reverse=True):
        n += found[b]
        if tests <= Fraction(FALSE * n) * 2 ** b:
            least = b
    return least


def revealing(rows: DataFrame) -> DataFrame:
    """(rid, found: term and disclosure of each revealing term of the document's entities)."""
    docs = rows.where("rid is not null")
    total = docs.count()
    # two hashes of the set of an entity's documents, whatever their order
    held_by = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"in{k}") for k in (1, 2)]
    n_e = materialise(docs.select("rid", F.explode("entities").alias("entity")).groupBy("entity")
                      .agg(F.count("*").alias("n_e"), *held_by), "pii-entities")
    # entities that stand in the same documents have the same counts with every term: one of
    # them is paired with terms for all, so a list of contacts costs its terms once
    leads = (n_e.where("n_e > 1").groupBy("n_e", "in1", "in2")
             .agg(F.min("entity").alias("entity"), F.count("*").alias("entities")).select("entity", "n_e", "entities"))
    n_t = materialise(rows.where("rid is null").groupBy(F.col("term").alias("handle"))
                      .agg(F.sum("n").alias("n_t")), "pii-terms")
    tests, most = n_e.count() * n_t.count(), n_e.agg(F.max("n_e")).first()[0] or 0

    def limit(n):
        # n_et is n_e at most, so more documents of t keep the disclosure below GENERALISE
        return F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * F.pow(n, F.lit(GENERALISE)) * 1.000001

    named = materialise(docs.select("rid", F.explode("entities").alias("entity"))
                        .join(leads, "entity"), "pii-named")
    held = marked(docs.select(F.col("rid").alias("handle"), "held"), named.select(F.col("rid").alias("handle")))
    rare = n_t.where((F.col("n_t") > 1) & (F.col("n_t") <= limit(F.lit(float(most)))))
    spelt = (marked(held.select(F.col("handle").alias("rid"), F.explode("held").alias("handle")), rare.select("handle"))
             .join(rare, "handle").withColumnRenamed("handle", "term"))
    pairs = materialise(spelt.join(named, "rid").where(F.col("n_t") <= limit(F.col("n_e"))), "pii-pairs")
    scored = (pairs.groupBy("entity", "term")
              .agg(F.count("*").alias("n_et"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"),
                   F.max("entities").alias("entities")).where("n_et > 1")
              .withColumn("ic", F.log2(F.lit(total) / F.col("n_e")))
              .withColumn("pmi", F.log2(F.col("n_et") * F.lit(total) / (F.col("n_e") * F.col("n_t"))))
              .where("ic > 0 and pmi > 0").withColumn("disclosure", F.col("pmi") / F.col("ic"))
              .where(F.col("disclosure") >= GENERALISE))
    scored = materialise(scored.select("entity", "term", "disclosure", "entities", surprise(total)("n_e", "n_t", "n_et").alias("bits")),
                         "pii-scored")
    counts = {r["bits"]: r["n"] for r in scored.groupBy("bits").agg(F.sum("entities").alias("n")).collect()}   # at most MOST_BITS rows
    sure = scored.where(F.col("bits") >= least_bits(counts, tests))
    return (pairs.select("rid", "entity", "term").join(sure, ["entity", "term"]).groupBy("rid", "term")
            .agg(F.max("disclosure").alias("disclosure")).groupBy("rid")
            .agg(F.collect_list(F.struct("term", "disclosure")).alias("found")))


@F.arrow_udf(T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("disclosure", "double")))
def placed(places: pa.Array, found: pa.Array) -> pa.Array:
    """All occurrences of the found terms, in order."""
    out = []
    for words, terms in zip(places.to_pylist(), found.to_pylist()):
        disclosure = {x["term"]: x["disclosure"] for x in terms}
        out.append([{"start": w["start"], "end": w["end"], "disclosure": disclosure[w["term"]]}
                    for w in words if w["term"] in disclosure])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("disclosure", pa.float64())])))


@F.arrow_udf(T.StringType())
def joined(base: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """All spans as kind:start:end by start, then kind as listed (terms last)."""
    out = []
    for b, s, e in zip(base.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        spans = [(int(x[1]), KINDS.index(x[0]), int(x[2]), x[0]) for x in (y.split(":") for y in b.split(",") if y)]
        spans += [(a, len(KINDS), z, REVEALING) for a, z in zip(s or [], e or [])]
        out.append(",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans)))
    return pa.array(out, pa.string())


def find(docs: DataFrame) -> DataFrame:
    """Per document: rid, doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256, spans and
    terms (start, end, disclosure of each revealing term)."""
    rows = scanned(docs)
    docs = rows.where("rid is not null")
    found = materialise(revealing(rows).withColumnRenamed("rid", "handle"), "pii-found")
    words = marked(docs.select(F.col("rid").alias("handle"), "places"), found.select("handle"))
    found = words.join(found, "handle").select(F.col("handle").alias("rid"), placed("places", "found").alias("terms"))
    return (docs.drop("entities", "held", "places", "term", "n").join(found, "rid", "left")
            .withColumn("base_sha256", F.sha2("base", 256))
            .withColumn("spans", joined("base", F.col("terms.start"), F.col("terms.end"))))


def digests(docs: DataFrame) -> DataFrame:
    return find(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with their text sanitised: base entities become [KIND], revealing terms are
    removed at REMOVE or more and become [TERM] otherwise.  Where spans overlap, the
    earlier and then longer one is replaced."""
    rid, base, terms = (fresh_name(docs, c) for c in ("__rid", "__base", "__terms"))
    numbered = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "pii-docs")
    marks = find(numbered.select(F.col(rid).alias("doc_id"), "text")).select(
        F.col("doc_id").alias(rid), F.col("base").alias(base), F.col("terms").alias(terms))

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for text, b, t in zip(texts.to_pylist(), base.to_pylist(), terms.to_pylist()):
            spans = [(int(s), -int(e), f"[{k.upper()}]") for k, s, e in (y.split(":") for y in (b or "").split(",") if y)]
            spans += [(x["start"], -x["end"], "" if x["disclosure"] >= REMOVE else "[TERM]") for x in t or []]
            parts, at = [], 0
            for s, e, new in sorted(spans):
                if s >= at:
                    parts += [text[at:s], new]
                    at = -e
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return numbered.join(marks, rid).withColumn("text", clean("text", base, terms)).select(docs.columns)

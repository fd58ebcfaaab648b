"""Source divergence, substring dedup and hard negatives against plain Python, with the odd cases."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from liftlake.llm import divergence_audit, hard_negatives, passage_dedup
from liftlake.llm.term_transducer import TermTransducer
from tests.llm.test_llm_operators import multiset, prose

SHARED = prose(11, 60)
LONG = prose(12, 400_000)
TEXTS = [
    "a b " + SHARED + " tail", SHARED, "x " + SHARED[:200] + " y " + SHARED, None, "", " \n\t", " ".join(["again"] * 70), " ".join(["again"] * 30), prose(13, 19), prose(13, 20), prose(13, 21),
    LONG, "head " + LONG[1_000_000:1_300_000] + " é 漢字", "w" * 3_000_000 + " " + SHARED, prose(14, 300).replace(" ", "\x0b\r\n", 40),
]
ROWS = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 4 else f"s{i % 4}", "h", 1, "d") for i, t in enumerate(TEXTS)]
# repeated rows, one id with two texts, null ids
ROWS += [ROWS[1], ROWS[1], (7, "other " + SHARED, "en", "s1", "h", 1, "d"), (None, SHARED, "en", "", "h", 1, "d"), (None, SHARED, "", "s0", "h", 1, "d"), (None, None, None, None, None, None, None), (-(1 << 63), SHARED + " end", "en", "s9", "h", 1, "d")]
SCHEMA = "doc_id long, text string, lang string, source string, digest string, bucket int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def kept_rows(rows, width=20):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    key = lambda d, i: (d is None, d or 0, i)
    first: dict = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            name = hashlib.md5(b" ".join(w[i : i + width])).digest()
            first[name] = min(first.get(name, key(d, i)), key(d, i))
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[hashlib.md5(b" ".join(w[i : i + width])).digest()] < key(d, i):
                gone.update(range(i, i + width))
        yield d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_substring_dedup_by_brute_force(docs):
    want = collections.Counter((d, n, lost, hashlib.sha256(kept).hexdigest()) for d, n, lost, kept in kept_rows(ROWS))
    assert multiset(passage_dedup.dedup_report(docs)) == want


def test_substring_dedup_in_two_rounds_of_buckets(docs, monkeypatch):
    monkeypatch.setattr(passage_dedup, "FANOUT", 16)
    few = docs.where("length(text) < 10000 or text is null")
    got = {(r.doc_id, tuple(r.spans)) for r in passage_dedup.removal_intervals(few, 5, 50).collect()}
    assert got == {(r.doc_id, tuple(r.spans)) for r in passage_dedup.removal_intervals(few, 5, 4).collect()} and got
    for _, spans in got:  # maximal: ordered, apart
        assert list(spans) == sorted(set(spans))


def test_texts_without_repeats(docs):
    few = docs.where("length(text) < 10000 or text is null")
    rows = [r for r in ROWS if len(r[1] or "") < 10000]
    lost = collections.Counter((d, kept) for d, _, lost, kept in kept_rows(rows) if lost)
    got = passage_dedup.without_repeats(few)
    assert got.columns == few.columns
    got = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(got.values()) == len(rows)
    for (d, kept), n in lost.items():
        assert got[d, kept.decode()] == n
    assert got[2, "x " + SHARED[:200] + " y " + SHARED] == 0 and got[None, None] == 1 and got[5, " \n\t"] == 1


def test_substring_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert passage_dedup.dedup_report(empty).count() == 0 and passage_dedup.without_repeats(empty).count() == 0


def test_transducer_numbers_terms_in_order_and_is_minimal():
    terms = sorted({w.encode() for w in "a ab abc b bc naïve naïves xa xab xabc 漢 漢字".split()} | {f"t{i}s".encode() for i in range(500)})
    made = TermTransducer.from_bytes(TermTransducer.build(terms).to_bytes())
    tokens = terms + [b"ac", b"t", b"t500s", b"na", b"xabcd", b"\xe6"]
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    stops = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = stops - [len(t) for t in tokens]
    assert made.ordinals(data, starts, stops).tolist() == [*range(len(terms)), *[-1] * 6]
    assert [made.term(i) for i in range(len(terms))] == terms
    # Myhill-Nerode: as many states as there are distinct sets of tails
    tails = collections.defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            tails[t[:i]].add(t[i:])
    assert len(made.final) == len({frozenset(s) for s in tails.values()})
    assert TermTransducer.build([]).ordinals(data, starts, stops).tolist() == [-1] * len(tokens)


def audit(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = [(lang or "", source or "", term.findall((text or "").translate(lower))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {r[0] for r in read}:
        mine = [r for r in read if r[0] == lang]
        df = collections.Counter(t for r in mine for t in set(r[2]))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        counts = {s: collections.Counter(t for r in mine if r[1] == s for t in r[2]) for s in {r[1] for r in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in p:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted(((p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("shard_terms, broadcast, width, sources", [(1 << 16, 64 << 20, 4096, 64), (7, 3000, 16, 2)])
def test_divergence_by_brute_force(docs, monkeypatch, shard_terms, broadcast, width, sources):
    monkeypatch.setattr(divergence_audit, "SHARD_TERMS", shard_terms)
    monkeypatch.setattr(divergence_audit.vocabulary, "__defaults__", (shard_terms,))
    monkeypatch.setattr(divergence_audit, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(divergence_audit, "WIDTH", width)
    monkeypatch.setattr(divergence_audit, "SOURCES", sources)
    monkeypatch.setattr(divergence_audit, "FAN_IN", 2)
    want = audit(ROWS, 2, 5)
    assert multiset(divergence_audit.divergence_report(docs, 2, 5)) == want
    assert {k[2] for k in want} == {"pair", "term"}


def test_divergence_without_kept_terms(spark, docs):
    assert multiset(divergence_audit.divergence_report(docs, 1000)) == audit(ROWS, 1000, 50)
    assert divergence_audit.divergence_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_a_long_product():
    counts = np.array([0, 1, 10**12, 7 * 10**14])
    total = 10**15 + 13
    assert divergence_audit._shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def mined(rows):
    points = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in vec]) for i, label, vec, *_ in rows if i is not None and label is not None and vec and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for a in points:
        if a[0] % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in points if b[0] != a[0] and len(b[2]) == len(a[2])]
        for p in sorted(s for s in scores if s[2] == a[1])[:5]:
            near = sorted(s for s in scores if s[2] != a[1] and -50 * p[0] <= -100 * s[0] <= -95 * p[0])[:3]
            out += [(a[0], p[1], k + 1, n[1], clip(-p[0]), clip(-n[0])) for k, n in enumerate(near)]
    return collections.Counter(out)


VECTORS = "vec_id long, label int, embedding array<double>, id long, vec string, rank int"


def vectors(seed, n, d=6, kinds=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return [(int(i), int(rng.integers(kinds)), [float(x) for x in np.round(centres[i % 8] + rng.normal(size=d) * 0.3, 2)], 1, "v", 2) for i in rng.permutation(n)]


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "SUBTREE_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "SLAB_ROWS", 250)
    monkeypatch.setattr(hard_negatives, "WALK", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rows = vectors(1, 700)
    one = rows[0][2]
    rows += [(i, i % 2, one, 1, "v", 2) for i in range(1000, 1150)]  # a common vector: ties by id
    rows += [rows[3], rows[3], (50, 1, rows[9][2], 1, "v", 2), (100, None, one, 1, "v", 2), (None, 1, one, 1, "v", 2), (2000, 1, None, 1, "v", 2), (2050, 1, [], 1, "v", 2), (2100, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, "v", 2)]
    rows += [(2150, 1, [float("nan")] * 6, 1, "v", 2), (2200, 1, [float("inf")] * 6, 1, "v", 2), (2250, 1, [0.0] * 6, 1, "v", 2), (2300, 1, [3.0, 4.0], 1, "v", 2), (2301, 1, [3.0, 4.5], 1, "v", 2), (2302, 2, [2.0, 3.0], 1, "v", 2)]
    want = mined(rows)
    assert multiset(hard_negatives.mine_report(spark.createDataFrame(rows, VECTORS).repartition(5))) == want and len(want) > 100


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = vectors(2, 120, 3)
    rows += [(200 + k, k % 3, [10.0 ** (10 + k % 7), 3.0 * k, -(10.0**9)], 1, "v", 2) for k in range(60)]
    rows += [(300, 1, [1e300, 0.0, 1.0], 1, "v", 2), (301, 1, [1e308, 0.0, 1.0], 1, "v", 2), (302, 2, [6e307, 1.0, 1.0], 1, "v", 2), (350, 1, [1.7e308, 1.0, 1.0], 1, "v", 2)]
    assert multiset(hard_negatives.mine_report(spark.createDataFrame(rows, VECTORS))) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine_report(spark.createDataFrame([], VECTORS)).count() == 0
    lone = [(50, 1, [1.0, 2.0], 1, "v", 2), (51, 2, [1.0, 1.0], 1, "v", 2)]
    assert hard_negatives.mine_report(spark.createDataFrame(lone, VECTORS)).count() == 0


def test_boxes_bound_their_products():
    rng = np.random.default_rng(3)
    rows, queries = np.floor(rng.normal(size=(300, 5)) * 256), np.floor(rng.normal(size=(20, 5)) * 256)
    tree = hard_negatives._subtree(rows, np.zeros(300, int), np.arange(300) // 64)
    low, high = hard_negatives._bounds(queries, [tree])
    scores = queries @ rows.T
    assert (scores >= low).all() and (scores <= high).all()
    order = np.concatenate(list(hard_negatives._tiles(rows, np.arange(300), 0)))
    assert sorted(order) == list(range(300)) and len(list(itertools.groupby(order))) == 300

import random
import re
from fractions import Fraction

import pytest

from plumbline.llm.components import components
from plumbline.llm.partenum import SKETCH, Scheme, fold, near_duplicates, sketch_of


def brute(rows, similarity, k):
    g, sets = Fraction(similarity), {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and len(a & b) >= g * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def copies(seed, n=6, group=12, words=60):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, words * 3))]
        for _ in range(group):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 20)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(99)}"
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("similarity", "k"), [("0.9", 3), ("0.8", 5), ("0.66", 2), ("0.5", 3), ("0.4", 1)])
def test_against_brute_force(docs_of, similarity, k):
    base = " ".join(f"b{i}" for i in range(30))
    rows = [*copies(1), *((1000 + n, " ".join(base.split()[:n])) for n in (11, 14, 18, 23, 30)), (2, "doc two again under one id"), (2003, "doc two again under one id x")]
    rows += [(3001, "aa bb cc dd ee ff"), (3002, "aa bb cc dd ee ff"), (3002, "gg hh ii jj kk ll"), (3003, "gg hh ii jj kk ll"), (900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO"), (905, "one"), (None, "one two"), (906, "Éa Éb éc éd ée"), (907, "éa éb éc éd ée")]
    got = {r.doc_id: r for r in near_duplicates(docs_of(rows), similarity, k).collect()}
    want = brute(rows, similarity, k)
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert got[None].component_id is None
    assert got[901].n_shingles == 0 and got[903].n_shingles == (2 if k == 1 else 1)


def test_long_sets_against_brute_force(docs_of):
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(450, 1500))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(9999)}"
            rows.append((i, " ".join(t)))
            i += 1
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), "0.8", 5, count=False).collect()}
    assert got == brute(rows, "0.8", 5) and len(set(got.values())) < len(rows)


def test_group_shared_by_half_of_all_is_split(docs_of, monkeypatch):
    """A passage in half of the documents, dealt over blocks of a few members each."""
    monkeypatch.setattr("plumbline.llm.partenum.WIDE", 8)
    rng = random.Random(10)
    passage = " ".join(f"p{j}" for j in range(40))
    rows = [(j, (passage + " " if j % 2 else "") + " ".join(f"q{rng.randrange(50)}" for _ in range(rng.choice([4, 5, 9, 30])))) for j in range(120)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), "0.8", 3, count=False).collect()}
    assert got == brute(rows, "0.8", 3)


def test_sets_of_any_sizes_that_can_link_share_an_instance():
    for g in ("0.3", "0.4", "0.5", "0.6", "0.66", "0.7", "0.8", "0.9"):
        scheme, f = Scheme(Fraction(g)), Fraction(g)
        known = {m: {x[:2] for x in scheme.instances(m)} for m in range(1, 400)}
        assert all(known[m] & known[n] for m in range(1, 400) for n in range(m, min(399, int(m / f)) + 1) if scheme.differences(m + n) and m != n)


def test_empty_table_and_long_text(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    long = " ".join(str(i) for i in range(30_000))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of([(1, long), (2, long + " x"), (3, long[: len(long) // 2])])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("g", ["0.4", "0.5", "0.66", "0.8", "0.9"])
def test_linked_sets_share_a_signature(g):
    import numpy as np

    rng, scheme, f = np.random.default_rng(3), Scheme(Fraction(g)), float(g)
    seen = 0
    for _ in range(300):
        n = int(rng.integers(6, 300))
        a = np.unique(rng.integers(1 << 62, size=n).astype(np.uint64))
        # some features dropped, some added, about as many as the similarity lets be
        drop = int(rng.integers(0, 1 + int(len(a) * (1 - f))))
        both = len(a) - drop
        add = max(0, int(both / f) - len(a))
        b = np.unique(np.concatenate([a[drop:], rng.integers(1 << 62, size=add).astype(np.uint64)]))
        if Fraction(g) * (len(a) + len(b) - both) <= both and not np.array_equal(a, b):
            seen += 1
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
    assert seen > 200


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 90), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).distinct().collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 100: 90}


def test_sketches_never_lose_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 40, 300, 5000):
        a = np.unique(rng.integers(1 << 62, size=n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(1 << 62, size=2 * n).astype(np.uint64)]))
        x, y = sketch_of(a), sketch_of(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= len(np.setxor1d(a, b))
        cells = np.unpackbits(fold(y, SKETCH // 8))
        assert len(cells) == SKETCH and cells.sum() <= len(b)


@pytest.mark.parametrize("block", [256, 5])
def test_links_are_counted_whole(docs_of, monkeypatch, block):
    monkeypatch.setattr("plumbline.llm.partenum.BLOCK", block)
    rows = [*copies(4, n=3, group=20), (800, "One two three four"), (801, "one TWO three four"), (802, None), (None, "one two three four")]
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, (t or "").lower().split()) for i, t in rows) if i is not None}
    want = {i: sum(10 * len(a & b) >= 9 * len(a | b) for j, b in sets.items() if j != i and a and b) for i, a in sets.items()}
    got = {r.doc_id: r.links for r in near_duplicates(docs_of(rows), "0.9", 3).collect()}
    assert {i: n for i, n in got.items() if i is not None} == want and got[None] == 0 and max(want.values()) > 2


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_components_in_one_task_and_dealt_are_the_same(spark, monkeypatch, held):
    monkeypatch.setattr("plumbline.llm.components.HELD", held)
    rng = random.Random(12)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(-(1 << 62), 1 << 62), (70, 70), (None, 2)]
    up = {i: i for p in pairs if None not in p and p[0] != p[1] for i in p}
    for _ in up:
        for a, b in pairs:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    rows = components(spark.createDataFrame(pairs, "u long, v long").repartition(3)).collect()
    assert {r.node: r.label for r in rows} == up and len(rows) == len(up)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_joins_with_and_without_broadcast_are_the_same(docs_of, monkeypatch, few):
    monkeypatch.setattr("plumbline.llm.common.BROADCAST_ROWS", few)
    monkeypatch.setattr("plumbline.llm.common.maybe_broadcast.__defaults__", (None, few))
    monkeypatch.setattr("plumbline.llm.partenum.BROADCAST_ROWS", few)
    monkeypatch.setattr("plumbline.llm.partenum.SKETCHES", 8 * few)
    for rows in (copies(13, n=3), copies(13, n=3) * 2 + [(1, "one two three four")]):
        got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), "0.8", 3).collect()}
        assert got == brute(rows, "0.8", 3)


def test_stages_are_few(docs_of):
    """Each shuffle costs a task for every partition, however few rows there are."""
    docs = docs_of([(i, " ".join(f"w{j}" for j in range(60)) + f" x{i % 5}") for i in range(20)] + [(30, "a b c d")])
    context = docs.sparkSession.sparkContext
    context.setJobGroup("stages", "")
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, "0.9", 3).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("stages")]
    stages = {s for j in jobs if j for s in j.stageIds}
    assert len(set(got.values())) == 2 and len(stages) <= 130, len(stages)

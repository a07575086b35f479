import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldloom.llm.simhash import components, near_links, similarity_dedup, simhash_components, simhash_dedup


def brute_fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def similar_heads(texts, width=5, similarity=0.8):
    """Smallest ids of the components of texts that share so much of their shingle sets, all pairs compared."""
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        sets[i] = {b" ".join(words[j : j + width]) for j in range(max(1, len(words) - width + 1))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def brute_roots(points, k):
    """Smallest point that each point reaches."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= k:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(n))


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    base = [random_text(rng, 60) for _ in range(40)]
    texts = [None, "", "  \n", "One two", "one TWO", "É x y", "word " * 30000]
    for b in base:
        words = b.split()
        words[rng.randrange(60)] = "zzz"
        texts += [b, b.upper(), " ".join(words), b + " tail"]
    rows = [(i, t, "n/a") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in simhash_components(df).collect()}
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    roots = brute_roots(sorted(set(prints)), 4)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(roots[p], i)
    assert [got[i].component_id for i in range(len(rows))] == [least[roots[p]] for p in prints]


def cluster(rng, n, flips):
    centre = rng.getrandbits(64)
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)}


def test_no_link_is_lost_in_hot_keys(spark):
    """Near copies that share their keys, a chain, and random points; blocks so small that keys are dealt out."""
    rng = random.Random(5)
    points = cluster(rng, 150, 3) | cluster(rng, 100, 6) | {rng.getrandbits(64) for _ in range(200)}
    chain = rng.getrandbits(64)
    for i in range(16):
        points.add(chain)
        chain ^= 0b1111 << (4 * (i % 16))
    points = sorted(points)
    roots = brute_roots(points, 4)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(6)
    for block in (8, 4096):
        links = near_links(df, 4, block)
        for r in links.limit(200).collect():
            assert roots[r.a & (1 << 64) - 1] == roots[r.b & (1 << 64) - 1]
        found = {r.id & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(links).collect()}
        sets, brute = {}, {}
        for p in points:
            sets.setdefault(found.get(p, p), set()).add(p)
            brute.setdefault(roots[p], set()).add(p)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, brute.values()))


@pytest.mark.parametrize("k", [0, 1, 3, 5])
def test_other_distances(spark, k):
    rng = random.Random(k)
    points = sorted(cluster(rng, 60, k + 2) | {rng.getrandbits(64) for _ in range(30)})
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    found = components(near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), k))
    got = {r.id & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found.collect()}
    roots = brute_roots(points, k)
    for p in points:
        for q in points:
            assert (roots[p] == roots[q]) == (got.get(p, p) == got.get(q, q))


def test_dedup_keeps_one_of_each_group(spark):
    text = "the same words in the same order over and over"
    rows = [(3, text, 1), (2, text.upper(), 2), (9, "something else that is not like it at all", 3), (None, None, 4), (7, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash_dedup(df).collect()) == [(-1, 4), (2, 2), (7, 5), (9, 3)]
    assert simhash_dedup(df.limit(0)).count() == 0


def test_dedup_keeps_one_row_without_ids_and_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, i) for i in range(6)] + [(1, a, 6)] + [(None, b, 7 + i) for i in range(5)] + [(2, c, 12)] * 4 + [(3, d, 13), (2, d, 14), (None, d, 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(5)
    kept = simhash_dedup(df)
    assert kept.columns == df.columns
    got = sorted((r.text[0], r.doc_id or -1) for r in kept.collect())
    assert got == [("a", 1), ("b", -1), ("c", 2), ("d", 2)]


def test_similar_texts_against_all_pairs(spark):
    """Copies with 0 to 14% of their words replaced, in groups of two and of hundreds, and unrelated texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts, ids = {}, iter(range(100000))
    for size in (2, 3, 5, 40, 300, *[1] * 300):
        base = [word() for _ in range(rng.randint(80, 300))]
        for _ in range(size):
            copy = list(base)
            for _ in range(int(rng.random() * 0.02 * len(copy))):
                copy[rng.randrange(len(copy))] = word()
            texts[next(ids)] = " ".join(copy)
    want = similar_heads(texts)
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in texts.items()], "doc_id long, text string, point string, n int").repartition(4)
    kept = similarity_dedup(df)
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    assert want <= got | want and len(got - want) <= 0.03 * len(texts) and len(want - got) == 0
    assert similarity_dedup(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "a b c", "p", 1)] * 3 + [(None, None, "p", 1)] * 2 + [(4, "", "p", 1), (5, None, "p", 1)], df.schema)
    assert sorted(map(str, similarity_dedup(one).select("doc_id", "text").collect())) == sorted(map(str, one.select("doc_id", "text").where("text IS NULL AND doc_id IS NULL").collect() + one.select("doc_id", "text").where("text = 'a b c'").limit(1).collect() + one.select("doc_id", "text").where("doc_id = 4").collect()))

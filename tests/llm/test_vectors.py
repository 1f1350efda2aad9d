"""Centroid clustering, whitening and covering SimHash beside plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from plumbline.llm import centroids, simhash, whitening
from tests.llm.cases import CLASH, LONG, LOWER, TEXTS, WORD, documents

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in [*CLASH, "x", "cluster", "upper", "w", "f", "at", "mask"] if c != "vec")


def vectors(spark, rows):
    extra = len(VECTORS.split(",")) - 3
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, *["?"] * extra) for i, v in rows], VECTORS).repartition(3)


def lloyd(rows, k=16, rounds=3, size=64, scale=64, seed=1):
    """[(id, cluster, distance)] and centroids, all distances computed each time."""
    kept = [(i, np.array([math.floor(scale * c) for c in v])) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    c = [x for _, x in start[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [int(((x - m) ** 2).sum()) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for n in range(len(c)):
            mine = [x for (_, x), (a, _) in zip(kept, at) if a == n]
            if mine:
                c[n] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    return [(i, *a) for (i, _), a in zip(kept, assign())], c


def check_clusters(spark, rows, **options):
    got = centroids.clustered(vectors(spark, rows), **options).collect()
    want, c = lloyd([(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, v in rows], **options)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    per, total = Counter(), 0
    for _, a, d in want:
        per[a] += d
        total += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], total)
        assert r.centroid_sha256 == hashlib.sha256(",".join(str(int(y)) for y in c[r.cluster]).encode()).hexdigest()
    return got


def test_clusters_of_groups_skip_scans(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (16, 64))
    rows = [(i, middle[i % 16] + rng.normal(0, 0.05, 64)) for i in range(1600)]
    got = check_clusters(spark, rows)
    assert np.mean([r.scans for r in got]) < 3  # of four passes


def test_clusters_of_noise_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.12, 64)) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[7][1]), (7, rows[8][1])]
    check_clusters(spark, rows)
    check_clusters(spark, rows, k=40, rounds=6)


def test_clusters_of_awkward_rows(spark):
    one = [0.5] * 64
    odd = [(1, None), (2, []), (3, one[:63]), (4, [None] + one[1:]), (5, [float("nan")] + one[1:]), (6, [float("inf")] + one[1:]), (None, one), (8, one), (9, [-c for c in one]), (8, one)]
    got = check_clusters(spark, odd)
    assert len(got) == 4
    assert centroids.clustered(vectors(spark, odd).limit(0)).count() == 0
    with pytest.raises(Exception, match="squared distances"):
        centroids.clustered(vectors(spark, [(1, [3e30] * 64)])).collect()


@pytest.mark.parametrize("size", [2, 3, 64])
def test_no_vector_comes_nearer_than_its_bound(size):
    rng = np.random.default_rng(size)
    saved = 0
    for _ in range(300):
        old = rng.integers(-50, 50, (5, size))
        new = old + rng.integers(-20, 20, (5, size))
        radius = rng.uniform(0, 60, 5)
        bound = centroids.drifts(old, new, radius)
        for i in range(5):
            way = rng.normal(0, 1, (400, size))
            way /= np.sqrt((way**2).sum(axis=1))[:, None]
            x = old[i] + way * radius[i] * np.append(np.ones(200), rng.uniform(0, 1, 200))[:, None]
            nearer = [np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1)) for j in range(5) if j != i]
            assert np.max(nearer) <= bound[i] + 1e-9
            saved += bound[i] < max(np.sqrt(((new[j] - old[j]) ** 2).sum()) for j in range(5) if j != i) * 0.95
    assert saved > 100


def dense(rows, scale=256, top=4):
    kept = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1].T
    out = {}
    for i, x in kept:
        dev = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        out[i] = dev, [(np.array(x) - s / n) @ axes[k] / np.sqrt(values[k]) for k in range(top)]
    return n, out, values / values.sum()


def test_whitening_beside_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (500, 12)) * np.linspace(2, 0.2, 12)
    base[:, 5] += base[:, 0] * 0.7
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[3]) for i in range(250)] + [(2000, base[3] + 1e-7)]
    n, want, share = dense(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 4 * len(rows)
    sign = {k: np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == k + 1) * want[0][1][k]) for k in range(4)}
    for r in got:
        dev, w = want[r.vec_id]
        assert (r.n, int(r.deviation)) == (n, dev)
        assert r.whitened == pytest.approx(sign[r.component - 1] * w[r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_popcounts_are_exact():
    rng = np.random.default_rng(4)
    for rows, width, top in [(1, 1, 1), (63, 3, 5), (64, 4, 2**20), (700, 6, 2**46), (4096, 3, 1000)]:
        x = rng.integers(0, top, (rows, width), endpoint=True)
        x[:, 0] = 0 if width > 1 else x[:, 0]
        bits = np.array([int(x[:, i].max()).bit_length() for i in range(width)])
        got = whitening.cross_products(x, bits)
        for i in range(width):
            for j in range(i, width):
                assert got[i, j] == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


def test_whitening_of_awkward_rows(spark):
    odd = [(1, None), (2, [1, None]), (3, [1, float("nan")]), (4, [float("-inf"), 1]), (5, [1, 2]), (None, [2, 4]), (5, [1, 2]), (6, [1, 2, 3]), (7, [])]
    got = whitening.whiten(vectors(spark, odd)).collect()  # one line: one component
    assert sorted((r.vec_id is None, r.component, r.n, round(r.whitened, 9)) for r in got) == [(False, 1, 2, -1.0), (False, 1, 2, -1.0), (True, 1, 2, 1.0)]
    assert whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    assert whitening.whiten(vectors(spark, odd).limit(0)).count() == 0
    big = whitening.whiten(vectors(spark, [(1, [2.0**36, 0]), (2, [-(2.0**36), 1]), (3, [0, 5])])).collect()
    assert {r.vec_id: int(r.deviation) for r in big}[1] == (3 * 2**44) ** 2 + (3 * 0 - 6 * 256) ** 2
    with pytest.raises(Exception, match="2.46"):
        whitening.whiten(vectors(spark, [(1, [1e30])])).collect()


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    """Component label of each fingerprint by comparing all pairs."""
    f = np.array(sorted(prints), np.uint64)
    label, todo = {}, list(range(len(f)))
    while todo:
        near, todo_ = [todo[0]], set(todo[1:])
        for a in near:
            hit = [b for b in todo_ if int(f[a] ^ f[b]).bit_count() <= radius] if len(todo_) else []
            todo_ -= set(hit)
            near += hit
        for a in near:
            label[int(f[a])] = int(f[near[0]])
        todo = sorted(todo_)
    return label


def check_simhash(spark, rows, **options):
    got = simhash.near_duplicates(documents(spark, rows), **options).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    label = plain_components(set(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(label[prints[i]], i)
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == format(prints[r.doc_id] if r.doc_id is not None else int(r.fingerprint, 16), "016x")
        assert r.component_id == (first[label[prints[r.doc_id]]] if r.doc_id is not None else None)
    return got


def test_fingerprints():
    for text in [None, "", " \t", "one", "One two\x0bTHREE", "é É ß\x85x y", LONG, "a b c d e a b c d e"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
        assert simhash.fingerprint(text, chunk=7) == plain_fingerprint(text)


def test_simhash_of_awkward_rows(spark):
    check_simhash(spark, TEXTS)
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


def test_simhash_on_the_small_table(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_simhash(spark, rows)


def test_simhash_of_many_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(400)]
    rows = [(0, " ".join(base), "en", "a")] + [(900 + i, None, "en", "a") for i in range(200)]
    for i in range(1, 500):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 9)):
            words[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words), "en", "a"))
    check_simhash(spark, rows, bucket=32)
    check_simhash(spark, rows)


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(6)
    for free in [2**64 - 1, 0xFFFF0000FFFF0000, 0x3F]:
        places, all_ = [i for i in range(64) if free >> i & 1], simhash.masks(free)
        assert all(m and not m & ~free for m in all_)
        for _ in range(4000):
            apart = sum(1 << int(i) for i in rng.choice(places, 4, replace=False))
            assert any(not m & apart for m in all_)


@pytest.mark.parametrize("bucket", [32, 1024])
def test_links_in_crowded_buckets(spark, bucket):
    """Thousands of fingerprints that agree on half of their bits, one chain among them."""
    rng = np.random.default_rng(7)
    prints = {0x0123456700000000 | int(x) for x in rng.integers(0, 2**32, 1500)}
    prints |= {0xF000000000000000 | sum(1 << b for b in range(k)) for k in range(0, 60, 3)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "f long")
    got = {}
    for v, w in simhash.links(df, bucket=bucket).collect():
        assert (v ^ w).bit_count() <= 4 if (v ^ w) >= 0 else ((v ^ w) + 2**64).bit_count() <= 4
        got.setdefault(v % 2**64, []).append(w % 2**64)
        got.setdefault(w % 2**64, []).append(v % 2**64)
    label = plain_components(prints)
    seen = {}
    for f in sorted(prints):
        todo = [f] if f not in seen else []
        for x in todo:
            if x not in seen:
                seen[x] = f
                todo += got.get(x, [])
    assert seen == label
    assert re.fullmatch("[0-9a-f]{16}", format(max(prints), "016x"))

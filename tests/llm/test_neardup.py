import random

import numpy as np

from parchmill.llm import neardup
from parchmill.llm.forms import canonical
from parchmill.llm.neardup import MinHash, band_keys, compared, minima, packed, run_hashes
from tests.conftest import rows


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def brute(data, threshold=0.6):
    form, sets = canonical(), {}
    for k, t in data:
        if t and any(map(str.isalnum, t)):
            codes = compared(t, form)
            sets[k] = (bytes(codes.astype("<u4")), set(run_hashes(codes, 10).tolist()))
    out = []
    for a in sets:
        for b in sets:
            if a < b:
                x, y = sets[a], sets[b]
                if x[0] == y[0] or (x[1] and y[1] and len(x[1] & y[1]) >= threshold * len(x[1] | y[1])):
                    out.append((a, b))
    return sorted(out)


def collection(rng):
    base = [words(rng, 60) for _ in range(12)]
    data, k = [], 0
    for t in base:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.choice([0, 1, 3, 30])):
                w[rng.randrange(len(w))] = words(rng, 1)
            data.append((k, " ".join(w)))
            k += 1
    return data + [(900, None), (901, ""), (902, "?!"), (903, "?!"), (904, "ab"), (905, "AB."), (906, "abcdefghi"), (907, base[0].upper()), (908, base[0].replace("a", "а"))]


def connected(ids, pairs):
    root = {k: k for k in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(170, 260)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = connected({x for e in edges for x in e}, edges)
    assert {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)} == got
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_template_is_one_group_and_a_chain_is_kept(spark):
    """Fillings of one template share all bands; members that aren't like a band's least one still find each other."""
    rng = random.Random(6)
    head, tail = words(rng, 150), words(rng, 150)
    data = [(k, f"{head} number {k} paid {k * 7919} {tail}") for k in range(300)]
    w = words(rng, 120).split()
    chain = []
    for k in range(8):  # each like the next, the ends unlike
        chain.append((1_000 + k, " ".join(w)))
        w = w[12:] + words(rng, 12).split()
    data += chain
    df = spark.createDataFrame(data, "record_id long, core_text string")
    got = {r["record_id"]: (r["group_id"], r["group_size"]) for r in neardup.near_duplicate_groups(df, p=MinHash(block=16)).collect()}
    want = connected([k for k, _ in data], brute(data[:3] + chain) + [(0, k) for k in range(1, 300)])
    assert {k: g for k, (g, _) in got.items()} == want and got[5][1] == 300


def test_pairs_against_brute_force(spark):
    data = collection(random.Random(3))
    df = spark.createDataFrame([(k, t, "x") for k, t in data], "record_id long, core_text string, id string")
    assert rows(neardup.near_duplicate_pairs(df)) == [tuple(p) for p in brute(data)]
    groups = {r["record_id"]: r for r in neardup.near_duplicate_groups(df).collect()}
    assert groups[905]["class_id"] == 904 and groups[905]["group_size"] == 2 and 902 not in groups and 900 not in groups
    want = connected(sorted(groups), brute(data))
    assert {k: r["group_id"] for k, r in groups.items()} == want
    assert all(r["group_size"] == list(want.values()).count(r["group_id"]) for r in groups.values())
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_long_runs_are_paired_in_blocks(spark):
    data = [(7, k) for k in range(600)] + [(8, k) for k in range(1_000, 1_010)] + [(9, 5)]
    df = spark.createDataFrame(data, "k long, id long").repartition(3)
    for block in (16, 256, 1_000):
        got = neardup.pairs_within(df, "k", block).distinct()
        assert got.count() == 600 * 599 // 2 + 45 and got.filter("a >= b").count() == 0


def test_estimate_follows_similarity(spark):
    rng, p = random.Random(1), MinHash()
    a = np.unique(np.array([rng.getrandbits(64) for _ in range(2_000)], np.uint64))
    for share in (1.0, 0.8, 0.5, 0.0):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate((rng_sample(rng, a, keep), np.array([rng.getrandbits(64) for _ in range(len(a) - keep)], np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sketch = [packed(minima(x, p.bins), p.bits, p.words).view(np.int64).tolist() for x in (a, b)]
        df = spark.createDataFrame([(sketch[0], sketch[1])], "x array<long>, y array<long>")
        assert abs(df.select(neardup.estimate("x", "y", p)).first()[0] - true) < 0.12


def rng_sample(rng, a, n):
    return a[sorted(rng.sample(range(len(a)), n))]


def test_small_sets_fill_all_bins():
    p = MinHash()
    least = minima(np.array([5, 1 << 62, (1 << 63) + 9], np.uint64), p.bins)
    assert len(least) == p.bins and len(set(least.tolist())) <= 3 and len(band_keys(least, p.bands, p.rows)) == p.bands

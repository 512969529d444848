"""Centroid clustering, the filter audit and source mixing: brute force, edges, properties."""

import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from compare import connect, difference
from lapcast.llm import audit, clusters, mixing
from lapcast.llm.common import table


# ---- centroid clustering ----------------------------------------------------------------------


def brute_clusters(rows, dimensions, count, rounds, scale=64, seed=1):
    kept = [
        (i, [math.floor(scale * c) for c in v]) for i, v in rows
        if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)
    ]
    start = sorted((brute.sha(f"{seed}:{'' if i is None else i}"), x) for i, x in kept)
    centroids = [x for _, x in start[:count]]

    def place(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[place(x)[1]].append(x)
        for k, g in groups.items():
            centroids[k] = [sum(c) // len(g) for c in zip(*g)]
    out = [(i, *place(x)) for i, x in kept]
    inertia = Counter()
    for _, d, k in out:
        inertia[k] += d
    digest = [brute.sha(",".join(map(str, c))) for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in out)


def _clustered(df, **kw):
    found, centroids = clusters.clustered(df, **kw)
    return sorted((str(r["id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect()), centroids


VECTOR = "vec_id long, embedding array<double>, id string, x string, cluster string, distance long"


def test_clusters_equal_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 2.0, 3.0]), (204, [nan, 0.0, 0.0, 0.0]), (205, [0.0, -inf, 0.0, 0.0]),
        (3, [0.5, 0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0, 1.0]), (None, [-0.0, -1e-9, 1e5, 2.0]), (206, [0.0] * 5),
    ] + [(300 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(200)]
    df = spark.createDataFrame([(i, v, "i", "x", "c", 1) for i, v in rows], VECTOR).repartition(5)
    got, _ = _clustered(df, dimensions=4, count=7, rounds=3)
    assert got == brute_clusters(rows, 4, 7, 3)


def test_fewer_vectors_than_centroids_ties_and_no_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, centroids = _clustered(df, dimensions=2)
    assert got == brute_clusters(rows, 2, 16, 3)
    assert len(centroids) == 3
    assert _clustered(df.where("vec_id > 9"), dimensions=2) == ([], [])


def test_huge_components_are_held_at_the_bound(spark):
    rows = [(1, [1e300, -1e300]), (2, [1e300, 1e300]), (3, [-1e300, 0.0])]
    got, _ = _clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dimensions=2, count=1, rounds=0)
    assert max(r[2] for r in got) == 2**62
    assert all(r[3] == min(sum(r[2] for r in got), 2**63 - 1) for r in got)


def test_assignment_is_jvm_native(spark, sf):
    vectors = clusters.integer_vectors(table(spark, sf, "embeddings"))
    plan = clusters.nearest(F.col("x"), [[0] * 64, [1] * 64])
    text = vectors.select(plan.alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "zip_with" in text and "aggregate" in text


# ---- filter audit -----------------------------------------------------------------------------


def brute_audit(docs, labels):
    """Every order walked document by document."""
    good = {d for d, q, t in labels if d is not None and q == 1}
    toxic = {d for d, q, t in labels if d is not None and t == 1}
    ids = defaultdict(list)
    for d, text, _ in docs:
        if d is not None:
            ids[text or ""].append(d)
    fails = []
    for d, text, source in docs:
        t = text or ""
        w = brute.WORD.findall(t)
        fails.append((d, source or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and min(ids[t]) < d,
        }))
    out = {}
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        alive = list(fails)
        for step, f in enumerate(order, 1):
            lost = [x for x in alive if x[2][f]]
            alive = [x for x in alive if not x[2][f]]
            for part in {x[1] for x in fails}:
                here = lambda rows: [x for x in rows if x[1] == part]  # noqa: B023, E731
                all_fail = [x for x in here(fails) if x[2][f]]
                gone = here(lost)
                shapley[part, f] += len(gone)
                out[part, order, step] = (
                    len(here(alive)), len(gone), len(all_fail) - len(gone), sum(sum(x[2].values()) == 1 for x in all_fail),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DOCS = "doc_id long, text string, source string, id long, bits int, n long, part string, hash string"


def _audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in audit.audit(docs, labels).collect()}


def odd_documents():
    long = " ".join(f"word{i}" for i in range(250))
    dull = "same words again " * 100
    rows = [(1, None, "a"), (2, "", "a"), (2, "", None), (None, "", "a"), (None, "", "a"), (3, " \n\t ", "b"), (4, long, "b"), (5, long, "a"), (5, long, "a"),
            (4, long, None), (6, dull, "b"), (7, dull + "#", "b"), (8, "ABC", "c"), (9, long.upper() + " | x", "c"), (10, long + "é\U0001f600", None), (None, long, "c"),
            (-(2**63), dull, "c"), (2**63 - 1, dull, "c")]
    rows += [(100 + i, dull, "hot") for i in range(60)]
    labels = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, 0, 0), (6, None, 1), (None, 1, 1), (105, 1, None), (106, 0, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("copies, shared", [(audit.COPIES, audit.SHARED), (5, audit.SHARED), (5, 0)])
def test_audit_equals_brute_force(spark, monkeypatch, copies, shared):
    monkeypatch.setattr(audit, "COPIES", copies)
    monkeypatch.setattr(audit, "SHARED", shared)
    rows, labels = odd_documents()
    docs = spark.createDataFrame([(d, t, s, 0, 0, 0, "p", "h") for d, t, s in rows], DOCS).repartition(4)
    told = spark.createDataFrame([(*r, "x", 1) for r in labels], "doc_id long, quality int, toxic int, part string, n int")
    assert _audited(docs, told) == brute_audit(rows, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    rows, _ = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert _audited(docs.where("false"), none) == {}
    assert _audited(docs, none) == brute_audit(rows, [])


def test_audit_with_overfull_keys(spark, tiny_limits):
    rows, labels = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert _audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == brute_audit(rows, labels)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_filter_audit"])
def test_equals_sql(spark, sf, name):
    from lapcast.llm import QUERIES as queries
    from lapcast.llm import SQL as sql

    assert difference(queries[name](spark, sf), connect(sf), sql[name]) is None


# ---- source mixing ----------------------------------------------------------------------------


def brute_mix(docs, block, shard, seed, weights=(1, 2, 3), most=3):
    """The same rule, word by word: (targets by source, taken words by document row)."""
    sized = sorted(((s is None, s or "", d is not None, d or 0, len(brute.WORD.findall(t or ""))) for d, t, s in docs))
    names = sorted({x[:2] for x in sized})
    size = [sum(x[4] for x in sized if x[:2] == n) for n in names]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    target = [0.0] * len(names)
    full = set()
    while True:
        left = sum(size) - sum(most * size[i] for i in full)
        open_ = sum(w for i, w in enumerate(weight) if i not in full)
        target = [most * size[i] if i in full else weight[i] * left / open_ for i in range(len(names))]
        more = {i for i in range(len(names)) if i not in full and target[i] > most * size[i]}
        if not more:
            break
        full |= more
    order = lambda i, turn: mixing.permuted(np.arange(-(-size[i] // block)), np.full(-(-size[i] // block), -(-size[i] // block)), mixing.key_of(seed, np.full(-(-size[i] // block), i), np.full(-(-size[i] // block), turn)))
    want = []
    for i in range(len(names)):
        need, turn, slots = math.floor(target[i] + 0.5), 0, []
        while need > 0:
            for b in order(i, turn):
                words = min(block, size[i] - int(b) * block, need)
                slots.append((int(b), words))
                need -= words
                if not need:
                    break
            turn += 1
        want.append(slots)
    total = sum(map(len, want))
    owner = [i for i, w in enumerate(want) for _ in w]
    mark = lambda slot: xxhash.xxh64(slot.to_bytes(8, "little"), seed=xxhash.xxh64(seed.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    drawn = [owner[signed(mark(s)) % total] for s in range(total)]
    seen = Counter()
    over, out = defaultdict(list), {}
    for s, i in enumerate(drawn):
        if seen[i] < len(want[i]):
            out[s] = (i, *want[i][seen[i]])
        else:
            over[i].append(s)
        seen[i] += 1
    spare = [s for i in sorted(over) for s in over[i]]
    lack = [(i, k) for i in range(len(names)) for k in range(seen[i], len(want[i]))]
    for s, (i, k) in zip(spare, lack, strict=True):
        out[s] = (i, *want[i][k])
    words = [[r for r, x in enumerate(sized) if x[:2] == n for _ in range(x[4])] for n in names]
    taken = Counter(r for i, b, n in out.values() for r in words[i][b * block : b * block + n])
    index = {n: i for i, n in enumerate(names)}
    rows = [(x[3] if x[2] else None, x[4], size[index[x[:2]]], round(float(target[index[x[:2]]]), 6), taken[r]) for r, x in enumerate(sized)]
    slots = sorted((s // shard, s, i, b, n) for s, (i, b, n) in out.items())
    return sorted(rows, key=str), slots


def _mixed(docs, **kw):
    mix = mixing.mixed_sources(docs, **kw)
    rows = [(r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.taken_words(mix).collect()]
    return sorted(rows, key=str), sorted(tuple(r) for r in mix.slots.select("shard", "slot", "sid", "block", "words").collect()), mix


def odd_sources():
    text = lambda n, w="w": " ".join([w] * n)
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, text(5), "a"), (None, text(5), "a"), (3, " \n ", None), (4, text(31), None), (5, text(1), "b"),
            (6, text(2), "B"), (7, text(400), "hot"), (7, text(400), "hot"), (8, text(9), "é"), (9, text(7), "\U0001f600"), (10, text(8), ""), (11, text(0), "zero")]
    return rows + [(100 + i, text(i % 13), "hot") for i in range(200)]


@pytest.mark.parametrize("block, shard", [(7, 5), (1, 64), (2048, 1024)])
def test_mix_equals_brute_force(spark, block, shard):
    docs = odd_sources()
    df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], "doc_id long, text string, source string, sid int, id string, size long")
    rows, slots, mix = _mixed(df.repartition(3), block=block, shard=shard, seed=9)
    want, want_slots = brute_mix(docs, block, shard, 9)
    assert (rows, slots) == (want, want_slots)
    # The pieces are real: they fill each slot without gaps.
    places = defaultdict(list)
    for p in mix.pieces.collect():
        places[p["slot"]].append((p["place"], p["words"]))
    for _, slot, _, _, n in slots:
        at = 0
        for place, words in sorted(places[slot]):
            assert place == at
            at += words
        assert at == n


def test_mix_with_overfull_keys(spark, tiny_limits):
    docs = odd_sources()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert _mixed(df, block=50, shard=5, seed=3)[:2] == brute_mix(docs, 50, 5, 3)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert _mixed(spark.createDataFrame([], schema))[:2] == ([], [])
    assert _mixed(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema))[0] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_shares_of_the_given_table_come_near_their_targets(spark, sf):
    mix = mixing.mixed_sources(table(spark, sf, "documents"))
    rows = mixing.taken_words(mix).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.5 and r["over"] <= 0 for r in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 63, 64, 65, 1000])
def test_permutations_are_bijections_with_an_inverse(size):
    n, key = np.full(size, size), mixing.key_of(7, np.full(size, 3), np.full(size, 2))
    forth = mixing.permuted(np.arange(size), n, key)
    assert sorted(forth) == list(range(size))
    assert list(mixing.permuted(forth, n, key, inverse=True)) == list(range(size))


def test_draws_are_multinomial(spark, sf):
    """Shard counts before and after passing on scatter as the shares say."""
    mix = mixing.mixed_sources(table(spark, sf, "documents"), block=16, shard=64)
    counts = mix.slots.groupBy("shard", "sid").count().collect()
    draws = {r["sid"]: r["draws"] for r in mix.sources.collect()}
    total = sum(draws.values())
    shards = total // 64
    chi = sum((r["count"] - 64 * draws[r["sid"]] / total) ** 2 / (64 * draws[r["sid"]] / total) for r in counts if r["shard"] < shards)
    # Shards without a source add their expectation.
    seen = {(r["shard"], r["sid"]) for r in counts}
    chi += sum(64 * d / total for s in range(shards) for i, d in draws.items() if (s, i) not in seen)
    freedom = shards * (len(draws) - 1)
    assert abs(chi - freedom) < 6 * math.sqrt(2 * freedom)



"""Every operator over a whole small table against its plain re-statement."""

import re
import zlib

import pytest

import brute
from lapcast.llm import QUERIES, SQL, katz, leaks, near, packing, secrets
from lapcast.llm.common import table

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}


def rows(spark, sf, name, key="doc_id"):
    found = QUERIES[name](spark, sf).collect()
    out = {r[key]: r.asDict() for r in found}
    assert len(out) == len(found)
    return out


def test_sql_twins(spark, sf):
    from compare import connect, difference

    con = connect(sf)
    for name, sql in SQL.items():
        assert difference(QUERIES[name](spark, sf), con, sql) is None, name


def test_packing(spark, sf, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    found = QUERIES["op1_best_fit_packing"](spark, sf).collect()
    want = {}
    for d, r in docs.items():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want[d, n] = (at, len(piece), zlib.crc32(piece.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    assert_packed(found, 2048)


def assert_packed(found, limit):
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    assert len(bins) == len(brute.best_fit([r["length"] for r in found], limit))


def test_plan_fills_like_best_fit_decreasing():
    import random

    rng = random.Random(5)
    for limit in (1, 7, 10, 64, 100):
        for n in (0, 1, 5, 60, 300):
            lengths = [rng.choice([rng.randint(1, limit), limit // 2 + 1, max(1, limit // 3)]) for _ in range(n)]
            counts = {x: lengths.count(x) for x in set(lengths)}
            used = {}
            for length, rank, each, first, offset in packing.plan(counts, limit).tolist():
                later = [r for _, r, *_ in [x for x in packing.plan(counts, limit).tolist() if x[0] == length] if r > rank]
                for k in range(min(later, default=counts[length]) - rank):
                    used.setdefault(first + k // each, []).append((offset + k % each * length, length))
            for places in used.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
            rooms = sorted(limit - sum(x for _, x in p) for p in used.values())
            assert rooms == sorted(brute.best_fit(lengths, limit))


def test_line_dedup(spark, sf, docs):
    want = brute.later_lines([(d, r["text"]) for d, r in docs.items()])
    got = rows(spark, sf, "op2_line_dedup")
    for d, r in docs.items():
        assert got[d]["later_lines"] == ",".join(map(str, want.get(d, []))), d
        assert got[d]["n_lines"] == len((r["text"] or "").split("\n"))


def test_katz(spark, sf, docs):
    model = brute.Katz([(d, r["text"]) for d, r in docs.items()])
    got = rows(spark, sf, "op3_katz_scores")
    for d, r in docs.items():
        n, known, base, score = model.scores(r["text"])
        g = got[d]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (n, known, model.n, brute.held_out(d))
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert g["score"] == pytest.approx(score, rel=1e-9)
    for a in ["<start>", *list(model.follow)[:30], "never seen"]:
        known = sum(model.p(a, b) for b in model.c)
        assert known + (model.v + 1) * model.p(a, "never seen") == pytest.approx(1, abs=1e-9)
    out = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


@pytest.mark.parametrize("frequent", [1, 400, 1 << 20])
def test_katz_with_hot_pairs_and_small_parts(spark, sf, docs, monkeypatch, frequent):
    monkeypatch.setattr(katz, "HOT_PAIR", 60)
    model = brute.Katz([(d, r["text"]) for d, r in docs.items()])
    found = katz.katz_scores(table(spark, sf, "documents"), frequent=frequent, part_tokens=3000).collect()
    assert len(found) == len(docs)
    for g in found:
        n, known, base, score = model.scores(docs[g["id"]]["text"])
        assert (g["n_tokens"], g["n_known"]) == (n, known)
        assert (g["base_score"], g["score"]) == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))


def test_private_data(spark, sf, docs):
    got = rows(spark, sf, "op4_private_data")
    for d, r in docs.items():
        found = brute.spans(r["text"], brute.PRIVATE)
        assert got[d]["base_sha256"] == brute.sha(brute.joined(found)), d
        assert got[d]["spans"].startswith(brute.joined(found))
        for kind in brute.PRIVATE:
            assert got[d][f"n_{kind}"] == sum(x[0] == kind for x in found)


def test_main_text(spark, sf):
    import html

    got = rows(spark, sf, "op6_main_text", "page_id")
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_near_duplicates(spark, sf, docs):
    want = brute.near([(d, r["text"]) for d, r in docs.items()])
    got = rows(spark, sf, "op7_near_duplicates")
    assert {d: (g["n_shingles"], g["component_id"]) for d, g in got.items()} == want
    assert all(g["kept"] == (d == g["component_id"]) for d, g in got.items())


def test_near_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.5, 0.85):
        n = 4000
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        new = rng.integers(0, 2**63, int(n * (1 - share) / (1 + share)), dtype=np.uint64) * np.uint64(2)
        b = np.unique(np.concatenate((a[len(new) :], new)))
        rng.shuffle(a)
        a.sort()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        told, filled = near.similarity(near.registers(a), near.registers(b))
        assert filled == near.REGISTERS and abs(told - true) < 0.12


def test_quality(spark, sf, docs):
    got = rows(spark, sf, "op8_quality_rules")
    for d, r in docs.items():
        want = brute.quality(r["text"])
        assert {k: got[d][k] for k in want} == want
        assert not (got[d]["base_failed"] and got[d]["kept"])


@pytest.mark.parametrize("block_words", [100_000, 300])
def test_decontamination(spark, sf, docs, block_words):
    items = table(spark, sf, "benchmark")
    want = brute.leaked([(d, r["text"]) for d, r in docs.items()], [tuple(r) for r in items.select("item_id", "text").collect()])
    found = leaks.matched(table(spark, sf, "documents"), items, block_words=block_words).collect()
    assert any(w[1] for w in want.values())
    for r in found:
        n, hit, names, places = want[r["id"]]
        assert (r["n_words"], sorted(map(str, r["items"]))) == (n, names)
        assert {i for s in r["spans"] for i in range(s["first"], s["last"])} == places


def test_decontamination_digest(spark, sf, docs):
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = brute.leaked([(d, r["text"]) for d, r in docs.items()], items)
    for d, g in rows(spark, sf, "op9_decontamination").items():
        n, hit, names, _ = want[d]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (n, hit, len(names), hit > 0)
        assert g["items_sha256"] == brute.sha(",".join(names))


def test_secrets(spark, sf, docs):
    got = rows(spark, sf, "op10_secrets")
    order = list(brute.SECRETS)
    owners = {}
    for d, r in docs.items():
        found = sorted(brute.spans(r["text"], brute.SECRETS), key=lambda s: (s[1], order.index(s[0])))
        assert got[d]["base_sha256"] == brute.sha(brute.joined(found)), d
        for kind in order:
            assert got[d][f"n_{kind}"] == sum(x[0] == kind for x in found)
        for kind, _, _, value in found:
            value = re.match(brute.ASSIGN, value)[1] if kind == "assign" else value
            owners.setdefault(value, set()).add(r["source"])
    copied = {d for d, r in docs.items() for v, o in owners.items() if len(o) >= secrets.EXAMPLE_OWNERS and v in (r["text"] or "")}
    assert copied <= {d for d, g in got.items() if g["n_example"]}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    from lapcast.llm import lines

    stages = dict(corpus_pipeline.STAGES)
    start = table(spark, sf, "documents")
    good = corpus_pipeline.written(stages["quality rules"](spark, start, sf))
    judged = rows(spark, sf, "op8_quality_rules")
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = {d: docs[d]["text"] for d, g in judged.items() if g["kept"]}
    assert good.columns == start.columns and text_of(good) == kept

    cut = corpus_pipeline.written(stages["line dedup"](spark, good, sf))
    late = brute.later_lines(kept.items(), lines.PERCENT, lines.LEAST_WORDS)
    rest = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in late.get(d, [])) for d, t in kept.items()}
    rest = {d: t for d, t in rest.items() if brute.words(t)}
    assert cut.columns == start.columns and text_of(cut) == rest
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    single = corpus_pipeline.written(stages["near-duplicates"](spark, cut, sf))
    alone = {d: t for d, t in rest.items() if brute.near(rest.items(), 80)[d][1] == d}
    assert single.columns == start.columns and text_of(single) == alone

    clean = corpus_pipeline.written(stages["benchmark decontamination"](spark, single, sf))
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    leak = brute.leaked(alone.items(), items)
    want = {d for d in alone if leak[d][1] <= leaks.COVERAGE * leak[d][0]}
    got = text_of(clean)
    assert clean.columns == start.columns and set(got) == want
    for d in want:
        places = leak[d][3]
        assert brute.words(got[d], brute.MARKED) == [w for i, w in enumerate(brute.words(alone[d], brute.MARKED)) if i not in places]

    assert_packed(stages["best-fit packing"](spark, clean, sf).collect(), packing.LIMIT)

"""Near-duplicates, repeats, decontamination, mixing, components, and the pipeline."""

import collections
import itertools
import math

import corpus_pipeline
import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from pagegate.llm import bytes_text, decontam, graph, mixing, neardup, registry, repeats
from pagegate.session import cut_lineage

WORDS = [f"w{k}" for k in range(4000)]


def copies(seed, n_groups, size, length, edits):
    """Groups of texts that share most words, and a chain in which only neighbours are alike."""
    r, out = np.random.default_rng(seed), []
    for _ in range(n_groups):
        base = r.choice(WORDS, length)
        for _ in range(size):
            own = base.copy()
            at = r.integers(0, length, r.integers(0, edits + 1))
            own[at] = r.choice(WORDS, len(at))
            out.append(" ".join(own))
    base = r.choice(WORDS, 100)
    for _ in range(8):
        out.append(" ".join(base))
        base = np.concatenate([base[10:], r.choice(WORDS, 10)])
    return {k * 3 + 1: t for k, t in enumerate(out)}


# ---- 7: near-duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "groups", "size", "length", "edits"), [(1, 30, 4, 60, 4), (2, 1, 90, 80, 6)])
def test_components_are_those_of_all_pairs(spark, seed, groups, size, length, edits):
    texts = copies(seed, groups, size, length, edits)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows).collect()}
    assert got == plain.components(texts)


def test_near_duplicate_edges(spark, edge, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(edge).collect()), key=str)
    n = {i: len(plain.shingles(t)) for i, t in EDGE}
    assert got == sorted([(1, n[1], 1), (2, 0, 2), (3, 0, 3), (4, n[1], 1), (4, n[1], 1), (None, n[None], None), (6, n[6], 6), (7, 0, 7), (8, n[8], 8), (9, 1, 9)], key=str)
    kept = neardup.drop_copies(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 6, 7, 8, 9], key=str)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_copies(empty).count() == 0


def test_an_id_with_several_texts_links_their_classes(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcde"}
    rows = [(1, "a"), (5, "a"), (2, "b"), (5, "b"), (7, "c"), (5, "c"), (3, "d"), (8, "d"), (9, "e"), (9, "d")]
    found = neardup.near_duplicates(spark.createDataFrame([(i, texts[c]) for i, c in rows], "doc_id long, text string"))
    got = sorted((r.doc_id, r.component_id) for r in found.collect())
    assert got == sorted([(1, 1), (5, 1), (2, 1), (5, 1), (7, 1), (5, 1), (3, 3), (8, 3), (9, 3), (9, 3)])


def test_pruning_keeps_the_chosen_miss_probability():
    from math import comb

    t = neardup.PERCENT / 100
    for n, least in zip(range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH), neardup.least_matches(), strict=True):
        below = sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(least))
        assert below < neardup.MISS <= below + comb(n + 1, least) * t**least * (1 - t) ** (n + 1 - least)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(4)
    pool = bytes_text.mix(r.integers(0, 1 << 62, 900).astype(np.uint64))
    a, b = np.unique(pool[:600]), np.unique(pool[150:750])
    sig = neardup.signatures([a, np.zeros(0, np.uint64), b])
    assert abs((sig[0] == sig[2]).mean() - 450 / 750) < 0.15


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(3, 2), (2, 3), (5, 5)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 300)} == {7} and got[3] == got[2] == 2 and got[5] == 5
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9: repeats -----------------------------------------------------------------------------------------------------------


def repeated_texts():
    r = np.random.default_rng(9)
    prose = lambda n: " ".join(r.choice(WORDS, n))
    p, q = prose(60), prose(50)
    out = [prose(80) + p + prose(30) for _ in range(6)] + [p[:210] + prose(40), prose(20) + p[40:], "x" + p + q, p + "y" + q, "é" * 150 + q + "é" * 150]
    out += ["ab" * 400, "ab" * 101, "z" * 199, "z" * 200, prose(70), "", None, p, p, "a" * 300 + prose(5) + "a" * 299]
    near = r.choice(WORDS, 90)
    for _ in range(12):
        own = near.copy()
        own[r.integers(0, 90, 3)] = r.choice(WORDS, 3)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hot", [4096, 2, 5])
def test_removal_is_that_of_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_ROWS", 50)
    texts = repeated_texts()
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(plain.without_repeats(texts)))


def test_repeat_edges(spark, edge, empty):
    got = repeats.remove_repeats(edge).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter(plain.without_repeats([t for _, t in EDGE]))
    assert {r.doc_id for r in got} == {i for i, _ in EDGE} and repeats.remove_repeats(empty).count() == 0


def test_intervals_are_all_shared_prefixes():
    got = set(repeats.prefix_intervals([2, 2, 5, 0, 3, 4, 1]))
    assert got == {(2, 0, 3), (5, 2, 3), (0, 0, 7), (3, 4, 6), (4, 5, 6), (1, 4, 7)}


def test_all_occurrences_of_a_repeat_share_its_number():
    r = np.random.default_rng(2)
    seed, tail, others = bytes(r.integers(97, 123, 100).astype(np.uint8)), bytes(r.integers(97, 123, 100).astype(np.uint8)), [bytes([65 + k]) * 100 for k in range(4)]
    rights = pa.array([seed + tail, seed + tail, seed + tail, seed + b"!" * 100], pa.binary())
    left, right, group = repeats.scan_shard(np.ones(4, np.uint64), pa.array([o[: 90 + k] for k, o in enumerate(others)], pa.binary()), rights)
    assert right.tolist() == [200, 200, 200, 0] and left.tolist() == [0, 0, 0, 0] and len(set(group[:3].tolist())) == 1 and group[3] == -1


# ---- 8: decontamination ---------------------------------------------------------------------------------------------------


def test_leaks_survive_substitutions(spark):
    r = np.random.default_rng(8)
    items = {k: r.choice(WORDS, n) for k, n in enumerate((15, 20, 40, 59, 7, 30))}
    docs, want = {}, {}
    for k, item in items.items():
        changed = item.copy()
        changed[3 :: 9] = "other"
        far = item.copy()
        far[::3] = "other"
        for j, own in enumerate((item, changed, far, r.permutation(item))):
            i = 10 * k + j
            docs[i] = " ".join([*r.choice(WORDS, 30), *[w.upper() for w in own], *r.choice(WORDS, 30)])
            want[i] = j < 2 and len(item) >= 8
    docs |= {1000: None, 1001: "", 1002: " ".join(items[3][:10]), 1003: " ".join(items[3][20:36])}
    want |= {1000: False, 1001: False, 1002: False, 1003: True}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(90, None), (91, "")], "item_id long, text string")
    leaks = decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()
    assert {x.doc_id for x in leaks} == {i for i, bad in want.items() if bad}
    assert all(x.item_id == x.doc_id // 10 for x in leaks if x.doc_id < 1000)
    exact = next(x for x in leaks if x.doc_id == 20)
    assert exact.matched == exact.stretch == 40 and exact.begin == 30


def test_every_stretch_that_counts_has_a_hit():
    masks = [(int(m, 2), len(m)) for m in decontam.MASKS]
    for n in range(7, 26):  # words of a stretch that begins and ends with a match; the shortest item that can hold it asks least
        needed = max(decontam.matches_needed(max(n, 8), decontam.LEAST, decontam.IDENTITY), math.ceil(decontam.IDENTITY * n - 1e-9))
        for k in range(n - needed + 1):
            for gone in itertools.combinations(range(1, n - 1), k):
                same = (1 << n) - 1 - sum(1 << g for g in gone)
                assert any(same >> at & m == m for m, size in masks for at in range(n - size + 1)), (n, gone)


def test_short_and_much_changed_leaks_are_found(spark):
    r = np.random.default_rng(9)
    patterns = ("1111011", "11110111", "1110110111", "1110111011", "11101110111", "111011101110111", "1111011101110111", "11110111011110111101", "1111011110111101111011110")
    patterns = [p.ljust(8, "0") for p in patterns]
    items = [r.choice(WORDS, len(p)) for p in patterns]
    # the same with one more word changed, where that is too much
    texts = [(k, [w if c == "1" else "other" for w, c in zip(x, p, strict=True)]) for k, (x, p) in enumerate(zip(items, patterns, strict=True))]
    texts += [(100 + k, ["other", *x[1:]]) for k, x in texts if k in (0, 1, 2)]
    docs = spark.createDataFrame([(k, " ".join([*r.choice(WORDS, 20), *x, *r.choice(WORDS, 20)])) for k, x in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    want = {k for k, p in enumerate(patterns) if p.count("1") >= decontam.matches_needed(len(p), decontam.LEAST, decontam.IDENTITY)}
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench).collect()} == {(k, k) for k in want} and want == set(range(1, 9))


def test_best_stretch_is_that_of_all_stretches():
    r = np.random.default_rng(6)
    for _ in range(60):
        same = r.random(25) < 0.75
        hit = np.flatnonzero(same)
        options = [int(same[a : b + 1].sum()) for a in hit for b in hit if a <= b and same[a : b + 1].mean() >= 0.8 - 1e-9]
        assert decontam.best_stretch(same, 0.8)[0] == max(options, default=0)


def test_leak_edges(spark, edge, edge_dir, empty_dir):
    got = {(r.doc_id, r.contaminated, r.item_id) for r in registry.queries()["op8_decontaminate"](spark, edge_dir).collect()}
    assert {x[0] for x in got if x[1]} == {1, 4} and len(got) == len({i for i, _ in EDGE})
    assert registry.queries()["op8_decontaminate"](spark, empty_dir).count() == 0
    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    kept = decontam.drop_leaks(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 3


# ---- 5: mixing ------------------------------------------------------------------------------------------------------------


def test_no_source_is_a_block_off_its_share(spark):
    weights = spark.createDataFrame([("a", 50), ("b", 31), ("c", 7), ("d", 1), ("e", 11), ("gone", 0)], "source string, weight long")
    slots = sorted((r.slot, r.source) for r in mixing.period_slots(weights).collect())
    assert [s for s, _ in slots] == list(range(100))
    share, had = {r.source: r.weight / 100 for r in weights.collect()}, collections.Counter()
    for t, s in slots:
        had[s] += 1
        assert all(abs(had[x] - share[x] * (t + 1)) < 1 for x in share)


def test_every_row_is_placed_once(spark, edge, empty):
    docs = spark.createDataFrame([(k, "big" if k % 3 else ("x", "y", None)[k % 9 // 3]) for k in range(2000)], "doc_id long, source string")
    got = mixing.interleave(docs, mixing.root_weights(docs), block=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000)) and len({r.mix_position for r in got}) == 2000
    assert all(r.mix_position // 4 == r.mix_slot for r in got)
    out = mixing.interleave(edge, mixing.root_weights(edge))
    assert out.columns == [*edge.columns, "mix_block", "mix_slot", "mix_position"] and out.count() == len(EDGE)
    assert mixing.interleave(empty, mixing.root_weights(empty)).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------------


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert out.columns == columns
        if name == "near_dedup":
            comps = plain.components({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in comps.items() if c == i}
        elif name == "decontamination":
            grams = {g for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for g in (tuple(plain.words(r.text)[k : k + 13]) for k in range(len(plain.words(r.text)) - 12))}
            leaky = {i for i, r in before.items() if any(tuple(plain.words(r.text)[k : k + 13]) in grams for k in range(len(plain.words(r.text)) - 12))}
            assert leaky and not leaky & set(after) and len(before) - len(after) <= len(leaky) + 2
        elif name == "pii":
            assert set(after) == set(before) and not any(plain.base_spans(r.text or "") for r in after.values())
            assert all(after[i].text == r.text for i, r in before.items() if not any(c.isdigit() or c == "@" for c in r.text or ""))
        elif name == "mixing":
            assert set(after) == set(before) and len({r.mix_position for r in after.values()}) == len(after)
        docs = out.select(*columns)
    assert corpus_pipeline.run(spark, d).count() == len(after)


def test_edges_pass_every_stage(spark, edge_dir, empty_dir):
    for d, most in ((edge_dir, len(EDGE)), (empty_dir, 0)):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, d))
            assert docs.count() <= most and (name == "mixing" or docs.columns == columns)
        assert docs.filter(F.col("mix_position").isNull()).count() == 0


def test_components_of_chains_stars_and_random_links(spark):
    """Smallest node reachable; links are read again only while their sides are apart."""
    import random

    r = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(1000, 400 + i) for i in range(300)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(7, 7), (3000, 3000)]
    r.shuffle(links)
    links = [e if r.random() < 0.5 else e[::-1] for e in links]
    up = {n: n for e in links for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.comp for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}


def test_a_group_of_near_copies_is_compared_about_once(spark, monkeypatch):
    """Buckets draw the same centers, so a group's pairs are a few times its members, not members times bands."""
    import random

    r = random.Random(6)
    own = [f"w{r.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join([*own[:k], f"x{i}", *own[k + 1 :]])) for i, k in enumerate(r.randrange(300) for _ in range(400))]
    pairs, real = [], neardup.survivors
    monkeypatch.setattr(neardup, "survivors", lambda p: pairs.append(p.count()) or real(p))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in out} == {0} and sum(pairs) <= 6 * len(rows), pairs

"""Chat formatting, licences, fingerprints, personal data, language model, toxicity."""

import hashlib
import re

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from pagegate.llm import bytes_text, chat, chunks, licenses, lstm_crf, ngram_lm, pii, registry, toxicity

TEXTS = [t for _, t in EDGE]


# ---- bytes ----------------------------------------------------------------------------------------------------


def test_words_and_shingles_are_those_of_each_text():
    data, offs = bytes_text.utf8(pa.array(TEXTS))
    starts, ends, first = bytes_text.words(data, offs)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [plain.WORD.findall(t or "") for t in TEXTS]
    h, doc = bytes_text.shingle_hashes(bytes_text.word_hashes(data, starts, ends), first, 5)
    assert [len(set(h[doc == k].tolist())) for k in range(len(TEXTS))] == [len(plain.shingles(t)) for t in TEXTS]


def test_sliced_batches_keep_their_texts():
    batch = pa.record_batch([pa.array(["x", "aé", None, "", "bcd"])], ["text"]).slice(1, 4)
    (rows, data, offs), = bytes_text.pieces(iter([batch]))
    assert rows.num_rows == 4 and [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)] == ["aé".encode(), b"", b"", b"bcd"]


# ---- 2: chat ----------------------------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", r"<\s>[\INST]", "<s>[ROLE]x[/ROLE]y[TURN]", "ends with <", "/s>", "[", r"[\\TURN]", "", None, "日本 🎉"]


def test_chats_read_back_exactly(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", t, 0) for k, t in enumerate(HARD)] + [(None, None, None, "x", 1), (2, 1, "assistant", "b", 1), (2, 1, "assistant", "b", 1), (2, 0, "[ROLE]", "a", 1)]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2], r[3] or "") for r in rows[: len(HARD)]]
    assert out[1].loss_text == "".join(t or "" for k, t in enumerate(HARD) if k % 3 == 0)
    assert [(t.role, t.text) for t in out[2].turns] == [("[ROLE]", "a"), ("assistant", "b"), ("assistant", "b")] and out[2].n_blocks == 2 and out[2].loss_text == "bb"
    assert [(t.role, t.text) for t in out[None].turns] == [("", "x")]


def test_no_chats(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- 1: licences ---------------------------------------------------------------------------------------------------


def test_licences(spark, edge, empty):
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.", 2: "  LICENSED under   the Apache-License, Version 2.0!", 3: "the mit of the license is in the park",
        4: licenses.TEMPLATES[18][1].replace(", ", ",\n"), 5: None, 6: "",
    }
    got = {r.doc_id: r.hits for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [(h.line, h.license) for h in got[1]] == [(1, "MIT")] and got[2][0].license == "Apache-2.0"
    assert got[3] == got[5] == got[6] == [] and got[4][-1].line == -1 and got[4][-1].license == "MIT"
    assert licenses.scan(edge).count() == len(EDGE) and licenses.scan(empty).count() == 0


def test_wrapped_notices_are_not_ruled_out(spark):
    # every bigram of a notice is broken by a line end, with signs and empty lines around it
    texts = [(k, re.sub(r"\s+", (" \n", "\r\n\n ", ",\n> ")[k % 3], text)) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    texts.append((100, "Released\nunder the MIT\nLicense."))
    got = {r.doc_id: r.hits for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    names = dict(enumerate(n for n, _ in licenses.TEMPLATES)) | {100: "MIT"}
    assert {k: [(h.line, h.license, h.dice) for h in hits if h.line == -1] for k, hits in got.items()} == {k: [(-1, n, 1.0)] for k, n in names.items()}


def test_pruning_loses_no_match():
    for name, grams, low, high in licenses.compiled(licenses.TEMPLATES, licenses.THRESHOLD):
        for shared in range(1, len(grams) + 1):
            sizes = [n for n in range(shared, 400) if 2 * shared / (n + len(grams)) >= licenses.THRESHOLD]
            assert all(low <= n <= high for n in sizes) and (not sizes or shared >= low), name


# ---- 10: fingerprints -----------------------------------------------------------------------------------------------


def test_fingerprints_do_not_depend_on_neighbours_and_shift(real):
    texts = [r.text for r in real.select("text").limit(40).collect()]
    together = chunks.fingerprints(*bytes_text.utf8(pa.array(texts)))
    assert together == [chunks.fingerprints(*bytes_text.utf8(pa.array([t])))[0] for t in texts]
    assert all(sum(c.values()) <= len(t.encode()) for c, t in zip(together, texts, strict=True))
    long = max(texts, key=len)
    moved = chunks.fingerprints(*bytes_text.utf8(pa.array(["a few bytes before it " + long])))[0]
    assert chunks.containment(chunks.fingerprints(*bytes_text.utf8(pa.array([long])))[0], moved) > 0.8
    assert chunks.containment({}, {}) == 1 and chunks.containment({}, {1: 2}) == 0 and chunks.containment({1: 2}, {}) == 0


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear(data).tolist() == want


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, o = t or "", order[(k + 1) % len(order)][1] or ""
        out.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200, 5000, 1 << 24])
def test_edited_texts(spark, edge_dir, edge, monkeypatch, block):
    monkeypatch.setattr(chunks.with_next, "__defaults__", (block,))
    got = chunks.op10_fingerprints(spark, edge_dir).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected_edits([r[:2] for r in EDGE])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and len({r.fingerprint for r in got if r.doc_id in (1, 4)}) == 1


def test_no_fingerprints(spark, empty_dir):
    assert chunks.op10_fingerprints(spark, empty_dir).count() == 0


# ---- 4: personal data -------------------------------------------------------------------------------------------------

DATA = (
    "a@b.c x@y@z.de aa..b+%-@c-.d.e.f. @x.y a@b 1.2.3.4.5 300.1.1.1 255.255.255.255.1.1.1.1 0001.2.3.4 4111 1111 1111 1111 4111-1111-1111-1111 "
    "41111111111111111 +49 (0) 30.123-4567 +1 2 +123456789012345678 ++49 30 1234567 x+1 (988) 555-2485. 79927398713 a@b.c@d.e.f"
)


def test_base_spans_are_the_patterns(real):
    for text in [DATA, *(r.text or "" for r in real.select("text").collect())]:
        assert pii.base_spans(text) == plain.base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "@a" * 60_000):
        pii.base_spans(text)


def test_model_gradients_are_slopes():
    r = np.random.default_rng(3)
    x, tags = r.integers(0, lstm_crf.CLASSES, (7, 5)).astype(np.uint8), np.array([[0] * 5, [1] * 5, [2] * 5, [2] * 5, [0] * 5, [3] * 5, [4] * 5], np.int8)
    model = {k: v.astype(np.float64) for k, v in lstm_crf.new_model().items()}
    _, slope = lstm_crf.gradients(model, x, tags)
    for k in ("xf", "hb", "out", "trans", "start"):
        at = np.unravel_index(np.abs(slope[k]).argmax(), slope[k].shape)
        up, down = ({**model, k: model[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        rise = (lstm_crf.gradients(up, x, tags)[0] - lstm_crf.gradients(down, x, tags)[0]) / 2e-2
        assert abs(rise - slope[k][at]) < 0.03 * abs(slope[k][at]) + 1e-3


def test_decoding_is_the_best_path():
    r = np.random.default_rng(5)
    e = r.standard_normal((4, 3, lstm_crf.TAGS)).astype(np.float32)
    model = lstm_crf.new_model()
    tags, chance = lstm_crf.decode(e, model, np.array([4, 2, 3]))
    trans, start = lstm_crf.rules() + model["trans"], lstm_crf.first_rules() + model["start"]
    import itertools

    for j, n in enumerate((4, 2, 3)):
        score = {p: start[p[0]] + sum(e[t, j, p[t]] for t in range(n)) + sum(trans[p[t - 1], p[t]] for t in range(1, n)) for p in itertools.product(range(lstm_crf.TAGS), repeat=n)}
        assert tuple(tags[:n, j].tolist()) == max(score, key=score.get)
        top = max(score.values())
        z = sum(np.exp(s - top) for s in score.values())
        for t in range(n):
            assert abs(sum(np.exp(s - top) for p, s in score.items() if p[t] == tags[t, j]) / z - chance[t, j]) < 1e-3


def test_personal_data(spark, edge, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.fit(docs, steps=150)
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    for r in docs.collect():
        base = plain.base_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(pii.joined(base).split(",")) <= set(got[r.doc_id].spans.split(","))
        assert got[r.doc_id].n_added == 0 or any(c.isdigit() or c == "@" for c in r.text)
    assert pii.find(edge, model).count() == len(EDGE) and pii.find(empty, None).count() == 0 and pii.fit(empty) is None
    masked = {r.doc_id: r for r in pii.mask(edge, model).collect()}
    assert masked[2].text is None and masked[8].text.count("<EMAIL>") == 1 and masked[8].text.count("<PHONE>") == 1 and masked[8].n_chars == len(masked[8].text) and masked[8].key == 1


def test_held_out_spans_are_found(spark, sf):
    """The model alone, without the patterns, finds base spans of documents that it was not trained on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    hit = total = wrong = 0
    for r in docs.filter("doc_id % 2 = 1").collect():
        base, parts = set(pii.base_spans(r.text)), pii.stretches(r.text)
        own = {(k, a + s, a + e) for (a, _), found in zip(parts, pii.model_spans(model, [r.text[a:b] for a, b in parts]), strict=True) for k, s, e in found}
        hit, total, wrong = hit + len(base & own), total + len(base), wrong + len(own - base)
    assert hit >= 0.5 * total and wrong <= 0.2 * total


def test_the_model_reads_every_character(monkeypatch):
    """spans far from any digit or `@` are found, and parts give what one path over the whole text gives."""
    r = np.random.default_rng(11)
    model = {k: v * 3 for k, v in lstm_crf.new_model().items()}
    texts = ["".join(r.choice(list("abcXY .,@19+"), n)) for n in (0, 1, 47, 48, 49, 96, 97, 5000, 700)] + ["only words, " * 300]
    monkeypatch.setattr(pii, "SURE", 0.2)
    got = pii.model_spans(model, texts)
    for text, spans in zip(texts, got, strict=True):
        n = len(text)
        x = np.zeros(-(-n // pii.BLOCK) * pii.BLOCK, np.uint8)
        x[:n] = lstm_crf.classes(text)
        last = np.arange(len(x) // pii.BLOCK) == len(x) // pii.BLOCK - 1
        e = pii.block_scores(model, x.reshape(-1, pii.BLOCK), last).transpose(0, 2, 1).reshape(-1, lstm_crf.TAGS) if n else np.zeros((0, lstm_crf.TAGS))
        e[n:] = [0] + [-60] * (lstm_crf.TAGS - 1)
        whole = pii._path_spans(np.ascontiguousarray(e[:, :, None], np.float32), model)[0] if n else []
        assert spans == [(lstm_crf.KINDS[k], a, z) for k, a, z, sure in whole if sure]
    assert any(not pii._MARKED.search(t[max(0, a - 40) : z + 40]) for t, spans in zip(texts, got, strict=True) for _, a, z in spans)


# ---- 6: language model --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("part", "chunk"), [(16 << 20, 256), (40_000, 8)])
def test_scores_are_those_of_the_recursion(spark, real, edge, monkeypatch, part, chunk):
    monkeypatch.setattr(ngram_lm, "PART_BYTES", part)
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    rows = real.select("doc_id", "text").union(edge.filter("doc_id <> 4 or doc_id is null").select(F.col("doc_id") + 10_000, "text"))
    docs = ngram_lm.with_fold(rows)
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.fit(docs)).collect()}
    want = plain.language_model({r.doc_id: r.text for r in rows.collect()}, 0, 0, ngram_lm.LEAST_COUNT, ngram_lm.DISCOUNT)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, not plain.trains(i))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [i for i in want if not plain.trains(i)]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_rare_pairs_of_a_large_text_are_learnt(spark):
    train = [i for i in range(400) if plain.trains(i)][:61]
    held = next(i for i in range(400, 800) if not plain.trains(i))
    # 120,000 tokens; each of these words occurs twice, below any share of the tokens
    texts = {i: "common filler " * 1000 for i in train[:-1]} | {train[-1]: "rare twin words rare twin words", held: "rare twin words"}
    docs = ngram_lm.with_fold(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.fit(docs)).collect()}
    want = plain.language_model(texts, 0, 0, ngram_lm.LEAST_COUNT, ngram_lm.DISCOUNT)
    assert all(got[i].score == pytest.approx(want[i][4], rel=1e-9) for i in texts) and got[held].score > got[held].base_score + 4


def test_backoff_rows_are_dealt_out_compressed(spark, monkeypatch):
    """What is shuffled is far smaller than the texts, and is all of them; n-grams that are not kept come back without numbers."""
    monkeypatch.setattr(ngram_lm, "PACK_BYTES", 50_000)
    docs = ngram_lm.with_fold(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = ngram_lm.dealt_out(docs, 3).applyInArrow(lambda t: ngram_lm.unpacked(t).append_column("size", pa.array([sum(map(len, t.column("rows").to_pylist()))] * ngram_lm.unpacked(t).num_rows)), "doc_id long, text string, held_out boolean, size long")
    rows, want = got.collect(), docs.collect()
    assert sorted(map(str, (tuple(r)[:3] for r in rows))) == sorted(map(str, map(tuple, want)))
    assert sum({r["size"] for r in rows}) < 0.6 * sum(len((r.text or "").encode()) for r in want)
    lists = ngram_lm.fit(docs).counts.filter("kind = 1").toArrow()
    counts = ngram_lm.answers(lists, ngram_lm.PAIR)
    assert 1 not in counts and counts.max() > 1 and lists.column("value").nbytes < counts.nbytes / 4


def test_no_text_to_learn_from(spark, empty, edge):
    docs = ngram_lm.with_fold(empty)
    assert ngram_lm.score(docs, ngram_lm.fit(docs)).count() == 0
    held = ngram_lm.with_fold(edge).withColumn("held_out", F.lit(True))
    assert ngram_lm.score(held, ngram_lm.fit(held)).filter("score = 0 and base_score = 0 and train_tokens = 0 and n_known = 0").count() == len(EDGE)


# ---- 3: toxicity --------------------------------------------------------------------------------------------------------


def test_toxic_documents_are_found_and_clean_ones_left(spark, sf):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    seen = toxicity.judge(docs, model).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    toxic = [r for r in seen if r.truth == 1]
    assert sum(r.toxic for r in toxic) >= 0.5 * len(toxic) and sum(r.toxic for r in seen if r.truth == 0) <= 0.03 * len(seen)


def test_a_later_model_sees_the_earlier_chance():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 6)).astype(np.float32)
    first = (x[:, 0] > 0).astype(np.float32)
    y = np.stack([first, first * (x[:, 1] > 0)], axis=1).astype(np.float32)
    chain = toxicity.fit_chain(x, y)
    assert len(chain[1]) == len(chain[0]) + 1 and chain[1][-2] > 0.2
    assert ((toxicity.run_chain(x, chain) > 0.5) == (y > 0)).mean() > 0.95


def test_toxicity_edges(spark, edge, empty, edge_dir, empty_dir):
    assert registry.queries()["op3_toxicity_chain"](spark, edge_dir).count() == len(EDGE)
    assert registry.queries()["op3_toxicity_chain"](spark, empty_dir).count() == 0
    assert toxicity.keep_clean(edge, None).columns == edge.columns and toxicity.keep_clean(edge, None).count() == len(EDGE)

"""Piece codec, Merkle manifest and filter audit."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from conftest import EDGE
from pyspark.sql import functions as F

from pagegate.llm import filter_audit, merkle, piece_codec, registry

PATH = public_tokenizers.path(piece_codec.MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11: SentencePiece codec ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def own():
    return piece_codec.Codec(piece_codec.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def noise(own, seed, n):
    r = random.Random(seed)
    letters = "ab c  \n\t▁é北🎉thein THE0123..--==\x00́"
    for k in range(n):
        kind = k % 3
        if kind == 0:
            yield "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        elif kind == 1:
            yield "".join(r.choice(own.texts).replace("▁", " ") for _ in range(r.randint(0, 30)))
        else:
            yield " " * r.randint(0, 70) + "".join(r.choice("aeinrst") for _ in range(r.randint(0, 300))) + " " * r.randint(0, 3)


def test_encoding_is_the_librarys(own, library):
    for text in noise(own, 1, 3000):
        assert own.encode(text) == library.encode(text, add_eos=True), repr(text)


def test_backtracking_gives_what_merging_gives(own):
    r = random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice("▁theanidorsl") for _ in range(r.randint(1, 24)))
        assert [own.tokens[t] for t in own.row(text)] == own.merged(text)


def test_decoding_is_the_librarys(own, library):
    r = random.Random(3)
    for k in range(4000):
        ids = [r.randrange(0, 32_000 if k % 2 else 400) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids
    assert own.decode([]) == ""


def test_long_words_without_a_blank(own, library):
    r = random.Random(4)
    for text in ("".join(r.choice("abcdefghij") for _ in range(100_000)), "a" * 100_000, " " * 50_000, "北" * 30_000, "\x01" * 30_000):
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True) and own.decode(ids) == text


def test_codec_forgets_but_stays_right(own, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT", 5)
    monkeypatch.setattr(piece_codec, "PAIRS", 7)
    for text in noise(own, 5, 300):
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_other_kinds_of_models_are_refused():
    with pytest.raises((ValueError, StopIteration, KeyError)):
        piece_codec.Codec(b"")


def test_codec_query_on_edges_and_whole_tables(spark, library, edge_dir, empty_dir, sf):
    for d in (edge_dir, sf):
        want = []
        for doc_id, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
            ids = library.encode(text or "", add_eos=True)
            want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
        assert sorted(map(tuple, registry.queries()["op11_piece_codec"](spark, d).collect()), key=str) == sorted(want, key=str)
    assert registry.queries()["op11_piece_codec"](spark, empty_dir).count() == 0


def test_ids_are_decoded_from_a_table(spark, edge):
    model = piece_codec.read_model(PATH)
    ids = piece_codec.encode(edge, model)
    got = piece_codec.decode(ids.unionByName(spark.createDataFrame([(99, None, "")], ids.schema)), model)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, t or "") for i, t in EDGE] + [(99, "")], key=str)


# ---- 12: Merkle manifest -----------------------------------------------------------------------------------------------------


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    """(left, right) of each level."""
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) -> result rows of the query."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0], sha("".join(map(field, row))), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for members in trees.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    grown = {s: levels([m[1] for m in members]) for s, members in trees.items()}
    top = levels([grown[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (doc_id, leaf, row) in enumerate(trees[s]):
            steps = way(grown[s], i) + way(top, at)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and row[4] is not None:
                node = sha("".join(map(field, (*row[:4], row[4].replace("\n", "")))))
            for left, right in steps:
                node = sha(left + node + right)
            root = top[-1][0]
            out.append((doc_id, leaf, grown[s][-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def test_van_emde_boas_addresses():
    assert [a.tolist() for a in merkle.veb(2)] == [[0], [1, 2, 3]]
    four = merkle.veb(4)  # the upper two levels first, then nine subtrees of two levels
    assert [a.tolist() for a in four[:2]] == [[0], [1, 2, 3]]
    assert four[2].tolist() == [4 + 4 * k for k in range(9)] and four[3].tolist() == [4 + 4 * k + 1 + j for k in range(9) for j in range(3)]
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 80, 2187):
        places = [x for a in merkle.addresses(n) for x in a.tolist()]
        assert sorted(places) == list(range(sum(merkle.level_sizes(n))))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 26, 27, 28, 82])
def test_subtree_and_siblings(n):
    leaves = [sha(str(k)) for k in range(n)]
    nodes, tree = merkle.subtree(leaves), levels(leaves)
    assert merkle.hexes(nodes, merkle.addresses(n)[0]) == tree[-1]
    assert merkle.siblings(nodes, n) == [way(tree, i) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_of_trees_of_all_sizes(spark, height):
    """Sources of 1 to 40 rows and some of hundreds, so that low subtrees make several storeys."""
    rows, k = [], 0
    for s, n in [(None, 7), ("", 3), ("Z", 1), ("a", 2), ("é", 30), ("hot", 250), *[(f"s{n}", n) for n in (4, 9, 10, 27, 28, 40)]]:
        for _ in range(n):
            k += 1
            rows.append((k * 7 % 1009, s, None if k % 5 == 0 else "en", k, None if k % 11 == 0 else f"text {k}\nof lines\n" if k % 3 else ""))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    given = df.select("source", "doc_id", merkle.leaf_of({c: F.col(c) for c in merkle.FIELDS}).alias("leaf"))
    trees, top = merkle.manifest(given, ["doc_id", "leaf"], height)
    assert len(trees) == {1: 6, 2: 3, 7: 1}[height]
    got = merkle.inclusion_proofs(trees, top, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    want = {(r[0], r[1]): r for r in plain_manifest(rows)}
    for r in got.collect():
        w = want[r.doc_id, r.leaf]
        assert (r.subroot, r.root, sha("".join(s.left + s.right for s in r.proof))) == w[2:5]
    assert got.select(merkle.fold(F.col("proof"), F.col("leaf")).alias("x"), "root").filter("x = root").count() == len(rows)


def test_manifest_query_on_edges_and_whole_tables(spark, edge_dir, empty_dir, sf):
    for d in (edge_dir, sf):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select(*merkle.FIELDS).collect()]
        assert sorted(map(tuple, registry.queries()["op12_merkle_manifest"](spark, d).collect()), key=str) == plain_manifest(rows)
    assert registry.queries()["op12_merkle_manifest"](spark, empty_dir).count() == 0


# ---- 13: filter audit ----------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order walked filter by filter over the documents themselves."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang or "", {f for f, x in bad.items() if x}, i in good, i in toxic))
    out, sums = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return sorted((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_query_on_edges_and_whole_tables(spark, edge_dir, empty_dir, sf):
    for d in (edge_dir, sf):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
        labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
        got = sorted(map(tuple, registry.queries()["op13_filter_audit"](spark, d).collect()))
        assert got == plain_audit(docs, labels)
    assert registry.queries()["op13_filter_audit"](spark, empty_dir).count() == 0


def test_audit_of_copies_ties_and_missing_ids(spark):
    long = " ".join(f"word{k}" for k in range(120))
    docs = [(3, long, "en"), (3, long, "de"), (5, long, "en"), (None, long, "en"), (None, "x", None), (None, "x", None), (9, "x", ""), (9, None, "en"), (10, "", "en"), (11, "A" * 50, "en"), (12, long + " #", "en"), (13, f"{long} {long}", "en"), (14, "Ä É\x0b\x0c\x1cß x", "de")]
    labels = [(3, 1, 0), (3, 0, 1), (5, None, 1), (9, 1, None), (None, 1, 1)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clashing = d.select("*", *[F.lit(1).alias(c) for c in ("part", "fails", "n", "good", "toxic", "digest", "words", "step")])
    assert sorted(map(tuple, filter_audit.audit(clashing, m).collect())) == plain_audit(docs, labels)


def test_potential_of_a_game_is_fair(spark):
    """Shapley values of all filters share out exactly what they remove together, 120-fold."""
    counts = spark.createDataFrame([("p", k, (k * k * 7 + 3) % 11, 0, 0) for k in range(32)], "part string, fails int, n long, good long, toxic long")
    row = filter_audit.with_shapley(filter_audit.coalitions(counts)).first()
    assert sum(row.shapley) == 120 * row.v_n[31] and len(row.v_n) == 32

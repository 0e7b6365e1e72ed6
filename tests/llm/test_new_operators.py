"""Manifest, piece encoding and whitening against plain computations on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quantloom.llm import merkle, piece_encoding, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, g int, rank string"


def documents(n=700):
    """Several languages (one with thousands of digits to go, one with a single row), nulls everywhere, repeats, one long text."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(["en"] * 8 + ["de", "d", "日本", None, ""])
        text = rng.choice([None, "", "Ab cÉ " * rng.randint(0, 9), f"Doc {i} SAYS hello"])
        rows.append((rng.choice([i, 10**15 + i, -i]), text, lang, rng.choice(["web", None, "a:b"]), rng.choice([None, i]), "h", 3, "r"))
    rows += [rows[3]] * 3 + [(rows[5][0], "other", rows[5][2], "s", 1, "h", 3, "r"), (None, "no Id", "en", None, None, "h", 3, "r"), (None, None, None, None, None, None, None, None)]
    rows += [(5, "ONE", "only", "s", 3, "h", 3, "r"), (2**63 - 1, "last", "en", "s", 4, "h", 3, "r"), (-(2**63), "first", "en", "s", 5, "h", 3, "r"), (77, "Long " * 40_000, "en", "s", 5, "h", 3, "r")]
    return rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """A literal tree: lists of levels per language and over languages."""

    def said(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    leaves = {}
    for doc, text, lang, source, n_chars, *_ in rows:
        leaf = H(said(doc), said(source), said(lang), said(n_chars), said(text))
        bad = leaf
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            bad = H(said(doc), said(source), said(lang), said(n_chars), said(text.translate(LOW)))
        leaves.setdefault(lang, []).append((doc, leaf, bad))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    trees = {}
    for lang in langs:
        leaves[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = levels([x[1] for x in leaves[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    found = []
    for k, lang in enumerate(langs):
        for i, (doc, leaf, bad) in enumerate(leaves[lang]):
            proof, node = "", bad
            for at, tree in ((i, trees[lang]), (k, top)):
                for level in tree[:-1]:
                    start = at // 8 * 8
                    family = level[start : start + 8]
                    proof += "".join(family[: at - start] + family[at - start + 1 :])
                    node = H(*family[: at - start], node, *family[at - start + 1 :])
                    at //= 8
            found.append((doc, leaf, trees[lang][-1][0], top[-1][0], H(proof), node, node == top[-1][0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("bucket", [merkle.BUCKET, 5])
def test_merkle_manifest_matches_a_literal_tree(spark, monkeypatch, bucket):
    """Also with tiny buckets, so that prefixes grow through the id, the leaf and the row number."""
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    rows = documents(700 if bucket > 5 else 150)
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = plain_manifest(rows)
    assert sorted(map(tuple, got), key=repr) == want
    tampered = {r["doc_id"] for r in got if not r["verified"]}
    assert tampered and all(zlib.crc32(str(i).encode()) % 3 == 0 for i in tampered)


def test_merkle_manifest_with_two_passes_and_many_groups(spark):
    """One language of 4,500 rows (five levels, two passes), and 600 of one row each."""
    rows = [(i, f"T{i}", "en", "s", i, "h", 1, "r") for i in range(4500)] + [(10_000 + i, "x", f"l{i}", "s", i, "h", 1, "r") for i in range(600)]
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


def test_merkle_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.digest(empty).count() == 0
    one = [(1, "A", None, None, None, None, None, None)]
    row = merkle.digest(spark.createDataFrame(one, SCHEMA)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H("")
    evidence = merkle.proofs(spark.createDataFrame(documents(40), SCHEMA)).withColumn("again", merkle.fold(F.col("leaf"), F.col("proof")))
    assert evidence.where("again = root").count() == 50


def test_ranks_follow_the_bytes_of_keys(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET", 2)
    rng = random.Random(3)
    keys = {"".join(rng.choice("abé日") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    rows = [(f"g{k}", x) for k in range(2) for x in keys]
    from quantloom.llm.common import Stage

    got = {(r["g"], r["rank"]): r["own"] for r in merkle.ranks(spark.createDataFrame(rows, "g string, key string").withColumn("own", F.col("key")), Stage(spark, "t"), "t").collect()}
    for g in ("g0", "g1"):
        assert [got[g, i] for i in range(len(keys))] == sorted(keys, key=str.encode)


@pytest.fixture(scope="module")
def table():
    return piece_encoding.PieceTable(piece_encoding.model_bytes())


def odd_texts(table, n=4000):
    rng = random.Random(8)
    letters = sorted({c for t in table.tokens for c in t})
    foreign = "①\n\t\x00😀ẑ　▁"
    for k in range(n):
        kind = k % 5
        if kind == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        elif kind == 1:
            yield "".join(rng.choice(table.tokens) for _ in range(rng.randint(1, 12)))
        elif kind == 2:
            yield "".join(rng.choice("ab▁ e t") for _ in range(rng.randint(1, 40)))
        elif kind == 3:
            yield "".join(rng.choice([rng.choice(table.tokens), rng.choice(foreign), " ", "  ", " " * rng.randint(1, 40)]) for _ in range(rng.randint(1, 15)))
        else:
            yield "".join(rng.choice("lo") for _ in range(rng.randint(1, 90)))


def test_piece_table_encodes_as_the_library(table):
    library = table.library
    texts = list(odd_texts(table))
    packed = [b"".join(p[0] for p in parts) for parts in table.parts(texts)]
    for text, ids in zip(texts, packed, strict=True):
        want = library.encode(text)
        assert piece_encoding._unpack(ids) == want == table.encode(text), text
    assert table.encode("x" * 300_000) == library.encode("x" * 300_000)


def test_prefix_table_and_pairs_by_literal_merging(table):
    """The last token of every prefix, and whether two tokens agree, by merging from scratch."""
    rng = random.Random(2)
    for text in ("▁international▁understanding", "▁▁▁▁▁the▁▁end", "lololololo", "▁Straßenbahnhaltestelle"):
        last = table.prefixes(text)
        assert [table.tokens[k] for k in last[1:]] == [table._merged(text[:i])[-1] for i in range(1, len(text) + 1)]
    for _ in range(3000):
        a, b = rng.randrange(len(table.tokens)), rng.randrange(len(table.tokens))
        x, y = table.tokens[a], table.tokens[b]
        assert table.agree(a, b) == (table._merged(x + y) == [x, y]) == bool(table.agree_many(np.array([a]), np.array([b]))[0])


def test_words_that_do_not_fit_are_forgotten(table, monkeypatch):
    monkeypatch.setattr(piece_encoding, "WORDS", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(20)]
    for text in texts:
        assert table.encode(text) == table.library.encode(text)
        assert len(table.words) <= 60


def test_sentencepiece_digest_and_round_trip(spark, table):
    texts = [None, "", " ", "a  b ", "Hello World", "Hello World", "日本語 ①\n", "word " * 60_000, *odd_texts(table, 60)]
    rows = [(None if i == 4 else i, t, 1, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string").repartition(3)
    got = sorted((tuple(r) for r in piece_encoding.digest(df).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_encoding.model_bytes())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), H(",".join(map(str, ids))), H(library.decode(ids))))
    assert got == sorted(want, key=repr)
    back = piece_encoding.decode(piece_encoding.encode(df.where("doc_id < 8")))
    said = {r["doc_id"]: r["text"] for r in back.collect()}
    assert all(said[i] == library.decode(library.encode(t or "")) for i, t, *_ in rows if i is not None and i < 8)
    assert piece_encoding.digest(df.limit(0)).count() == 0


def plain_whitening(vectors, count=8):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    v = np.array([[float((n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j])) / n**2 for j in range(dim)] for i in range(dim)])
    e, q = np.linalg.eigh(v)
    deep = np.array([[r[j] - sums[j] / n for j in range(dim)] for r in x]) @ q[:, ::-1][:, :count]
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x], deep / np.sqrt(e[::-1][:count]), e[::-1][:count] / np.trace(v)


def test_whitening_matches_a_plain_computation(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 5
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(good)]
    broken = [(1000, None, 0), (1001, [None] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [float("inf")] + [0.0] * 11, 0), (1004, [1.0] * 3, 0), (1005, [], 0)]
    df = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>, n int").repartition(4)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    n, deviation, white, share = plain_whitening(good.tolist())
    assert len(got) == 300 * 8 and {i for i, _ in got} == set(range(300))
    assert all(r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] - share[k - 1]) < 1e-12 and r["identity_error"] < 1e-9 for (i, k), r in got.items())
    for k in range(8):
        mine = np.array([got[i, k + 1]["whitened"] for i in range(300)])
        assert min(abs(mine - white[:, k]).max(), abs(mine + white[:, k]).max()) < 1e-9


def test_scatter_is_exact_for_large_entries(spark):
    """Products far beyond 2^63, negative entries included."""
    rng = random.Random(6)
    rows = [[rng.choice([-1, 1]) * rng.randrange(1 << 40) / 3 for _ in range(3)] for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(3)
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in rows]
    widest = max(abs(c) for r in x for c in r)
    found = whitening.scatter(df, 3, 50, widest)
    assert [[int(c) for c in r] for r in found.products] == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    assert [int(c) for c in found.sums] == [sum(r[j] for r in x) for j in range(3)]
    big = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = whitening.whiten(big).where("component = 1").collect()
    assert all(r["deviation"] is None and r["identity_error"] < 1e-6 for r in got)


def test_whitening_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 3 for r in got)
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and abs(sum(r["whitened"] ** 2 for r in got if r["component"] == 1) / 5 - 1) < 1e-12
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    assert len(whitening.primes(20)) == len(set(whitening.primes(20))) == 20

"""The training-data operators against brute force on small fixtures."""

import hashlib
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import decontamination, fingerprints, language_id, license_scan, ngram_join, packing, sharding, suffix_dedup, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Ties, copies, near copies, shared passages, nulls, blanks, accents, one long and some short texts."""
    rng = random.Random(11)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    base = words(rng, 100).split()
    passage = words(rng, 40)
    for i in range(25):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(100)] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 4 + [f"{words(rng, 60)} {passage} {words(rng, 50)}" for _ in range(12)]
    texts += [None, "", " \t\n", "one", "one", "Two words", "two WORDS", "é" * 130, "é" * 131, "ab" * 400, "x" * 99, "x" * 100, "x" * 101, words(rng, 6000, 50)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i + 1, texts[j]) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", -1, "n", 7, "k") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, n int, k string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_repeats(corpus, n=100):
    seen, out = set(), {}
    for i, t in sorted(corpus, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(docs, corpus, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    want = brute_repeats(corpus)
    assert got == {i: v[:4] for i, v in want.items()}
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all((r["text"] or "") == want[i][4].decode("utf-8", "ignore") and r["n_chars"] == len(r["text"] or "") and r["k"] == "k" for i, r in cut.items())
    assert suffix_dedup.digest(empty).count() == 0


def spans_by_brute_force(rows, n=100):
    """Removed bytes of each distinct (id, text), null ids last, texts of one id as separate documents in the order of Spark's hash."""
    seen, out = set(), {}
    for i, t in rows:
        if (i, t) in out:
            continue
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        out[i, t] = (len(raw), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a" * 150), (1, "a" * 150), (2, "q" + "a" * 100)], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.digest(rows).collect())
    assert got == [(1, 150, 149, 1), (1, 150, 149, 1), (2, 101, 100, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_dedup_of_null_ids_shared_ids_and_hot_strings(spark, parts, monkeypatch):
    """Null ids, one id with several texts, ids beyond 2**53, a string in hundreds of contexts, over one sorted run and over several."""
    rng = random.Random(21)
    hot = "".join(rng.choice("abcdef ") for _ in range(120))
    rows = [(i, f"{words(rng, 15)} {hot} {words(rng, 15)}") for i in range(400)]
    rows += [(2**53 + i, rows[i][1][20:]) for i in range(3)]
    shared = words(rng, 60)
    rows += [(1000, shared), (1000, words(rng, 60)), (1000, words(rng, 10) + shared[:200]), (None, shared), (None, shared), (None, "z" * 300), (None, None), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.asc_nulls_last("doc_id"), F.hash(F.coalesce("text", F.lit("")))).collect()]
    want = spans_by_brute_force(order)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ROWS", 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.digest(df).collect()
        kept = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got))) == sorted(map(repr, ((i, *want[i, t]) for i, t in rows)))
    assert sorted(map(repr, kept)) == sorted(map(repr, ((i, want[i, t][2]) for i, t in rows)))


def test_edges_of_sorted_runs():
    """Splitting a sorted list anywhere gives what one task gives."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(3), rng.randrange(4), 0, rng.randrange(3), 1) for _ in range(60))

    def ranked(parts):
        found, edges = set(), []
        for no, part in enumerate(parts):
            cols = [np.array(x, np.int64) for x in zip(*part, strict=True)]
            batch = suffix_dedup._batch(suffix_dedup._ROW, np.zeros(len(part), np.int64), *cols)
            cut = rng.randrange(len(part)) if len(part) > 1 else 0
            suffix_dedup.TaskContext = type("T", (), {"get": staticmethod(lambda no=no: type("C", (), {"partitionId": lambda self: no})())})
            for b in suffix_dedup._rank(100, True)(iter([batch.slice(0, cut), batch.slice(cut)])):
                for r in b.to_pylist():
                    if r["kind"] > 2:
                        edges.append(r)
                    elif r["kind"] == 1:
                        found |= {(1, r["doc"], x) for x in range(r["lo"], r["span"])}
                    else:
                        found.add((2, r["doc"], r["lo"], r["k"], r["sw"]))
        return found, edges

    from pyspark import TaskContext

    try:
        for _ in range(200):
            whole, edges = ranked([rows])
            cuts = sorted({0, len(rows), *(rng.randrange(1, len(rows)) for _ in range(rng.randrange(8)))})
            found, edges = ranked([rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
            for x in suffix_dedup._across(edges, 100, True):
                found |= {(1, x[1], p) for p in range(x[3], x[4])} if x[0] == 1 else {(2, x[1], x[3])}
            short = lambda f: {x[:3] for x in f}
            assert short(whole) <= short(found)
            assert {x for x in short(found) if x[0] == 1} == {x for x in short(whole) if x[0] == 1}
    finally:
        suffix_dedup.TaskContext = TaskContext


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(corpus):
    sets = {i: shingles(t) for i, t in corpus}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs, corpus, empty):
    want = brute_components(corpus)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_on_a_family_of_edits(spark):
    """Members that reach one another through others only, and many that share half of their words."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(80):
        t = list(base)
        for j in range(i // 8):
            t[(7 * j) % 60] = f"z{i // 8}_{j}" if i % 3 else f"y{j}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:30]) + " " + words(rng, 30)) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_an_id_with_two_texts_and_of_null_ids(spark):
    """Whatever one text of a document links with belongs to the document; rows without an id are left out."""
    rng = random.Random(31)
    a, c, d = (words(rng, 40) for _ in range(3))
    near = a.rsplit(" ", 2)[0]
    rows = [(1, c), (1, a), (5, near), (7, d), (7, c), (9, d), (9, None), (None, a), (12, a + " " + words(rng, 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(3):
        got = ngram_join.near_duplicates(df.repartition(3)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"]} == {(1, 1), (5, 1), (7, 1), (9, 1), (12, 12)}
        assert len(got) == len(rows) - 1


def test_rows_of_leaders_follow_the_lists():
    """A list gives a row for each set but its leader, however many batches the lists come in."""
    import numpy as np
    import pyarrow as pa

    lists, sets = 40, 4
    s = np.tile(np.arange(sets), lists)
    rows = {"h": np.repeat(np.arange(lists), sets), "s": s, "n": np.full(len(s), 50, np.int32), "pos": np.zeros(len(s), np.int32), "w": 100 - s, "c": s}
    whole = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in rows.items()})
    for size in (len(s), 10 * sets, sets, 3):
        got = [tuple(r.values())[:2] for b in ngram_join._stars(80, 0)(whole.slice(i, size) for i in range(0, len(s), size)) for r in b.to_pylist()]
        assert sorted(got) == sorted([(0, x) for x in range(1, sets)] * lists)


def test_components_stop_at_stars(spark):
    """Stars on the least node take no round at all, as no round would change them; chains and hubs still end as stars."""
    from quantloom.llm.common import Stage
    from quantloom.llm.graph import components

    class Named(Stage):
        def write(self, df, name):
            names.append(name)
            return super().write(df, name)

    def run(edges):
        names.clear()
        got = components(spark.createDataFrame(edges, "a long, b long"), Named(spark, "stars")).collect()
        return {r["node"]: r["root"] for r in got}, len(got)

    names = []
    assert run([(1, 2), (3, 1), (1, 3), (10, 12), (7, 7)]) == ({2: 1, 3: 1, 12: 10}, 3)
    assert len(names) == 1
    assert run([]) == ({}, 0)
    chain = [(i, i + 1) for i in range(20)] + [(40, 50), (40, 60), (60, 30)]
    assert run(chain) == ({i: 0 for i in range(1, 21)} | {40: 30, 50: 30, 60: 30}, 23)


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    urls = ["http://Example.ORG/es/x?y#z", "https://a.b.example.org/en/12", "http://example.org", "http://org", "org/x", None, "", "://", "http://x.com/fr/a", "http://x.com/de/b", "http://com/fr/", "http://notexample.org/es/", "http://example.org:80/es/", "http://é.com/fr/é?", "http://x.com/fr", "a://b://c.org/"]
    rows = [(i % 14, u, "old") for i, u in enumerate(urls * 2)]
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(df, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(url_filter.ORACLE).fetchall()))
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0
    none = url_filter.judge(df, url_filter.rule_table(spark).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_url_filter_against_a_loop_over_nested_rules(spark):
    rng = random.Random(4)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "d"]
    rules = list({(rng.choice(hosts), "/" + "".join(rng.choice("pq/") for _ in range(rng.randrange(5)))): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    urls = [(i, f"http://{rng.choice(hosts)}/" + "".join(rng.choice("pq/") for _ in range(6))) for i in range(200)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), table).collect():
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        want = max(fits)[2:] if fits else (None, "allow")
        assert (r["rule"], r["verdict"]) == want


def test_url_filter_salts_and_urls_without_host(spark):
    """Heavy keys get more salts than others; null ids, repeated and null URLs keep their rows; a plain run gives the same."""
    rng = random.Random(9)
    urls = [(None if i % 7 == 0 else i, rng.choice([None, "", "no scheme", f"http://h{i % 40}.com/{rng.choice(['fr', 'de'])}/{i}", "https://a.example.org/en/1" + "0" * (i % 9)])) for i in range(600)]
    df = spark.createDataFrame(urls + urls[:50], "page_id long, url string").repartition(6)
    plain = url_filter.judge(df, url_filter.rule_table(spark))
    salted = url_filter.judge(df, url_filter.rule_table(spark), salts=2, salt_rows=10)
    assert salted.columns == plain.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
    assert plain.count() == 650 and {r["verdict"] for r in plain.where("host = ''").collect()} == {"allow"}


def test_fingerprints(docs, corpus, empty):
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    order = sorted(corpus, reverse=True, key=lambda x: x[0])
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = dict(corpus)
    for a in got:
        for b in got:
            if texts[a] == texts[b]:
                assert got[a]["fingerprint"] == got[b]["fingerprint"]
    long = [r for i, r in got.items() if 80 <= len((texts[i] or "").split()) <= 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.3
    assert fingerprints.edited_likeness(empty).count() == 0


def test_syncmers_do_not_depend_on_context(spark):
    rng = random.Random(9)
    t = words(rng, 200)
    df = spark.createDataFrame([(1, t), (2, "x y z " + t)], "doc_id long, text string")
    rows = fingerprints.anchors(df).collect()
    a = {(r["position"], r["kmer"]) for r in rows if r["doc_id"] == 1}
    b = {(r["position"] - 3, r["kmer"]) for r in rows if r["doc_id"] == 2}
    assert a and a <= b


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def longs_hash(values):
    """Spark's xxhash64 over longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), h)
    return signed(h)


def sketches(text):
    """Chosen k-mers and words as {hash: first place}, by plain loops."""
    units = [y for x in re.split(r"[\x09-\x0D\x20]+", text or "") for y in (x if len(x) > 40 else [x]) if y]
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in units]
    pairs = [longs_hash(x) for x in zip(w, w[1:], strict=False)]
    kmers, single = {}, {}
    for i in range(len(w) - 5):
        least = min(pairs[i : i + 5])
        if least in (pairs[i], pairs[i + 4]):
            kmers.setdefault(longs_hash(w[i : i + 6]) >> 32, i)
    for i, x in enumerate(w):
        single.setdefault(x >> 32, i)
    signed32 = lambda d: {((k + 2**31) % 2**32) - 2**31: v for k, v in d.items()}
    return signed32(kmers), signed32(single)


def plain_fingerprint(text):
    values = next((x for x in sketches(text) if x), {})
    return "".join(f"{(h % 2**32) << 32 | i:016x}" for h, i in sorted(values.items())[:64])


def plain_likeness(a, b):
    a, b = sketches(a), sketches(b)
    a, b = (x[0] if a[0] and b[0] else x[1] for x in (a, b))
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    a, b = (dict(sorted(x.items())[:64]) for x in (a, b))
    union = sorted(a.keys() | b.keys())[:64]
    shifts = sorted(b[h] - a[h] for h in union if h in a and h in b)
    j = sum(abs(s - shifts[len(shifts) // 2]) <= 32 for s in shifts) / len(union)
    return 2 * j / (1 + j)


def test_fingerprints_equal_a_plain_computation(spark):
    """Texts of 0 to 30 words and long ones, edited, reordered and repeated; likeness and fingerprints by plain loops."""
    rng = random.Random(12)
    texts = [words(rng, n % 31, 10**6) for n in range(90)]
    base = words(rng, 300, 10**6).split()
    for i in range(12):
        t = list(base)
        for _ in range(i * 3):
            t[rng.randrange(300)] = f"e{rng.random()}"
        texts.append(" ".join(t))
    texts += [" ".join(base[150:] + base[:150]), " ".join(base[100:200] * 5), " ".join(["new"] * 200 + base), None, "", "a" * 5000, words(rng, 9000, 50)]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1200))
    texts += [han, han[:600] + "\U00020000" + han[600:], "x" * 40 + " " + "y" * 41, f"one {han[:50]} two {han[50:90]} \U0001F600"]
    rows = list(enumerate(texts)) + [(None, texts[40]), (7, texts[41])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.edited_likeness(df).collect()
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(edited), round(plain_likeness(t, edited), 9), round(plain_likeness(t, nxt), 9)))
    found = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert all(bool(w[3]) == bool((t or "").split()) for w, (_, t) in zip(want, order, strict=True))
    halves_swapped, shifted = texts[102], texts[104]
    assert plain_likeness(han, texts[110]) > 0.9 and plain_likeness(han, texts[90]) == 0.0
    assert plain_likeness(texts[90], halves_swapped) < 0.8 < 0.9 < plain_likeness(texts[90], shifted)


@pytest.mark.parametrize("rows,most", [(8, 1 << 18), (128, 1 << 18), (8, 16)])
def test_next_of_outlying_frequent_and_null_ids(spark, rows, most):
    """One outlying id doesn't leave all rows in one range, nor does an id that a third of the rows have."""
    rng = random.Random(5)
    ids = [*range(300), -(2**63), 2**63 - 1, 2**53 + 1, 2**53 + 2, *[77] * 150, *[None] * 150]
    data = [(i, f"text {rng.random()}") for i in ids] + [(5, None), (5, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    sizes = [r["count"] for r in fingerprints.with_ranges(df, rows, most).groupBy("_ql_start", "_ql_sub").count().collect()]
    assert sum(sizes) == len(data) and max(sizes) <= 4 * max(rows, len(data) // most)
    got = fingerprints.with_next(df, ["text", "doc_id"], rows, most).collect()
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1] is not None))
    want = [(*a, b[1], b[0]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["next_text"], r["next_doc_id"]) for r in got))) == sorted(map(repr, want))


def contained_licenses(rows, templates):
    """(id, license) by plain containment of the pairs of words."""
    pairs = lambda t: set(zip(w := [x for x in re.split(r"[^\w]+", (t or "").lower()) if x], w[1:], strict=False))
    known = [(name, p) for name, t in templates if name is not None and (p := pairs(t))]
    return {(i, name) for i, t in rows for name, p in known if len(p & (mine := pairs(t))) >= 0.8 * len(p) and mine}


def test_license_scan_against_containment(spark, empty):
    """Notices of three words and more in any context: none is made up, and nearly all are retrieved."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        name, notice = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        rows.append((i, f"{words(rng, rng.randint(0, 60))} {notice if i % 3 else ''} {words(rng, rng.randint(0, 40))}"))
    rows += [(1000, None), (1001, ""), (1002, "license"), (1003, "ALL RIGHTS  reserved"), (1003, "nothing here"), (None, "all rights reserved."), (1004, words(rng, 30_000) + " Licensed under CC BY-NC 4.0. " + words(rng, 10))]
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = contained_licenses(rows, license_scan.TEMPLATES)
    assert got <= want and len(got) >= 0.985 * len(want) and {(1003, "proprietary"), (None, "proprietary"), (1004, "CC-BY-NC-4.0")} <= want
    assert license_scan.scan(empty).count() == 0
    assert license_scan.bands_needed(2) >= 16


def test_license_scan_of_whole_license_texts(spark):
    """A table of long templates, in documents whole, edited, cut in half and twice."""
    rng = random.Random(18)
    templates = [(f"L{i}", words(rng, rng.randint(300, 900), 800)) for i in range(30)] + [("short", "all rights reserved"), (None, words(rng, 50)), ("one", "word"), ("none", None)]
    rows = []
    for i in range(90):
        t = templates[i % 30][1].split()
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = "changed"
        body = " ".join(t if i % 5 else t[: len(t) // 2])
        rows.append((i, f"{words(rng, rng.randint(0, 400), 800)} {body} {words(rng, 50, 800)} {body if i % 7 == 0 else ''}"))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=spark.createDataFrame(templates, "license string, text string")).collect()
    want = contained_licenses(rows, templates)
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(want) > 60 and all(r["containment"] >= 0.8 for r in got)


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        d = edit_distance(p, t)
        assert decontamination.myers(p, t, 200) == d
        assert decontamination.myers(p, t, d - 1) is None


def test_decontamination_finds_every_edited_passage(spark, empty):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(12)] + [(50, None), (51, "tiny")]
    rows, want = [], {}
    for i in range(60):
        item, passage = items[i % 12]
        p = list(passage)
        edits = i % 12
        for _ in range(edits):
            p[rng.randrange(len(p))] = rng.choice(["", "#", "ab"])
        rows.append((i, f"{words(rng, 20)} {''.join(p).upper() if i % 2 else ''.join(p)}\n {words(rng, 20)}"))
    rows += [(100, None), (101, "")]
    norm = [(i, decontamination.normal(t)) for i, t in items if t]
    for i, t in rows:
        found = [j for j, p in norm if edit_distance(p, decontamination.normal(t)) <= int(0.05 * len(p))]
        want[i] = found
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.report(df, bench).collect()}
    assert got == want and any(want.values()) and not all(want.values())
    kept = decontamination.drop_contaminated(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, f in want.items() if not f} and kept.columns == df.columns
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.drop_contaminated(df, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_decontamination_by_short_items_and_items_of_several_texts(spark, monkeypatch, block):
    """Short items occur exactly and as whole words; the result doesn't depend on the number of scans."""
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
    items = [(1, "What is 2+2?"), (2, "cat"), (3, "the first text of this item is here"), (3, "another text of the very same item"), (None, "null id"), (4, " "), (4, None)]
    texts = ["What is 2+2?", "so,  what is\n2+2?ok", "concatenate cats", "a cat.", "cat", "xcat", "the first text of this item is here", "and another text of the very same item!", "another text of the vary same item", None, "", "null id", "x" * 300_000 + " cat " + "y" * 10]
    want = [[1], [1], [], [2], [2], [], [3], [3], [3], [], [], [], [2]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a cat")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.report(df, bench).collect()}
    assert got == dict(enumerate(want)) | {None: [2]}


def test_decoder_restores_disguises():
    counts = np.ones((28, 28, 28))
    for w in ("idiot", "stupid", "the", "of") * 50:
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 10
    d = toxicity.Decoder(counts)
    assert [d.decode(w) for w in ("1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "$tup1d")] == ["idiot", "idiot", "idiot", "idiot", "stupid"]


def test_decoder_equals_enumeration():
    """The cheapest of all readings of a lattice, by listing them; a long word takes time in proportion to its length."""
    rng = random.Random(19)
    counts = np.array([[[rng.randrange(50) for _ in range(28)] for _ in range(28)] for _ in range(28)], float)
    d = toxicity.Decoder(counts)

    def cost_of(letters):
        code = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in letters), 0]
        return sum(d.cost[a][b][c] for a, b, c in zip(code, code[1:], code[2:], strict=False))

    for _ in range(150):
        word = "".join(rng.choice("ab1$.*eé-0 ccc6") for _ in range(rng.randint(1, 8)))
        readings = [("", 0.0)]
        for ways in d._steps(word):
            readings = [(t + x, c + e) for t, c in readings for x, _, e in ways]
        want = min(c + cost_of(t) for t, c in readings)
        found = d.decode(word)
        assert abs(min(c for t, c in readings if t == found) + cost_of(found) - want) < 1e-9
    began = time.perf_counter()
    rounds = "".join(rng.choice("0123456789abcdef") for _ in range(100_000))
    assert len(d._decode(rounds)) > 50_000 and time.perf_counter() - began < 20


def test_the_gate_finds_disguised_words():
    """Recall of the spans that are decoded, over random disguises of words inside texts."""
    rng = random.Random(23)
    swaps = {"o": "0", "i": "1!", "e": "3", "a": "4@", "s": "5$", "t": "7+", "b": "8", "l": "1|"}
    vocabulary = ["stupid", "idiot", "moron", "bastard", "loser", "trash", "filthy", "scumbag"]
    found = 0
    for i in range(400):
        w = rng.choice(vocabulary)
        way = i % 4
        if way == 0:
            at = rng.choice([j for j, c in enumerate(w) if c in swaps])
            shown = "".join(rng.choice(swaps[c]) if c in swaps and (j == at or rng.random() < 0.5) else c for j, c in enumerate(w))
        elif way == 1:
            shown = rng.choice([" ", ".", "-", "_", "*"]).join(w)
        elif way == 2:
            at = rng.randrange(1, len(w))
            shown = w[:at] + rng.choice([".", "-", "_"]) + w[at:]
        else:
            at = rng.randrange(len(w))
            shown = w[:at] + w[at] * rng.randint(3, 7) + w[at + 1 :]
        text = f"{words(rng, 3)} {shown} {words(rng, 3)}".encode()
        buf = np.frombuffer(text, np.uint8)
        lo = text.index(shown.encode())
        spans = toxicity.disguised(buf, language_id.fold_letters(buf), np.array([0, len(buf)]))
        found += any(a <= lo and lo + len(shown) <= b and b - a <= len(shown) + 8 for _, a, b in spans)
    assert found >= 0.97 * 400


def test_toxicity_learns_from_one_text_of_an_id(spark):
    rows = [(i % 40, f"{'vile' if i % 40 % 4 == 0 else 'kind'} words {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.rate(df, labels, train_rows=20).collect()
    assert len(got) == 400 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    bad = ["nasty", "vile", "rotten"]
    for i in range(900):
        t = words(rng, rng.randint(5, 40), 300).split()
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(bad)
            t.insert(rng.randrange(len(t)), w if i % 8 else w.replace("o", "0").replace("a", "@").replace("i", "1"))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "!!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.rate(df, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"] and i < 2000} == set(held)
    right = sum(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2000]["predicted"] == got[2001]["predicted"] == 0
    assert toxicity.rate(empty, lab).count() == 0
    assert toxicity.rate(df, lab.limit(0)).count() == len(rows)


def test_toxicity_of_words_cut_or_ending_in_signs(spark):
    rng = random.Random(13)
    bad = ["idiot", "ass", "moron", "stupid"]
    rows, labels = [], []
    for i in range(800):
        t = words(rng, rng.randint(5, 40), 300).split()
        if i % 4 == 0:
            t.insert(rng.randrange(len(t)), bad[i // 4 % 4])
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    planted = ["a$$", "idio+", "st.upid", "mo-ron", "m o ron", "mor o n", "i d i o t", "i  d  i  o  t", "i - d - i - o - t", "an i d i o t", "moron!", "1d10t!"]
    rows += [(5000 + i, f"w1 w2 {w} w3 w4") for i, w in enumerate(planted)] + [(6000, "w1 w2 w3! w4-w5 a w6")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.rate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [w for i, w in enumerate(planted) if not got[5000 + i]] == [] and got[6000] == 0


def test_language_on_held_out_rows(spark, empty):
    rng = random.Random(5)
    alphabet = {"aa": "abcde ", "bb": "fghij ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(10, 200))) + " z", lang) for i in range(300) for lang in [rng.choice(list(alphabet))]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (1003, "…", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)} == {"und"}
    known = {name: [w for _, t, lang in rows[:300] if lang == name for w in t.split() if len(w) > 4] for name in alphabet}
    torn = " ".join(w for name in alphabet for w in known[name][:80])
    two = spark.createDataFrame([(2000, torn, "aa"), (2001, "abcde bcdea abced edcba dbcea aabbc", "cc")], df.schema)
    kept = language_id.keep_told(df.unionByName(two).withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    rows = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert set(rows) == set(range(300)) | {2001} and rows[2001] == "aa"
    assert language_id.keep_told(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0 == language_id.keep_told(empty).count()
    assert language_id.identify(empty).count() == 0


def test_mixture_shares():
    lik = np.array([[1, 1e-3]] * 30 + [[1e-3, 1]] * 10)
    share = language_id.infer(lik, np.array([0]), np.array([40]))
    assert abs(share[0, 0] - 0.75) < 0.02


def plain_inference(lik, penalty=4.0):
    """One document: EM by plain loops for the k likeliest languages of the full mixture, each k up to all."""

    def em(langs):
        share = {m: 1 / len(langs) for m in langs}
        for _ in range(50):
            new = dict.fromkeys(langs, 0.0)
            for row in lik:
                total = sum(share[m] * row[m] for m in langs)
                for m in langs:
                    new[m] += share[m] * row[m] / total / len(lik)
            moved = max(abs(new[m] - share[m]) for m in langs)
            share = new
            if moved <= 1e-3:
                break
        return share, sum(np.log(sum(share[m] * row[m] for m in langs)) for row in lik)

    every = list(range(len(lik[0])))
    single = max(every, key=lambda m: sum(np.log(row[m]) for row in lik))
    best = (sum(np.log(row[single]) for row in lik), {single: 1.0})
    full, _ = em(every)
    order = sorted(every, key=lambda m: -full[m])
    for k in range(2, len(every) + 1):
        share, fit = em(order[:k])
        fit -= penalty * (k - 1) * np.log1p(len(lik))
        if fit > best[0] + 1e-9:
            best = (fit, share)
    return [best[1].get(m, 0.0) for m in every]


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(60):
        parts = rng.dirichlet([0.4] * 5)
        of = rng.choice(5, rng.integers(1, 120), p=parts)
        logp = rng.normal(-4, 1.5, (len(of), 5))
        logp[np.arange(len(of)), of] += 5
        docs.append(np.exp(logp - logp.max(1, keepdims=True)) + 1e-6)
    count = np.array([len(d) for d in docs])
    got = language_id.infer(np.concatenate(docs), np.cumsum(count) - count, count)
    want = np.array([plain_inference(d.tolist()) for d in docs])
    assert np.allclose(got, want, atol=1e-6) and (np.count_nonzero(want, axis=1) > 1).sum() > 10


def naive_best_fit(lengths, sizes, overhead, attention):
    """The same rule by plain loops: the sizes compete by a trial filling of the pieces to come."""
    cost = lambda s: s + s * s / attention + overhead
    bins, place = [], {}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for k, i in enumerate(order):
        n = lengths[i]
        if n == 0:
            place[i] = 0
            bins = bins or [[0, 0]]
            continue
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if fits:
            b = min(fits)[1]
        else:
            offers = []
            for s in sizes:
                if s < n:
                    continue
                held = 0
                for j in order[k:]:
                    if held + lengths[j] <= s:
                        held += lengths[j]
                offers.append((cost(min(x for x in sizes if x >= held)) / held, s))
            bins.append([min(offers)[1], 0])
            b = len(bins) - 1
        bins[b][0] -= n
        bins[b][1] += n
        place[i] = b
    return [place[i] for i in range(len(lengths))], [min(s for s in sizes if s >= u) for _, u in bins]


def test_packing_equals_a_plain_best_fit():
    rng = random.Random(10)
    for _ in range(60):
        n = [rng.choice([0, rng.randint(1, 64), rng.randint(1, 512)]) for _ in range(rng.randint(0, 80))]
        assert packing.best_fit(n, (64, 128, 256, 512), 8, 1024) == naive_best_fit(n, (64, 128, 256, 512), 8, 1024)


def test_sizes_compete():
    """Pieces just over half of a size share the next one, and the joint choice costs less than any single size."""
    assert packing.best_fit([1024, 500, 0, 0])[0] == [0, 1, 0, 0] and packing.best_fit([0, 0]) == ([0, 0], [1024])
    bins, final = packing.best_fit([700] * 40)
    assert max(final) > 1024 and sum(map(packing.bin_cost, final)) < 40 * packing.bin_cost(1024)
    rng = random.Random(17)
    used = set()
    for mix in ([rng.randint(1, 1000) for _ in range(2000)], [rng.randint(500, 1100) for _ in range(900)], [int(rng.lognormvariate(6.5, 1)) % 8192 for _ in range(2000)], [rng.choice([680, 1500, 3000, 5000]) for _ in range(600)]):
        joint = packing.best_fit(mix)[1]
        used |= set(joint)
        for size in packing.SIZES:
            if size >= max(mix):
                alone = packing.best_fit(mix, (size,))[1]
                assert sum(map(packing.bin_cost, joint)) <= sum(map(packing.bin_cost, alone))
        smallest = {}  # one best fit per size class, each piece in the smallest size that holds it
        for n in mix:
            smallest.setdefault(min(s for s in packing.SIZES if s >= n), []).append(n)
        apart = sum(packing.bin_cost(s) * len(packing.best_fit(x, (s,))[1]) for s, x in smallest.items())
        assert sum(map(packing.bin_cost, joint)) < apart or len(smallest) == 1
    assert used == set(packing.SIZES)


def test_packing_places_every_piece_once(docs, corpus, empty):
    rows = packing.pack(docs, sizes=(64, 256, 1024), group_pieces=40).collect()
    used, size, got = {}, {}, {}
    for r in rows:
        key = (r["bin_group"], r["bin"])
        used[key] = used.get(key, 0) + r["length"]
        size[key] = r["bin_size"]
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert all(used[k] <= size[k] and not any(used[k] <= s < size[k] for s in (64, 256, 1024)) for k in used)
    for i, t in corpus:
        n = len((t or "").encode())
        want = [(p, p * 1024, min(1024, n - p * 1024)) for p in range(max(1, -(-n // 1024)))]
        assert sorted(got[i]) == want
    assert packing.pack(empty).count() == 0


def test_packing_spreads_repeated_and_null_ids(spark):
    """Null ids, one id of many rows and plain ids: each row is placed, no group holds a multiple of its share, a second run is the same."""
    rows = [(None, "x" * (i % 3)) for i in range(3000)] + [(7, "y" * 90)] * 3000 + [(i, "z" * (i % 50)) for i in range(100, 1100)] + [(5, "w" * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pack = lambda d: sorted(map(repr, packing.pack(d, sizes=(64, 256), group_pieces=500).collect()))
    got = packing.pack(df, sizes=(64, 256), group_pieces=500).collect()
    assert len(got) == len(rows) + 3
    groups, bins, ids = {}, {}, {}
    for r in got:
        groups[r["bin_group"]] = groups.get(r["bin_group"], 0) + 1
        key = (r["bin_group"], r["bin"])
        bins.setdefault(key, [r["bin_size"], 0])[1] += r["length"]
        ids[r["doc_id"], r["length"]] = ids.get((r["doc_id"], r["length"]), 0) + 1
    assert len(groups) > 10 and max(groups.values()) < 4 * 500
    assert all(held <= size for size, held in bins.values())
    assert [ids[None, n] for n in range(3)] == [1000] * 3 and ids[7, 90] == 3000 and ids[5, 256] == 3 and ids[5, 232] == 1
    assert pack(df) == pack(df.repartition(3))


def test_shard_store(docs, tmp_path, spark, empty):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000, small_bytes=4_000, fanout=3)
    sharding.ingest(docs, arrivals=7, store=store)
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, docs.collect()))
    shards = store.shards().collect()
    assert sum(r["n_rows"] for r in shards) == docs.count() and max(r["level"] for r in shards) >= 1
    tiers = [r["tier"] for r in shards if r["n_bytes"] < 20_000]
    assert all(tiers.count(t) < 3 for t in tiers)
    before = store.version()
    rival = sharding.ShardStore(spark, str(tmp_path / "store"))
    rival.append(docs.limit(3))
    with pytest.raises(sharding.Conflict):
        store._commit(before, [], docs.schema.json())
    assert store.read().count() == docs.count() + 3
    assert json.loads((tmp_path / f"store/manifest/v{before + 1:08d}.json").read_text())["version"] == before + 1
    fresh = sharding.ShardStore(spark, str(tmp_path / "none"))
    fresh.append(empty)
    assert fresh.read().count() == 0 and fresh.read().columns == empty.columns
    digest = {(r["doc_id"], r["n_bytes"], r["md5"]) for r in sharding.stored_digest(docs, arrivals=3).collect()}
    assert digest == {(r["doc_id"], len((r["text"] or "").encode()), None if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()) for r in docs.collect()}


def test_shard_store_with_rivals(spark, docs, tmp_path):
    """Of writers that commit the same version at once exactly one does; appends and merges of rivals all arrive."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "rivals")
    stores = [sharding.ShardStore(spark, root, fanout=3) for _ in range(4)]
    few = docs.limit(5).coalesce(1)
    stores[0].append(few)
    schema = few.schema.json()

    def commit(store):
        try:
            return store._commit(1, [], schema)
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(commit, stores * 5), key=str) == [2] + [None] * 19
        list(pool.map(lambda s: (s.append(few), s.append(few), s.compact()), stores))
    assert stores[0].read().count() == 40 and not [n for n, _ in stores[0]._list("manifest") if n.startswith(".")]
    assert stores[0].compact() and max(s.level for s in stores[0].manifest()[0]) >= 1 and stores[0].read().count() == 40
    with pytest.raises(ValueError):
        stores[1].append(few.select("doc_id"))


def test_vacuum_keeps_what_may_be_in_use(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "kept"), fanout=2)
    few = docs.limit(5).coalesce(1)
    store.append(few)
    store.append(few)
    before = store.version()
    uncommitted = store._write(few, 0, 99)
    store.compact()
    assert store.vacuum() == 0 and store.read(before).count() == 10
    assert store.vacuum(versions=2, least_age_s=0) == len(uncommitted) and store.read(before).count() == 10
    assert store.vacuum(versions=1, least_age_s=0) == 2 and store.read().count() == 10


def test_shards_reach_the_target_size(spark, tmp_path):
    """Arrivals of one size climb the tiers: no tier stays full, and each version's rows are those of its arrivals."""
    rng = random.Random(14)
    rows = [(i, words(rng, 200)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    store = sharding.ShardStore(spark, str(tmp_path / "tiers"), target_bytes=200_000, small_bytes=10_000, fanout=3)
    sharding.ingest(df, arrivals=20, store=store)
    shards = store.shards().collect()
    assert sum(r["n_rows"] for r in shards) == 600 and len(shards) < 12 and max(r["n_bytes"] for r in shards) > 100_000
    small = [r["tier"] for r in shards if r["n_bytes"] < 100_000]
    assert all(small.count(t) < 3 for t in small) and {r["level"] for r in shards} != {0}
    sizes = [store.read(v).count() for v in range(1, store.version() + 1) if store.manifest(v)[0]]
    assert sizes == sorted(sizes)


@pytest.mark.parametrize("name", ["op1_sharding", "op3_ngram_join", "op4_url_filters", "op11_merkle_manifest"])
def test_query_equals_sql(spark, name):
    from quantloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    assert got.columns == [d[0] for d in con.execute(queries.ORACLES[name]).description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(queries.ORACLES[name]).fetchall()))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in left.collect()}
        left = stage(spark, left, DATA)
        assert left.columns == columns
        after = {r["doc_id"]: r for r in left.collect()}
        assert set(after) <= set(before), name
        if name == "language":
            assert set(after) == set(before)
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in before.items()]).items() if c == i}
        if name == "repeats":
            want = brute_repeats([(i, r["text"]) for i, r in before.items()])
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, v in want.items() if (t := v[4].decode("utf-8", "ignore")).strip()}
        if name == "decontaminate":
            items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not any(x in decontamination.normal(r["text"]) for r in after.values() for x in items)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(after)

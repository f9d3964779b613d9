"""WARC, joins, substring removal, neighbours and classifiers against brute force or held-out rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm import jaccard, langid, neighbours, substrings, tokens, toxicity, warc
from facsimile.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- tokens ----

def test_words_equal_a_regular_expression(monkeypatch):
    rng = random.Random(3)
    rows = ["".join(rng.choice("abé\t\n \x0b\x1c\x85 Z") for _ in range(rng.randrange(60))).encode() for _ in range(200)] + [b"", b" ", b"x" * 500]
    monkeypatch.setattr(tokens, "BLOCK", 64)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data = np.frombuffer(b"".join(rows), np.uint8)
    starts, ends, first = tokens.word_bounds(data, at)
    found = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert found == [WORD.findall(r) for r in rows]
    hashes = tokens.hash_words(data, starts, ends, tokens.byte_table(1, False))[0]
    named = {}
    for s, e, h in zip(starts, ends, hashes):
        assert named.setdefault(bytes(data[s:e]), h) == h
    assert len(set(named.values())) == len(named)
    tokens._powers.clear()


# ---- components ----

def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(500)] + [(5000 + k, 5000 + (k + 1) % 50) for k in range(50)]
    edges += [(rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(150)] + [(7, 7), (1, 0)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- WARC ----

def _pages():
    magic = "x" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nPage-Id: 777\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nrest" * 3
    body = [(k, f"http://h/{k}", f"<p>{k % 40} " + "é" * (k % 70) + "</p>" + "y" * 120) for k in range(300)]
    return body + [
        (901, "http://e/1", magic), (902, "http://e/2", magic), (903, None, None), (None, "u\r\nX: y", "abc"), (904, "u", "WARC/1.1\r\n"), (905, "u", magic + "\r\n\r\n"),
        (906, "u", "abc"), (906, "u", "abc"), (907, "u", "z" * 99), (908, "u", "z" * 99), (909, "u", "q" * 200), (909, "u", "q" * 200), (None, "u", "q" * 200),
        (910, "u", "long " * 60000), (911, "u", "")]


def _expected(pages):
    bodies = [(i, (b or "").encode()) for i, _, b in pages]
    first = {}
    for i, b in bodies:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in bodies:
        again = len(b) >= 100 and b in first and (i is None or i > first[b])
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(map(str, out))


def test_archives_read_back_in_small_ranges(spark, tmp_path):
    pages = _pages()
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, _digest string").repartition(2)
    path = warc.write(df, str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("7k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.summary(warc.read(spark, path)).collect()
            assert sorted(str(tuple(r)) for r in got) == _expected(pages)
        whole = {(r["page"], bytes(r["payload"])) for r in warc.read(spark, path, payload=True).where("type = 'response'").collect()}
        assert ("910", b"long " * 60000) in whole and (None, b"abc") in whole and ("901", pages[300][2].encode()) in whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damaged_and_empty_archives(spark, tmp_path):
    def record(page, body, length=None):
        return b"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (page, len(body) if length is None else length, body)

    good = record(1, b"a" * 50) + record(2, b"b")
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "cut.warc").write_bytes(good + record(3, b"cut short", 500))
    (folder / "garbage.warc").write_bytes(b"junk\r\n" + record(4, b"x"))
    (folder / "broken.warc").write_bytes(record(5, b"ok") + b"WARC/1.1\r\nno header here" + record(6, b"after"))
    (folder / "empty.warc").write_bytes(b"")
    assert sorted(r["page"] for r in warc.read(spark, str(folder)).collect()) == ["1", "2", "5"]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.summary(warc.read(spark, warc.write(none, str(tmp_path / "n")))).collect() == []


# ---- set joins ----

def _prose(rng, n, base=5000):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def _corpus():
    rng = random.Random(9)
    line = _prose(rng, 30)
    rows = []
    for k in range(120):
        rows.append(_prose(rng, rng.randrange(1, 200)) + (line if k % 3 == 0 else []))
    for size in (40, 150, 400):
        base = _prose(rng, size)
        rows += [_edited(rng, base, rng.randrange(0, 1 + size // 20)) for _ in range(60)]
        rows += [base[: len(base) - k] for k in range(0, size // 4, 3)]
    texts = [" ".join(r) for r in rows] + ["", None, " \t", "One two", "one TWO", "one two three four", "ONE two three four", "one  two three\nfour", "x " * 400, "x " * 30, "é ü"]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3]), (500, texts[125]), (500, texts[190])]


def _sets(rows, width):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        out.append((i, frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def _components(rows, width, percent):
    sets = _sets(rows, width)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1024), (5, 80, 16)])
def test_groups_equal_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = _corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, leader int").repartition(5)
    got = jaccard.groups(df, jaccard.Settings(width, percent)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _components(rows, width, percent)
    assert jaccard.groups(df.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = _corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()), key=str)
    want = {i for i, _, c in _components(rows, 5, 80) if i is not None and i == c}
    assert sorted(i for i, _ in kept if i is not None) == sorted(want)
    assert [t for i, t in kept if i is None] == [rows[3][1]]


# ---- substrings ----

def _plain(rows, width=20):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if key in seen:
                gone[k:k + width] = [True] * width
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def _repeating(seed):
    rng = random.Random(seed)
    passage = _prose(rng, 70)
    rows = []
    for k in range(150):
        words = _prose(rng, rng.randrange(0, 120), 40 if k % 5 == 0 else 5000)
        if k % 2:
            a = rng.randrange(0, 50)
            words[len(words) // 2:len(words) // 2] = passage[a:a + rng.randrange(15, 40)]
        if k % 7 == 0:
            words += words[:30]
        rows.append((k, " ".join(words)))
    rows += [(200, "same " * 90), (201, "same " * 19), (202, "a b " * 30), (203, "a b c " * 9), (204, None), (205, ""), (206, rows[20][1]), (207, rows[20][1]),
             (208, "a b " * 25), (209, " ".join(passage)), (210, "\n".join(passage[:20])), (211, "same\tsame\n" * 500), (212, "one two three four five six seven eight " * 21)]
    return rows


def test_removal_equals_the_plain_definition(spark, monkeypatch):
    for seed, part in ((1, 4096), (2, 3)):
        monkeypatch.setattr(substrings, "PART_ROWS", part)
        rows = _repeating(seed)
        df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
        got = substrings.deduplicate(df, digests=True).collect()
        assert sorted(tuple(r) for r in got) == sorted(_plain(rows))
    assert substrings.deduplicate(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(40))
    other = " ".join(f"u{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text), (None, other), (9, other)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in substrings.deduplicate(df).collect()), key=str)
    assert got == sorted([(5, 0, text.encode())] * 2 + [(None, 40, b""), (7, 40, b""), (None, 30, b""), (9, 0, other.encode())], key=str)


def test_texts_without_an_id_that_share_a_short_hash_stay_apart(spark):
    # Spark's 32-bit hash is the same for both texts; the first also opens an earlier document, so all of it goes
    one, two = ("".join(f"a{j}-{k} " for j in range(25)) for k in (69, 356269))
    df = spark.createDataFrame([(1, one + "and more"), (None, one), (None, two), (None, two + one)], "doc_id long, text string")
    assert len({r[0] for r in df.where("doc_id IS NULL").limit(2).select(F.hash(F.col("text").cast("binary"))).collect()}) == 1
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.deduplicate(df).collect()]
    assert (1, 27, 0) in got and (None, 25, 25) in got
    assert sorted(gone for i, _, gone in got if i is None) in ([0, 25, 50], [25, 25, 25])
    copied = spark.createDataFrame([(1, one), (None, one), (None, two)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.deduplicate(copied).collect()) == [0, 0, 25]


def test_equal_stretches_get_equal_symbols():
    rng = np.random.default_rng(4)
    inner = rng.integers(1, 6, 60).astype(np.uint64)
    outer = [np.concatenate([rng.integers(1, 6, 25).astype(np.uint64), inner, rng.integers(1, 6, 25).astype(np.uint64)]) for _ in range(2)]
    named = []
    for words in outer:
        name, _, span, low, high = substrings.levels(tokens.mixed(words), np.zeros(len(words), np.int64))[-1]
        inside = (low >= 25) & (high <= 85)
        named.append(list(zip(name[inside], span[inside], low[inside])))
    assert named[0] == named[1] and len(named[0]) > 5 and max(s for _, s, _ in named[0]) > 1


# ---- neighbours ----

def _vectors(n=1500, dim=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[100:700] = x[100]  # one vector held by a third of the rows
    return x


def test_neighbours_recall_ties_and_scores(spark):
    x = _vectors()
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, rank int").repartition(4)
    settings = neighbours.Settings(shard_rows=300, query_rows=10)
    shards = neighbours.index(df, settings)
    assert shards.count() >= 3 and sum(len(r["sizes"]) for r in shards.select("sizes").collect()) == len({v.tobytes() for v in x})
    got = neighbours.nearest(shards, neighbours.every(df, 50), 5, settings).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(x), 50):
        rows = sorted(found[q])
        s = u @ u[q]
        assert [k for k, _, _ in rows] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in rows]
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in rows)
        assert [(-c, v) for _, v, c in rows] == sorted((-c, v) for _, v, c in rows)
        s[q] = -9
        hits += len({v for _, v, _ in rows} & set(np.lexsort((np.arange(len(x)), -s.round(12)))[:5]))
    assert hits / (5 * len(found)) >= 0.9
    assert [v for _, v, _ in sorted(found[150])] == [100, 101, 102, 103, 104]


def test_neighbours_leave_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, [0.0, 3.0]),
            (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (50, [1e-30, 1e-30]), (50, [1e-30, 1e-30]), (100, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(neighbours.index(df), neighbours.every(df, 50), 5).collect())
    half = round(0.5**0.5, 9)
    assert got == [(0, 1, 6, 1.0), (0, 2, 100, 1.0), (0, 3, 50, half), (0, 4, 7, 0.0), (50, 1, 0, half), (50, 2, 6, half), (50, 3, 7, half), (50, 4, 100, half),
                   (100, 1, 0, 1.0), (100, 2, 6, 1.0), (100, 3, 50, half), (100, 4, 7, 0.0)]
    empty = df.limit(0)
    assert neighbours.nearest(neighbours.index(empty), empty, 5).collect() == []


def test_vectors_of_two_lengths_answer_their_own_queries(spark):
    rows = [(k, [1.0, float(k)]) for k in range(12)] + [(100 + k, [1.0, float(k), 2.0]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(neighbours.index(df), neighbours.every(df, 10), 5).collect()
    units = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    for q in (0, 10, 100, 110):
        near = sorted((-float(units[k] @ units[q]), k) for k in units if k != q and len(units[k]) == len(units[q]))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [k for _, k in near]


# ---- classifiers ----

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1200):
        words = _prose(rng, rng.randrange(5, 120), 3000)
        toxic = k % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgon", "blafex"]) + rng.choice(["", "a", "ish", "ément"]))
        rows.append((k, " ".join(words), "en" if k % 2 else "de", int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, y) for k, _, _, y in rows] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    extra = spark.createDataFrame([(-1, None, None), (-2, "", "xx"), (-3, "... 12", "en"), (-4, "plain " * 100000, "en"), (-5, "plain " * 100000 + "Zorgon blafex", "en"), (-5, "plain " * 100000 + "Zorgon blafex", "en")], docs.schema)
    got = toxicity.score(docs.unionByName(extra).withColumn("score", F.lit("clash")), model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    held = [(score[k] >= 0.5) == bool(y) for k, _, _, y in rows if k % 5 == 0]
    assert np.mean(held) >= 0.95 and len(got) == len(rows) + 6
    assert all(0 <= s <= 1 for s in score.values()) and score[-1] == score[-2] == score[-3] < 0.5 and score[-4] < 0.5 <= score[-5]
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, nothing).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_convolution_in_blocks_is_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity.train([rng.integers(0, 512, (30, 4)).astype(np.int32) for _ in range(8)], np.array([0, 1] * 4, np.float32), toxicity.Settings(buckets=512, epochs=1))
    codes = rng.integers(0, 512, (70000, 4)).astype(np.int32)
    one = toxicity.margins(model, codes, np.array([0, len(codes)]))
    two = toxicity.margins(model, np.concatenate([codes, codes[:5]]), np.array([0, len(codes), len(codes) + 5]))
    assert one[0] == pytest.approx(two[0], abs=1e-5)


def test_words_shared_by_two_blocks_are_never_cut_off():
    # a filter that likes a word with nothing after it, over a run of words that crosses the end of a block
    settings = toxicity.Settings(buckets=8, dim=1, filters=1, widths=(3,))
    embeddings = np.array([0, 1, 0.5, 0.25, 0.125, 0, 0, 0], np.float32)[:, None]
    kernel = np.array([1.0, -2.0, -2.0], np.float32).reshape(3, 1, 1)
    model = toxicity.Model(settings, embeddings, {3: kernel}, np.zeros(1, np.float32), np.ones(1, np.float32), 0.0)
    codes = np.zeros((70000, 1), np.int32)
    codes[65530:65553, 0] = [1] * 20 + [2, 3, 4]
    one = toxicity.margins(model, codes, np.array([0, len(codes)]))
    two = toxicity.margins(model, np.concatenate([codes, codes[:5]]), np.array([0, len(codes), len(codes) + 5]))
    assert one[0] == two[0] == 0.125


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "tion", "er"], "bb": ["sch", "ung", "ü", "ei"], "cc": ["eau", "é", "ou", "ai"]}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(rng.choices(list(parts), k=600))]
    docs = spark.createDataFrame(rows + [(9001, "x y", None), (9002, None, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 4 != 2, langid.Settings(per_language=150))
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.2
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 ... !", None), (-4, "THE TION" * 200000, None), (-4, "THE TION" * 200000, None)], docs.schema)
    got = langid.predict(docs.unionByName(extra).withColumn("score", F.lit(1)), model).collect()
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert np.mean([told[k][0] == lang for k, _, lang in rows if k % 4 == 2]) >= 0.97
    assert told[-1] == told[-2] == told[-3] == ("und", 0.0) and told[-4][0] == "aa" and all(0 <= s <= 1 for _, s in told.values())
    nothing = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_ngrams_do_not_span_texts():
    together = langid.counts_of(["ab", "", "cd\udcff"[:2], "abc"], 1 << 13)
    assert together.sum(axis=1).tolist() == [3, 0, 3, 6] and (together[0] == langid.counts_of(["ab"], 1 << 13)[0]).all()

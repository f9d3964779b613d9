"""URL filters, personal data, decontamination and mixing against brute force on small tables."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from facsimile.llm import decontam, mixing, pii, urls

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _accepted(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")),
        "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


TEXTS = [
    "mail a@b.c_d@e.f and x+1 (222) 333-4444. +12345678901234567 é😀 1.2.3.4.5.6.7.8 999.1.1.1 4111-1111 1111 1111",
    "4111111111111111@x.com +33 1 23 45 67 89 +1 visa 4111 1111 1111 1111!", "001.002.003.0255 256.1.1.1", "", None, "no data at all",
    "@@@ a@b a@b. a@.b +++ 12-12-12-12-12-12-12 +1-", "1" * 30000, "+" + "1 " * 20000, "a" * 20000 + "@b.c", "x@y.z " * 300,
]


def test_spans_equal_plain_regular_expressions(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    for row in pii.find(df, kinds=pii.BASE).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, row["text"] or "") if _accepted(k, m.group())]
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == want
        assert all(s["text"] == row["text"][s["start"]:s["end"]] for s in row["spans"])


def test_iban_context_and_redaction(spark):
    text = "my account DE89 3704 0044 0532 0130 00, not DE89370400440532013001; call +33 1 23 45 67 89 or 4111111111111111@x.com"
    df = spark.createDataFrame([(1, text, "kept"), (2, None, "kept"), (3, "", None)], "doc_id long, text string, spans string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    iban = [s for s in found[1] if s["kind"] == "iban"]
    assert [s["text"] for s in iban] == ["DE89 3704 0044 0532 0130 00"] and iban[0]["score"] == pytest.approx(1.0)
    assert found[2] == found[3] == []
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[1]["text"] == "my account [IBAN], not DE89370400440532013001; call [PHONE] or [EMAIL]"
    assert clean[1]["spans"] == "kept" and clean[2]["text"] is None and clean[3]["text"] == ""
    assert pii.redact(df.limit(0)).collect() == []


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame([
        (1, "http://a.EXAMPLE.org/es/1", '<link rel="canonical" href="/x">', "keep"), (2, "https://a.example.org/x", "", None),
        (3, "http://zz.net/q", "<meta http-equiv='refresh' content='0; url=http://k.com/de/9#k'>", None),
        (4, "http://zz.net/r", "<LINK href='http://zz.net/q' REL=canonical>", None), (4, "http://zz.net/r", "<LINK href='http://zz.net/q' REL=canonical>", None),
        (5, None, None, None), (6, "no scheme", "", None), (7, "ftp://", "", None), (8, "http://k.com", "", None), (9, "x://example.org/en/12?q#f", None, None),
        (10, "http://m.net/a", '<link href="http://q.org/b" rel="canonical">', None), (11, "http://m.net/b", '<link rel="canonical" href="http://m.net/a">', None),
        (12, "http://other.net/", "x" * 100000, None),
    ], "page_id int, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("a.example.org", "/x", "org/", "allow"),  # its own rule decides
        3: ("zz.net", "/q", None, "block"), 4: ("zz.net", "/r", None, "block"),  # a chain of aliases of a blocked url
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("k.com", "", None, "allow"),
        9: ("example.org", "/en/12", "example.org/en/1", "block"), 10: ("m.net", "/a", None, "allow"), 11: ("m.net", "/b", None, "allow"),
        12: ("other.net", "/", None, "allow"),
    }
    assert urls.judge(pages).count() == 13 and urls.judge(pages.limit(0)).collect() == []
    known = spark.createDataFrame([("http://other.net/", "http://k.com/de/1"), ("http://other.net/", "http://zz.org/")], "a_url string, b_url string")
    told = {r["page_id"]: r["verdict"] for r in urls.judge(pages, redirects=known).collect()}
    assert told[12] == "allow"  # an allowed url in the group outweighs the blocked one


def test_long_alias_chains(spark):
    n = 300
    pages = spark.createDataFrame([(k, f"http://h.net/{k}", f'<link rel="canonical" href="/{k + 1}">' if k < n - 1 else "") for k in range(n)], "page_id int, url string, html string")
    rules = (urls.Rule("block", "h.net", f"/{n - 1}"),)
    assert {r["verdict"] for r in urls.judge(pages, rules).collect()} == {"block"}
    with pytest.raises(ValueError):
        urls.judge(pages, rules * 5000)


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _shingles(text, width=5):
    w = _words(text)
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_containment_equals_brute_force(spark):
    items = [(1, " ".join(f"w{k}" for k in range(30))), (2, " ".join(f"v{k}" for k in range(14))), (3, "only three words"), (4, ""), (5, None), (6, "One two three four five"),
             (1, " ".join(f"w{k}" for k in range(30))), (7, " ".join(["same"] * 20))]
    base = items[0][1].split()
    documents = [
        (1, "intro text " * 50 + items[0][1] + " tail" * 3000), (2, " ".join(base[:27])), (3, " ".join(base[:20])), (4, " ".join(base[:12] + ["x"] + base[13:])),
        (5, "ONLY three, words!"), (6, "with only three words inside"), (7, None), (8, ""), (9, "one, two; three four five"), (10, items[1][1].upper()),
        (11, "same " * 100), (12, " ".join(base[:15] + ["gap"] * 40 + base[15:])), (1, "intro text " * 50 + items[0][1] + " tail" * 3000), (None, items[1][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in documents], "doc_id long, text string, n_item int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontam.contained(docs, bench).collect())
    want = Counter()
    for i, t in documents:
        for item, q in {(a, b) for a, b in items}:
            s = _shingles(q)
            if s and 100 * len(s & _shingles(t)) >= 80 * len(s):
                want[(i, item, len(s & _shingles(t)), len(s))] += 1
    assert got == want and len(want) >= 8
    kept = [r["doc_id"] for r in decontam.clean(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([i for i, t in documents if not any(_shingles(q) and 100 * len(_shingles(q) & _shingles(t)) >= 80 * len(_shingles(q)) for _, q in items)], key=str)
    assert decontam.contained(docs.limit(0), bench).collect() == [] and decontam.contained(docs, bench.limit(0)).collect() == []


def test_containment_by_shuffle_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 40))) for k in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k * 7, k * 7 + 12))) for k in range(8)], "item_id long, text string")
    small = sorted(map(tuple, decontam.contained(docs, bench).select("doc_id", "item_id", "n_shared").collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    monkeypatch.setattr("facsimile.llm.common.BROADCAST_ROWS", -1)
    assert sorted(map(tuple, decontam.contained(docs, bench).select("doc_id", "item_id", "n_shared").collect())) == small and small


def _mixed(spark, rows, target):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), target).collect()


def test_mixing_meets_the_target_entropy(spark):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 3 else f"s{k % 4}") for k in range(3000)]
    got = _mixed(spark, rows, mixing.Target(entropy=0.9, repeats=None, block_tokens=500))
    tokens, drawn, weight = defaultdict(int), defaultdict(int), {}
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        drawn[r["source"]] += r["n_tokens"] * r["copies"]
        weight[r["source"]] = r["weight"]
    total = sum(tokens.values())
    assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(0.9 * math.log(len(weight)), abs=1e-4)
    for s in tokens:
        assert 0 <= weight[s] * total - drawn[s] <= 10  # less than one document short
    assert len(got) == 3000 and len({r["place"] for r in got}) == 3000


def test_mixing_prefix_of_the_permutation_and_limits(spark):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 10 else "small") for k in range(2000)]
    got = _mixed(spark, rows, mixing.Target(entropy=1.0, repeats=2.0, block_tokens=300))
    small = sum(r["n_tokens"] for r in got if r["source"] == "small")
    drawn = sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == "small")
    assert drawn <= 2 * small and drawn >= 2 * small - 20  # the limit binds, the entropy gives way
    big = sorted((r["block"], r["place"], r["copies"], r["n_tokens"]) for r in got if r["source"] == "big")
    copies = [c for _, _, c, _ in big]
    assert copies == sorted(copies, reverse=True)  # whole blocks first, then one cut


def test_mixing_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "q " * 1000, "b"), (5, " \t", "empty")]
    got = _mixed(spark, rows, mixing.Target(entropy=None, repeats=None))
    assert len(got) == 7 and {r["n_tokens"] for r in got if r["source"] in ("a", "empty")} == {0}
    assert [r["copies"] for r in got if r["source"] is None] == [1, 1] and all(r["copies"] == 0 for r in got if r["source"] == "a")
    assert _mixed(spark, rows[:0] or [], mixing.Target()) == []
    clash = spark.createDataFrame([(1, "a b", "s", 5, "x")], "doc_id long, text string, source string, copies int, place string")
    assert mixing.mix(clash).columns == ["doc_id", "text", "source", "n_tokens", "weight", "copies", "block", "place"]

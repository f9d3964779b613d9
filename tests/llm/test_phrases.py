"""Phrase counts against plain counting."""

import random
import re
from collections import Counter

import pytest

from facsimile.llm import phrases

SCHEMA = "doc_id long, text string, lang string, key string, n long"


def plain(rows, least, longest, top, contained=100):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score)
    inside = {}
    for (lang, p), row in found.items():
        for w in range(2, len(p)):
            for i in range(len(p) - w + 1):
                inside[lang, p[i : i + w]] = max(inside.get((lang, p[i : i + w]), 0), row[0])
    out = []
    for lang in total:
        kept = [(-r[4], -r[0], " ".join(p).encode(), r) for (g, p), r in found.items() if g == lang and 100 * inside.get((g, p), 0) < contained * r[0]]
        for rank, (_, _, phrase, (a, l, r, n, score)) in enumerate(sorted(kept, key=lambda x: x[:3])[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n, score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    vocabulary = ["the", "The", "of", "a", "été", "über", "x1", "x2", "cat", "sat", "en", "fr"]
    fixed = ["new york city hall clock", "one two three four five six seven"]
    made = []
    for i in range(240):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 2)):
            words.insert(draw.randint(0, len(words)), draw.choice(fixed))
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        made.append((i, text, draw.choice(["en", "fr", None, "und"]), "k", i))
    made += [(None, None, None, None, None), (900, "", "en", None, 1), (901, "a " * 3000, "en", None, 1), (902, "a b a b a b " * 400, "de", None, 1)]
    return made + made[:20]


@pytest.mark.parametrize("settings", [
    phrases.Settings(least=12, shards=3, slots=1 << 12, top=50),
    phrases.Settings(least=5, shards=2, slots=16, top=2000),  # every slot is shared
    phrases.Settings(least=30, shards=1, longest=3, held=64),
    phrases.Settings(least=8, shards=4, slots=64, longest=4, contained=90, held=1),
])
def test_phrases_equal_plain_counts(spark, rows, settings):
    made = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), settings)
    found = sorted(tuple(r) for r in made.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == plain(rows, settings.least, settings.longest, settings.top, settings.contained)
    assert found or settings.least > 100


def test_no_rows_no_phrases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        ((F.lit(1000).cast("decimal(4,0)") * F.lit(10**15).cast("decimal(16,0)")) * F.lit(10**16).cast("decimal(17,0)")).alias("above"),
        (F.lit(10**15).cast("decimal(19,0)") * F.lit(10**15 + 1).cast("decimal(19,0)")).alias("below")).selectExpr("above div below as s").first()
    assert row["s"] == 1000 * 10**31 // (10**15 * (10**15 + 1))

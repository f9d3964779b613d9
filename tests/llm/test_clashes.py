"""Columns of the corpus that are called like an operator's helpers: no crash, same results, own values kept."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from facsimile.llm import common, decontam, jaccard, langid, mixing, pii, toxicity, urls

ROWS = [
    (1, "one two three four five six seven mail bob@example.com now", "en", "a", "http://x.com/de/1"),
    (2, "one two three four five six seven mail bob@example.com now", "en", "a", "http://x.com/fr/1"),
    (2, "quite another row of words with the same id as before here", "de", "b", "http://y.org/"),
    (3, None, None, None, None), (4, "", "de", "b", ""), (None, "no id in this row of six", "en", "a", "x"),
    (5, "item words alpha beta gamma delta epsilon zeta eta theta", "de", "b", "https://z.net/?q=1"),
]
HELPERS = {
    "toxicity": ["_bytes"], "language": ["_read", "_of", "_share"], "contained": ["_doc", "_items", "_M"], "clean": ["_text", "_TEXT_"],
    "find": ["_hits_email", "_spans_ip"], "redact": ["_spans", "_kept_spans", "_cut", "Spans"],
    "mix": ["_group", "passes", "blocks", "cut_block", "CUT"], "judge": ["_rule", "_key", "_alias"], "keep_one": ["_k"],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, url string").withColumn("html", F.lit(""))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta eta"), (8, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(spark, docs, items):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, nothing, F.lit(True))
    known = langid.fit(docs, F.lit(True), langid.Settings(buckets=256))
    return {
        "toxicity": lambda d: toxicity.score(d, model), "language": lambda d: langid.predict(d, known),
        "contained": lambda d: decontam.contained(d, items), "clean": lambda d: decontam.clean(d, items), "find": pii.find, "redact": pii.redact,
        "mix": mixing.mix, "judge": urls.judge, "keep_one": jaccard.keep_one,
    }


def _bag(df, names):
    return sorted(map(repr, df.select(*names).collect()))


def test_free_names(docs):
    assert common.free_name(docs, "_k") == "_k" and common.free_name(docs.withColumn("_K", F.lit(1)), "_k") == "_k_"


@pytest.mark.parametrize("name", HELPERS)
def test_helper_names_in_the_input(docs, operators, name):
    extra = HELPERS[name]
    plain, got = operators[name](docs), operators[name](docs.withColumns({c: F.lit(f"own {c}") for c in extra}))
    names = [c for c in plain.columns]
    assert _bag(got, names) == _bag(plain, names) and plain.count() > 0
    assert set(got.columns) == {*names, *extra}
    assert [tuple(r) for r in got.select(*extra).distinct().collect()] == [tuple(f"own {c}" for c in extra)]


def test_languages_are_learned_beside_any_columns(docs):
    settings = langid.Settings(buckets=256)
    model = langid.fit(docs.withColumns({"_of": F.lit(1), "_share": F.lit(2), "n": F.lit(3)}), F.lit(True), settings)
    assert model.languages == langid.fit(docs, F.lit(True), settings).languages == ["de", "en"]


def test_names_of_results_in_another_case(docs, operators):
    found = operators["toxicity"](docs.withColumn("Score", F.lit("x")).withColumn("TOXIC", F.lit("y")))
    assert found.columns == [*docs.columns, "score", "toxic"] and found.count() == len(ROWS)
    found = operators["language"](docs.withColumn("Lang_Pred", F.lit("x")))
    assert found.columns == [*docs.columns, "lang_pred", "score"] and found.count() == len(ROWS)
    found = operators["mix"](docs.withColumn("Copies", F.lit("x")))
    assert found.columns == [*docs.columns, "n_tokens", "weight", "copies", "block", "place"] and found.count() == len(ROWS)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, docs, items, stage, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (4, 1), (5, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {c: F.lit(f"own {c}") for c in ["Score", "toxic", "_bytes", "_text", "_doc", "_k", "spans", "_spans", "_cut", "_hits_email", "item_id", "id", "n"]}
    plain, got = stage[1](spark, docs, str(tmp_path)), stage[1](spark, docs.withColumns(extra), str(tmp_path))
    assert got.columns == [*docs.columns, *extra]
    assert _bag(got, docs.columns) == _bag(plain, docs.columns)
    kept = [tuple(r) for r in got.select(*extra).distinct().collect()]
    assert kept == ([tuple(f"own {c}" for c in extra)] if plain.count() else [])

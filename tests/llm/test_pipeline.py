"""The pipeline on a small folder of tables: every stage's decision takes effect, clean documents stay."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from facsimile.llm import jaccard, queries


def _text(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    where = tmp_path_factory.mktemp("tables")
    item = " ".join(f"b{k}" for k in range(25))
    rows, labels = [], []
    for k in range(900):
        words = _text(rng, rng.randrange(20, 90))
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumblor", "vexnit", "slagpot"]))
        rows.append((k, " ".join(words), "en" if k % 3 else "de", f"s{k % 4}"))
        if k % 10 < 8:
            labels.append((k, 1, int(toxic)))
    base = _text(rng, 100)
    for k in range(1000, 1012):  # near copies
        near = list(base)
        near[rng.randrange(100)] = f"edit{k}"
        rows.append((k, " ".join(near), "en", "s1"))
    rows += [(1100, "before " + item + " " + " ".join(_text(rng, 60)), "en", "s2"), (1101, " ".join(_text(rng, 30)) + " mail me: who@where.org or +1 222 333 4444", "en", "s3"),
             (1102, None, None, None), (1103, "", "en", "s0"), (1104, rows[1][1], "en", "s3"), (1104, "another text of the same id " + rows[2][1], "en", "s3"), (2, rows[2][1], "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "not in any document at all here")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert [q.split("_")[0] for q in queries.QUERIES] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13", "pipeline"]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_keeps_what_is_clean(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "weight", "copies", "block", "place"]
    rows = {r["doc_id"]: r for r in got.collect()}
    toxic = {k for k in range(0, 900, 5)}
    clean = set(range(900)) - toxic
    assert len(toxic & set(rows)) <= 0.05 * len(toxic) and len(clean - set(rows)) <= 0.02 * len(clean)
    assert [k for k in rows if 1000 <= k < 1012] == [1000]
    assert 1100 not in rows and {1102, 1103} <= set(rows)
    assert rows[1101]["text"] == rows[1101]["text"].replace("@", "") and rows[1101]["n_chars"] == len(rows[1101]["text"])
    assert rows[1102]["text"] is None and rows[1103]["text"] == "" and rows[1102]["copies"] == 0
    assert got.count() == len(rows)  # one row for each id


def test_each_stage_returns_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.collect() == []
        assert empty.schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []


def test_near_duplicates_of_the_pipeline_equal_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 900 OR doc_id % 9 = 0")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets.setdefault(r["doc_id"], []).append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    lowest = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    assert kept == {i for i in sets if lowest[i] == i}
    assert jaccard.Settings(width=5, percent=80) == jaccard.Settings(5, 80)

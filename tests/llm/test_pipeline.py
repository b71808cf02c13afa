import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from brute import components, measures, words  # noqa: E402
from incidentlens.llm import edit_decontam, kn_quality, queries  # noqa: E402
from incidentlens.llm import pseudonyms as P  # noqa: E402
from incidentlens.plans.materialize import materialize  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    rel = db.execute(entry.oracle_sql()[name])
    assert compare.rows(df.columns, df.collect()) == compare.rows([c[0] for c in rel.description], rel.fetchall())


def test_stages_against_plain_forms(spark, documents):
    """Each stage on what its predecessor kept, compared with the plain form of its decision."""
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    run = lambda name: materialize(stages[name](spark, docs, FOLDER))
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}

    kept = run("quality")
    assert kept.columns == docs.columns
    judged = by_id(kn_quality.quality_rules(docs))
    assert set(by_id(kept)) == {i for i, r in judged.items() if r["kept"]}
    assert all(measures(r["text"])[0] >= 50 for r in by_id(kept).values())

    docs = kept
    kept = run("near_duplicates")
    assert kept.columns == docs.columns
    want = components([(i, r["text"]) for i, r in by_id(docs).items()], 5, 80)
    assert set(by_id(kept)) == {c for _, _, c in want}

    docs = kept
    kept = run("decontaminate")
    leaks = {r["doc_id"] for r in edit_decontam.find_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert kept.columns == docs.columns and set(by_id(kept)) == set(by_id(docs)) - leaks

    docs = kept
    kept = run("pseudonymize")
    plain = P.Pseudonyms(corpus_pipeline.PSEUDONYM_KEY.encode())
    assert kept.columns == docs.columns
    assert {i: r["text"] for i, r in by_id(kept).items()} == {i: plain.text(r["text"])[0] for i, r in by_id(docs).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in by_id(kept).values())

    docs = kept
    mixed = by_id(run("mix_sources"))
    assert {i: r["size"] for i, r in mixed.items()} == {i: len(words(r["text"])) for i, r in by_id(docs).items()}

    whole = by_id(corpus_pipeline.run(spark, FOLDER))
    assert {i: r["taken"] for i, r in whole.items()} == {i: r["taken"] for i, r in mixed.items()}


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for df in (odd, nothing):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, FOLDER))
            assert name == "mix_sources" or out.columns == docs.columns
            docs = out
        assert docs.count() == 0 or df is odd

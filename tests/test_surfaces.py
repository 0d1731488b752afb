"""Registered queries compare surfaces in the full normal form."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mentionloom.functions import text as tx
from mentionloom.operators import gazetteer
from mentionloom.plans.annotation import Tables
from mentionloom.sources import files

NAMES = ["fixed gait", "ﬁxed gait", "Ｆｉｘｅｄ　Gait", "FIXED  gait", "straße", "STRASSE"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("surfaces")
    docs, rows = [], []
    for i, text in enumerate(NAMES):
        pmc = f"PMC{i}"
        mention = {"identifier": f"HP:{i % 2}", "type": "Phenotype", "offset": 0, "length": len(text), "text": text, "note": None}
        docs.append((pmc, "1", [{"section_type": "CASE", "offset": 0, "text": text}], [], [mention], [], i, "train"))
        rows.append((i, pmc, f"HP:{i // 4}", "Phenotype", 0, len(text), text, None, 0.9))
    spark.createDataFrame(docs, files.ARTICLE + ", article_row bigint, split string").write.parquet(f"{d}/articles.parquet")
    spark.createDataFrame(rows, "candidate_id bigint, pmc_id string, identifier string, type string, offset int, length int, text string, note string, score double").write.parquet(f"{d}/cnn_candidates.parquet")
    return str(d)


def test_precision_by_full_form_against_counting(spark, folder):
    gold = [f"HP:{i % 2}" == f"HP:{i // 4}" for i in range(len(NAMES))]
    by = {}
    for text, hit in zip(NAMES, gold, strict=True):
        by.setdefault(tx.normalized(text), []).append(hit)
    want = {k: (round(sum(v) / len(v), 9), len(v)) for k, v in by.items() if len(v) >= 3}
    got = {r["surface"]: (r["precision"], r["total"]) for r in entry.queries()["surface_precision_nfkc"](spark, folder).collect()}
    assert got == want and set(got) == {"fixed gait"}
    others = {}
    for i, text in enumerate(NAMES):
        rest = [g for j, g in enumerate(gold) if j != i and tx.normalized(NAMES[j]) == tx.normalized(text)]
        others[f"PMC{i}"] = (tx.normalized(text), round(sum(rest) / len(rest), 9), len(rest))
    left = entry.queries()["surface_precision_loo_nfkc"](spark, folder)
    assert {r["pmc_id"]: (r["surface"], r["precision"], r["total"]) for r in left.collect()} == others


def test_queries_with_sql_keep_its_form_and_the_others_fold(spark, folder):
    simple = {r["surface"] for r in entry.queries()["surface_precision_loo"](spark, folder).collect()}
    assert simple == {"fixed gait"}  # of PMC0 and PMC3 alone
    assert {n for n in entry.queries() if n.endswith("_nfkc")}.isdisjoint(entry.oracle_sql())
    assert all(n.removesuffix("_nfkc") in entry.oracle_sql() for n in entry.queries() if n.endswith("_nfkc"))
    t = Tables(spark, folder)
    assert [r[0] for r in spark.range(1).select(t.normalize(F.lit("ﬁt"))).collect()] == ["fit"] and t.fold is gazetteer.fold_same


def test_findings_of_all_annotators_are_linked(spark, tmp_path):
    article = ("PMC1", "1", [{"section_type": "CASE", "offset": 0, "text": "ataxia"}], [], [], [], 0, "train")
    spark.createDataFrame([article], files.ARTICLE + ", article_row bigint, split string").write.parquet(f"{tmp_path}/articles.parquet")
    said = [(1, "dict", "HP:1", "ataxia"), (2, "ann1", "HP:1", "ataxia"), (3, "ann2", "-1", "Ataxia"), (4, "ann3", "HP:1", "ataxias"), (5, "ann1", "-1", "zzz"), (6, "ann2", "-1", None)]
    rows = [(i, "PMC1", who, hp, "Phenotype", 0, 6, text, None) for i, who, hp, text in said]
    spark.createDataFrame(rows, "entity_id bigint, pmc_id string, annotator string, identifier string, type string, offset int, length int, text string, note string").write.parquet(f"{tmp_path}/entities.parquet")
    terms = [("HP:1", "Ataxia", [], [], [], False, None, 1)]
    spark.createDataFrame(terms, "identifier string, name string, synonyms array<string>, parents array<string>, alt_ids array<string>, obsolete boolean, replaced_by string, loaded_at bigint").write.parquet(f"{tmp_path}/hpo_terms.parquet")
    got = {r["finding_id"]: (r["identifier"], r["how"]) for r in entry.queries()["finding_ids"](spark, str(tmp_path)).collect()}
    assert got == {1: ("HP:1", "supplied"), 2: ("HP:1", "supplied"), 3: ("HP:1", "exact"), 4: ("HP:1", "supplied"), 5: (None, None)}

"""Behaviour of the annotation operators on small articles."""

import json

import pytest

from mentionloom import cli
from mentionloom.functions import jsontext
from mentionloom.functions import text as tx
from mentionloom.operators import abbreviations, associations, batching, candidates, entity_sets, evaluation, gazetteer, linking, model_io, ontology, structure, validation
from mentionloom.sources import articles as src
from mentionloom.sources import files

TEXT = "Patient 1 had no seizures. He was tall. Both patients P1 and P2 had ataxia. P2 alone walked late."


def entity(identifier, offset, text, note=None, **more):
    return {"identifier": identifier, "type": "Phenotype", "offset": offset, "length": len(text), "text": text, "note": note, **more}


def article(pmc="PMC1", text=TEXT, patients=("P1", "P2"), entities=(), association=None, section="CASE", mentions=None, row=0):
    at = mentions or {"P1": [(0, "Patient 1")], "P2": [(text.find("P2"), "P2")]}
    return {
        "pmc_id": pmc, "pmid": "1", "article_row": row, "full_text": [{"section_type": section, "offset": 0, "text": text}],
        "patient": [{"patient_id": p, "mention": [{"text": t, "offset": o, "length": len(t)} for o, t in at.get(p, [])]} for p in patients],
        "entities": list(entities), "association": association if association is not None else [{"patient_id": p, "phenotype": []} for p in patients],
    }


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ("pmc_id", "pmid", "full_text", "patient", "entities", "association", "article_row")) for r in rows], files.ARTICLE + ", article_row bigint")


class Long:
    def __init__(self, spark, rows):
        self.docs = src.latest_articles(frame(spark, rows))
        self.passages, self.patients, self.anchors = src.passages(self.docs), src.patients(self.docs), src.anchors(self.docs)
        self.entities = src.entities(self.docs)
        self.associations = src.associations(self.docs).select("pmc_id", "patient_id", "v_ord", "value")


def mentions(df):
    return [(r["identifier"], r["offset"], r["length"], r["note"]) for r in df.orderBy("pmc_id", "e_ord").collect()]


def values(df):
    out = {}
    for r in df.orderBy("patient_id", "v_ord").collect():
        out.setdefault(r["patient_id"], []).append(r["value"])
    return out


def assoc(spark, rows):
    return spark.createDataFrame([("PMC1", p, i, v) for p, vs in rows.items() for i, v in enumerate(vs)], "pmc_id string, patient_id string, v_ord int, value string")


ATAXIA, SEIZURE, TALL, LATE = (entity("HP:2", TEXT.find("ataxia"), "ataxia"), entity("HP:1", TEXT.find("seizures"), "seizures", "NO"), entity("-1", TEXT.find("tall"), "tall"), entity("HP:4;HP:5", TEXT.find("walked late"), "walked late"))


def test_last_row_of_an_article_holds(spark):
    t = Long(spark, [article(row=1, entities=[ATAXIA]), article(row=2, entities=[TALL]), article(pmc=None, row=3)])
    assert mentions(t.entities) == [("-1", TALL["offset"], 4, None)]


def test_offsets_count_code_points(spark):
    t = Long(spark, [article(text="😀😀 ataxia. More", entities=[entity("HP:2", 3, "ataxia"), entity("HP:2", 99, "x")])])
    rows = entity_sets.locate(t.entities, t.passages).orderBy("e_ord").collect()
    assert [r["p_idx"] for r in rows] == [0, None]
    placed = structure.placed(t.entities, t.passages).first()
    assert (placed["s_start"], placed["s_end"]) == (0, 10)


def test_entity_sets(spark):
    a, b = Long(spark, [article(entities=[ATAXIA, SEIZURE])]), Long(spark, [article(entities=[{**ATAXIA, "text": "ATAXIA"}, {**SEIZURE, "note": None}, TALL])])
    assert mentions(entity_sets.merge(a.entities, b.entities)) == [("HP:1", 17, 8, None), ("HP:1", 17, 8, "NO"), ("-1", TALL["offset"], 4, None), ("HP:2", ATAXIA["offset"], 6, None)]
    assert {r["text"] for r in entity_sets.merge(a.entities, b.entities).filter("identifier = 'HP:2'").collect()} == {"ATAXIA"}
    assert mentions(entity_sets.subtract(a.entities, b.entities)) == [("HP:1", 17, 8, None), ("-1", TALL["offset"], 4, None)]
    from pyspark.sql import functions as F

    ballots = a.entities.unionByName(a.entities).withColumn("source", F.lit(0)).unionByName(b.entities.withColumn("source", F.lit(1)))
    assert mentions(entity_sets.select_by_vote(ballots, 2, 2)) == [("HP:2", ATAXIA["offset"], 6, None)]
    assert entity_sets.select_by_vote(ballots, 2, 2, max_text_length=5).count() == 0
    for bad in ({"n_sources": 0}, {"min_votes": 3}, {"min_votes": 0}, {"max_text_length": 0}):
        with pytest.raises(ValueError):
            entity_sets.select_by_vote(ballots, **{"n_sources": 2, "min_votes": 1, **bad})
    with pytest.raises(ValueError, match="PMC1"):
        entity_sets.require_partners(a.docs, b.docs.limit(0), "row")


def test_nested_and_overlapping(spark):
    t = Long(spark, [article(entities=[entity("HP:9", 10, "x" * 20), entity("HP:8", 12, "x" * 5), entity("HP:7", 10, "x" * 20), entity("HP:6", 30, "xx")])])
    assert mentions(entity_sets.nested(t.entities)) == [("HP:8", 12, 5, None)]
    other = Long(spark, [article(entities=[entity("HP:1", 29, "xx"), entity("HP:1", 8, "xx")])])
    assert mentions(entity_sets.not_overlapping(other.entities, t.entities)) == [("HP:1", 8, 2, None)]


def scored(spark, rows):
    return spark.createDataFrame([("PMC1", i, e["identifier"], "Phenotype", e["offset"], e["length"], e["text"], e["note"], e["score"]) for i, e in enumerate(rows)], "pmc_id string, c_ord int, identifier string, type string, offset int, length int, text string, note string, score double")


def test_candidates_cap_overlap_and_precision(spark):
    base = Long(spark, [article(entities=[entity("HP:1", 0, "seizure")])])
    rows = scored(spark, [entity("HP:2", 3, "over long", score=0.99), entity("HP:2", 20, "ataxia a", score=0.9), entity("HP:2", 40, "ataxia b", score=0.95), entity("HP:3", 60, "short", score=0.99), entity("HP:4", 70, "no score", score=None), entity("HP:4", 80, "nan score", score=float("nan"))])
    rules = candidates.CandidateRules(min_score=0.5, max_per_identifier=1)
    added = candidates.additions(base.entities, rows, rules)
    assert [(r["identifier"], r["offset"]) for r in added.collect()] == [("HP:2", 40)]
    assert mentions(candidates.fuse(base.entities, added)) == [("HP:1", 0, 7, None), ("HP:2", 40, 8, None)]
    low = spark.createDataFrame([("ataxia b", 0.1)], "surface string, precision double")
    assert [r["offset"] for r in candidates.additions(base.entities, rows, candidates.CandidateRules(min_score=0.5, surface_min_precision=0.2), low).collect()] == [20]


def test_leave_one_out_precision(spark):
    counts = spark.createDataFrame([("A", "x", 1, 2), ("B", "x", 0, 1), ("B", "y", 1, 1)], "pmc_id string, surface string, tp bigint, total bigint")
    got = {(r["pmc_id"], r["surface"]): r["precision"] for r in candidates.surface_precision_left_out(counts).collect()}
    assert got == {("A", "x"): 0.0, ("B", "x"): 0.5}
    assert {r["surface"]: r["precision"] for r in candidates.surface_precision(counts, 2).collect()} == {"x": pytest.approx(1 / 3)}


def test_judge_gate(spark):
    t = Long(spark, [article(entities=[ATAXIA, TALL, LATE])])
    added, judged = t.entities.filter("identifier in ('HP:2', '-1')"), t.entities.filter("identifier = 'HP:2'")
    assert mentions(entity_sets.judge_gate(t.entities, t.passages, added, judged, {"case"})) == [("HP:2", ATAXIA["offset"], 6, None), ("HP:4;HP:5", LATE["offset"], 11, None)]
    assert len(mentions(entity_sets.judge_gate(t.entities, t.passages, added, judged, {"INTRO"}))) == 3
    assert len(mentions(entity_sets.judge_gate(t.entities, t.passages, added, judged, None, 5))) == 3


def test_structure(spark):
    t = Long(spark, [article(entities=[ATAXIA, LATE, TALL])])
    got = {(r["e_ord"], r["patient_id"]) for r in structure.structural_patients(t.entities, t.passages, t.anchors).collect()}
    assert got == {(0, "P2"), (1, "P1"), (1, "P2"), (2, "P1"), (2, "P2")}
    kept = structure.filter_by_structure(assoc(spark, {"P1": ["HP:2", "HP:4", "HP:4;HP:5"], "P2": ["HP:2"]}), t.entities, t.passages, t.anchors, t.patients)
    assert values(kept) == {"P1": ["HP:4"], "P2": ["HP:2"]}
    one = Long(spark, [article(entities=[ATAXIA], patients=("P1",))])
    assert values(structure.filter_by_structure(assoc(spark, {"P1": ["HP:77"]}), one.entities, one.passages, one.anchors, one.patients)) == {"P1": ["HP:77"]}


def test_nearest_before_and_after(spark):
    far = "Opening words.", "A finding without a name here.", "Closing words."
    doc = article(text=far[1], entities=[entity("HP:1", 120, "x")], mentions={"P1": [(10, "a")], "P2": [(200, "b")]})
    doc["full_text"] = [{"section_type": "A", "offset": 0, "text": far[0]}, {"section_type": "B", "offset": 110, "text": far[1]}, {"section_type": "C", "offset": 195, "text": far[2]}]
    t = Long(spark, [doc])
    run = lambda p, n: {r["patient_id"] for r in structure.structural_patients(t.entities, t.passages, t.anchors, p, n).collect()}
    assert (run(200, 300), run(110, 79), run(109, 80), run(0, 0)) == ({"P1", "P2"}, {"P1"}, {"P2"}, set())


def test_proximity(spark):
    t = Long(spark, [article(entities=[TALL, ATAXIA, {**ATAXIA, "identifier": "HP:9", "note": "NO"}, LATE])])
    assert values(structure.by_proximity(t.entities, t.passages, t.anchors, t.patients)) == {"P2": ["tall", "HP:2", "HP:4;HP:5"]}
    tie = Long(spark, [article(entities=[TALL], mentions={"P1": [(TALL["offset"] + 7, "a")], "P2": [(TALL["offset"] - 7, "b")]})])
    assert values(structure.by_proximity(tie.entities, tie.passages, tie.anchors, tie.patients)) == {"P1": ["tall"]}
    assert values(structure.by_proximity(t.entities, t.passages, t.anchors, t.patients, same_passage_distance=5)) == {}
    one = Long(spark, [article(entities=[TALL], patients=("P1",), mentions={"P1": []})])
    assert values(structure.by_proximity(one.entities, one.passages, one.anchors, one.patients)) == {"P1": ["tall"]}


def test_explicit_groups(spark):
    t = Long(spark, [article(entities=[SEIZURE, ATAXIA, LATE])])
    got = structure.propagate_groups(assoc(spark, {"P2": ["HP:8"]}), t.entities, t.passages, t.anchors, t.patients)
    assert values(got) == {"P1": ["HP:2"], "P2": ["HP:8", "HP:2"]}
    told = "P1 and P2 were seen. Both had ataxia. They had no tremor."
    s = Long(spark, [article(text=told, entities=[entity("HP:2", told.find("ataxia"), "ataxia"), entity("HP:3", told.find("tremor"), "tremor")], mentions={"P1": [(0, "P1")], "P2": [(7, "P2")]})])
    assert values(structure.propagate_groups(assoc(spark, {"P1": ["HP:1"]}), s.entities, s.passages, s.anchors, s.patients)) == {"P1": ["HP:1", "HP:2"], "P2": ["HP:2"]}


def test_fusion_policies(spark):
    two, one = Long(spark, [article()]), Long(spark, [article(patients=("P1",))])
    p, s = assoc(spark, {"P1": ["a", "b", "c"], "P2": ["d"]}), assoc(spark, {"P1": ["c", "e"]})
    f = associations.fuse_by_patient_count
    assert values(f(one.patients, p, s)) == {"P1": ["a", "b", "c", "e"]}
    assert values(f(two.patients, p, s)) == {"P1": ["c", "e"]}
    assert values(f(two.patients, p, s, union_multi=True)) == {"P1": ["a", "b", "c", "e"], "P2": ["d"]}
    assert values(f(two.patients, p, s, union_range=(3, 4), outside_primary=True)) == {"P1": ["a", "b", "c"], "P2": ["d"]}
    assert values(f(two.patients, p, s, union_multi=True, max_ratio=1.5)) == {"P1": ["c", "e"], "P2": ["d"]}
    for bad in ({"union_range": (0, 2)}, {"union_range": (3, 2)}, {"max_ratio": 0}):
        with pytest.raises(ValueError):
            f(two.patients, p, s, **bad)


def test_votes_and_augmentation(spark):
    two, one = Long(spark, [article()]), Long(spark, [article(patients=("P1",))])
    s = [assoc(spark, {"P1": ["a", "b"]}), assoc(spark, {"P1": ["b", "c"], "P2": ["d"]}), assoc(spark, {"P1": ["c", "b"], "X": ["z", "z2"]})]
    f = associations.fuse_by_vote
    assert values(f(two.patients, s, 2)) == {"P1": ["b", "c"]}
    assert values(f(two.patients, s, 1)) == {"P1": ["a", "b", "c"], "P2": ["d"]}
    assert values(f(one.patients, s, 2, single_sources=[2, 0], single_min_votes=1)) == {"P1": ["c", "b", "a"]}
    assert values(f(two.patients, s, 3, single_sources=[0], single_min_votes=1)) == {"P1": ["b"]}
    for bad in ({"sources": []}, {"min_votes": 4}, {"single_sources": [3]}, {"single_sources": [0, 0]}, {"single_sources": [0], "single_min_votes": 2}):
        with pytest.raises(ValueError):
            f(**{"patients": two.patients, "sources": s, "min_votes": 1, **bad})
    assert values(associations.augment(assoc(spark, {"P1": ["a"]}), assoc(spark, {"P1": ["b", "a"], "P2": ["c"]}))) == {"P1": ["a", "b"]}


def test_clip_and_stabilize(spark):
    t = Long(spark, [article(entities=[ATAXIA, SEIZURE, TALL, LATE])])
    mine = assoc(spark, {"P1": ["HP:4;HP:5", "HP:4", "HP:1", "tall", "-1", "HP:2"]})
    assert values(associations.clip(mine, t.entities)) == {"P1": ["HP:4;HP:5", "HP:4", "tall", "HP:2"]}
    text = "No rash was seen in P1. P1 had rash and fever. P2 had none."
    new = Long(spark, [article(text=text, entities=[entity("HP:10", 3, "rash"), entity("HP:11", text.find("fever"), "fever")])])
    old = Long(spark, [article(text=text, entities=[entity("HP:1", text.find("rash and"), "rash"), entity("HP:11", text.find("fever"), "fever")])])
    got = associations.stabilize(old.patients, old.passages, old.anchors, assoc(spark, {"P1": ["HP:1", "HP:99"]}), old.entities, new.entities, assoc(spark, {"P1": ["HP:10", "HP:11"], "P2": ["HP:1"]}))
    assert values(got) == {"P1": ["HP:1", "HP:11"]}


def test_evaluation(spark):
    gold = Long(spark, [article(entities=[ATAXIA, SEIZURE, TALL, LATE], association=[{"patient_id": "P1", "phenotype": ["HP:2"]}, {"patient_id": "P2", "phenotype": []}])])
    pred = Long(spark, [article(entities=[ATAXIA, {**SEIZURE, "note": None}, {**TALL, "identifier": "HP:7"}, {**LATE, "identifier": "HP:4"}]), article(pmc="PMC9", entities=[ATAXIA])])
    assert tuple(evaluation.mention_counts(gold.entities, pred.entities, gold.docs).first()) == (3, 1, 1)
    assert tuple(evaluation.document_counts(gold.entities, pred.entities, gold.docs).first()) == (2, 2, 1)
    listed = gold.docs.selectExpr("pmc_id", "explode(association.patient_id) AS patient_id")
    per = evaluation.patient_counts(gold.associations, assoc(spark, {"P1": ["HP:2", "HP:3"], "P3": ["x"]}), listed)
    row = evaluation.with_prf(evaluation.association_scores(per)).first()
    assert (row["tp"], row["fp"], row["fn"], row["macro_precision"], row["macro_recall"]) == (1, 1, 0, 0.75, 1.0)
    none = evaluation.with_prf(evaluation.mention_counts(gold.entities.limit(0), pred.entities.limit(0), gold.docs)).first()
    assert (none["tp"], none["precision"], none["f1"]) == (0, 1.0, 1.0)


def test_validation(spark):
    good = article(entities=[ATAXIA], association=[{"patient_id": "P1", "phenotype": []}, {"patient_id": "P2", "phenotype": ["HP:2"]}])
    expected = frame(spark, [good, article(pmc="PMC2")])
    assert validation.validate(frame(spark, [good, {**article(pmc="PMC2"), "article_row": 1}]), expected).count() == 0
    bad = {**good, "pmid": "2", "article_row": 5, "entities": [{**ATAXIA, "text": "ataxiX"}, {**ATAXIA, "text": "ataxiX"}, entity("HP:1", 900, "z"), {**TALL, "type": "Gene"}, {**TALL, "text": None}], "association": [{"patient_id": "P2", "phenotype": [None]}]}
    codes = sorted(r["code"] for r in validation.validate(frame(spark, [bad, {**bad, "article_row": 6, "pmid": "1", "entities": None, "association": None}, article(pmc="PMC7", row=7)]), expected).collect())
    assert codes == ["association_not_a_list", "bad_type", "count_mismatch", "duplicate_document", "duplicate_entity", "entities_not_a_list", "missing_document", "missing_fields", "outside_passages", "patients_differ", "phenotype_not_a_list", "pmid_differs", "text_mismatch", "text_mismatch", "unexpected_document"]


def test_dictionary_extraction_against_scanning(spark):
    text = "Ataxia, non-ataxia; ataxias. SHORT stature was absent. No evidence of ataxia and short stature."
    t = Long(spark, [article(text=text)])
    rows = spark.createDataFrame([("ataxia", "HP:2"), ("short stature", "HP:3"), ("stature", "HP:4"), ("(x", "HP:5")], "alias string, identifier string")
    got = [(r["text"], r["offset"], r["note"]) for r in gazetteer.extract(t.passages, rows).orderBy("e_ord").collect()]
    low, want = text.lower(), []
    for alias in ("ataxia", "short stature", "stature"):
        i = low.find(alias)
        while i >= 0:
            before, after = low[i - 1 : i], low[i + len(alias) : i + len(alias) + 1]
            if not before.isalnum() and not after.isalnum():
                want.append((text[i : i + len(alias)], i))
            i = low.find(alias, i + 1)
    assert sorted(g[:2] for g in got) == sorted(want)
    assert {g[2] for g in got if g[1] < 12} == {None} and {g[2] for g in got if g[0].startswith("SHORT")} == {"NO"} and {g[2] for g in got if g[1] == low.rfind("ataxia")} == {"NO"}


def test_surface_statistics(spark):
    text = "Fits and fits and fits. FTT seen."
    t = Long(spark, [article(text=text, entities=[entity("HP:1", 0, "Fits"), entity("HP:9", 0, "Fits"), entity("HP:1", 9, "fits", "NO"), entity("HP:5", 24, "FTT")])])
    got = {r["surface"]: tuple(r)[1:] for r in gazetteer.surface_stats(t.entities, t.passages, tx.normalize_ascii).collect()}
    assert got == {"fits": (1, 1, 0, 3, pytest.approx(2 / 3)), "ftt": (1, 0, 1, 1, 1.0)}
    assert {r["surface"]: r["identifier"] for r in gazetteer.most_common_id(t.entities, tx.normalize_ascii).collect()} == {"fits": "HP:1", "ftt": "HP:5"}


def test_normalisation(spark):
    df = spark.createDataFrame([("ﬁxed  Gait‑x",), ("Straße",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.normalize_surface("t")).collect()] == ["fixed gait-x", "strasse", None]


def test_abbreviations(spark):
    text = "Fast twitch tremor (FTT) was seen. FTT and XFTT. Later GDD (global developmental delay) and GDD."
    t = Long(spark, [article(text=text, entities=[entity("HP:1", 0, "Fast twitch tremor"), entity("HP:2", text.find("global"), "global developmental delay"), entity("HP:3", 0, "Fast")])])
    assert mentions(abbreviations.abbreviation_candidates(t.entities, t.passages)) == [("HP:1", 20, 3, None), ("HP:1", 35, 3, None), ("HP:2", text.find("GDD"), 3, None), ("HP:2", text.rfind("GDD"), 3, None)]


def test_ontology_files(spark, tmp_path):
    (tmp_path / "hp.obo").write_text('format-version: 1.2\n\n[Term]\nid: HP:0000118\nname: Top\n\n[Term]\nid: HP:1\nname: Ataxia\nsynonym: "Unsteady \\"gait\\"" EXACT []\nis_a: HP:0000118 ! Top\nalt_id: HP:11\n\n[Typedef]\nid: part_of\n\n[Term]\nid: HP:2\nname: Old\nis_obsolete: true\nreplaced_by: HP:1\n')
    terms = ontology.latest(files.read_obo(spark, str(tmp_path / "hp.obo")).selectExpr("*", "cast(null as timestamp) AS loaded_at"))
    assert {r["identifier"] for r in terms.collect()} == {"HP:0000118", "HP:1", "HP:2"}
    assert {r[0] for r in ontology.descendants(terms, "HP:0000118").collect()} == {"HP:0000118", "HP:1"}
    ids = spark.createDataFrame([("HP:11",), ("HP:2",), ("HP:404",)], "identifier string")
    assert {r[0]: r[1] for r in ontology.canonical(ids, terms).collect()} == {"HP:11": "HP:1", "HP:2": "HP:1", "HP:404": "HP:404"}
    assert {(r["alias"], r["identifier"]) for r in ontology.aliases(terms).collect()} == {("top", "HP:0000118"), ("ataxia", "HP:1"), ('unsteady "gait"', "HP:1")}
    (tmp_path / "d.json").write_text('{"wide_gait": ["HP:1", "HP:2"]}')
    assert {tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {("wide gait", "HP:1"), ("wide gait", "HP:2")}


def test_chunks_and_batches(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 6, 20, 1, 1])], "g string, o int, s int")
    assert [r["chunk"] for r in batching.greedy_chunks(df, "g", "o", F.col("s"), 10).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]
    assert [(r["batch"], r["index"]) for r in batching.fixed_batches(df, "g", ["o"], 4).orderBy("o").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]


@pytest.mark.parametrize(
    ("reply", "value"),
    [
        ('```json\n{"a": [1]}\n```', {"a": [1]}), ('{"a": 1} and more {"b": 2}', {"a": 1}), ('{"entity_indices": [1, 2, 3', {"entity_indices": [1, 2, 3]}), ('{"assignments": {"P1": [1, 2], "P2": [3', {"assignments": {"P1": [1, 2], "P2": [3]}}),
        ('{"assignments": {"P1": [{"passage_index": 0, "text": "x"}, {"passage_ind', {"assignments": {"P1": [{"passage_index": 0, "text": "x"}]}}), ('{"entities": [{"text": "a"}, {"text": "b', {"entities": [{"text": "a"}]}), ("note: [1, 2] end", [1, 2]),
    ],
)
def test_replies_are_recovered(reply, value):
    assert jsontext.recover(reply) == value


def test_replies_without_json():
    with pytest.raises(ValueError):
        jsontext.recover("nothing here")


def test_requests_and_cache(spark, tmp_path):
    from pyspark.sql import functions as F

    class Echo:
        def chat(self, payload):
            if "fail" in payload:
                raise RuntimeError
            return payload.upper()

    df = model_io.with_key(spark.createDataFrame([(1, "x"), (2, "x"), (3, "fail"), (4, "known")], "i int, t string"), F.col("t"))
    cache = df.filter("i = 4").select("key", F.lit("m").alias("model"), F.lit("old").alias("reply"))
    out = model_io.run_requests(df, cache, Echo)
    assert {r["i"]: (r["reply"], r["cached"]) for r in out.collect()} == {1: ("X", False), 2: ("X", False), 3: (None, False), 4: ("old", True)}
    assert model_io.read_cache(spark, str(tmp_path / "c")).count() == 0
    model_io.append_cache(out, str(tmp_path / "c"))
    assert [r["reply"] for r in model_io.read_cache(spark, str(tmp_path / "c")).collect()] == ["X"]


def test_linking(spark):
    assert linking.ratio("abcd", "abxd") == 75.0 and linking.weighted_ratio("late walking", "walking late") == 95.0 and linking.weighted_ratio("", "a") == 0.0
    s = spark.createDataFrame([("muscle weaknes",), ("zzz",), ("ataxia",)], "surface string")
    a = spark.createDataFrame([("muscle weakness", "HP:1"), ("ataxia", "HP:2"), ("ataxias", "HP:3")], "alias string, identifier string")
    assert {r["surface"]: r["identifier"] for r in linking.fuzzy_link(s, a).collect()} == {"muscle weaknes": "HP:1", "ataxia": "HP:2"}


def test_commands(spark, tmp_path, capsys):
    def put(name, rows):
        (tmp_path / name).write_text("\n\n".join(json.dumps({k: v for k, v in r.items() if k != "article_row"}) for r in rows))
        return str(tmp_path / name)

    gold = put("gold.jsonl", [article(entities=[ATAXIA, TALL], association=[{"patient_id": "P1", "phenotype": ["HP:2"]}, {"patient_id": "P2", "phenotype": []}])])
    other = put("other.jsonl", [article(entities=[ATAXIA, LATE])])
    out = str(tmp_path / "out")
    assert cli.main(["merge-entities", "--base", gold, "--sources", other, "--output", out], spark) == 0
    row = files.read_jsonl(spark, out).first()
    assert [e["identifier"] for e in row["entities"]] == ["-1", "HP:2", "HP:4;HP:5"] and [a["phenotype"] for a in row["association"]] == [["HP:2"], []]
    assert '"note":null' in next(p for p in (tmp_path / "out").glob("*.json") if p.stat().st_size).read_text()
    assert cli.main(["clip-associations", "--predictions", gold, "--entities", other, "--output", out], spark) == 0
    cli.main(["evaluate", "--gold", gold, "--predictions", gold], spark)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["score"] == 1.0
    assert cli.main(["validate", "--articles", gold, "--predictions", other], spark) == 0
    assert cli.main(["fuse-associations", "--articles", gold, "--base", gold, "--primary", gold, "--secondary", other, "--union-multi", "--output", out], spark) == 0
    assert files.read_jsonl(spark, out).first()["association"][0]["phenotype"] == ["HP:2"]


def test_stream(spark, tmp_path):
    from mentionloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(json.dumps({"entities": [{"identifier": "HP:1"}]}) + "\n\nbroken\n")
    for _ in range(2):
        q = ingest.stream_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert [(r["child"], json.loads(r["payload"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("entity", {"identifier": "HP:1"})]


def test_union_of_sides_with_different_partitioning(spark):
    from pyspark.sql import functions as F

    from mentionloom.session import settle

    settle(spark)
    left = spark.range(200).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("v")).groupBy("a").agg(F.collect_set("v").alias("v")).select("a", F.explode("v").alias("v"))
    right = spark.range(200).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("v")).groupBy("a", "v").count().select("a", "v")
    assert left.unionByName(right).groupBy("a", "v").count().filter("count <> 2").count() == 0


def test_contexts(spark):
    from mentionloom.operators import contexts

    t = Long(spark, [article(entities=[ATAXIA, LATE, entity("HP:2", 900, "x")])])
    shown = {r["e_ord"]: (r["section"], r["context"]) for r in contexts.marked_contexts(t.entities, t.passages).collect()}
    assert shown[0][0] == "CASE" and "had [[ataxia]]. P2" in shown[0][1] and shown[2] == ("UNKNOWN", "x")
    near = contexts.patient_contexts(t.anchors, t.passages, before=5, after=4).orderBy("patient_ord").collect()
    assert [r["context"] for r in near] == ["Patient 1 had", " and P2 had"]
    ranked = {(r["patient_id"], r["value"]): r["e_ord"] for r in contexts.nearest_occurrences(t.entities, t.anchors, t.patients, 1).collect()}
    assert ranked == {("P1", "HP:2"): 0, ("P2", "HP:2"): 0, ("P1", "HP:4"): 1, ("P2", "HP:4"): 1, ("P1", "HP:5"): 1, ("P2", "HP:5"): 1}
    terms = spark.createDataFrame([("HP:4", "Late gait")], "identifier string, name string")
    assert {r["identifier"]: r["names"] for r in contexts.display_names(t.entities, terms).collect()} == {"HP:2": "HP:2", "HP:4;HP:5": "Late gait; HP:5"}


def test_trained_abbreviations_need_their_long_form(spark):
    text = "Low muscle tone (LMT) was seen. LMT grew. Then (lmt) and other (LMT)."
    t = Long(spark, [article(text=text)])
    rows = spark.createDataFrame([("lmt", "HP:1", "train-abbreviation")], "alias string, identifier string, source string")
    names = spark.createDataFrame([("HP:1", "low muscle-tone"), ("HP:1", "low")], "identifier string, name string")
    assert mentions(gazetteer.extract(t.passages, rows, expansions=names)) == [("HP:1", 17, 3, None)]
    assert len(mentions(gazetteer.extract(t.passages, rows))) == 4


def test_findings_get_identifiers(spark):
    rows = [(1, "muscle weaknes", "", "HP:1"), (2, "muscle weaknes", "", "HP:2"), (3, "ataxia", "", "HP:1"), (4, "zzz", "ataxia", None), (5, "zzz", "", "HP:9"), (6, "usual words", "", None), (7, "", "", None)]
    f = spark.createDataFrame(rows, "finding_id int, text string, canonical string, supplied string")
    aliases = spark.createDataFrame([("muscle weakness", "HP:1"), ("ataxia", "HP:2")], "alias string, identifier string")
    majority = spark.createDataFrame([("usual words", "HP:7")], "surface string, identifier string")
    got = {r["finding_id"]: (r["identifier"], r["how"]) for r in linking.finding_identifiers(f, aliases, aliases, majority).collect()}
    assert got == {1: ("HP:1", "supplied"), 2: ("HP:1", "fuzzy"), 3: ("HP:2", "exact"), 4: ("HP:2", "exact"), 5: (None, None), 6: ("HP:7", "exact"), 7: (None, None)}


def test_value_requests(spark):
    from mentionloom.operators import contexts

    t = Long(spark, [article(entities=[ATAXIA, LATE, SEIZURE])])
    batches = model_io.value_batches(t.entities, 2)
    assert {(r["value"], r["batch"], r["index"]) for r in batches.collect()} == {("HP:2", 0, 0), ("HP:4", 0, 1), ("HP:5", 1, 0)}
    near = contexts.nearest_occurrences(t.entities, t.anchors, t.patients)
    requests = model_io.value_requests(batches, near, contexts.marked_contexts(t.entities, t.passages), t.patients)
    assert requests.count() == 4
    from pyspark.sql import functions as F

    answered = requests.withColumn("reply", F.when(F.col("patient_id") == "P1", '```json\n{"associated_indices": ["1", 0, 99, "x"], "uncertain_indices": [0]}\n```').otherwise("no idea"))
    assert values(model_io.chosen_values(batches, answered)) == {"P1": ["HP:2", "HP:4", "HP:5"]}
    both = model_io.consensus(structure.structural_patients(t.entities, t.passages, t.anchors, next_distance=0), structure.structural_patients(t.entities, t.passages, t.anchors))
    assert values(model_io.values_of(both, t.entities)) == {"P1": ["HP:4;HP:5"], "P2": ["HP:2", "HP:4;HP:5"]}


def test_dictionary_of_five_sources_and_leave_one_out(spark, tmp_path):
    """Against counting by hand: totals, an article's own part, and who decides the identifier."""
    rows = [
        article("PMC1", "Wobble and wobble. Low tone (LT).", entities=[entity("HP:1", 0, "Wobble"), entity("HP:8;HP:11", 29, "LT"), entity("-1", 29, "LT", "NO")]),
        article("PMC2", "Wobble. Shaking, shaking, shaking. LT.", row=1, entities=[entity("HP:2", 0, "Wobble"), entity("HP:2", 0, "Wobble"), entity("HP:5", 8, "Shaking")]),
        article("PMC3", "Wobble again; unsteady gait. Floppy limbs.", row=2),
    ]
    t = Long(spark, rows)
    terms = spark.createDataFrame(
        [("HP:1", "Wobbling", ["Unsteady gait"], [], [], False, None), ("HP:2", "Tremor", ["Unsteady gait", "Shaking"], [], ["HP:11"], False, None), ("HP:5", "Unsteady gait", [], [], [], False, None), ("HP:6", "Old", [], [], [], True, "HP:5")],
        "identifier string, name string, synonyms array<string>, parents array<string>, alt_ids array<string>, obsolete boolean, replaced_by string",
    )
    names = ontology.aliases(terms, tx.normalize_ascii)
    external = ontology.external_aliases(spark.createDataFrame([("Floppy limbs", "HP:6"), ("xy", "HP:1"), ("Floppy limbs", "HP:99")], "alias string, identifier string"), terms, terms.select("identifier"), tx.normalize_ascii)
    args = (t.entities, t.passages, terms, names, tx.normalize_ascii, gazetteer.lower_same, external)
    got = {r["alias"]: (r["identifier"], r["source"]) for r in gazetteer.alias_table(*args).collect()}
    # shaking: 1 of 3 is too little to be trained, but it names one term; wobble: HP:2 twice; an abbreviation counts positive labels
    assert got == {"wobble": ("HP:2", "train"), "lt": ("HP:8;HP:2", "train-abbreviation"), "shaking": ("HP:2", "recovered"), "wobbling": ("HP:1", "ontology"), "tremor": ("HP:2", "ontology"), "unsteady gait": ("HP:5", "ontology"), "floppy limbs": ("HP:5", "external")}
    assert "shaking" not in {r["alias"] for r in gazetteer.alias_table(*args, recovered_precision=None).collect()}
    assert "unsteady gait" in {r["alias"] for r in gazetteer.alias_table(*args, synonyms=False).collect()}
    out = {(r["pmc_id"], r["alias"]): (r["identifier"], r["source"], r["n"]) for r in gazetteer.left_out_aliases(*args).collect()}
    # of PMC1 the two other wobbles, one labelled; of PMC2 the three others; PMC2 alone knows shaking, PMC1 alone the abbreviation
    assert out == {("PMC1", "wobble"): ("HP:2", "train", 2), ("PMC3", "wobble"): ("HP:2", "train", 1), ("PMC2", "shaking"): ("HP:2", "ontology", 3), ("PMC2", "lt"): ("HP:8;HP:2", "train-abbreviation", 1), ("PMC3", "unsteady gait"): ("HP:5", "ontology", 1), ("PMC3", "floppy limbs"): ("HP:5", "external", 1)}
    few = gazetteer.occurrences(t.passages, names)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in gazetteer.occurrences(t.passages, names, most=0).collect()} and few.count() == 4


def test_predict_and_partners(spark, tmp_path):
    docs = [article("PMC1", "She had ataxia. Ataxia again.", ("P1",), [entity("HP:2", 8, "ataxia"), entity("HP:2", 16, "Ataxia")], mentions={"P1": [(0, "She")]}), article("PMC2", "He had ataxia.", ("P1",), row=1, mentions={"P1": [(0, "He")]})]
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "article_row"}) for r in rows)) and str(tmp_path / name)
    both, one = put("both.jsonl", docs), put("one.jsonl", docs[:1])
    obo = tmp_path / "hp.obo"
    obo.write_text("\n[Term]\nid: HP:0000118\nname: Top\n\n[Term]\nid: HP:2\nname: Unsteady gait\nis_a: HP:0000118 ! Top\n")
    base = ["predict", "--articles", both, "--training", both, "--ontology", str(obo), "--output", str(tmp_path / "out")]
    found = lambda: {r["pmc_id"]: [e["offset"] for e in r["entities"]] for r in files.read_jsonl(spark, str(tmp_path / "out")).collect()}
    assert cli.main([*base, "--limit", "1"], spark) == 0 and found() == {"PMC1": [8, 16]}
    assert cli.main([*base, "--resume"], spark) == 0 and found() == {"PMC1": [8, 16], "PMC2": [7]}
    assert cli.main([*base, "--leave-one-out"], spark) == 0 and found() == {"PMC1": [], "PMC2": [7]}
    for command in (["vote-associations", "--sources", one], ["augment-associations", "--sources", one]):
        with pytest.raises(ValueError, match="PMC2"):
            cli.main([*command, "--articles", both, "--base", both, "--output", str(tmp_path / "x")], spark)
    with pytest.raises(ValueError, match="PMC2"):
        cli.main(["stabilize-associations", "--articles", both, "--base", both, "--entities", both, "--additions", one, "--addition-associations", both, "--output", str(tmp_path / "x")], spark)
    with pytest.raises(ValueError, match="PMC2"):
        cli.main(["fuse-candidates", "--base", both, "--candidates", one, "--output", str(tmp_path / "x")], spark)
    from mentionloom.operators import model_io

    model_io.append_cache(spark.createDataFrame([("k", False, "{}")], "key string, cached boolean, reply string"), str(tmp_path / "cache"))
    discover = ["discover-entities", "--articles", both, "--base", both, "--ontology", str(obo), "--cache", str(tmp_path / "cache"), "--output", str(tmp_path / "d")]
    assert cli.main(discover, spark) == 0
    asked = spark.read.json(str(tmp_path / "d.requests")).collect()
    assert len(asked) == 2
    replies = spark.createDataFrame([(r["key"], False, '{"entities": [{"passage_index": 0, "start": 9, "text": "had ataxia"}, {"passage_index": 0, "start": 0, "text": "unsteady gait"}') for r in asked], "key string, cached boolean, reply string")
    model_io.append_cache(replies, str(tmp_path / "cache"))
    assert cli.main(discover, spark) == 0 and files.read_jsonl(spark, str(tmp_path / "d")).count() == 2


def test_links_against_all_pairs(spark):
    import random

    r = random.Random(8)
    words = ["late", "early", "muscle", "weakness", "gait", "unsteady", "spasm", "tremor", "skin", "pale", "short", "stature", "cleft", "palate", "wide", "nose", "low", "tone"]
    aliases = sorted({" ".join(r.sample(words, r.randint(1, 3))) for _ in range(150)})
    surfaces = set()
    for _ in range(120):
        text = list(r.choice(aliases))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[], [r.choice("aeinst")], [text[k], r.choice("aeinst")]])
        surfaces.add("".join(text) if r.random() < 0.8 else " ".join(reversed("".join(text).split())))
    s = spark.createDataFrame([(x,) for x in surfaces], "surface string")
    a = spark.createDataFrame([(x, f"HP:{i}") for i, x in enumerate(aliases)], "alias string, identifier string")
    best = {}
    for x in surfaces - {""}:
        scores = [(100.0 if x == y else linking.weighted_ratio(x, y) - 8 * (len(y) < 5)) for y in aliases if x == y or linking.weighted_ratio(x, y) >= 78]
        if scores and max(scores) >= 78:
            best[x] = max(scores)
    got = {r["surface"]: r["score"] for r in linking.fuzzy_link(s, a).collect()}
    right = sum(abs(got.get(x, 0) - v) < 1e-9 for x, v in best.items())
    assert len(best) > 80 and right >= 0.97 * len(best) and set(got) <= set(best)


def test_links_hold_no_pairs(spark):
    """Strings that nearly all share their trigrams: no more than the tables and the best links is written, in blocks of any size the same."""
    import random
    from pathlib import Path

    r = random.Random(9)
    aliases = [f"{a} {b} {c} of the {d} side" for a in ("mild", "focal", "marked") for b in ("tibial", "spinal", "dermal", "aortic") for c in ("atrophy", "spasm", "laxity", "cysts", "opacity") for d in ("left", "right", "inner", "outer")] + ["tics", "a" * 90, "ÄÖ 页面", "\U0001d518x"]
    surfaces = ["ticz", "a" * 89, "ÄÖ 页 面", "\U0001d518 x", ""]
    for _ in range(400):
        text = list(r.choice(aliases))
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = r.choice("aeinst ")
        surfaces.append("".join(text)[r.choice((0, 0, 9)) :])
    s = spark.createDataFrame([(x,) for x in surfaces], "surface string").repartition(2)
    a = spark.createDataFrame([(x,) for x in aliases], "alias string").repartition(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    grams = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}
    before = written()
    got = linking.fuzzy_scores(s, a, most=2).collect()
    assert written() - before < 250_000
    best = {}
    for x in set(surfaces) - {""}:
        rows = [(100.0 if x == y else linking.weighted_ratio(x, y), y) for y in aliases if len(grams(x) & grams(y)) >= 0.4 * min(len(grams(x)), len(grams(y)))]
        best[x] = {(y, v - 8 * (len(y) < 5 and x != y)) for v, y in sorted((p for p in rows if p[0] >= 78), key=lambda p: (-p[0], p[1]))[:2]}
    assert len(got) > 300
    for rows in (got, linking.fuzzy_scores(s, a, most=2, block=900, part=3000).collect()):
        assert {x: {(t["alias"], t["score"]) for t in rows if t["surface"] == x} for x in best} == best


def test_every_pair_that_reaches_the_cutoff_is_found(spark):
    """Few shared trigrams, changed blanks, strings of many words of bits, more than five short aliases before the best one: as by comparing all pairs."""
    import random

    r = random.Random(10)
    words = ["late", "muscle", "weakness", "gait", "spasm", "skin", "of", "the", "ßtraße", "页面", "\U0001d518x"]
    phrase = lambda: "".join(r.choice(words) + r.choice([" "] * 20 + ["  ", "\t"]) for _ in range(r.choice((1, 2, 3, 5, 9, 16, 30))))
    crowd = ["gait", "aits", "gats", "gais", "gits", "gaitxys"]
    aliases = sorted({x if r.random() < 0.05 else x.strip() for x in (phrase() for _ in range(150))} | {"feuer", "mikrocefaly", " ", "\t", "a" * 65, "ab" * 64, "tics", *crowd})
    surfaces = {"fever", "microcephaly", "   ", "a" * 90, "ab" * 60, "tic", "gaits"}
    for _ in range(90):
        text = list(r.choice(aliases))
        for _ in range(r.choice((0, 1, 2, 4, 8))):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[r.choice("aeins ")], [text[k], r.choice("aeins ")]])
        text = "".join(text)[r.choice((0, 0, 0, 5)) :]
        surfaces.add(" ".join(reversed(text.split())) if r.random() < 0.3 else text)

    def plain(x, y):
        a, b = sorted((x, y), key=len)
        best = max(linking.ratio(a, b), 0.95 * linking.ratio(*(" ".join(sorted(t.split())) for t in (a, b))))
        if len(b) >= 1.5 * len(a) and linking.common_length(a, b) >= 0.8 * len(a):
            best = max(best, (0.6 if len(b) >= 8 * len(a) else 0.9) * max(linking.ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)))
        return best - 8 * (len(y) < 5 and x != y)

    s = spark.createDataFrame([(x,) for x in surfaces], "surface string")
    a = spark.createDataFrame([(x, f"HP:{i}") for i, x in enumerate(aliases)], "alias string, identifier string")
    pairs = {(x, y): v for x in surfaces - {""} for y in aliases if (v := plain(x, y)) >= 78}
    assert {("fever", "feuer"), ("microcephaly", "mikrocefaly"), ("   ", " ")} <= set(pairs) and len(pairs) > 150
    for size in ({}, {"block": 700, "part": 900}):
        assert {(t["surface"], t["alias"]): t["score"] for t in linking.fuzzy_scores(s, a, most=1000, **size).collect()} == pairs
    best = {x: min((-v, y) for (z, y), v in pairs.items() if z == x) for x, _ in pairs}
    got = {t["surface"]: (-t["score"], t["alias"]) for t in linking.fuzzy_link(s, a).collect()}
    assert got == best | {x: (-100.0, x) for x in surfaces & set(aliases)}
    assert best["gaits"][1] == "gaitxys"
    mentions = spark.createDataFrame([(1, 0, "zzz"), (1, 1, "gaits"), (2, 0, "fever"), (3, 0, "zzz")], "link_id int, ord int, surface string")
    assert {t["link_id"]: t["alias"] for t in linking.link(mentions, a).collect()} == {1: "gaitxys", 2: "feuer"}


def test_findings_hold_no_pairs(spark):
    """Texts that nearly all share their trigrams leave no more than the findings and their links in the shared folder; findings of like columns are joined with null ids too."""
    from pathlib import Path

    aliases = [f"{a} {b} {c} of the {d} side" for a in ("mild", "focal", "marked") for b in ("tibial", "spinal", "dermal", "aortic") for c in ("atrophy", "spasm", "laxity", "cysts", "opacity") for d in ("left", "right", "inner", "outer")]
    rows = [(4 * i + k, x[:k] + "z" + x[k + 1 :], "", None if k else "HP:9999") for i, x in enumerate(aliases) for k in range(4)] + [(-1, aliases[0], aliases[1], None), (-2, aliases[0], aliases[1], "HP:1"), (-3, "?", "", None)]
    f = spark.createDataFrame(rows, "finding_id int, text string, canonical string, supplied string").repartition(2)
    a = spark.createDataFrame([(x, f"HP:{i}") for i, x in enumerate(aliases)], "alias string, identifier string").repartition(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = written()
    got = {r["finding_id"]: (r["identifier"], r["how"]) for r in linking.finding_identifiers(f, a, a, a.limit(0).select(a["alias"].alias("surface"), "identifier")).collect()}
    assert written() - before < 1_000_000
    assert got == {**{4 * i + k: (f"HP:{i}", "fuzzy") for i in range(len(aliases)) for k in range(4)}, -1: ("HP:0", "exact"), -2: ("HP:1", "supplied"), -3: (None, None)}


def test_wordings_in_order_and_few_shot(spark):
    a = spark.createDataFrame([("ataxia", "HP:1"), ("muscle weakness", "HP:2"), ("tics", "HP:3")], "alias string, identifier string")
    rows = [(1, 0, "muscle weaknes"), (1, 1, "ataxia"), (2, 0, "muscle weaknes"), (2, 1, "ataxi"), (3, 0, "ticz"), (4, 0, ""), (5, 0, "ataxia"), (5, 1, "muscle weakness")]
    got = {r["link_id"]: (r["alias"], r["exact"]) for r in linking.link(spark.createDataFrame(rows, "link_id int, ord int, surface string"), a).collect()}
    assert got == {1: ("ataxia", True), 2: ("muscle weakness", False), 5: ("ataxia", True)}
    f = spark.createDataFrame([(1, "zzz", "ataxia"), (2, "muscle weaknesz", ""), (3, "ataxea", None), (4, None, None)], "finding_id int, text string, canonical string")
    assert {r["finding_id"]: r["identifier"] for r in linking.few_shot_identifiers(f, a).collect()} == {1: "HP:1", 2: "HP:2"}


def test_calibration_of_associations(spark):
    """The best of either label from other articles: shared values first, then the greatest tie value."""
    from mentionloom.operators import calibration

    t = Long(spark, [article("PMC1", entities=[ATAXIA, LATE], association=[{"patient_id": "P1", "phenotype": ["HP:2"]}, {"patient_id": "P2", "phenotype": []}]), article("PMC2", entities=[ATAXIA, TALL], row=1)])
    terms = spark.createDataFrame([("HP:2", "Ataxia", None, False, None)], "identifier string, name string, alt_ids array<string>, obsolete boolean, replaced_by string")
    rows = calibration.association_examples(t.entities, t.passages, t.anchors, t.patients, t.associations, terms)
    got = {(r["pmc_id"], r["patient_id"], r["value"]): (r["accepted"], r["name"]) for r in rows.collect()}
    assert got[("PMC1", "P1", "HP:2")] == (1, "Ataxia") and got[("PMC1", "P2", "HP:4")] == (0, "HP:4") and got[("PMC2", "P1", "tall")] == (0, "tall") and len(got) == 10
    one = rows.filter("pmc_id = 'PMC1' and patient_id = 'P1' and value = 'HP:2'").first()
    assert one["patient_context"] == "mentions: Patient 1@0; contexts: " + " ".join(TEXT.split()) and one["occurrence_context"].startswith(f"CASE@{ATAXIA['offset']}: Both patients")
    pool = spark.createDataFrame([(f"PMC{i % 7}", f"v{i % 5}", i % 2, f"{i * 37 % 100:02d}") for i in range(100)], "pmc_id string, value string, accepted int, tie string")
    batches = spark.createDataFrame([("PMC3", 0, "v1"), ("PMC3", 0, "v2"), ("PMC9", 1, "zz")], "pmc_id string, batch int, value string")
    chosen = {}
    for r in calibration.select_examples(batches, pool, 3).orderBy("pmc_id", "accepted", "rank_no").collect():
        chosen.setdefault((r["pmc_id"], r["accepted"]), []).append(r["tie"])
    every = pool.distinct().collect()
    for (pmc, label), ties in chosen.items():
        values = {b for a, _, b in [tuple(x) for x in batches.collect()] if a == pmc}
        best = sorted(((x["value"] in values, x["tie"]) for x in every if x["pmc_id"] != pmc and x["accepted"] == label), reverse=True)[:3]
        assert ties == [t for _, t in best]


def test_dense_articles_by_plain_comparison(spark):
    """Nearest patients and structure over random articles, against looking at every pair."""
    import random

    r = random.Random(11)
    docs = []
    for k in range(6):
        texts = [" ".join(r.choice(["aa", "bbb.", "cc", "dd;", "e"]) for _ in range(r.randint(5, 60))) for _ in range(4)]
        offsets = [sum(len(t) + 3 for t in texts[:i]) for i in range(4)]
        end = offsets[-1] + len(texts[-1])
        doc = article(f"PMC{k}", patients=("P1", "P2", "P3"), row=k, mentions={p: [(r.randint(0, end + 20), "x") for _ in range(r.randint(0, 4))] for p in ("P1", "P2", "P3")}, entities=[entity(f"HP:{i}", r.randint(0, end - 2), "aa") for i in range(12)])
        doc["full_text"] = [{"section_type": "A", "offset": o, "text": t} for o, t in zip(offsets, texts, strict=True)]
        docs.append(doc)
    t = Long(spark, docs)
    want, near = set(), {}
    for d in docs:
        spans = [(p["offset"], p["offset"] + len(p["text"]), p["text"]) for p in d["full_text"]]
        place = lambda o, spans=spans: next((i for i, (a, b, _) in enumerate(spans) if a <= o < b), None)
        anchors = [(m["offset"], pi, mi, p["patient_id"]) for pi, p in enumerate(d["patient"]) for mi, m in enumerate(p["mention"])]
        for i, e in enumerate(d["entities"]):
            at = place(e["offset"])
            if at is None:
                continue
            a, _, text = spans[at]
            start = e["offset"] - a
            s0 = max(text.rfind(c, 0, start) for c in ".!?;\n") + 1
            ends = [j for j in (text.find(c, start + 2) for c in ".!?;\n") if j >= 0]
            s1 = min(ends) + 1 if ends else len(text)
            here = [x for x in anchors if place(x[0]) == at]
            chosen = {x[3] for x in here if a + s0 <= x[0] < a + s1} or {x[3] for x in here}
            if not chosen:
                prev, nxt = max((x for x in anchors if x[0] <= e["offset"]), default=None), min((x for x in anchors if x[0] > e["offset"]), default=None)
                chosen = {x[3] for x in (prev if prev and e["offset"] - prev[0] <= 50 else None, nxt if nxt and nxt[0] - e["offset"] <= 30 else None) if x}
            want |= {(d["pmc_id"], i, p) for p in chosen}
            inside, over = min(((abs(e["offset"] - x[0]), x[3]) for x in here), default=None), min(((abs(e["offset"] - x[0]), x[3]) for x in anchors), default=None)
            who = (inside[1] if inside[0] <= 40 else None) if inside else over[1] if over and over[0] <= 60 else None
            if who:
                near.setdefault((d["pmc_id"], who), set()).add(e["identifier"])
    assert {tuple(x) for x in structure.structural_patients(t.entities, t.passages, t.anchors, 50, 30).select("pmc_id", "e_ord", "patient_id").collect()} == want
    got = {}
    for x in structure.by_proximity(t.entities, t.passages, t.anchors, t.patients, 40, 60).collect():
        got.setdefault((x["pmc_id"], x["patient_id"]), set()).add(x["value"])
    assert got == near

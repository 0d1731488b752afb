"""Commands over JSON-lines files: each reads nested articles or predictions, runs one operator and writes nested rows.

``python -m mentionloom.cli COMMAND --help``; inputs are files or folders of any size, outputs are folders.
"""

from __future__ import annotations

import argparse
import sys
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import abbreviations, associations, batching, candidates, entity_sets, evaluation, gazetteer, model_io, ontology, structure, validation
from mentionloom.session import settle
from mentionloom.sources import articles as src
from mentionloom.sources import files


def _load(spark: SparkSession, path: str, schema: str = files.ARTICLE) -> SimpleNamespace:
    return _tables(src.latest_articles(files.read_jsonl(spark, path, schema)))


def _tables(docs: DataFrame) -> SimpleNamespace:
    t = SimpleNamespace(docs=docs, entities=src.entities(docs))
    if "full_text" in docs.columns:
        t.passages, t.patients, t.anchors = src.passages(docs), src.patients(docs), src.anchors(docs)
        t.associations = src.associations(docs).select("pmc_id", "patient_id", "v_ord", "value")
    return t


def _scored(spark: SparkSession, path: str) -> DataFrame:
    docs = src.latest_articles(files.read_jsonl(spark, path, files.SCORED))
    e = docs.select("pmc_id", F.posexplode("entities").alias("c_ord", "e")).filter("e is not null")
    return e.select("pmc_id", "c_ord", "e.identifier", "e.type", "e.offset", "e.length", "e.text", "e.note", "e.score")


def _first(docs: DataFrame, most: int | None) -> DataFrame:
    """The first articles in order of delivery, where a number is asked for."""
    return docs if most is None else docs.orderBy("article_row").limit(most)


def _require(docs: DataFrame, **others: SimpleNamespace) -> None:
    for what, other in others.items():
        entity_sets.require_partners(docs, other.docs, what.replace("_", " "))


def _store(docs: DataFrame, entities: DataFrame, values: DataFrame | None, out: str, order: DataFrame | None = None, mode: str = "overwrite") -> None:
    rows = docs.select("pmc_id", "pmid", "article_row").join(src.nest_entities(entities), "pmc_id", "left")
    if values is not None:
        rows = rows.join(src.nest_associations(values, order), "pmc_id", "left")
    else:
        rows = rows.withColumn("association", F.lit(None))
    none = F.array().cast(f"array<{files.ENTITY}>")
    listed = F.coalesce(F.col("association").cast("array<struct<patient_id:string,phenotype:array<string>>>"), F.array().cast("array<struct<patient_id:string,phenotype:array<string>>>"))
    files.write_jsonl(rows.orderBy("article_row").select("pmc_id", "pmid", F.coalesce("entities", none).alias("entities"), listed.alias("association")), out, mode)


def _terms(spark: SparkSession, path: str) -> DataFrame:
    return ontology.latest(files.read_obo(spark, path).withColumn("loaded_at", F.lit(None).cast("timestamp")))


def evaluate(spark, a):
    gold, pred = _load(spark, a.gold), _load(spark, a.predictions)
    listed = gold.docs.select("pmc_id", F.explode("association").alias("x")).select("pmc_id", "x.patient_id").distinct()
    per = evaluation.patient_counts(gold.associations, pred.associations, listed)
    rows = evaluation.score(evaluation.mention_counts(gold.entities, pred.entities, gold.docs), evaluation.document_counts(gold.entities, pred.entities, gold.docs), evaluation.association_scores(per))
    print(rows.toJSON().first())


def validate(spark, a):
    errors = validation.validate(files.read_jsonl(spark, a.predictions), _load(spark, a.articles).docs)
    for row in errors.orderBy("pmc_id", "code", "detail").limit(a.show).collect():
        print(*row, sep="\t")
    return int(not errors.isEmpty())


def merge_entities(spark, a):
    base, more = _load(spark, a.base), [_load(spark, p) for p in a.sources]
    _store(base.docs, entity_sets.merge(base.entities, *[m.entities for m in more]), base.associations, a.output, base.patients)


def _ballots(spark, paths):
    rows = None
    for i, p in enumerate(paths):
        one = _load(spark, p).entities.withColumn("source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def vote_entities(spark, a):
    base = _load(spark, a.base)
    _store(base.docs, entity_sets.vote(base.entities, _ballots(spark, a.sources), len(a.sources), a.min_votes, a.max_text_length), base.associations, a.output, base.patients)


def select_entities(spark, a):
    base = _load(spark, a.base)
    _store(base.docs, entity_sets.select_by_vote(_ballots(spark, a.sources), len(a.sources), a.min_votes, a.max_text_length), base.associations, a.output, base.patients)


def subtract_entities(spark, a):
    base, more = _load(spark, a.base), _load(spark, a.candidates)
    entity_sets.require_partners(base.docs, more.docs, "candidate entity row")
    _store(base.docs, entity_sets.subtract(base.entities, more.entities), None, a.output)


def clip_associations(spark, a):
    pred = _load(spark, a.predictions)
    allowed = _load(spark, a.entities) if a.entities else pred
    entity_sets.require_partners(pred.docs, allowed.docs, "entity row")
    _store(pred.docs, allowed.entities, associations.clip(pred.associations, allowed.entities), a.output, pred.patients)


def fuse_associations(spark, a):
    docs, base, one, two = (_load(spark, p) for p in (a.articles, a.base, a.primary, a.secondary))
    for other in (base, one, two):
        entity_sets.require_partners(docs.docs, other.docs, "fusion input")
    span = tuple(a.union_range) if a.union_range else None
    values = associations.fuse_by_patient_count(docs.patients, one.associations, two.associations, a.union_multi, span, a.outside_primary, a.max_ratio)
    if a.previous_distance is not None or a.next_distance is not None:
        # a distance of 0 stands for the default here
        values = structure.filter_by_structure(values, base.entities, docs.passages, docs.anchors, docs.patients, previous_distance=a.previous_distance or 1500, next_distance=a.next_distance or 300)
    _store(docs.docs, base.entities, values, a.output, docs.patients)


def vote_associations(spark, a):
    docs, base, sources = _load(spark, a.articles), _load(spark, a.base), [_load(spark, p) for p in a.sources]
    _require(docs.docs, base_row=base, **{f"association_source_{i}": s for i, s in enumerate(sources, 1)})
    values = associations.fuse_by_vote(docs.patients, [s.associations for s in sources], a.min_votes, [i - 1 for i in a.single_sources] if a.single_sources else None, a.single_min_votes)
    if a.previous_distance is not None or a.next_distance is not None:
        wide = {"wide_sections": {s.upper() for s in a.wide_sections}, "wide_previous_distance": a.wide_previous_distance, "wide_next_distance": a.wide_next_distance} if a.wide_sections else {}
        values = structure.filter_by_structure(values, base.entities, docs.passages, docs.anchors, docs.patients, previous_distance=1500 if a.previous_distance is None else a.previous_distance, next_distance=300 if a.next_distance is None else a.next_distance, **wide)
    if a.propagate_groups:
        values = structure.propagate_groups(values, base.entities, docs.passages, docs.anchors, docs.patients)
    if a.command == "augment-associations":
        values = associations.augment(base.associations, values)
    _store(docs.docs, base.entities, values, a.output, docs.patients)


def stabilize_associations(spark, a):
    docs, base, final, added, told = (_load(spark, p) for p in (a.articles, a.base, a.entities, a.additions, a.addition_associations))
    _require(docs.docs, base_row=base, entity_row=final, addition_row=added, addition_association_row=told)
    values = associations.stabilize(
        docs.patients, docs.passages, docs.anchors, base.associations, final.entities, added.entities, told.associations, set(a.sections) if a.sections else None, reject_negated=not a.allow_negated, reject_nested=not a.allow_nested,
        new_values_only=not a.allow_existing_values, final_structure_filter=a.structure_filter, previous_distance=a.previous_distance, next_distance=a.next_distance, preserve_groups=a.preserve_groups,
    )
    _store(docs.docs, final.entities, values, a.output, docs.patients)


def fuse_candidates(spark, a):
    base, scored = _load(spark, a.base), _scored(spark, a.candidates)
    entity_sets.require_partners(base.docs, files.read_jsonl(spark, a.candidates, files.SCORED), "candidate row")
    rules = candidates.CandidateRules(a.min_score, a.min_text_length, a.max_per_identifier, not a.allow_overlap, a.new_identifiers_only, a.surface_min_precision, a.surface_min_count)
    precision = None
    if a.gold:
        counts = candidates.surface_counts(_scored(spark, a.training), _load(spark, a.gold).entities)
        precision = candidates.surface_precision_left_out(counts, a.surface_min_count) if a.leave_one_out else candidates.surface_precision(counts, a.surface_min_count)
    added = candidates.additions(base.entities, scored, rules, precision)
    if a.additions_output:
        _store(base.docs, added.withColumn("e_ord", F.col("a_ord")), None, a.additions_output)
    _store(base.docs, candidates.fuse(base.entities, added), base.associations, a.output, base.patients)


def filter_judged_entities(spark, a):
    docs, pred, added, judged = (_load(spark, p) for p in (a.articles, a.base, a.additions, a.judged))
    _require(pred.docs, article=docs, addition_row=added, judged_row=judged)
    kept = entity_sets.judge_gate(pred.entities, docs.passages, added.entities, judged.entities, set(a.sections or ()), a.min_text_length)
    _store(pred.docs, kept, pred.associations, a.output, docs.patients)


def abbreviation_candidates(spark, a):
    docs, base = _load(spark, a.articles), _load(spark, a.base)
    _store(docs.docs, abbreviations.abbreviation_candidates(base.entities, docs.passages), None, a.output)


def predict(spark, a):
    docs, train, terms = _load(spark, a.articles), _load(spark, a.training), _terms(spark, a.ontology)
    todo = _first(docs.docs, a.limit)
    if a.resume:
        todo = files.pending(todo, files.read_jsonl(spark, a.output))
    if todo.isEmpty():
        return None
    docs = _tables(todo)
    within = ontology.descendants(terms, a.root)
    names = ontology.aliases(terms, within=within)
    external = ontology.external_aliases(files.read_dictionary(spark, a.dictionary), terms, within) if a.dictionary else None
    build = gazetteer.left_out_aliases if a.leave_one_out else gazetteer.alias_table
    table = build(train.entities, train.passages, terms, names, tx.normalize_surface, external=external, min_precision=a.train_min_precision, recovered_precision=None if a.no_recover_exact_train_aliases else 0.10, synonyms=not a.no_hpo_synonyms)
    entities = gazetteer.extract(docs.passages, table, root=a.root, expansions=gazetteer.expansions(train.entities, ontology.admissible(names), tx.normalize_surface))
    values = structure.by_proximity(entities, docs.passages, docs.anchors, docs.patients)
    if a.propagate_groups:
        values = structure.propagate_groups(values, entities, docs.passages, docs.anchors, docs.patients)
    _store(docs.docs, entities, values, a.output, docs.patients, "append" if a.resume else "overwrite")
    written = files.read_jsonl(spark, a.output).join(todo.select("pmc_id"), "pmc_id", "left_semi")
    return int(not validation.validate(written, todo).isEmpty())


def replies_from_cache(spark, a):
    """judge-entities, judge-associations, discover-entities: requests whose replies the cache holds; the others are written out to be asked."""
    docs, base = _load(spark, a.articles), _load(spark, a.base)
    todo = _first(docs.docs, a.limit).select("pmc_id")
    docs.docs, base.entities = docs.docs.join(todo, "pmc_id", "left_semi"), base.entities.join(todo, "pmc_id", "left_semi")
    _require(docs.docs, base_row=base)
    if a.command == "discover-entities":
        rows = docs.passages.join(todo, "pmc_id", "left_semi")
        requests = model_io.discovery_requests(rows, a.chunk_size)
    else:
        rows = model_io.candidate_context(base.entities.filter(tx.is_positive(F.col("note"))), docs.passages)
        rows = batching.fixed_batches(rows, "pmc_id", ["e_ord"], a.batch_size)
        requests = model_io.judge_requests(rows) if a.command == "judge-entities" else model_io.association_requests(rows, docs.patients)
    cache = model_io.read_cache(spark, a.cache)
    requests.join(cache, "key", "left_anti").select("key", "payload").write.mode("overwrite").json(f"{a.output}.requests")
    answered = requests.join(cache.select("key", "reply").dropDuplicates(["key"]), "key")
    if a.command == "judge-entities":
        kept = model_io.judged_entities(rows, answered, a.include_uncertain).select(*base.entities.columns)
        _store(docs.docs, entity_sets.merge(kept, base.entities.filter("note = 'NO'")), base.associations, a.output, docs.patients)
    elif a.command == "judge-associations":
        values = model_io.assigned_values(rows, answered, docs.patients)
        if a.intersect_proximity:
            values = associations.confirmed(values, structure.by_proximity(base.entities, docs.passages, docs.anchors, docs.patients))
        _store(docs.docs, base.entities, values, a.output, docs.patients)
    else:
        terms = _terms(spark, a.ontology)
        aliases = ontology.resolve(ontology.aliases(terms, within=ontology.descendants(terms, a.root)), ontology.id_frequency(base.entities, terms))
        found = model_io.discovered_entities(answered, docs.passages, aliases, base.entities, tx.normalize_surface)
        _store(docs.docs, entity_sets.merge(base.entities, found), base.associations, a.output, docs.patients)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mentionloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *paths, output=True):
        c = sub.add_parser(name)
        for path in paths:
            c.add_argument(f"--{path}", required=not path.endswith("?"), nargs="+" if path == "sources" else None) if not path.endswith("?") else c.add_argument(f"--{path[:-1]}")
        if output:
            c.add_argument("--output", required=True)
        c.set_defaults(run=run)
        return c

    command("evaluate", evaluate, "gold", "predictions", output=False)
    command("validate", validate, "articles", "predictions", output=False).add_argument("--show", type=int, default=1000)
    command("merge-entities", merge_entities, "base", "sources")
    for name, run in (("vote-entities", vote_entities), ("select-entities", select_entities)):
        c = command(name, run, "base", "sources")
        c.add_argument("--min-votes", type=int, default=2)
        c.add_argument("--max-text-length", type=int)
    command("subtract-entities", subtract_entities, "base", "candidates")
    command("clip-associations", clip_associations, "predictions", "entities?")
    c = command("fuse-associations", fuse_associations, "articles", "base", "primary", "secondary")
    c.add_argument("--union-multi", action="store_true")
    c.add_argument("--union-range", type=int, nargs=2)
    c.add_argument("--outside-primary", action="store_true")
    c.add_argument("--max-ratio", type=float)
    distances = [c]
    for name in ("vote-associations", "augment-associations"):
        c = command(name, vote_associations, "articles", "base", "sources")
        c.add_argument("--min-votes", type=int, default=2 if name == "vote-associations" else 1)
        c.add_argument("--single-sources", type=int, nargs="+", help="numbers from 1")
        c.add_argument("--single-min-votes", type=int)
        c.add_argument("--propagate-groups", action="store_true")
        c.add_argument("--wide-sections", nargs="+")
        c.add_argument("--wide-previous-distance", type=int)
        c.add_argument("--wide-next-distance", type=int)
        distances.append(c)
    for c in distances:
        c.add_argument("--previous-distance", type=int)
        c.add_argument("--next-distance", type=int)
    c = command("stabilize-associations", stabilize_associations, "articles", "base", "entities", "additions", "addition-associations")
    c.add_argument("--sections", nargs="+")
    for flag in ("structure-filter", "preserve-groups", "allow-negated", "allow-nested", "allow-existing-values"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("--previous-distance", type=int, default=4000)
    c.add_argument("--next-distance", type=int, default=300)
    c = command("fuse-candidates", fuse_candidates, "base", "candidates", "training?", "gold?", "additions-output?")
    c.add_argument("--min-score", type=float, default=0.9997)
    c.add_argument("--min-text-length", type=int, default=6)
    c.add_argument("--max-per-identifier", type=int, default=10)
    c.add_argument("--surface-min-precision", type=float, default=0.0)
    c.add_argument("--surface-min-count", type=int, default=1)
    for flag in ("allow-overlap", "new-identifiers-only", "leave-one-out"):
        c.add_argument(f"--{flag}", action="store_true")
    c = command("filter-judged-entities", filter_judged_entities, "articles", "base", "additions", "judged")
    c.add_argument("--sections", nargs="+")
    c.add_argument("--min-text-length", type=int, default=0)
    command("abbreviation-candidates", abbreviation_candidates, "articles", "base")
    c = command("predict", predict, "articles", "training", "ontology", "dictionary?")
    c.add_argument("--root", default="HP:0000118")
    c.add_argument("--train-min-precision", type=float, default=0.40)
    c.add_argument("--limit", type=int)
    for flag in ("leave-one-out", "no-recover-exact-train-aliases", "no-hpo-synonyms", "propagate-groups", "resume"):
        c.add_argument(f"--{flag}", action="store_true")
    for name, size in (("judge-entities", 40), ("judge-associations", 30)):
        c = command(name, replies_from_cache, "articles", "base", "cache")
        c.add_argument("--batch-size", type=int, default=size)
        c.add_argument("--limit", type=int)
        c.add_argument("--include-uncertain" if name == "judge-entities" else "--intersect-proximity", action="store_true")
    c = command("discover-entities", replies_from_cache, "articles", "base", "cache", "ontology")
    c.add_argument("--root", default="HP:0000118")
    c.add_argument("--chunk-size", type=int, default=12_000)
    c.add_argument("--limit", type=int)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    session = settle(spark or SparkSession.builder.appName("mentionloom").getOrCreate())
    return a.run(session, a) or 0


if __name__ == "__main__":
    sys.exit(main())

"""Queries of the annotation and fusion operators over whole tables, each with its SQL.

Gold mentions and associations are those of ``articles``; the annotators of ``entities`` are prediction sources; the scored
candidates are ``cnn_candidates``; the ontology is ``hpo_terms``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import abbreviations, associations, candidates, entity_sets, evaluation, gazetteer, ontology, structure, validation
from mentionloom.plans import annotation_sql as sql
from mentionloom.session import cut, table
from mentionloom.sources import articles as src

ANNOTATORS = ("ann1", "ann2", "ann3", "dict")
RULES = candidates.CandidateRules(min_score=0.5, min_text_length=6, max_per_identifier=2, surface_min_precision=0.2)
N_SOURCES = len(ANNOTATORS) + 1
_OUT = ["pmc_id", "e_ord", "identifier", "offset", "length", "text", "note"]


class Tables:
    """The long tables of one data folder; surfaces, aliases and passages are compared in the given normal form."""

    def __init__(self, spark: SparkSession, d: str, normalize: Callable[[Column], Column] = tx.normalize_surface, fold: Callable[[str], str] = gazetteer.fold_same) -> None:
        self.spark, self.d, self.normalize, self.fold = spark, d, normalize, fold

    @cached_property
    def docs(self) -> DataFrame:
        return src.latest_articles(table(self.spark, self.d, "articles"))

    @cached_property
    def passages(self) -> DataFrame:
        return src.passages(self.docs)

    @cached_property
    def patients(self) -> DataFrame:
        return src.patients(self.docs)

    @cached_property
    def anchors(self) -> DataFrame:
        return src.anchors(self.docs)

    @cached_property
    def entities(self) -> DataFrame:
        return src.entities(self.docs)

    @cached_property
    def associations(self) -> DataFrame:
        return src.associations(self.docs).select("pmc_id", "patient_id", "v_ord", "value")

    @cached_property
    def annotations(self) -> DataFrame:
        rows = table(self.spark, self.d, "entities").filter("pmc_id is not null and identifier is not null and offset is not null and length is not null")
        number = F.array_position(F.array(*map(F.lit, ANNOTATORS)), F.col("annotator")).cast("int") - 1
        return rows.groupBy(F.col("entity_id").alias("e_ord")).agg(F.min(F.struct("pmc_id", "annotator", "identifier", "type", "offset", "length", "text", "note")).alias("r")).select("e_ord", "r.*").withColumn("source", number).filter("source >= 0")

    @cached_property
    def ballots(self) -> DataFrame:
        """Sources of a vote: the articles' own mentions, then the annotators."""
        cols = ["pmc_id", "e_ord", "identifier", "type", "offset", "length", "text", "note", "source"]
        own = self.entities.withColumn("source", F.lit(0)).withColumn("e_ord", F.col("e_ord").cast("bigint"))
        return own.select(*cols).unionByName(self.annotations.withColumn("source", F.col("source") + 1).select(*cols))

    @cached_property
    def annotated(self) -> DataFrame:
        return entity_sets.select_by_vote(self.annotations, len(ANNOTATORS), 1)

    @cached_property
    def candidates(self) -> DataFrame:
        rows = table(self.spark, self.d, "cnn_candidates").filter("pmc_id is not null")
        once = rows.groupBy(F.col("candidate_id").alias("c_ord")).agg(F.min(F.struct("pmc_id", "identifier", "type", "offset", "length", "text", "note", "score")).alias("r"))
        return once.select("c_ord", "r.*")

    @cached_property
    def terms(self) -> DataFrame:
        return ontology.latest(table(self.spark, self.d, "hpo_terms"))

    @cached_property
    def aliases(self) -> DataFrame:
        return ontology.aliases(self.terms, self.normalize)

    @cached_property
    def external(self) -> DataFrame:
        """The findings of the annotator ``dict`` as a dictionary from outside."""
        said = self.annotations.filter("annotator = 'dict' and text is not null").select(F.col("text").alias("alias"), F.explode(F.split("identifier", ";")).alias("identifier"))
        return ontology.external_aliases(said, self.terms, self.terms.filter("NOT obsolete").select("identifier"), self.normalize)

    @cached_property
    def left_out(self) -> DataFrame:
        return candidates.surface_precision_left_out(candidates.surface_counts(self.candidates, self.entities, self.normalize))

    @cached_property
    def additions(self) -> DataFrame:
        added = candidates.additions(self.entities, self.candidates.join(self.docs.select("pmc_id"), "pmc_id", "left_semi"), RULES, self.left_out, self.normalize)
        return cut(added)  # read several times

    @cached_property
    def fused(self) -> DataFrame:
        return candidates.fuse(self.entities, self.additions)

    @cached_property
    def near(self) -> DataFrame:
        return structure.by_proximity(self.entities, self.passages, self.anchors, self.patients)

    @cached_property
    def voted(self) -> DataFrame:
        return entity_sets.select_by_vote(self.ballots, N_SOURCES, 2)

    @cached_property
    def surfaces(self) -> DataFrame:
        return gazetteer.surface_stats(self.entities, self.passages, self.normalize, self.fold)

    @cached_property
    def dictionary(self) -> DataFrame:
        return cut(ontology.resolve(ontology.admissible(self.aliases), ontology.id_frequency(self.entities, self.terms)))  # read several times


def _ints(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def passages(t: Tables) -> DataFrame:
    return _ints(t.passages.select("pmc_id", "p_idx", "section", "p_off", "p_end"), "p_idx", "p_off", "p_end")


def patient_mentions(t: Tables) -> DataFrame:
    return _ints(t.anchors, "patient_ord", "m_ord", "m_off", "m_len")


def offset_to_passage(t: Tables) -> DataFrame:
    rows = entity_sets.locate(t.entities, t.passages).select("pmc_id", "e_ord", F.coalesce("p_idx", F.lit(-1)).alias("p_idx"))
    return _ints(rows, "e_ord", "p_idx")


def merge_entities(t: Tables) -> DataFrame:
    return _ints(entity_sets.merge(t.entities, *[t.annotations.filter(F.col("source") == i) for i in range(len(ANNOTATORS))]).select(*_OUT), "e_ord")


def subtract_entities(t: Tables) -> DataFrame:
    return _ints(entity_sets.subtract(t.entities, t.annotations).select(*_OUT), "e_ord")


def select_entities(t: Tables) -> DataFrame:
    return _ints(entity_sets.select_by_vote(t.ballots, N_SOURCES, 2, max_text_length=40).select(*_OUT), "e_ord")


def vote_entities(t: Tables) -> DataFrame:
    return _ints(entity_sets.vote(t.entities, t.ballots, N_SOURCES, 2).select(*_OUT), "e_ord")


def nested_entities(t: Tables) -> DataFrame:
    return _ints(entity_sets.nested(t.fused).select("pmc_id", "e_ord", "offset", "length"), "e_ord")


def overlap_free_candidates(t: Tables) -> DataFrame:
    return entity_sets.not_overlapping(t.candidates, t.entities).select("pmc_id", "c_ord", "offset", "length")


def surface_precision(t: Tables) -> DataFrame:
    return _rounded(candidates.surface_precision(candidates.surface_counts(t.candidates, t.entities, t.normalize), 3))


def surface_precision_loo(t: Tables) -> DataFrame:
    return _rounded(t.left_out)


def cnn_additions(t: Tables) -> DataFrame:
    return _ints(t.additions.select("pmc_id", "a_ord", "c_ord", "identifier", "offset", "length", "text", "note"), "a_ord")


def cnn_fuse(t: Tables) -> DataFrame:
    return _ints(t.fused.select(*_OUT), "e_ord")


def judge_gate(t: Tables) -> DataFrame:
    return _ints(entity_sets.judge_gate(t.fused, t.passages, t.additions, t.annotations, {"CASE", "RESULTS"}, 20).select(*_OUT), "e_ord")


def sentence_bounds(t: Tables) -> DataFrame:
    return _ints(structure.placed(t.entities, t.passages).select("pmc_id", "e_ord", "s_start", "s_end"), "e_ord", "s_start", "s_end")


def negation_flags(t: Tables) -> DataFrame:
    at = entity_sets.locate(t.entities, t.passages).filter("p_idx is not null")
    text, start = F.col("p_text"), F.col("offset") - F.col("p_off")
    end = start + F.col("length")
    prefix = tx.slice_text(text, tx.sentence_start(text, start), start)
    suffix = tx.slice_text(text, end, tx.sentence_end(text, end))
    near = tx.slice_text(text, F.greatest(tx.sentence_start(text, start), start - 80), start)
    rows = at.select("pmc_id", "e_ord", prefix.rlike(tx.NEGATION_BEFORE).alias("before"), suffix.rlike(tx.NEGATION_AFTER).alias("after"), near.rlike(tx.NEGATION_NEAR).alias("near"))
    return _ints(rows, "e_ord")


def proximity_association(t: Tables) -> DataFrame:
    return _ints(t.near, "v_ord")


def structural_patients(t: Tables) -> DataFrame:
    return _ints(structure.structural_patients(t.entities, t.passages, t.anchors, wide_sections={"CASE"}, wide_previous_distance=6000, wide_next_distance=600), "e_ord")


def structure_filter(t: Tables) -> DataFrame:
    return _ints(structure.filter_by_structure(t.associations, t.entities, t.passages, t.anchors, t.patients), "v_ord")


def group_propagation(t: Tables) -> DataFrame:
    return _ints(structure.propagate_groups(t.near, t.entities, t.passages, t.anchors, t.patients), "v_ord")


def clip_associations(t: Tables) -> DataFrame:
    return _ints(associations.clip(t.associations, t.voted), "v_ord")


def fuse_patient_count(t: Tables) -> DataFrame:
    return _ints(associations.fuse_by_patient_count(t.patients, t.near, t.associations, union_range=(1, 2), outside_primary=True, max_ratio=2.0), "v_ord")


def vote_associations(t: Tables) -> DataFrame:
    clipped = associations.clip(t.near, t.voted)
    return _ints(associations.fuse_by_vote(t.patients, [t.associations, t.near, clipped], 2, single_sources=[0, 1], single_min_votes=1), "v_ord")


def augment_associations(t: Tables) -> DataFrame:
    return _ints(associations.augment(t.associations, t.near), "v_ord")


def stabilize_associations(t: Tables) -> DataFrame:
    added = t.additions.withColumn("e_ord", F.col("a_ord"))
    near = structure.by_proximity(added, t.passages, t.anchors, t.patients)
    return _ints(associations.stabilize(t.patients, t.passages, t.anchors, t.associations, t.fused, added, near), "v_ord")


def stabilize_structured(t: Tables) -> DataFrame:
    added = t.additions.withColumn("e_ord", F.col("a_ord"))
    near = structure.by_proximity(added, t.passages, t.anchors, t.patients)
    return _ints(associations.stabilize(t.patients, t.passages, t.anchors, t.associations, t.fused, added, near, final_structure_filter=True, preserve_groups=True), "v_ord")


def _gold_patients(t: Tables) -> DataFrame:
    return t.docs.select("pmc_id", F.explode("association").alias("a")).filter("a.patient_id is not null").select("pmc_id", "a.patient_id").distinct()


def evaluate_mention(t: Tables) -> DataFrame:
    return _rounded(evaluation.with_prf(evaluation.mention_counts(t.entities, t.annotated, t.docs)))


def evaluate_document(t: Tables) -> DataFrame:
    return _rounded(evaluation.with_prf(evaluation.document_counts(t.entities, t.annotated, t.docs)))


def evaluate_association(t: Tables) -> DataFrame:
    per = evaluation.patient_counts(t.associations, t.near, _gold_patients(t))
    return _rounded(evaluation.with_prf(evaluation.association_scores(per)))


def evaluate_score(t: Tables) -> DataFrame:
    per = evaluation.patient_counts(t.associations, t.near, _gold_patients(t))
    rows = evaluation.score(evaluation.mention_counts(t.entities, t.annotated, t.docs), evaluation.document_counts(t.entities, t.annotated, t.docs), evaluation.association_scores(per))
    return _rounded(rows)


def validate_submission(t: Tables) -> DataFrame:
    return validation.validate(table(t.spark, t.d, "articles").filter("pmc_id is not null"), t.docs)


def ontology_descendants(t: Tables) -> DataFrame:
    """Everything that hangs below a live term without parents."""
    return ontology.descendants(t.terms, t.terms.filter(~F.col("obsolete")).filter(F.size(F.coalesce("parents", F.array())) == 0).select("identifier"))


def canonical_ids(t: Tables) -> DataFrame:
    own = t.terms.select("identifier").unionByName(t.terms.select(F.explode("alt_ids").alias("identifier"))).filter("identifier is not null").distinct()
    return ontology.canonical(own, t.terms)


def resolve_alias(t: Tables) -> DataFrame:
    return t.dictionary


def gazetteer_extract(t: Tables) -> DataFrame:
    return _ints(gazetteer.extract(t.passages, t.dictionary, t.fold).select(*_OUT), "e_ord")


def gazetteer_trained(t: Tables) -> DataFrame:
    rows = gazetteer.extract(t.passages, _trained(t, gazetteer.alias_table), t.fold, expansions=gazetteer.expansions(t.entities, ontology.admissible(t.aliases), t.normalize))
    return _ints(rows.select(*_OUT), "e_ord")


def _trained(t: Tables, how: Callable[..., DataFrame]) -> DataFrame:
    return cut(how(t.entities, t.passages, t.terms, t.aliases, t.normalize, t.fold, t.external))


def gazetteer_leave_one_out(t: Tables) -> DataFrame:
    """The aliases of every article as all other articles give them, and how often the article holds them."""
    return _trained(t, gazetteer.left_out_aliases)


def gazetteer_left_out_mentions(t: Tables) -> DataFrame:
    rows = gazetteer.extract(t.passages, _trained(t, gazetteer.left_out_aliases), t.fold, expansions=gazetteer.expansions(t.entities, ontology.admissible(t.aliases), t.normalize))
    return _ints(rows.select(*_OUT), "e_ord")


def surface_stats(t: Tables) -> DataFrame:
    return _rounded(_ints(t.surfaces, "positive", "negative", "uppercase_positive", "occurrences"))


def most_common_id(t: Tables) -> DataFrame:
    return gazetteer.most_common_id(t.entities, t.normalize)


def alias_priority(t: Tables) -> DataFrame:
    return _trained(t, gazetteer.alias_table)


def abbreviation_candidates(t: Tables) -> DataFrame:
    return _ints(abbreviations.abbreviation_candidates(t.entities, t.passages).select(*_OUT), "e_ord")


def abbreviations_written_out(t: Tables) -> DataFrame:
    """The same over a passage for each finding that defines its initials and uses them again: the tables' own texts define none."""
    short = tx.initials(F.col("text"))
    said = t.entities.filter(tx.is_positive(F.col("note")) & F.col("text").isNotNull() & (F.length("text") < 400) & short.rlike("^[A-Z][A-Z0-9]+$")).withColumn("offset", (F.col("e_ord") * 1000).cast("int")).withColumn("length", F.length("text"))
    text = F.concat("text", F.lit(" ("), short, F.lit(") was seen; later "), short, F.lit(" grew."))
    written = said.select("pmc_id", F.col("e_ord").alias("p_idx"), F.lit("CASE").alias("section"), F.col("offset").alias("p_off"), (F.col("offset") + F.length(text)).alias("p_end"), text.alias("text"))
    return _ints(abbreviations.abbreviation_candidates(said, written).select(*_OUT), "e_ord")


def renested_articles(t: Tables) -> DataFrame:
    nested = src.nest_entities(t.entities).join(src.nest_associations(t.associations, t.patients), "pmc_id", "full")
    return nested.select("pmc_id", F.coalesce(F.size("entities"), F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(F.get("entities", F.lit(0))["identifier"], F.lit("")).alias("first_identifier"), F.to_json("association").alias("association"))


_QUERIES = [
    passages, patient_mentions, offset_to_passage, gazetteer_extract, gazetteer_trained, gazetteer_leave_one_out, gazetteer_left_out_mentions, merge_entities, subtract_entities, select_entities, vote_entities, nested_entities, overlap_free_candidates,
    surface_stats, most_common_id, alias_priority, surface_precision, surface_precision_loo, cnn_additions, cnn_fuse, judge_gate, sentence_bounds, negation_flags, proximity_association,
    structural_patients, structure_filter, group_propagation, clip_associations, fuse_patient_count, vote_associations, augment_associations, stabilize_associations, stabilize_structured,
    evaluate_mention, evaluate_document, evaluate_association, evaluate_score, validate_submission, abbreviation_candidates, abbreviations_written_out, ontology_descendants, canonical_ids, resolve_alias, renested_articles,
]


#: with SQL, which can't say NFKC and case folding: under their own names they compare the simple form that their SQL says, as ``..._nfkc`` the full one
_SURFACES = [
    gazetteer_extract, gazetteer_leave_one_out, nested_entities, surface_stats, most_common_id, alias_priority, surface_precision, surface_precision_loo, cnn_additions, cnn_fuse, judge_gate, stabilize_associations, resolve_alias,
]


def registered(functions: list, with_sql: set[str], by_surface: list) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries without SQL in the full normal form; those with SQL in the simple one and, where surfaces matter, in the full one too."""
    plain = {f.__name__: lambda spark, d, f=f: f(Tables(spark, d, tx.normalize_ascii, gazetteer.lower_same) if f.__name__ in with_sql else Tables(spark, d)) for f in functions}
    return plain | {f"{f.__name__}_nfkc": lambda spark, d, f=f: f(Tables(spark, d)) for f in by_surface}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registered(_QUERIES, set(oracle_sql()), _SURFACES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

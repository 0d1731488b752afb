"""Dictionary extraction as an equi-join: all boundary-valid occurrences of many aliases in many texts.

An alias that starts with a letter or digit can only occur where a run of letters and digits starts, and its own first run
must equal that run; so runs are looked up by the first runs of the aliases and the rest is compared on the few that match.
An alias that starts otherwise is looked up by its first character. Overlapping and nested occurrences are all kept.

Offsets are code points of the original text: normalisation works character by character and keeps a character whose
normal form has another length.

What the training articles say of a surface is kept by article, so that leaving one out is a subtraction, not a rebuild.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import entity_sets as es
from mentionloom.operators import ontology
from mentionloom.session import cut

_START = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")
_FIRST_RUN = r"^(?:[\p{L}\p{N}]+|.)"
#: aliases of up to so many bytes in all are sent to the tasks; more are joined by shuffle
BROADCAST_BYTES = 32_000_000


def lower_same(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def fold_same(text: str) -> str:
    """NFKC, hyphens and case folding where the length of the character stays."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        n = unicodedata.normalize("NFKC", "-" if c in tx.DASHES else c).casefold()
        out.append(n if len(n) == 1 else c)
    return "".join(out)


def _hits(passages: DataFrame, fold: Callable[[str], str], by_run: dict[str, list[str]] | None) -> DataFrame:
    """Occurrences of the aliases of ``by_run``; without it the places where any alias may start, as (run, start)."""
    sent = passages.sparkSession.sparkContext.broadcast(by_run)

    def work(batches):
        by_run = sent.value
        for batch in batches:
            rows = []
            for pmc, idx, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = fold(text)
                for m in _START.finditer(low):
                    start = m.start()
                    if by_run is None:
                        rows.append((pmc, idx, start, m[0]))
                    else:
                        rows += [(pmc, idx, start, alias) for alias in by_run.get(m[0], ()) if low.startswith(alias, start) and free_end(low, start, alias)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=["pmc_id", "p_idx", "start", "alias"])

    return passages.select("pmc_id", "p_idx", "text").mapInArrow(work, "pmc_id string, p_idx int, start int, alias string")


def free_end(text: str, start: int, alias: str) -> bool:
    """No letter or digit follows an alias that ends in one."""
    end = start + len(alias)
    return end >= len(text) or unicodedata.category(alias[-1])[0] not in "LN" or unicodedata.category(text[end])[0] not in "LN"


def occurrences(passages: DataFrame, alias_rows: DataFrame, fold: Callable[[str], str] = fold_same, most: int = BROADCAST_BYTES) -> DataFrame:
    """(pmc_id, p_idx, start, alias): every boundary-valid occurrence of the distinct aliases."""
    keyed = cut(alias_rows.select("alias").filter("alias <> ''").distinct().withColumn("run", F.regexp_extract("alias", _FIRST_RUN, 0)))
    if (keyed.agg(F.sum(F.octet_length("alias") + F.octet_length("run"))).first()[0] or 0) <= most:
        by_run: dict[str, list[str]] = {}
        for r in keyed.orderBy("alias").toArrow().to_pylist():
            by_run.setdefault(r["run"], []).append(r["alias"])
        return _hits(passages, fold, by_run)
    met = _hits(passages, fold, None).withColumnRenamed("alias", "run").join(keyed, "run")
    there = met.join(passages.select("pmc_id", "p_idx", "text"), ["pmc_id", "p_idx"]).select("pmc_id", "p_idx", "start", "alias", "text")

    def compare(batches):
        for batch in batches:
            text = None
            keep = []
            for start, alias, said in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if text is None or said != text:
                    text, low = said, fold(said)
                keep.append(low.startswith(alias, start) and free_end(low, start, alias))
            yield batch.select(["pmc_id", "p_idx", "start", "alias"]).filter(pa.array(keep, pa.bool_()))

    return there.mapInArrow(compare, "pmc_id string, p_idx int, start int, alias string")


def label_counts(entities: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(pmc_id, surface, positive, negative, uppercase_positive) of annotated surfaces; of one span the first annotation counts."""
    e = entities.filter("text is not null and text <> ''").withColumn("surface", normalize(F.col("text")))
    w = Window.partitionBy("pmc_id", "offset", "length", "surface").orderBy("e_ord")
    first = e.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    positive = tx.is_positive(F.col("note"))
    return first.groupBy("pmc_id", "surface").agg(F.sum(positive.cast("int")).alias("positive"), F.sum((~positive).cast("int")).alias("negative"), F.sum((positive & tx.is_uppercase_abbreviation(F.col("text"))).cast("int")).alias("uppercase_positive"))


_LABELS = ["positive", "negative", "uppercase_positive"]


def _precision(rows: DataFrame) -> DataFrame:
    share = F.least(F.lit(1.0), (F.col("positive") + F.col("negative")) / F.col("occurrences"))
    return rows.withColumn("precision", F.when(F.col("occurrences") > 0, share).otherwise(F.lit(0.0)))


def surface_stats(entities: DataFrame, passages: DataFrame, normalize: Callable[[Column], Column], fold: Callable[[str], str] = fold_same) -> DataFrame:
    """(surface, positive, negative, uppercase_positive, occurrences, precision) of annotated surfaces."""
    labels = label_counts(entities, normalize).groupBy("surface").agg(*[F.sum(c).alias(c) for c in _LABELS])
    seen = occurrences(passages, labels.select(F.col("surface").alias("alias")), fold).groupBy(F.col("alias").alias("surface")).agg(F.count("*").alias("occurrences"))
    return _precision(labels.join(seen, "surface", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0))))


def identifier_counts(entities: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(surface, identifier, pmc_id, n, n_positive, seen): how often an article gives an identifier to a surface, and positively on a span that no earlier annotation has."""
    e = entities.filter("text is not null and text <> '' and identifier is not null").withColumn("surface", normalize(F.col("text")))
    w = Window.partitionBy("pmc_id", "offset", "length", "surface").orderBy("e_ord")
    positive = (F.row_number().over(w) == 1) & tx.is_positive(F.col("note"))
    return e.withColumn("_p", positive.cast("int")).groupBy("surface", "identifier", "pmc_id").agg(F.count("*").alias("n"), F.sum("_p").alias("n_positive"), F.min("e_ord").alias("seen"))


def usual_identifiers(counts: DataFrame, keys: list[str], n: str = "n", n_positive: str = "n_positive", seen: str = "seen") -> DataFrame:
    """(keys, usual, usual_positive): the most frequent identifiers of all and of positive labels, ties to the one seen first."""
    rows = counts.filter(F.col(n) > 0)
    all_ = F.min(F.struct(-F.col(n), F.col(seen), F.col("identifier").alias("id"))).alias("a")
    told = F.min(F.when(F.col(n_positive) > 0, F.struct(-F.col(n_positive), F.col(seen), F.col("identifier").alias("id")))).alias("p")
    return rows.groupBy(*keys).agg(all_, told).select(*keys, F.col("a.id").alias("usual"), F.col("p.id").alias("usual_positive"))


def total_usual(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("surface", "identifier").agg(F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"), F.min(F.struct("pmc_id", "seen")).alias("seen"))
    return usual_identifiers(total, ["surface"])


def left_out_usual(counts: DataFrame) -> DataFrame:
    """(pmc_id, surface, usual, usual_positive) by all other articles, for the articles that label the surface themselves."""
    w = Window.partitionBy("surface", "identifier")
    first = F.row_number().over(w.orderBy("pmc_id"))
    two = counts.withColumn("_r", first).filter("_r <= 2").groupBy("surface", "identifier").agg(F.min(F.when(F.col("_r") == 1, F.struct("pmc_id", "seen"))).alias("s1"), F.min(F.when(F.col("_r") == 2, F.struct("pmc_id", "seen"))).alias("s2"))
    total = counts.groupBy("surface", "identifier").agg(F.sum("n").alias("_n"), F.sum("n_positive").alias("_p")).join(two, ["surface", "identifier"])
    own = counts.select("pmc_id", "surface", "identifier", "n", "n_positive")
    met = own.select("pmc_id", "surface").distinct().join(total, "surface").join(own, ["pmc_id", "surface", "identifier"], "left")
    rest = met.withColumn("n", F.col("_n") - F.coalesce("n", F.lit(0))).withColumn("n_positive", F.col("_p") - F.coalesce("n_positive", F.lit(0))).withColumn("seen", F.when(F.col("s1.pmc_id") == F.col("pmc_id"), F.col("s2")).otherwise(F.col("s1")))
    return usual_identifiers(rest, ["pmc_id", "surface"])


def most_common_id(entities: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(surface, identifier, n): the most frequent identifier of each surface, ties to the one seen first."""
    e = entities.filter("text is not null and text <> '' and identifier is not null").withColumn("surface", normalize(F.col("text")))
    counts = e.groupBy("surface", "identifier").agg(F.count("*").alias("n"), F.min(F.struct("pmc_id", "e_ord")).alias("seen"))
    w = Window.partitionBy("surface").orderBy(F.desc("n"), "seen")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("surface", "identifier", "n")


def name_pool(ontology_aliases: DataFrame, frequency: DataFrame, external: DataFrame | None = None, synonyms: bool = True) -> DataFrame:
    """(alias, only, named, external, best): of the ontology's aliases and an external dictionary's the single identifier of the ontology, which sources admit the alias, and the best identifier.

    ``ontology_aliases`` is (alias, identifier, preferred), ``external`` (alias, identifier). The best is, of those for which
    the alias is the preferred name, or else of all, the most frequent, ties to the greatest. Without ``synonyms`` only preferred names are a source.
    """
    own = ontology.admissible(ontology_aliases).select("alias", "identifier", "preferred", F.lit(1).alias("o"), F.lit(0).alias("x"))
    if external is not None:
        own = own.unionByName(ontology.long_enough(external).select("alias", "identifier", F.lit(0).alias("preferred"), F.lit(0).alias("o"), F.lit(1).alias("x")))
    pool = own.join(frequency, "identifier", "left").groupBy("alias").agg(F.max(F.col("o") if synonyms else F.col("o") * F.col("preferred")).alias("named"), F.max("x").alias("external"), F.max_by("identifier", F.struct("preferred", F.coalesce("freq", F.lit(0)), "identifier")).alias("best"))
    unique = ontology_aliases.groupBy("alias").agg(F.countDistinct("identifier").alias("ids"), F.max("identifier").alias("only")).filter("ids = 1").select("alias", "only")
    return pool.join(unique, "alias", "full")


#: the sources of an alias in order of priority
SOURCES = ("train-abbreviation", "train", "ontology", "recovered", "external")


def choose_aliases(stats: DataFrame, usual: DataFrame, pool: DataFrame, pairs: DataFrame | None = None, min_precision: float = 0.40, recovered_precision: float | None = 0.10) -> DataFrame:
    """(keys, alias, identifier, source): for each alias its first source in the order of ``SOURCES`` and its identifier.

    ``stats``, ``usual`` (surface, usual, usual_positive) and ``pool`` hold for all articles; or, where ``pairs`` (pmc_id,
    alias) is given, ``stats`` and ``usual`` by pmc_id, all other articles counted. A trained surface needs ``min_precision``;
    a name observed with less is left out unless it names one term and has positive labels and ``recovered_precision``. The
    only term of a name decides the identifier, else the training does (by positive labels for an abbreviation), else the pool.
    """
    keys = ["alias"] if pairs is None else ["pmc_id", "alias"]
    s = stats.withColumnRenamed("surface", "alias").join(usual.withColumnRenamed("surface", "alias"), keys, "left")
    rows = s.join(pool, "alias", "full") if pairs is None else pairs.join(s, keys, "left").join(pool, "alias", "left")
    labels = F.coalesce(F.col("positive") + F.col("negative"), F.lit(0))
    abbreviation = (F.col("uppercase_positive") >= 1) & tx.is_uppercase_abbreviation(F.upper("alias"))
    trained = (labels > 0) & (F.col("precision") >= min_precision) & F.col("alias").rlike("[0-9a-z]")
    low = F.coalesce((F.col("occurrences") > 0) & (labels > 0) & (F.col("precision") < min_precision), F.lit(False))
    recovered = F.lit(recovered_precision is not None) & F.col("only").isNotNull() & ontology.is_long_enough(F.col("alias")) & (F.col("positive") >= 1) & (F.col("precision") >= (recovered_precision or 0.0))
    source = F.when(abbreviation, SOURCES[0]).when(trained, SOURCES[1]).when((F.col("named") == 1) & ~low, SOURCES[2]).when(recovered, SOURCES[3]).when((F.col("external") == 1) & ~low, SOURCES[4])
    told = F.when(labels > 0, F.when(F.col("source") == SOURCES[0], F.col("usual_positive")).otherwise(F.col("usual")))
    return rows.withColumn("source", source).select(*keys, F.coalesce("only", told, "best").alias("identifier"), "source").filter("identifier is not null and source is not null")


def canonical_usual(usual: DataFrame, terms: DataFrame) -> DataFrame:
    """``usual`` with the single ids of its identifiers made canonical."""
    ids = usual.select(F.explode(F.array("usual", "usual_positive")).alias("id")).filter("id is not null and id <> '-1'").distinct()
    units = ids.select("id", F.posexplode(F.split("id", ";")).alias("i", "unit"))
    whole = ontology.canonical(units, terms, "unit").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "canonical"))), lambda x: x["canonical"]), ";").alias("main"))
    for c in ("usual", "usual_positive"):
        named = whole.select(F.col("id").alias(c), F.col("main").alias(f"_{c}"))
        usual = usual.join(named, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return usual


def alias_table(entities: DataFrame, passages: DataFrame, terms: DataFrame, ontology_aliases: DataFrame, normalize: Callable[[Column], Column], fold: Callable[[str], str] = fold_same, external: DataFrame | None = None, min_precision: float = 0.40, recovered_precision: float | None = 0.10, synonyms: bool = True) -> DataFrame:
    """(alias, identifier, source) that training articles, ontology and external dictionary give together."""
    pool = name_pool(ontology_aliases, ontology.id_frequency(entities, terms), external, synonyms)
    usual = canonical_usual(total_usual(identifier_counts(entities, normalize)), terms)
    return choose_aliases(surface_stats(entities, passages, normalize, fold), usual, pool, None, min_precision, recovered_precision)


def left_out_aliases(entities: DataFrame, passages: DataFrame, terms: DataFrame, ontology_aliases: DataFrame, normalize: Callable[[Column], Column], fold: Callable[[str], str] = fold_same, external: DataFrame | None = None, min_precision: float = 0.40, recovered_precision: float | None = 0.10, synonyms: bool = True) -> DataFrame:
    """(pmc_id, alias, identifier, source, n) of the aliases that occur in an article, as all other articles, the ontology and the dictionary give them: totals less the article's own part."""
    pool = cut(name_pool(ontology_aliases, ontology.id_frequency(entities, terms), external, synonyms))
    labels = cut(label_counts(entities, normalize))
    every = pool.select("alias").unionByName(labels.select(F.col("surface").alias("alias"))).distinct()
    own = cut(occurrences(passages, every, fold).groupBy("pmc_id", "alias").agg(F.count("*").alias("n")))
    seen = own.groupBy("alias").agg(F.sum("n").alias("_occ"))
    total = labels.groupBy(F.col("surface").alias("alias")).agg(*[F.sum(c).alias(f"_{c}") for c in _LABELS])
    mine = labels.withColumnRenamed("surface", "alias")
    met = own.join(total, "alias").join(seen, "alias").join(mine, ["pmc_id", "alias"], "left")
    for c in _LABELS:
        met = met.withColumn(c, F.col(f"_{c}") - F.coalesce(c, F.lit(0)))
    stats = _precision(met.withColumn("occurrences", F.col("_occ") - F.col("n")).filter("positive + negative > 0")).select("pmc_id", F.col("alias").alias("surface"), *_LABELS, "occurrences", "precision")
    counts = cut(identifier_counts(entities, normalize))
    both = [canonical_usual(u, terms) for u in (total_usual(counts), left_out_usual(counts))]
    labelled = counts.select("pmc_id", "surface").distinct().withColumn("_own", F.lit(True))
    others = both[1].select("pmc_id", "surface", F.col("usual").alias("_u"), F.col("usual_positive").alias("_up"))
    usual = stats.select("pmc_id", "surface").join(labelled, ["pmc_id", "surface"], "left").join(both[0], "surface", "left").join(others, ["pmc_id", "surface"], "left")
    pick = lambda mine_, all_: F.when(F.col("_own"), F.col(mine_)).otherwise(F.col(all_))
    usual = usual.select("pmc_id", "surface", pick("_u", "usual").alias("usual"), pick("_up", "usual_positive").alias("usual_positive"))
    return choose_aliases(stats, usual, pool, own.select("pmc_id", "alias"), min_precision, recovered_precision).join(own, ["pmc_id", "alias"])


def _expanded(hits: DataFrame, expansions: DataFrame) -> DataFrame:
    """Keys of abbreviation hits in capitals that stand in brackets right after a long name of one of their ids."""
    long = expansions.select("identifier", F.regexp_replace("name", "[-/]", " ").alias("name")).filter(F.length("name") >= 5)
    prefix = F.regexp_replace(tx.normalize_surface(F.col("prefix")), "[-/]", " ")
    short = hits.filter((F.col("source") == "train-abbreviation") & tx.is_uppercase_abbreviation(F.col("said"))).withColumn("before", prefix).filter(F.col("before").endswith("("))
    bare = F.rtrim(F.expr("substring(before, 1, length(before) - 1)"))
    parts = short.select("pmc_id", "p_idx", "start", "alias", bare.alias("before"), F.explode(F.split("identifier", ";")).alias("unit"))
    return parts.join(long.withColumnRenamed("identifier", "unit"), "unit").filter(F.col("before").endswith(F.col("name"))).select("pmc_id", "p_idx", "start", "alias").distinct()


def extract(passages: DataFrame, alias_rows: DataFrame, fold: Callable[[str], str] = fold_same, root: str | None = None, expansions: DataFrame | None = None) -> DataFrame:
    """Mentions of (alias, identifier) in the passages, with note NO where a cue before or after negates them; rows with a pmc_id hold for that article.

    With ``expansions`` (identifier, name: normalised names and surfaces of each id) aliases of source ``train-abbreviation``
    count only in capitals and where the article spells them out: ``long name (ABC``.
    """
    columns = [c for c in ("pmc_id", "alias", "identifier", "source") if c in alias_rows.columns]
    hits = occurrences(passages, alias_rows, fold).join(alias_rows.select(*columns), ["pmc_id", "alias"] if "pmc_id" in columns else "alias")
    if root is not None:
        hits = hits.filter(F.col("identifier") != root)
    at = hits.join(passages.select("pmc_id", "p_idx", "p_off", F.col("text").alias("p_text")), ["pmc_id", "p_idx"])
    start, end = F.col("start"), F.col("start") + F.length("alias")
    text = F.col("p_text")
    at = at.withColumn("said", tx.slice_text(text, start, end)).withColumn("prefix", tx.slice_text(text, tx.sentence_start(text, start), start))
    if expansions is not None and "source" in columns:
        told = _expanded(at, expansions).withColumn("_told", F.lit(True))
        at = at.join(told, ["pmc_id", "p_idx", "start", "alias"], "left").filter((F.col("source") != "train-abbreviation") | F.col("_told"))
    suffix = tx.slice_text(text, end, tx.sentence_end(text, end))
    note = F.when(F.col("prefix").rlike(tx.NEGATION_BEFORE) | suffix.rlike(tx.NEGATION_AFTER), "NO")
    rows = at.select("pmc_id", "identifier", F.lit("Phenotype").alias("type"), (F.col("p_off") + start).alias("offset"), F.length("alias").alias("length"), F.col("said").alias("text"), note.alias("note"))
    return es.ordered(rows.dropDuplicates(es.KEY))


def expansions(entities: DataFrame, ontology_aliases: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """(identifier, name): the normalised names of each term and the surfaces that were annotated with it positively."""
    seen = entities.filter(tx.is_positive(F.col("note")) & F.col("text").isNotNull()).select(F.explode(F.split("identifier", ";")).alias("identifier"), normalize(F.col("text")).alias("name"))
    return ontology_aliases.select("identifier", F.col("alias").alias("name")).unionByName(seen).distinct()

"""Calls to an external model as a join: requests, a cache keyed by the request, a pluggable client for the misses.

A client is made once per task by a factory and has ``chat(payload: str) -> str``; a failed call (``RuntimeError``) gives a
null reply, and the failure policy is the caller's. Replies are parsed tolerantly and cleaned relationally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionloom.functions import jsontext
from mentionloom.functions import text as tx
from mentionloom.operators import entity_sets as es
from mentionloom.operators import structure
from mentionloom.operators.batching import fixed_batches, greedy_chunks

CACHE = "key string, model string, reply string"


class Client(Protocol):
    def chat(self, payload: str) -> str: ...


def with_key(requests: DataFrame, payload: Column) -> DataFrame:
    """``requests`` with the payload as JSON text and its SHA-256 as key."""
    return requests.withColumn("payload", payload).withColumn("key", F.sha2("payload", 256))


def run_requests(requests: DataFrame, cache: DataFrame, factory: Callable[[], Client], model: str = "model", retries: int = 3) -> DataFrame:
    """``requests`` with ``reply`` and ``cached``: from the cache where it has the key, else asked for; equal requests are asked once."""
    known = cache.select("key", F.col("reply").alias("_cached")).dropDuplicates(["key"])
    misses = requests.select("key", "payload").dropDuplicates(["key"]).join(known, "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            replies = []
            for payload in frame["payload"]:
                client = client or factory()
                for left in range(retries - 1, -1, -1):
                    try:
                        replies.append(client.chat(payload))
                        break
                    except RuntimeError:
                        if not left:
                            replies.append(None)
            yield pd.DataFrame({"key": frame["key"], "_fresh": replies})

    fresh = misses.mapInPandas(ask, "key string, _fresh string")
    rows = requests.join(known, "key", "left").join(fresh, "key", "left")
    return rows.withColumn("reply", F.coalesce("_cached", "_fresh")).withColumn("cached", F.col("_cached").isNotNull()).drop("_cached", "_fresh")


def append_cache(answered: DataFrame, path: str, model: str = "model") -> None:
    answered.filter(~F.col("cached") & F.col("reply").isNotNull()).select("key", F.lit(model).alias("model"), "reply").dropDuplicates(["key"]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as missing:  # no cache yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CACHE)


@F.pandas_udf(T.StringType())
def recovered(replies: pd.Series) -> pd.Series:
    """The reply as strict JSON text, or null."""

    def one(reply):
        try:
            return jsontext.write(jsontext.recover(reply))
        except ValueError:
            return None

    return replies.map(one, na_action="ignore")


def reply_indices(answered: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """(keys, index): whole numbers of a list in the reply, however written, each once."""
    values = F.from_json(F.get_json_object("json", f"$.{field}"), "array<string>")
    rows = answered.withColumn("json", recovered(F.col("reply"))).select(*keys, F.explode(values).alias("v"))
    return rows.select(*keys, F.expr("try_cast(v AS int)").alias("index")).filter("index is not null").distinct()


def reply_assignments(answered: DataFrame, keys: list[str], field: str = "assignments") -> DataFrame:
    """(keys, patient_id, index) of a reply that lists numbers by patient; entries that are no lists are left out."""
    entries = F.from_json(F.get_json_object("json", f"$.{field}"), "map<string,string>")
    rows = answered.withColumn("json", recovered(F.col("reply"))).select(*keys, F.explode(entries).alias("patient_id", "list"))
    items = rows.select(*keys, "patient_id", F.explode(F.from_json("list", "array<string>")).alias("v"))
    return items.select(*keys, "patient_id", F.expr("try_cast(v AS int)").alias("index")).filter("index is not null").distinct()


def judge_requests(batch_rows: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """One request per (pmc_id, batch): the candidates by index, and calibration examples if given."""
    item = F.struct("index", F.coalesce("section", F.lit("UNKNOWN")).alias("section"), "text", "identifier", "context")
    rows = batch_rows.groupBy("pmc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    if examples is not None:
        shown = examples.groupBy("pmc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("accepted", "rank_no", "tie"))).alias("calibration"))
        rows = rows.join(shown, ["pmc_id", "batch"], "left")
    task = F.lit("Accept the candidates that are phenotype findings of a patient of the article. Answer {\"accepted_indices\": [], \"uncertain_indices\": []}.")
    return with_key(rows, F.to_json(F.struct(task.alias("task"), *[c for c in rows.columns if c not in ("batch",)])))


def judged_entities(batch_rows: DataFrame, answered: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """The candidates whose index the reply accepts."""
    keys = ["pmc_id", "batch"]
    chosen = reply_indices(answered, "accepted_indices", keys)
    if include_uncertain:
        chosen = chosen.unionByName(reply_indices(answered, "uncertain_indices", keys)).distinct()
    return batch_rows.join(chosen, [*keys, "index"], "left_semi")


def association_requests(batch_rows: DataFrame, patients: DataFrame) -> DataFrame:
    """One request per (pmc_id, batch) that lists all patients, so that they compete for each finding."""
    item = F.struct("index", "text", "identifier", "context")
    rows = batch_rows.groupBy("pmc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    listed = patients.groupBy("pmc_id").agg(F.array_sort(F.collect_list("patient_id")).alias("patients"))
    rows = rows.join(listed, "pmc_id")
    task = F.lit("Assign each finding to the patients it was observed in. Answer {\"assignments\": {\"patient\": [index]}}.")
    return with_key(rows, F.to_json(F.struct(task.alias("task"), "pmc_id", "patients", "findings")))


def assigned_values(batch_rows: DataFrame, answered: DataFrame, patients: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """(pmc_id, patient_id, v_ord, value) of the assigned findings in order of offset; with ``structural`` only where the article's structure supports the patient."""
    chosen = reply_assignments(answered, ["pmc_id", "batch"]).join(patients.select("pmc_id", "patient_id").distinct(), ["pmc_id", "patient_id"], "left_semi")
    rows = batch_rows.join(chosen, ["pmc_id", "batch", "index"])
    if structural is not None:
        rows = rows.join(structural, ["pmc_id", "e_ord", "patient_id"], "left_semi")
    return structure.first_seen(rows.withColumn("value", structure.whole_value(F.col("identifier"), F.col("text"))), ["offset", "e_ord"])


def discovery_requests(passages: DataFrame, most: int = 12_000) -> DataFrame:
    """One request per (pmc_id, chunk): passages up to so many characters, to be read for findings."""
    chunks = greedy_chunks(passages, "pmc_id", "p_idx", F.length("text") + 100, most)
    item = F.struct(F.col("p_idx").alias("passage_index"), "section", "text")
    rows = passages.join(chunks, ["pmc_id", "p_idx"]).groupBy("pmc_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("passages"))
    task = F.lit("Name every phenotype finding of a patient as it is written. Answer {\"entities\": [{\"passage_index\": 0, \"start\": 0, \"text\": \"\", \"negated\": false}]}.")
    return with_key(rows, F.to_json(F.struct(task.alias("task"), "pmc_id", "passages")))


def discovered_entities(answered: DataFrame, passages: DataFrame, alias_ids: DataFrame, known: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """Mentions that a reply proposes by passage, start and text: placed at the exact occurrence nearest to the declared start and linked by exact alias; known spans are left out."""
    proposal = "array<struct<passage_index:int,start:int,text:string,negated:boolean>>"
    rows = answered.withColumn("json", recovered(F.col("reply"))).select("pmc_id", F.explode(F.from_json(F.get_json_object("json", "$.entities"), proposal)).alias("p")).select("pmc_id", "p.*").filter("text <> ''")
    rows = rows.withColumnRenamed("text", "said").join(passages.select("pmc_id", F.col("p_idx").alias("passage_index"), "p_off", F.col("text").alias("p_text")), ["pmc_id", "passage_index"])
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length("p_text") - F.length("said"), F.lit(0))), lambda i: F.substr("p_text", i + 1, F.length("said")) == F.col("said"))
    nearest = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - F.col("start")).alias("d"), i.alias("i"))))["i"]
    found = rows.withColumn("_at", nearest).filter("_at is not null").withColumn("alias", normalize(F.col("said"))).join(alias_ids, "alias")
    note = F.when(F.col("negated"), "NO")
    out = found.select("pmc_id", "identifier", F.lit("Phenotype").alias("type"), (F.col("p_off") + F.col("_at")).alias("offset"), F.length("said").alias("length"), F.col("said").alias("text"), note.alias("note"))
    new = out.join(known.select("pmc_id", "offset", "length"), ["pmc_id", "offset", "length"], "left_anti")
    return es.ordered(new.dropDuplicates(es.KEY))


def candidate_context(rows: DataFrame, passages: DataFrame, most: int = 360) -> DataFrame:
    """``rows`` with section and context: the sentence of each mention, white space collapsed, cut to ``most`` characters."""
    at = es.locate(rows, passages)
    start = F.col("offset") - F.col("p_off")
    sentence = tx.slice_text(F.col("p_text"), tx.sentence_start(F.col("p_text"), start), tx.sentence_end(F.col("p_text"), start + F.col("length")))
    context = F.substring(F.regexp_replace(F.trim(sentence), r"(?U)\s+", " "), 1, most)
    return at.withColumn("context", F.coalesce(context, F.lit(""))).drop("p_idx", "p_off", "p_text")


def value_batches(entities: DataFrame, size: int = 30) -> DataFrame:
    """(pmc_id, value, v_ord, batch, index): the distinct single values of an article's positive mentions in order of first mention, in batches."""
    e = entities.filter(tx.is_positive(F.col("note"))).select("pmc_id", "e_ord", F.posexplode(structure.single_values(F.col("identifier"), F.col("text"))).alias("u", "value"))
    first = e.groupBy("pmc_id", "value").agg(F.min(F.struct("e_ord", "u")).alias("o"))
    ordered = first.withColumn("v_ord", F.row_number().over(Window.partitionBy("pmc_id").orderBy("o")) - 1).drop("o")
    return fixed_batches(ordered, "pmc_id", ["v_ord"], size)


def value_requests(batches: DataFrame, occurrences: DataFrame, contexts: DataFrame, patients: DataFrame) -> DataFrame:
    """One request per (pmc_id, patient_id, batch): each value with the contexts of its occurrences nearest to the patient.

    ``occurrences`` is (pmc_id, patient_id, value, e_ord, rank_no), ``contexts`` (pmc_id, e_ord, section, context).
    """
    shown = occurrences.join(contexts, ["pmc_id", "e_ord"]).groupBy("pmc_id", "patient_id", "value").agg(F.array_sort(F.collect_list(F.struct("rank_no", "section", "context"))).alias("occurrences"))
    rows = batches.join(patients.select("pmc_id", "patient_id").distinct(), "pmc_id").join(shown, ["pmc_id", "patient_id", "value"], "left")
    per = rows.groupBy("pmc_id", "patient_id", "batch").agg(F.array_sort(F.collect_list(F.struct("index", "value", "occurrences"))).alias("values"))
    task = F.lit("Name the values that the article observes in the patient. Answer {\"associated_indices\": [], \"uncertain_indices\": []}.")
    return with_key(per, F.to_json(F.struct(task.alias("task"), "pmc_id", "patient_id", "values")))


def chosen_values(batches: DataFrame, answered: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """(pmc_id, patient_id, v_ord, value) of the values that the replies accept, in the article's order."""
    keys = ["pmc_id", "patient_id", "batch"]
    chosen = reply_indices(answered, "associated_indices", keys)
    if include_uncertain:
        chosen = chosen.unionByName(reply_indices(answered, "uncertain_indices", keys)).distinct()
    rows = batches.join(chosen, ["pmc_id", "batch", "index"]).select("pmc_id", "patient_id", "value", F.col("v_ord").alias("o"))
    return structure.first_seen(rows, ["o"])


def consensus(*selections: DataFrame) -> DataFrame:
    """Union of (pmc_id, e_ord, patient_id) selections that were filtered each in its own way."""
    return reduce(DataFrame.unionByName, [s.select("pmc_id", "e_ord", "patient_id") for s in selections]).distinct()


def values_of(selection: DataFrame, entities: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, v_ord, value) of selected mentions in order of offset."""
    rows = selection.join(entities, ["pmc_id", "e_ord"]).withColumn("value", structure.whole_value(F.col("identifier"), F.col("text")))
    return structure.first_seen(rows, ["offset", "e_ord"])

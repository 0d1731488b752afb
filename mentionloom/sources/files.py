"""Readers and writers: JSON lines of articles, ontology files, external dictionaries, response caches, progress.

Schemas are given, never inferred: empty lists and all-null notes would infer wrongly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<identifier:string,type:string,offset:int,length:int,text:string,note:string>"
ARTICLE = f"pmc_id string, pmid string, full_text array<struct<section_type:string,offset:int,text:string>>, patient array<struct<patient_id:string,mention:array<struct<text:string,offset:int,length:int>>>>, entities array<{ENTITY}>, association array<struct<patient_id:string,phenotype:array<string>>>"
SCORED = f"pmc_id string, pmid string, entities array<{ENTITY[:-1]},score:double>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """Articles of JSON lines; blank lines are skipped, a malformed line or non-object ends the read with an error.

    ``article_row`` keeps the order of delivery within a file.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)
    return rows.withColumn("article_row", F.monotonically_increasing_id())


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields kept; the committer renames finished files only."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, name, synonyms, parents, alt_ids, obsolete, replaced_by) of the [Term] stanzas of an ontology file.

    The file is cut at stanza headers while it is read, so stanzas spread over tasks. Tags after a blank line are not part
    of the stanza; synonym scopes are ignored; other stanzas and terms without an id are left out.
    """
    stanza = spark.read.option("lineSep", "\n[").text(path).filter(F.col("value").startswith("Term]"))
    body = F.split(F.regexp_replace("value", r"\r", ""), r"\n[ \t]*\n")[0]
    one = lambda tag: F.nullif(F.regexp_extract(body, rf"(?m)^{tag}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    synonyms = F.transform(every(r'(?m)^synonym:[ \t]*"((?:[^"\\]|\\.)*)"'), lambda s: F.regexp_replace(s, r"\\(.)", "$1"))
    return stanza.select(
        one("id").alias("identifier"),
        F.coalesce(one("name"), F.lit("")).alias("name"),
        synonyms.alias("synonyms"),
        every(r"(?m)^is_a:[ \t]*(\S+)").alias("parents"),
        every(r"(?m)^alt_id:[ \t]*(\S+)").alias("alt_ids"),
        (F.coalesce(one("is_obsolete"), F.lit("")) == "true").alias("obsolete"),
        one("replaced_by").alias("replaced_by"),
    ).filter("identifier is not null")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(alias, identifier) of a JSON object of lists; underscores are spaces; an unreadable dictionary is empty."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("alias", "ids"))
    return pairs.select(F.regexp_replace("alias", "_", " ").alias("alias"), F.explode("ids").alias("identifier")).filter("identifier is not null")


def pending(rows: DataFrame, done: DataFrame, key: str = "pmc_id") -> DataFrame:
    """The rows that a stopped run has not written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")

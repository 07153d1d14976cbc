"""Queries of the text-preparation operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.addresses import building_of
from planloom.llm.canonical import map_to_list
from planloom.llm.disciplines import discipline_names
from planloom.llm.plans_sql import p4_sql
from planloom.llm.mixing import Mixture, distinct_texts, mixture, mixture_report
from planloom.llm.organisations import organisation_of
from planloom.llm.packing import pack
from planloom.llm.pairs import class_pairs
from planloom.llm.pii import personal_spans
from planloom.llm.residue import residue_records
from planloom.llm.tokens import token_counts
from planloom.session import materialise, table


def record_values(spark: SparkSession, d: str, own: list[str], bid: list[str], part: str) -> DataFrame:
    """(key, value) of the record keys of some fields: of projects, of requirement, and of its consultants."""

    def fields(rows: DataFrame, start, names: list[str]) -> DataFrame:
        held = F.explode(F.array(*[F.struct(F.concat(start, F.lit(n)).alias("key"), F.col(n).alias("value")) for n in names]))
        return rows.select(held.alias("_f")).select("_f.*").where(F.col("value").isNotNull())

    requirement = table(spark, d, "requirement").select("doc_id", "consultants", *bid)
    projects = fields(table(spark, d, "projects").select("id", *own), F.concat(F.lit("projects/"), F.col("id"), F.lit("/")), own)
    bids = fields(requirement, F.concat(F.lit("requirement/"), F.col("doc_id"), F.lit("/")), bid)
    each = requirement.select("doc_id", F.posexplode("consultants").alias("_at", "_c")).select("doc_id", "_at", F.col(f"_c.{part}").alias(part))
    parts = fields(each, F.concat(F.lit("requirement/"), F.col("doc_id"), F.lit("/consultants/"), (F.col("_at") + 1).cast("string"), F.lit("/")), [part])
    return projects.unionByName(bids).unionByName(parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    named = record_values(spark, d, ["architect", "client"], ["provider_company"], "firm")
    return class_pairs(materialise(organisation_of(named, "key", "value"), "organisations"), "organisation")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "requirement").select("doc_id", F.posexplode("consultants").alias("_at", "_c"))
    typed = entries.select("doc_id", (F.col("_at") + 1).alias("consultant_no"), F.col("_c.discipline").alias("typed"))
    names = discipline_names(spark, table(spark, d, "discipline_ref"))
    return map_to_list(typed, "typed", names, "discipline_code", "discipline_name").select("doc_id", "consultant_no", "discipline_code")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    placed = record_values(spark, d, ["project_address"], ["site_address", "provider_address"], "address")
    return class_pairs(materialise(building_of(placed, "key", "value"), "buildings"), "building")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    requirement = table(spark, d, "requirement")
    fields = ("project_title", "client", "job_number")
    held = requirement.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("_f")).select("doc_id", "_f.*")
    # A field is the host of its values. Residue that spread over it is residue all the same.
    return residue_records(held, ["doc_id", "field_name"], "field_name", "text", spread=True)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers of every capacity: one row for each text or piece of a text."""
    sizes = materialise(token_counts(table(spark, d, "documents"), ["doc_id"], "text"), "token-counts")
    capacities = [(r["pack_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]
    packed = [pack(sizes, "doc_id", "n_tokens", c).select(F.lit(name).alias("pack_name"), "container_id", "doc_id", "piece_no", "start_token", "n_tokens") for name, c in capacities]
    return reduce(DataFrame.unionByName, packed)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: containers, texts, tokens and the share of the room used, for each capacity."""
    packed = p7_containers(spark, d)
    by = packed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sizes = table(spark, d, "pack_sizes")
    return by.join(F.broadcast(sizes), "pack_name").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def _mixture(spark: SparkSession, d: str, **how) -> Mixture:
    sized = materialise(token_counts(table(spark, d, "documents"), ["doc_id", "source", "text"], "text").withColumn("text", F.sha2("text", 256)), "token-counts")
    texts = distinct_texts(sized, "doc_id", "source", "text", "n_tokens")
    return mixture(texts, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"), **how)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row for each use of a text."""
    return _mixture(spark, d).uses


def _shares(spark: SparkSession, d: str, **how) -> DataFrame:
    mixed = _mixture(spark, d, **how)
    planned = F.create_map(*[x for s, w in mixed.weights.items() for x in (F.lit(s), F.lit(w))]) if mixed.weights else F.lit(None).cast("map<string,double>")
    report = mixture_report(mixed.uses, "source", "n_tokens", table(spark, d, "mix_targets"))
    return report.withColumn("planned_share", F.coalesce(F.try_element_at(planned, F.col("source")), F.lit(0.0))).withColumn("exponent", F.lit(mixed.exponent))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _shares(spark, d)


def p8_budget_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mixture as large as all texts once: the exponent is bisected down from the targets until the repetition limits hold."""
    return _shares(spark, d, passes_of_all=1.0)


def p8_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mixture tempered from the sources' sizes to nine tenths of the entropy of equal shares."""
    sources = table(spark, d, "mix_targets").count()
    return _shares(spark, d, least_entropy=0.9 * math.log(max(sources, 1)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").distinct()


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_budget_shares": p8_budget_shares, "p8_entropy_shares": p8_entropy_shares, "p9_found": p9_found}
SQL = {"p4_found": p4_sql()}

"""One query per llm operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.audit import audit_filters, audit_sql
from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.html import extract_text
from quillgraph.llm.lattice import near_vectors
from quillgraph.llm.licenses import scan_licenses
from quillgraph.llm.lines import dedup_lines, dedup_lines_sql
from quillgraph.llm.merkle import manifest, manifest_sql
from quillgraph.llm.minhash import near_duplicates
from quillgraph.llm.mixing import mix, mix_sql
from quillgraph.llm.pii import find_pii
from quillgraph.llm.substrings import dedup_substrings
from quillgraph.llm.toxicity import toxicity
from quillgraph.llm.urls import filter_urls, filter_urls_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op7_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lattice_near_dedup": op1_lattice_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_toxicity_machine": op7_toxicity_machine,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": mix_sql(),
    "op9_line_dedup": dedup_lines_sql(),
    "op10_url_filter": filter_urls_sql(),
    "op11_merkle_manifest": manifest_sql(),
    "op12_filter_audit": audit_sql(),
}

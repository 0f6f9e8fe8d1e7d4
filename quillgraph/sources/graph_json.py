"""The graph document: JSON with nodes and edges, read with explicit schemas and written as versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.graph import Graph

NODE = "struct<id:string,label:string,entity_type:string,domains:array<string>,identity:map<string,string>,provenance:struct<merged_into:string>>"
TRANSPARENCY = (
    "struct<verification_source:string,source_reference:string,citation_url:string,document_date:string,date_verified:string,active:boolean,tenure_start:string,tenure_end:string,"
    "role_title:string,percent_of_class:double,evidence_window:struct<first_filing:string,last_filing:string,filings_seen:long>>"
)
INTEGRITY = "struct<control_type:string,control_class:string,conflict_weight:double,verification_hash:string,superseded_by:string>"
EDGE = f"struct<edge_id:string,source:string,target:string,relationship_type:string,human_bridge:string,transparency:{TRANSPARENCY},integrity:{INTEGRITY}>"


#: Edges of a document, about: a reader holds a whole document, so their number grows with the graph, not their size.
DOCUMENT_EDGES = 20_000


def documents(edges: DataFrame, size: int = DOCUMENT_EDGES) -> DataFrame:
    """(shard, nodes, edges): a graph's edges dealt by their ids into documents of about ``size`` edges, at least sixteen. Nodes are empty."""
    shards = max(16, -(-edges.count() // size))
    dealt = edges.select(F.pmod(F.xxhash64("edge_id"), F.lit(shards)).alias("shard"), F.struct(*edges.columns).alias("e"))
    return dealt.groupBy("shard").agg(F.collect_list("e").alias("edges")).select("shard", F.array().cast("array<struct<id:string>>").alias("nodes"), "edges")


def read_graph(spark: SparkSession, path: str, as_of: str) -> Graph:
    """A graph from one JSON document. Dates that do not parse are null; the first filing falls back on the last."""
    doc = spark.read.schema(f"nodes array<{NODE}>, edges array<{EDGE}>").option("multiLine", True).json(path)
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode("edges").alias("e")).select("e.*")
    date = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    t = F.col("transparency")
    last = F.coalesce(date(t.evidence_window.last_filing), date(t.document_date))
    nodes = n.select("id", "label", "entity_type", "domains", F.lit(None).cast("int").alias("sic"), "identity", F.col("provenance.merged_into").alias("merged_into"))
    edges = e.select(
        "edge_id", "source", "target", "relationship_type", F.coalesce(date(t.tenure_start), date(t.evidence_window.first_filing), last).alias("first_filing"), last.alias("last_filing"),
        F.coalesce(t.evidence_window.filings_seen, F.lit(1)).alias("filings_seen"), t.percent_of_class.alias("percent"), F.col("integrity.conflict_weight").alias("weight"),
        t.active.alias("active"), F.col("integrity.superseded_by").alias("superseded_by"), t.citation_url.alias("citation_url"),
    )
    return Graph(nodes, edges, as_of)


def identities(nodes: DataFrame) -> DataFrame:
    """(scheme, value, id) of the nodes that are not merged into others."""
    return nodes.where(F.coalesce(F.col("merged_into"), F.lit("")) == "").select("id", F.explode("identity").alias("scheme", "value")).select("scheme", "value", "id")

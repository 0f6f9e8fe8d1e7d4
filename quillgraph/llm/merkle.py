"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, and a proof per row.

H is the lower-case hex SHA-256 of its inputs' concatenation, digests as hex text. A leaf is H of the row's columns, each
``-`` if null, else byte count, ``:`` and value. Leaves of a source ascend by doc_id; every three consecutive nodes become
their H until one remains, the subroot; subroots, ordered by source (null first), give the root in the same way.

Trees are cut into aligned blocks of ``3 ** height`` nodes, one group each. A block is walked in postorder by recursion:
it returns its digest and, unwinding, appends the siblings of each subtree to the leaves in it. Block digests are the nodes
of the next, distributed walk, until a source is one block; then the siblings go down again, block by block, next to the
rows. So no task holds more than a block and a path, however large a source is, and only digests move, never texts.
Numbers inside a source come from a range sort over (source, doc_id, leaf) and counts by range, so that one source may hold
all rows.

Odd input: a null doc_id comes first in its source and is never tampered with; rows sharing a doc_id are leaves of their own,
ordered by leaf (equal rows have equal leaves, in any order); null and empty sources are two sources; null and empty texts
have different leaves; an empty table gives no rows; columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.columns import at
from quillgraph.plans.ranks import numbered
from quillgraph.plans.staging import Staging

#: Nodes that become one; levels of a block, by default.
ARITY, HEIGHT = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
Path = list[tuple[str, str]]


def leaf_digest(values: dict[str, Column]) -> Column:
    """Lower-case hex SHA-256 of the columns, in the manifest's order."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (values[c].cast("string") for c in COLUMNS)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): digests of each row as it is, and as the tampering with half of the rows leaves it."""
    values = {c: at(docs, c) for c in COLUMNS}
    cut = values | {"text": F.translate(values["text"].cast("string"), "\n", "")}
    hit = F.coalesce(F.crc32(values["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(values["text"].cast("string"), F.lit("\n")), F.lit(False))
    out = docs.select(values["source"].cast("string").alias("source"), values["doc_id"].cast("long").alias("doc_id"), leaf_digest(values).alias("leaf"), F.when(hit, leaf_digest(cut)).alias("tampered"))
    return out.select("source", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered"))


def _numbered(rows: DataFrame, st: Staging) -> DataFrame:
    """(tree, idx, n, digest, doc_id, tampered): rows with their source's number, their own inside it, and its size."""
    order = ["source", "doc_id", "leaf"]
    # Equal rows may be many; the last column deals them out.
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order, "copy").drop("copy")
    parts = st.write(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    of = parts.groupBy(F.col("part").alias("p"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    trees = numbered(of.select("s").distinct(), "s", name="tree").select(F.col("s").alias("of"), (F.col("tree") - 1).alias("tree"))
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    of = of.select("p", "s", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("s")).alias("n"))
    of = st.write(of.join(trees, F.col("s").eqNullSafe(F.col("of"))).drop("of"), "offsets")
    inside = F.row_number().over(Window.partitionBy("part", "source").orderBy(*order)) - 1
    out = parts.withColumn("inside", inside).join(of, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return out.select("tree", (F.col("before") + F.col("inside")).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "tampered")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(n: int, most: int) -> int:
    """Levels of a block in a tree of n nodes: all of them, or as many as leave one node."""
    h = 0
    while h < most and ARITY**h < n:
        h += 1
    return h


def _walk(digests: list[str], n: int, most: int) -> tuple[str, list[Path]]:
    """Digest of a block and, for each of its nodes, (left, right) siblings level by level."""
    paths: list[Path] = [[] for _ in digests]

    def subtree(lo: int, hi: int, height: int) -> str:
        if height == 0:
            return digests[lo]
        step = ARITY ** (height - 1)
        firsts = range(lo, hi, step)
        below = [subtree(a, min(a + step, hi), height - 1) for a in firsts]
        for i, a in enumerate(firsts):
            siblings = "".join(below[:i]), "".join(below[i + 1 :])
            for path in paths[a : min(a + step, hi)]:
                path.append(siblings)
        return _h("".join(below))

    return subtree(0, len(digests), _height(n, most)), paths


def _block(rows: pa.Table) -> tuple[pa.Table, list[str], int]:
    rows = rows.sort_by("idx")
    return rows, [x.hex() for x in rows["digest"].to_pylist()], rows["n"][0].as_py()


def _digest_block(rows: pa.Table, height: int) -> pa.Table:
    rows, digests, n = _block(rows)
    top, _ = _walk(digests, n, height)
    return pa.table({"tree": rows["tree"][:1], "idx": rows["block"][:1], "n": pa.array([-(-n // ARITY**height)], pa.int64()), "digest": pa.array([bytes.fromhex(top)], pa.binary())})


def _places_block(rows: pa.Table, above: pa.Table, height: int, subroots: bool) -> pa.Table:
    rows, digests, n = _block(rows)
    _, paths = _walk(digests, n, height)
    up = list(zip(above["left"][0].as_py(), above["right"][0].as_py(), strict=True))
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    whole = [path + up for path in paths]
    return pa.table({
        "tree": rows["tree"], "block": rows["idx"], "left": pa.array([[a for a, _ in p] for p in whole], pa.list_(pa.string())), "right": pa.array([[b for _, b in p] for p in whole], pa.list_(pa.string())),
        "subroot": pa.array(digests if subroots else [subroot] * len(digests), pa.string()), "root": pa.array([root] * len(digests), pa.string()),
    })


def _fold(digest: str, path: Path) -> str:
    for left, right in path:
        digest = _h(left + digest + right)
    return digest


def _proofs_block(rows: pa.Table, above: pa.Table, height: int) -> pa.Table:
    rows, digests, n = _block(rows)
    _, paths = _walk(digests, n, height)
    up = list(zip(above["left"][0].as_py(), above["right"][0].as_py(), strict=True))
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    proofs, folded = [], []
    for digest, tampered, path in zip(digests, rows["tampered"].to_pylist(), paths, strict=True):
        path += up
        proofs.append(_h("".join(left + right for left, right in path)))
        folded.append(_fold(tampered.hex() if tampered is not None else digest, path))
    k = len(digests)
    return pa.table({
        "doc_id": rows["doc_id"], "leaf": pa.array(digests, pa.string()), "subroot": pa.array([subroot] * k, pa.string()), "root": pa.array([root] * k, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


NODE = "tree long, idx long, n long, digest binary"
PLACE = "tree long, block long, left array<string>, right array<string>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class _Trees:
    """Walks over trees of any size in blocks of ``3 ** height`` nodes."""

    def __init__(self, height: int, st: Staging):
        self.height, self.st = height, st

    def _blocks(self, nodes: DataFrame):
        return nodes.withColumn("block", F.floor(F.col("idx") / ARITY**self.height).cast("long")).groupBy("tree", "block")

    def climb(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes, the digests of their blocks, of the blocks of these, and so on; in the last each tree is one node."""
        levels, height = [nodes], self.height
        while True:
            levels.append(self.st.write(self._blocks(levels[-1]).applyInArrow(lambda rows: _digest_block(rows, height), NODE), "blocks"))
            if levels[-1].where("n > 1").isEmpty():
                return levels

    def _with(self, nodes: DataFrame, above: DataFrame, block, schema: str) -> DataFrame:
        height = self.height
        return self._blocks(nodes).cogroup(above.groupBy("tree", "block")).applyInArrow(lambda rows, up: block(rows, up, height), schema)

    def places(self, nodes: DataFrame, above: DataFrame, subroots: bool = False) -> DataFrame:
        """Siblings and roots of each node; ``subroots`` tells that the nodes are subroots."""
        return self.st.write(self._with(nodes, above, lambda rows, up, height: _places_block(rows, up, height, subroots), PLACE), "places")

    def descend(self, levels: list[DataFrame], above: DataFrame) -> DataFrame:
        """Siblings and roots of each block of the first of ``levels``, from those of whole trees."""
        for nodes in reversed(levels[1:-1]):
            above = self.places(nodes, above)
        return above

    def proofs(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        return self._with(nodes, above, _proofs_block, PROOF)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of ``docs``."""
    st = Staging(docs.sparkSession, "merkle")
    trees = _Trees(height, st)
    nodes = st.write(_numbered(leaves(docs), st), "nodes")
    sources = trees.climb(nodes)
    subroots = sources[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    subroots = st.write(subroots.withColumn("n", F.lit(subroots.count()).cast("long")).select("tree", "idx", "n", "digest"), "subroots")
    dataset = trees.climb(subroots)
    none = F.array().cast("array<string>")
    top = dataset[-1].select("tree", F.col("idx").alias("block"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    of_subroots = trees.places(subroots, trees.descend(dataset, top), subroots=True)
    # A subroot's number among the subroots is its tree, which is one block at the top.
    above = of_subroots.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "left", "right", "subroot", "root")
    return trees.proofs(nodes, trees.descend(sources, above))


def manifest_sql(docs: str = "documents", levels: int = 16) -> str:
    """DuckDB SQL for the same rows, for sources of up to 3 ** ``levels`` rows: all levels of the trees one after the other."""
    h = lambda text: " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in (*COLUMNS[:4], text))
    out = [f"""with recursive crc as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
d as (select row_number() over () as rid, doc_id, source, text, {h('text')} as t, {h("replace(text, chr(10), '')")} as cut,
        coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0, false) as hit from {docs}, crc),
leaf as (select rid, doc_id, coalesce('s' || source, '') as source, sha256(t) as leaf, case when hit then sha256(cut) else sha256(t) end as tampered from d),
l0 as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, source as tree from leaf),
s0 as (select source as tree, idx, leaf as digest from l0)"""]

    def climb(name: str) -> None:
        for k in range(levels):
            out.append(f"""{name}n{k} as (select *, count(*) over (partition by tree) as n from {name}{k}),
{name}{k + 1} as (select tree, idx // (case when n > 1 then 3 else 1 end) as idx, case when any_value(n) > 1 then sha256(string_agg(digest, '' order by idx)) else any_value(digest) end as digest
      from {name}n{k} group by tree, idx // (case when n > 1 then 3 else 1 end))""")

    climb("s")
    out.append(f"r0 as (select 0 as tree, row_number() over (order by tree) - 1 as idx, digest, tree as source from s{levels})")
    climb("r")
    out.append("p0 as (select rid, doc_id, leaf, tampered, source as tree, idx, '' as proof, tampered as folded from l0)")

    def path(name: str, first: str, last: str) -> None:
        before = first
        for k in range(levels):
            after = f"{name}p{k + 1}" if k < levels - 1 else last
            out.append(f"""{name}g{k} as (select tree, idx // 3 as up, list(digest order by idx) as g, any_value(n) as n from {name}n{k} group by tree, idx // 3),
{after} as (select p.* exclude (idx, proof, folded), case when n > 1 then p.idx // 3 else p.idx end as idx,
      case when n > 1 then proof || array_to_string(g[:p.idx % 3], '') || array_to_string(g[p.idx % 3 + 2:], '') else proof end as proof,
      case when n > 1 then sha256(array_to_string(g[:p.idx % 3], '') || folded || array_to_string(g[p.idx % 3 + 2:], '')) else folded end as folded
      from {before} p join {name}g{k} g on g.tree = p.tree and g.up = p.idx // 3)""")
            before = after

    path("s", "p0", "q0")
    out.append("q1 as (select q0.* exclude (tree, idx), 0 as tree, r0.idx, r0.digest as subroot from q0 join r0 on r0.source = q0.tree)")
    path("r", "q1", "z")
    out.append(f"top as (select digest as root from r{levels})")
    return ",\n".join(out) + "\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from z, top"

"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over their roots; a proof for each row that leads from its leaf to the root.

A leaf is the SHA-256, as lower-case hexadecimal text, of the row's fields with their byte counts. Nodes are hashes of the texts of one or two children, so a tree's shape
depends on the number of its leaves alone. Leaves are range-partitioned and numbered within their tree, and cut into aligned buckets of 2 ** LEVELS consecutive ones, each a
subtree whatever lies beside it. An executor's DuckDB turns a bucket, an Arrow table, into its levels by ordered string_agg and sha256. Spark takes the buckets' roots as the
leaves of the next round, until each tree has one node, and then joins proofs from the top down: a bucket's rows meet the one proof of their bucket's root. So a tree of any
size, even one with nearly all rows, is spread over buckets, a round holds about a thousandth of the one before, and a row's path is never written or shuffled.

Defined cases: null fields count as `-`; rows of null language have a tree of their own, the first; an empty text differs from a null one; within a language null ids come first,
and rows of equal ids lie in order of their leaves, so that a dataset's root doesn't depend on its files; repeated rows are leaves each; a tree of one leaf is that leaf; texts of
any length are hashed whole; an empty table gives an empty manifest; other columns play no part. Rows without an id are never taken as tampered.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, placed, scratch, small, written

#: Levels in a bucket; a full one has 2 ** LEVELS leaves.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sized(value: Column) -> Column:
    """A field as it is hashed: its number of bytes, a colon, and its text; `-` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(sized, fields)), 256)


def tree_name(lang: Column) -> Column:
    """A key that isn't null and sorts like the language, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (a written table; tree, ...) with i, the place in the tree by `order`, and m, the number of the tree's rows. No tree needs one task."""
    order = [F.col("tree"), *order]
    ordered = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered"
    )
    runs = ordered.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("skip"), F.sum("n").over(tree).alias("m"))
    # A row for each tree and each partition that it reaches.
    return ordered.join(small(written(runs, "runs")), ["tree", "part"]).withColumn("i", F.col("number") + F.col("skip")).drop("part", "number", "skip")


class BlockEngine:
    """The DuckDB of one Python worker: works on a bucket at a time, in memory, with one thread."""

    _engine: BlockEngine | None = None

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

    @classmethod
    def get(cls) -> BlockEngine:
        cls._engine = cls._engine or cls()
        return cls._engine

    def levels(self, bucket: pa.Table, most: int) -> int:
        """Tables level0, level1, ... (i, node) of a bucket (i, m, node) of `most` levels, up to its root; their number less one."""
        n = min(most, (bucket.column("m")[0].as_py() - 1).bit_length())
        self.db.register("bucket", bucket)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE level0 AS SELECT i % {1 << most} AS i, node FROM bucket")
        for k in range(1, n + 1):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE level{k} AS SELECT i // 2 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM level{k - 1} GROUP BY i // 2")
        return n

    def root(self, bucket: pa.Table, most: int = LEVELS) -> str:
        n = self.levels(bucket, most)
        return self.db.execute(f"SELECT node FROM level{n}").fetchall()[0][0]

    def with_path(self, bucket: pa.Table, most: int = LEVELS) -> pa.Table:
        """bucket with the siblings of each row's nodes before its path; null where a node has none."""
        n = self.levels(bucket, most)
        if not n:
            return bucket
        joins = " ".join(f"LEFT JOIN level{k} AS l{k} ON l{k}.i = xor((b.i % {1 << most}) >> {k}, 1)" for k in range(n))
        path = ", ".join(f"l{k}.node" for k in range(n))
        return self.db.sql(f"SELECT b.* REPLACE (list_concat([{path}], b.path) AS path) FROM bucket AS b {joins}").to_arrow_table().cast(bucket.schema)


def bucket_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, i, m, node of the next round: a node for each bucket of nodes (tree, i, m, node)."""

    def root(bucket: pa.Table) -> pa.Table:
        i, m = bucket.column("i")[0].as_py(), bucket.column("m")[0].as_py()
        return pa.table({"tree": [bucket.column("tree")[0].as_py()], "i": [i >> levels], "m": [-(-m >> levels)], "node": [BlockEngine.get().root(bucket, levels)]})

    many = nodes.select("tree", "i", "m", "node", F.shiftright("i", levels).alias("bucket"))
    # Trees of one node are done; they need no bucket.
    roots = many.where("m > 1").groupBy("tree", "bucket").applyInArrow(root, "tree string, i long, m long, node string")
    return roots.unionByName(many.where("m = 1").drop("bucket"))


def proven(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, i, m, node, ...) with the columns of their bucket's root in `above` (tree, i, path, ...), and path led down to them."""
    rows = nodes.withColumn("bucket", F.shiftright("i", levels)).join(above.withColumnRenamed("i", "bucket"), ["tree", "bucket"])
    many = rows.where("m > 1").groupBy("tree", "bucket").applyInArrow(lambda bucket: BlockEngine.get().with_path(bucket, levels), rows.schema)
    return many.unionByName(rows.where("m = 1")).drop("bucket")


def beside(above: DataFrame) -> DataFrame:
    """above (a written table), to be broadcast if it is small; otherwise rows are shuffled by their bucket, as their grouping needs anyway."""
    row = 64 * (len(above.columns) + 3 * LEVELS)
    return F.broadcast(above) if row * above.count() <= BROADCAST_BYTES else above


class Forest:
    """The trees of nodes (a written table: tree, i, m, node, ...), of which each round keeps the roots of the buckets before."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.rounds, self.levels = [nodes], levels
        while not self.rounds[-1].where("m > 1").isEmpty():
            self.rounds.append(written(bucket_roots(self.rounds[-1], levels), "nodes"))

    def roots(self) -> DataFrame:
        """tree, root."""
        return self.rounds[-1].select("tree", F.col("node").alias("root"))

    def proofs(self, known: DataFrame) -> DataFrame:
        """The nodes with path, the siblings up to their tree's root (null: none), and the columns that `known` has for their tree."""
        above = self.rounds[-1].select("tree", "i", F.array().cast("array<string>").alias("path")).join(known, "tree")
        if len(self.rounds) == 1:
            return self.rounds[0].join(beside(written(above.drop("i"), "above")), "tree")
        for nodes in self.rounds[-2:0:-1]:
            above = proven(nodes, beside(written(above, "above")), self.levels).drop("m", "node")
        return proven(self.rounds[0], beside(written(above, "above")), self.levels)


def steps(path: Column, i: Column) -> Column:
    """Of a path the steps: sibling, and whether it is on the left, which a bit of the place tells."""
    return F.transform(path, lambda s, k: F.struct(s.alias("sibling"), (F.call_function("shiftright", i, k).bitwiseAND(F.lit(1)) == 1).alias("left")))


def folded(node: Column, steps_: Column) -> Column:
    """The root to which a leaf's hash and the steps of its proof lead."""
    one = lambda at, s: F.sha2(F.when(s["sibling"].isNull(), at).when(s["left"], F.concat(s["sibling"], at)).otherwise(F.concat(at, s["sibling"])), 256)
    return F.aggregate(steps_, node, one)


def prove(leaves: DataFrame, order: list[Column], levels: int = LEVELS) -> DataFrame:
    """leaves (a written table: tree, node, ...) with subroot, root and steps. Equal rows of `order` must be equal in node."""
    inner = Forest(written(numbered(leaves, order), "leaves"), levels)
    outer = Forest(written(numbered(written(inner.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), "roots"), [F.col("name")]), "subroots"), levels)
    known = outer.proofs(outer.roots()).select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "root", steps(F.col("path"), F.col("i")).alias("outer"))
    rows = inner.proofs(written(known, "known"))
    return rows.withColumn("steps", F.concat(steps(F.col("path"), F.col("i")), "outer")).drop("tree", "i", "m", "path", "outer")


def leaves_of(docs: DataFrame, further: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> DataFrame:
    """tree, doc_id, node, file, at of docs (the columns in FIELDS), and further columns made of the fields."""
    fields = {f: F.col("row").getField(f) for f in FIELDS}
    made = {name: make(fields) for name, make in (further or {}).items()}
    return placed(docs).select(tree_name(fields["lang"]).alias("tree"), fields["doc_id"].alias("doc_id"), leaf(list(fields.values())).alias("node"), "file", "at", *(c.alias(name) for name, c in made.items()))


#: Rows of a language in order: the place in storage only deals out rows that are equal in all else.
ORDER = ("doc_id", "node", "file", "at")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (sibling, left) of every row of docs."""
    with scratch(docs.sparkSession):
        found = prove(written(leaves_of(docs), "hashes"), [F.col(c) for c in ORDER], levels)
        return written(found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "steps"), "manifest", keep=True)


def tampered_leaf(fields: dict[str, Column]) -> Column:
    """The leaf with n_chars one higher, where 7 divides the crc32 of the id; null elsewhere."""
    doc_id, n_chars = fields["doc_id"], fields["n_chars"]
    chosen = doc_id.isNotNull() & n_chars.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0)
    more = {**fields, "n_chars": n_chars.cast("decimal(20,0)") + 1}
    return F.when(chosen, leaf(list(more.values())))


def verify_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs, some of which are tampered with after the proofs are made."""
    with scratch(docs.sparkSession):
        found = prove(written(leaves_of(docs, {"changed": tampered_leaf}), "hashes"), [F.col(c) for c in ORDER], levels)
        told = found.select(
            "doc_id",
            F.col("node").alias("leaf"),
            "subroot",
            "root",
            F.sha2(F.array_join(F.transform("steps", lambda s: s["sibling"]), ""), 256).alias("proof_sha256"),
            folded(F.coalesce("changed", "node"), F.col("steps")).alias("folded_root"),
        )
        return written(told.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs", keep=True)


MERKLE_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, lang, n_chars,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, i, m, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE m > 1 GROUP BY lang, level, i // 2, m
), subroots AS (
  SELECT lang, level AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM nodes WHERE m = 1
), outer_nodes AS (
  SELECT 0 AS level, i, m, node FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM outer_nodes WHERE m > 1 GROUP BY level, i // 2, m
), climbed AS (
  SELECT p.lang, p.i AS id, p.doc_id, p.leaf, coalesce(p.changed, p.leaf) AS now, '' AS proof, 0 AS level, p.i, p.m FROM placed p
  UNION ALL
  SELECT c.lang, c.id, c.doc_id, c.leaf, sha256(CASE WHEN c.i % 2 = 1 THEN s.node || c.now ELSE c.now || coalesce(s.node, '') END), c.proof || coalesce(s.node, ''), c.level + 1, c.i // 2, (c.m + 1) // 2
  FROM climbed c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.m > 1
), topped AS (
  SELECT c.lang, c.id, c.doc_id, c.leaf, r.node AS subroot, c.now, c.proof, 0 AS level, r.i, r.m FROM climbed c JOIN subroots r ON r.lang IS NOT DISTINCT FROM c.lang AND c.m = 1
  UNION ALL
  SELECT c.lang, c.id, c.doc_id, c.leaf, c.subroot, sha256(CASE WHEN c.i % 2 = 1 THEN s.node || c.now ELSE c.now || coalesce(s.node, '') END), c.proof || coalesce(s.node, ''), c.level + 1, c.i // 2, (c.m + 1) // 2
  FROM topped c LEFT JOIN outer_nodes s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.m > 1
)
SELECT doc_id, leaf, subroot, o.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = o.node AS verified
FROM topped t JOIN outer_nodes o ON t.m = 1 AND o.m = 1
"""

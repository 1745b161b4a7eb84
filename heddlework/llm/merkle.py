"""A Merkle manifest of a dataset: one tree for each group, one over the groups, and a proof for each row.

A leaf is the SHA-256 of the row's fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and the
value. In each group leaves ascend by key (null first, ties by digest); while a tree has several nodes,
every ``fan`` consecutive ones (the last run may have fewer, even one) become the SHA-256 of their
concatenated hex digests. What remains is the group's subroot, which may be a lone leaf. Subroots, by
group (null first, UTF-8 bytewise), make the root in the same way.

Trees are built bottom-up in blocks of ``fan ** SPAN`` nodes, so a task never holds more than a block, and a
group with a third of all rows is as many blocks as it needs. Proofs come from pointer jumping: each
node holds the siblings on the way to an ancestor, at first its parent; joined to itself, the table gets
the ancestor's ancestor and both segments, so the distance doubles each time until all point to the root.
Only inner nodes jump; a leaf takes its siblings and its parent's segment in one last join.

Nulls in any column are defined by the encoding. Rows that are equal in all fields have equal leaves, and
stand beside each other. Texts of any length are hashed in place and not shuffled. A table without rows
has no root and no rows in the manifest. Columns that are no fields are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import cut, join_by_source, table

FAN = 3
#: Levels that are built in one shuffle.
SPAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

KEY = ["tree", "level", "idx"]
POINTER = ["to_tree", "to_level", "to_idx"]
#: The tree over the subroots; the others have the numbers of their groups.
TOP = -1


def hashed(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(digests: Column) -> Column:
    """Digests one after the other as lower-case hex text."""
    return F.lower(F.hex(digests))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    encoded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return hashed(F.concat(*encoded))


def joined(digests: Column) -> Column:
    """An array of digests as one binary value."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def height(n: Column, fan: int) -> Column:
    """Levels above n leaves."""
    powers = [fan**k for k in range(64) if fan**k < 2**62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def _above(nodes: Column, fan: int) -> Column:
    """The nodes over an array of nodes: digest and children."""

    def node(i: Column) -> Column:
        children = joined(F.transform(F.slice(nodes, i * fan + 1, fan), lambda x: x["digest"]))
        return F.struct(hashed(hexed(children)).alias("digest"), children.alias("children"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int")), node)


def _described(nodes: Column, first: Column, level: int, fan: int) -> Column:
    """Nodes of one level with what stands left and right of them below the same parent."""

    def node(x: Column, i: Column) -> Column:
        run = F.floor(i / fan).cast("int") * fan
        own = lambda begin, n: joined(F.transform(F.slice(nodes, begin, n), lambda y: y["digest"]))
        return F.struct(F.lit(level).alias("level"), (first + i).alias("idx"), x["digest"].alias("digest"), x["children"].alias("children"), own(run + 1, i - run).alias("left"), own(i + 2, run + fan - 1 - i).alias("right"))

    return F.transform(nodes, node)


def climbed(leaves: DataFrame, top: int, fan: int) -> list[DataFrame]:
    """All nodes over leaves (tree, top, idx, digest, children), from level 0 to each tree's top: tree, top, level, idx, digest, children, left, right.

    A tree's blocks of fan ** SPAN nodes are one group each; what a block makes is the next round's input.
    """
    done, now = [], leaves
    for base in range(0, max(top, 1), SPAN):
        block = F.floor(F.col("idx") / fan**SPAN)
        rows = now.groupBy("tree", "top", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "children"))).alias("n0"))
        rows = rows.withColumn("n0", F.transform("n0", lambda x: F.struct(x["digest"].alias("digest"), x["children"].alias("children"))))
        for j in range(1, SPAN + 1):
            rows = rows.withColumn(f"n{j}", _above(F.col(f"n{j - 1}"), fan))
        all_levels = F.flatten(F.array(*(_described(F.col(f"n{j}"), F.col("block") * fan ** (SPAN - j), base + j, fan) for j in range(SPAN + 1))))
        made = cut(rows.select("tree", "top", F.inline(F.filter(all_levels, lambda x: x["level"] <= F.col("top")))), "nodes")
        last = base + SPAN
        done.append(made.filter((F.col("level") < last) | (F.col("level") == F.col("top"))))
        now = made.filter((F.col("level") == last) & (F.col("top") > last)).select("tree", "top", "idx", "digest", "children")
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jumped(nodes: DataFrame, root: tuple[int, int, int], rounds: int) -> DataFrame:
    """Nodes with ``steps`` to the root, from nodes with steps to their parents (KEY, POINTER, steps).

    In round r a node of a group's tree points 2 ** r levels up, so only nodes as far up are pointed to.
    """
    here = F.struct(*POINTER) == F.struct(*(F.lit(x).cast(t).alias(n) for x, t, n in zip(root, ("long", "int", "long"), POINTER, strict=True)))
    for r in range(rounds):
        far = nodes.filter((F.col("tree") == TOP) | (F.col("level") > 2**r)).select(*(F.col(c).alias(f"at_{c}") for c in KEY), *(F.col(c).alias(f"far_{c}") for c in [*POINTER, "steps"]))
        on = [F.col(a) == F.col(f"at_{b}") for a, b in zip(POINTER, KEY, strict=True)]
        moved = nodes.filter(~here).join(far, on).select(*KEY, *(F.col(f"far_{c}").alias(c) for c in POINTER), "children", F.concat("steps", "far_steps").alias("steps"))
        nodes = cut(nodes.filter(here).select(*KEY, *POINTER, "children", "steps").unionByName(moved), "jumped")
    return nodes


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, fan: int = FAN, altered: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: key, group, leaf, subroot, root (binary digests) and proof, the siblings (left, right) on the way to the root.

    With ``altered`` (columns by field, made from the row alone) there is also the leaf of the row so changed, as ``other``.
    """
    kinds = dict(df.dtypes)
    changed = leaf(*((altered or {}).get(f, F.col(f"`{f}`")) for f in fields)) if altered else F.lit(None).cast("binary")
    leaves = cut(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), leaf(*(F.col(f"`{f}`") for f in fields)).alias("digest"), changed.alias("other")), "leaves")

    groups = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    groups = ranked(groups, F.asc_nulls_first("group"), name="tree", total="n", running="_upto")
    groups = cut(groups.select("group", F.col("tree").cast("long").alias("tree"), (F.col("_upto") - F.col("n")).alias("_first"), height(F.col("n"), fan).alias("top")), "groups")
    n, highest = groups.agg(F.count(F.lit(1)), F.max("top")).first()
    columns = ["key", "group", "leaf", "other", "subroot", "root", "proof"]
    if not n:
        return df.sparkSession.createDataFrame([], f"key {kinds[key]}, group {kinds[group]}, leaf binary, other binary, subroot binary, root binary, proof array<struct<left:binary,right:binary>>").select(*columns)

    leaves = ranked(join_by_source(leaves, groups, "group"), F.col("tree"), F.asc_nulls_first("key"), F.col("digest"), name="_place")
    leaves = cut(leaves.withColumn("idx", F.col("_place") - F.col("_first")).drop("_place", "_first"), "ranked-leaves")

    plain = leaves.select("tree", "top", "idx", "digest", F.lit(None).cast("binary").alias("children"))
    inner = climbed(plain.filter("top > 0"), highest, fan) if highest else []
    lone = plain.filter("top = 0")
    subroots = cut(_union([lone, *(x.filter("level = top").select(*lone.columns) for x in inner)]), "subroots")
    over = max(0, next(k for k in range(64) if fan**k >= n))
    above = climbed(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(over).alias("top"), F.col("tree").alias("idx"), "digest", "children"), over, fan)

    # The top of a group's tree is level 0 of the tree over the groups.
    nodes = _union([*(x.filter("level > 0 AND level < top") for x in inner), *above])
    ends = (F.col("level") + 1 == F.col("top")) & (F.col("tree") != TOP)
    is_root = (F.col("tree") == TOP) & (F.col("level") == over)
    steps = F.when(is_root, F.array().cast("array<struct<left:binary,right:binary>>")).otherwise(F.array(F.struct("left", "right")))
    nodes = nodes.select(
        *KEY, F.when(ends, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("to_tree"), F.when(ends, 0).when(is_root, F.col("level")).otherwise(F.col("level") + 1).cast("int").alias("to_level"),
        F.when(ends, F.col("tree")).otherwise(F.floor(F.col("idx") / F.when(is_root, 1).otherwise(fan))).cast("long").alias("to_idx"), "children", steps.alias("steps"),
    )
    root = above[-1].filter(F.col("level") == over).select("digest").first()[0]
    nodes = jumped(cut(nodes, "segments"), (TOP, over, 0), max(0, highest - 1 + over - 1).bit_length())

    own = join_by_source(leaves, subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    low = F.col("top") <= 1
    own = own.withColumn("at_tree", F.when(low, F.lit(TOP).cast("long")).otherwise(F.col("tree"))).withColumn("at_level", F.when(low, 0).otherwise(1)).withColumn("at_idx", F.when(low, F.col("tree")).otherwise(F.floor(F.col("idx") / fan)))
    nodes = nodes.select(*(F.col(c).alias(f"_{c}") for c in KEY), "children", "steps")
    out = own.join(nodes, [F.col(f"at_{c}") == F.col(f"_{c}") for c in KEY])
    before = (F.col("idx") % fan).cast("int") * 32
    mine = F.struct(F.substring("children", F.lit(1), before).alias("left"), F.substring("children", before + 33, F.lit(32 * fan)).alias("right"))
    proof = F.when(F.col("top") == 0, F.col("steps")).otherwise(F.concat(F.array(mine), F.col("steps")))
    return out.select("key", "group", F.col("digest").alias("leaf"), "other", "subroot", F.lit(bytes(root)).alias("root"), proof.alias("proof"))


def siblings(proof: Column) -> Column:
    """A proof's digests one after the other."""
    return joined(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, digest, lambda a, s: hashed(hexed(F.concat(s["left"], a, s["right"]))))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what folding makes of rows of which half have their line ends deleted."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = manifest(docs, altered={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    out = out.withColumn("_folded", folded(F.col("other"), F.col("proof")))
    digests = [hexed(F.col(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return out.select(F.col("key").alias("doc_id"), *digests, F.sha2(hexed(siblings(F.col("proof"))), 256).alias("proof_sha256"), hexed(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"))


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_ENCODED = " || ".join(_field(f) for f in FIELDS)

#: The CRC of an id is the sum over its bytes of what each one contributes at its distance from the end.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT n::BIGINT AS byte, n::BIGINT AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT byte, c FROM steps WHERE k = 8),
shifts AS (SELECT byte, c AS v, 0 AS d FROM crc_table UNION ALL SELECT s.byte, xor(s.v >> 8, t.c), s.d + 1 FROM shifts s JOIN crc_table t ON t.byte = s.v & 255 WHERE s.d < 20),
begun AS (SELECT 4294967295::BIGINT AS v, 0 AS d UNION ALL SELECT xor(s.v >> 8, t.c), s.d + 1 FROM begun s JOIN crc_table t ON t.byte = s.v & 255 WHERE s.d < 20),
ids AS (SELECT doc_id, hex(encode(doc_id::VARCHAR)) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
id_bytes AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i, h FROM ids),
crcs AS (SELECT doc_id, xor(xor(bit_xor(s.v), any_value(b.v)), 4294967295) AS crc
  FROM id_bytes JOIN shifts s ON s.byte = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AND s.d = n - 1 - i JOIN begun b ON b.d = n GROUP BY doc_id),
tampered AS (SELECT doc_id, source, sha256({_ENCODED}) AS leaf, sha256({_ENCODED.replace(_field("text"), "coalesce(strlen(changed) || ':' || changed, '-')")}) AS other
  FROM (SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents d LEFT JOIN crcs USING (doc_id))),
leaves AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row FROM tampered),
nodes AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, level + 1, idx // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {FAN - 1}) // {FAN} FROM nodes WHERE n > 1 GROUP BY tree, level, idx // {FAN}, n),
known AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT tree, digest FROM known WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, idx // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {FAN - 1}) // {FAN} FROM tops WHERE n > 1 GROUP BY level, idx // {FAN}, n),
every AS MATERIALIZED (SELECT * FROM known UNION ALL SELECT -1, level, idx, digest, n FROM tops),
runs AS MATERIALIZED (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // {FAN} = b.idx // {FAN} WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx),
climbs AS (SELECT row, tree AS own, tree, 0 AS level, idx, n, other AS folded, '' AS proof FROM leaves
  UNION ALL SELECT row, own, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN c.n = 1 THEN c.tree ELSE c.idx // {FAN} END,
    CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + {FAN - 1}) // {FAN} END,
    CASE WHEN c.n = 1 THEN folded ELSE sha256(r.l || folded || r.r) END, CASE WHEN c.n = 1 THEN proof ELSE proof || r.l || r.r END
  FROM climbs c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.idx = c.idx WHERE c.n > 1 OR c.tree >= 0),
ended AS (SELECT * FROM climbs WHERE tree = -1 AND n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = t.digest AS verified
FROM leaves l JOIN ended e USING (row) JOIN subroots s ON s.tree = l.tree CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""

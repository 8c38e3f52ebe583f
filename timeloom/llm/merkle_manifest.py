"""Merkle manifests of a dataset: a digest of each row, a tree over each group, a tree over the groups, and a proof a row.

Rows of a group are numbered in order, and ``arity`` consecutive nodes of a level become one of the next. Each level is one
equijoin of its nodes with themselves on computed indices: a node looks its siblings up (its index XOR 1 in a binary tree,
else all slots of its run by their offsets), so that it knows what stands left and right of it, and the nodes of slot zero
emit the parents. Numbers come from a sort by ranges: places in a range and one row of counts a range and group, so that no
group passes through one task, however large. What a level found is written before the next; levels shrink by ``arity``.

Proofs go the other way: from the root down, each level puts its siblings before those of its parent, and rows fold theirs.

Defined results: null fields are digested as ``-``, so a null and an empty text differ; null keys come first in their group and
null groups first among the groups; repeated rows are leaves of their own, in any order among each other; an empty table gives
empty tables; other columns are neither read nor digested; texts of any length are digested whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm._shared import cut, discard

#: The fields of a document, in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def digest(*parts: Column) -> Column:
    """The digest of digests (bytes, or several of them one after another), taken as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def group_key(value: Column) -> Column:
    """A group's name as a key without nulls, which sorts null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the place in the group by ``order`` from 0, and ``n``, the rows of the group; written to the shared folder."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33).alias("_part")
    # one row a range and group; a range holds many rows
    counts = placed.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before, all_of = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    counts = counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(all_of).alias("n"))
    made = placed.withColumn("_part", part).join(counts, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    made = cut(made.drop("_part", "_at", "_shift"), "merkle-nodes")
    discard(placed)
    return made


def siblings(nodes: DataFrame, group: str, arity: int) -> DataFrame:
    """Each node (``group, idx, n, digest``) with what stands ``left`` and ``right`` of it in its run, as concatenated digests."""
    if arity == 2:
        near = F.array(F.col("idx"), F.col("idx").bitwiseXOR(F.lit(1)))
    else:
        slot = F.col("idx") % arity
        near = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: F.col("idx") - slot + (slot + k) % arity)
    asked = nodes.select(group, F.col("idx").alias("own"), F.explode(F.filter(near, lambda i: i < F.col("n"))).alias("idx"), "n")
    met = asked.join(nodes.select(group, "idx", "digest"), [group, "idx"])
    runs = met.groupBy(group, F.col("own").alias("idx")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    side = lambda keep: F.aggregate(F.filter("run", lambda x: keep(x["idx"])), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
    own = F.filter("run", lambda x: x["idx"] == F.col("idx"))[0]["digest"]
    return runs.select(group, "idx", "n", own.alias("digest"), side(lambda i: i < F.col("idx")).alias("left"), side(lambda i: i > F.col("idx")).alias("right"))


def parents(level: DataFrame, group: str, arity: int) -> DataFrame:
    """The nodes above a level of ``siblings``: those of slot zero emit the digest of their run."""
    up = lambda c: F.expr(f"({c} + {arity - 1}) div {arity}")
    return level.filter(F.col("idx") % arity == 0).select(group, F.expr(f"idx div {arity}").alias("idx"), up("n").alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))


@dataclass
class Tree:
    """Trees of all groups: ``levels[k]`` holds the nodes of height k whose group has more than one there; ``roots`` one row a group."""

    group: str
    arity: int
    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """``group, idx, path``: for each leaf its siblings up to the root of its group, then those of ``above`` (``group, path``)."""
        empty = F.array().cast("array<struct<left:binary,right:binary>>")
        tops = self.roots.select(self.group, "height", empty.alias("path")) if above is None else self.roots.select(self.group, "height").join(above, self.group)
        own = lambda k: tops.filter(F.col("height") == k).select(self.group, F.lit(0).cast("long").alias("idx"), "path")
        made, tables = own(len(self.levels)), []
        for k in range(len(self.levels) - 1, -1, -1):
            step = self.levels[k].select(self.group, "idx", F.array(F.struct("left", "right")).alias("step"), F.expr(f"idx div {self.arity}").alias("up"))
            joined = step.join(made.select(self.group, F.col("idx").alias("up"), "path"), [self.group, "up"])
            made = joined.select(self.group, "idx", F.concat("step", "path").alias("path")).unionByName(own(k))
            if k:
                tables.append(made := cut(made, "merkle-paths"))
        self.used = tables
        return made


def tree(nodes: DataFrame, group: str, arity: int) -> Tree:
    """Trees over ``nodes`` (``group, idx, n, digest``)."""
    found, height, roots = Tree(group, arity), 0, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1").select(group, F.lit(height).alias("height"), "digest"))
        if most <= 1:
            break
        level = cut(siblings(nodes.filter("n > 1").select(group, "idx", "n", "digest"), group, arity), f"merkle-level{height}")
        found.levels.append(level)
        nodes, height, most = parents(level, group, arity), height + 1, -(-most // arity)
    found.roots = roots[0]
    for more in roots[1:]:
        found.roots = found.roots.unionByName(more)
    found.roots = cut(found.roots, "merkle-roots")
    return found


def folded(own: Column, path: str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, own, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(rows: DataFrame, key: str, group: Column, own: Column, *keep: Column, arity: int = 8) -> DataFrame:
    """``key``, the columns ``keep``, and of each row ``leaf, subroot, root`` (bytes) and ``path`` (its siblings, from the leaf to the root).

    ``own`` is the digest of a row (``leaf``); rows of a group are ordered by ``key``, equal ones by their digests.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    made = cut(rows.select(F.col(key).alias("_key"), group_key(group).alias("_group"), own.alias("digest"), *[c.alias(n) for c, n in zip(keep, names)]), "merkle-leaves")
    leaves = numbered(made, "_group", ["_key", "digest", *names])
    lower = tree(leaves, "_group", arity)
    tops = numbered(lower.roots.select(F.lit(0).alias("_all"), "_group", F.col("digest")), "_all", ["_group"])
    upper = tree(tops, "_all", arity)
    named = tops.select("_group", "idx", F.col("digest").alias("subroot")).join(upper.paths().select("idx", "path"), "idx").select("_group", "subroot", "path")
    root = upper.roots.select("digest").first()
    above = cut(named.withColumn("root", F.lit(bytes(root[0]) if root else None).cast("binary")), "merkle-subroots")
    paths = lower.paths(above.select("_group", "path"))
    found = leaves.join(paths, ["_group", "idx"]).join(above.select("_group", "subroot", "root"), "_group")
    return found.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", *names)


def audit(docs: DataFrame, arity: int = 8) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of all documents, in trees of ``lang``.

    The texts of those whose id's CRC-32 is divisible by 3 are lower-cased (A-Z) as a tampering; ``folded_root`` is what the row then
    gives with the original siblings, and ``verified`` whether that is still the root. Every row is folded, tampered or not.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.col(c) for c in FIELDS]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tampered = F.when(touched & F.col("text").rlike("[A-Z]"), leaf(*fields[:-1], F.translate("text", upper, upper.lower())))
    made = manifest(docs, "doc_id", F.col("lang"), leaf(*fields), tampered, arity=arity)
    proof = F.sha2(F.lower(F.hex(F.aggregate("path", F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"])))), 256)
    again = folded(F.coalesce("_k0", "leaf"))
    made = made.select("doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"), proof.alias("proof_sha256"), as_text(again).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in SQL; the CRC-32 goes through a table that the rule of its polynomial fills.
SQL = r"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
 text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS touched FROM documents, crc),
h AS MATERIALIZED (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
 CASE WHEN touched AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered FROM d),
leaves AS MATERIALIZED (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
lower_tree AS (SELECT g, 0 AS lvl, idx, n, leaf AS dg FROM leaves UNION ALL SELECT g, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(dg, '' ORDER BY idx)) FROM lower_tree WHERE n > 1 GROUP BY g, lvl, idx // 8, n),
lows AS MATERIALIZED (SELECT * FROM lower_tree),
subs AS MATERIALIZED (SELECT g, dg AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM lows WHERE n = 1),
upper_tree AS (SELECT 0 AS lvl, idx, n, subroot AS dg FROM subs UNION ALL SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(dg, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 8, n),
ups AS MATERIALIZED (SELECT * FROM upper_tree),
sib_low AS MATERIALIZED (SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.dg, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.dg, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r FROM lows a JOIN lows b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.idx),
sib_up AS MATERIALIZED (SELECT a.lvl, a.idx, coalesce(string_agg(b.dg, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.dg, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r FROM ups a JOIN ups b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
steps AS MATERIALIZED (SELECT v.g, v.idx, s.lvl, s.l, s.r FROM leaves v JOIN sib_low s ON s.g = v.g AND s.idx = v.idx // CAST(pow(8, s.lvl) AS BIGINT)
 UNION ALL SELECT v.g, v.idx, 1000 + s.lvl, s.l, s.r FROM leaves v JOIN subs t ON t.g = v.g JOIN sib_up s ON s.idx = t.idx // CAST(pow(8, s.lvl) AS BIGINT)),
path AS MATERIALIZED (SELECT g, idx, list({'l': l, 'r': r} ORDER BY lvl) AS p FROM steps GROUP BY g, idx),
fold AS (SELECT v.g, v.idx, coalesce(v.tampered, v.leaf) AS dg, coalesce(p.p, []) AS p, 1 AS step FROM leaves v LEFT JOIN path p ON p.g = v.g AND p.idx = v.idx
 UNION ALL SELECT g, idx, sha256(p[step].l || dg || p[step].r), p, step + 1 FROM fold WHERE step <= len(p))
SELECT v.doc_id, v.leaf, t.subroot, u.dg AS root, sha256(coalesce(list_aggregate(list_transform(f.p, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256, f.dg AS folded_root, f.dg = u.dg AS verified
FROM leaves v JOIN subs t ON t.g = v.g JOIN ups u ON u.n = 1 JOIN fold f ON f.g = v.g AND f.idx = v.idx AND f.step = len(f.p) + 1
"""

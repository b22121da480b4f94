"""A Merkle manifest of a dataset, kept as Parquet node tables of one level each.

Every row is a leaf; the leaves of a group rise by id, and every eight
consecutive nodes become one, level by level, until one is left: the group's
subroot. The subroots, by group, are the leaves of one more such tree, whose
last node is the root.

Texts are hashed where they are read, and only digests move. The leaves are
sorted once into runs over all tasks and numbered by the runs' sizes, so that a
group that holds most rows is spread like any other. Each level is made from
the files of the level below, dealt by ranges of (group, place) and read in
that order, and keeps the digests of the nodes it was made from. A coordinate
of a node is (group, place); the coordinate of its parent is (group, place / 8).
Proofs come down from the root: paths of a level are merged by coordinate with
the nodes of that level, and each hands its own on to the eight below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import crc_mod, dropped, stored, table

ARITY = 8
#: Rows of a table of runs or of groups that is broadcast (some 50 bytes each); a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256 of a text."""
    return F.sha2(value.cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, counted: no two rows of values give the same text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(framed, values)))


def group_key(group: Column) -> Column:
    """A text for any group that sorts like it: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _text(b: Column) -> Column:
    return F.lower(F.hex(b))


def _joined(kids: Column) -> Column:
    """The digests of some nodes, one after the other."""
    return F.aggregate(kids, F.lit(b""), lambda a, x: F.concat(a, x["digest"]))


@dataclass
class Tree:
    """``levels[0]`` holds leaves (grp, at, n, digest, id, presented), each further level (grp, at, n, digest, kids).

    ``n`` is the number of leaves of the node's group. A group has nodes up to
    the first level at which it has one.
    """

    levels: list[DataFrame] = field(default_factory=list)

    def tops(self, k: int) -> DataFrame:
        """The nodes of a level that are the last of their groups."""
        d = self.levels[k].where(F.col("n") <= ARITY**k)
        return d.where(F.col("n") > ARITY ** (k - 1)) if k else d


@dataclass
class Manifest:
    """Trees of the groups and the tree over their subroots; ``root`` is None if there are no rows."""

    groups: Tree
    top: Tree
    root: str | None


def _small(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def _numbered(leaves: DataFrame) -> DataFrame:
    """(grp, at, n, digest, id, presented): places of leaves in their groups, by runs that together are sorted."""
    order = ["grp", "id", "digest"]
    runs = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id())
    runs = stored(runs, "merkle-runs").withColumn("run", F.shiftright("no", 33))
    sizes = runs.groupBy("run", "grp").agg(F.count(F.lit(1)).alias("m"), F.min("no").alias("first"))
    # A row for each run that a group has leaves in.
    before = W.partitionBy("grp").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("run", "grp", "first", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(W.partitionBy("grp")).alias("n"))
    sizes = stored(sizes, "merkle-run-sizes")
    d = runs.join(_small(sizes), ["run", "grp"])
    return d.select("grp", (F.col("base") + F.col("no") - F.col("first")).alias("at"), "n", "digest", "id", "presented")


def tree(leaves: DataFrame) -> Tree:
    """All levels over leaves (grp, id, digest binary, presented binary), each a table in the shared folder.

    Within a group leaves rise by id (null first), those of one id by digest.
    """
    out = Tree([stored(_numbered(leaves), "merkle-level-0")])
    most = out.levels[0].agg(F.max("n")).first()[0] or 0
    while most > ARITY ** (len(out.levels) - 1):
        k = len(out.levels) - 1
        below = out.levels[k].where(F.col("n") > ARITY**k)
        kid = F.struct("at", "digest", *([F.col("id"), F.col("presented")] if k == 0 else []))
        # Dealt by ranges, so that the level's files are in order and a group's nodes are in many tasks.
        runs = below.withColumn("up", F.floor(F.col("at") / ARITY)).repartitionByRange("grp", "up").groupBy("grp", "up").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        nodes = runs.select("grp", F.col("up").alias("at"), "n", F.unhex(digest(_text(_joined(F.col("kids"))))).alias("digest"), "kids")
        out.levels.append(stored(nodes.sortWithinPartitions("grp", "at"), f"merkle-level-{k + 1}"))
    return out


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over leaves (grp, id, digest, presented) and over their groups' subroots.

    No rows give a manifest without a root; one leaf is subroot and root itself.
    """
    groups = tree(leaves)
    tops = reduce(DataFrame.unionByName, [groups.tops(k).select("grp", "digest") for k in range(len(groups.levels))])
    top = tree(tops.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest", F.lit(None).cast("binary").alias("presented")))
    root = top.tops(len(top.levels) - 1).select(_text(F.col("digest"))).first()
    return Manifest(groups, top, root[0] if root else None)


_PATH = "array<struct<l: binary, r: binary>>"


def _below(nodes: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
    """Paths of the nodes that a level was made from: siblings to the left and right of each, then its parent's path."""
    d = nodes.select("grp", "at", "kids").join(paths, ["grp", "at"])
    d = d.select("grp", "path", *keep, "kids", F.posexplode("kids").alias("i", "kid"))
    side = F.struct(_joined(F.slice("kids", F.lit(1), F.col("i"))).alias("l"), _joined(F.slice("kids", F.col("i") + 2, F.lit(ARITY))).alias("r"))
    return d.select("grp", F.col("kid.at").alias("at"), F.concat(F.array(side), "path").alias("path"), *keep, "kid")


def _descended(t: Tree, above: DataFrame, keep: list[str]) -> DataFrame:
    """(grp, id, digest, presented, path) of all leaves; ``above`` has the path of each group's last node, and columns to keep."""
    old: list[DataFrame] = []
    starts = [t.tops(k).select("grp", "at").join(above, "grp") for k in range(len(t.levels))]
    paths = starts[-1]
    for k in range(len(t.levels) - 1, 0, -1):
        d = _below(t.levels[k], paths, keep)
        if k == 1:
            leaves = d.select("grp", "kid.id", "kid.digest", "kid.presented", "path", *keep)
            # A group of one leaf has no level above it.
            return leaves.unionByName(t.tops(0).join(above, "grp").select(*leaves.columns))
        paths = stored(d.drop("kid").unionByName(starts[k - 1]), f"merkle-paths-{k - 1}")
        dropped(*old)
        old = [paths]
    return t.levels[0].join(above, "grp").select("grp", "id", "digest", "presented", "path", *keep)


def proofs(m: Manifest) -> DataFrame:
    """(grp, id, digest, presented, subroot, path) of all leaves.

    ``path`` lists, from the leaf's run up to the root's, the digests to the
    left and to the right of the node; both are empty for a run of one.
    """
    spark = m.top.levels[0].sparkSession
    start = spark.range(1).select(F.lit("").alias("grp"), F.array().cast(_PATH).alias("path"))
    upper = _descended(m.top, start, [])
    # A row for each group, with the siblings of its subroot.
    upper = stored(upper.select(F.col("id").alias("grp"), F.col("digest").alias("subroot"), "path"), "merkle-groups")
    return _descended(m.groups, upper, ["subroot"])


def folded(first: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.aggregate(path, first, lambda a, x: digest(F.concat(_text(x["l"]), a, _text(x["r"]))))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex, left to right, level by level."""
    return F.array_join(F.transform(path, lambda x: _text(F.concat(x["l"], x["r"]))), "")


def verified(docs: DataFrame, presented: Column | None = None, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot, root and proof, and whether what is presented leads to the root.

    ``presented`` is the leaf (hex) that someone shows for the row, null if it
    is the row's own; it is folded with the row's original siblings. Nulls of
    any column are part of the leaf; a null group is a group of its own, the
    first; null ids come first in their group. Rows of one id are ordered by
    leaf, and repeated rows are leaves of their own. Texts are hashed whole. An
    empty table gives no rows. Columns not named in ``fields``, ``id_col`` and
    ``group_col`` aren't read.
    """
    one = F.lit(None).cast("string") if presented is None else presented
    hashed = docs.select(group_key(F.col(group_col)).alias("grp"), F.col(id_col).alias("id"), F.unhex(leaf(*map(F.col, fields))).alias("digest"), F.unhex(one).alias("presented"))
    hashed = stored(hashed, "merkle-leaves")
    m = manifest(hashed)
    dropped(hashed)
    d = proofs(m)
    own = _text(F.col("digest"))
    d = d.select(F.col("id").alias(id_col), own.alias("leaf"), _text(F.col("subroot")).alias("subroot"), F.lit(m.root).cast("string").alias("root"), digest(proof_text(F.col("path"))).alias("proof_sha256"), folded(F.coalesce(_text(F.col("presented")), own), F.col("path")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf(*[F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    return verified(docs, F.when(crc_mod(F.col("doc_id"), 3) == 0, tampered))


#: Levels come by recursion. crc32 has no function there: it is taken over the digits' bytes, a bit at a time.
SQL = """
WITH RECURSIVE docs AS (SELECT *, coalesce('=' || lang, '') AS grp,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(list_reduce(list_concat([4294967295], list_transform(str_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 3 = 0 AS hit
  FROM documents),
framed AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs),
leaves AS MATERIALIZED (SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf, hit,
  row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, sha256(head || coalesce(strlen(text) || ':' || text, '-'))) - 1 AS pos FROM framed),
t AS (SELECT 0 AS level, grp, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaves
  UNION ALL SELECT any_value(level) + 1, grp, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY grp, pos // 8),
subs AS MATERIALIZED (SELECT grp, h, level, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, h, n FROM subs UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY pos // 8),
nodes AS MATERIALIZED (SELECT level, grp, pos, h FROM t WHERE n > 1),
tops AS MATERIALIZED (SELECT level, pos, h FROM u WHERE n > 1),
steps AS MATERIALIZED (
  SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.grp = b.grp AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY a.grp, a.level, a.pos
  UNION ALL SELECT s.grp, s.level + a.level, NULL, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM subs s JOIN tops a ON a.pos = s.pos // (8 ** a.level)::BIGINT JOIN tops b ON a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY s.grp, s.level, a.level, a.pos),
paths AS MATERIALIZED (SELECT x.doc_id, x.grp, x.pos, x.leaf, CASE WHEN x.hit THEN x.low_leaf ELSE x.leaf END AS shown,
  coalesce(list({'l': s.l, 'r': s.r} ORDER BY s.level) FILTER (s.level IS NOT NULL), []) AS path
  FROM leaves x LEFT JOIN steps s ON s.grp = x.grp AND (s.pos IS NULL OR s.pos = x.pos // (8 ** s.level)::BIGINT) GROUP BY ALL),
f AS (SELECT doc_id, grp, pos, shown AS h, 0 AS k, path FROM paths
  UNION ALL SELECT doc_id, grp, pos, sha256(path[k + 1].l || h || path[k + 1].r), k + 1, path FROM f WHERE k < len(path))
SELECT p.doc_id, p.leaf, subs.h AS subroot, root.h AS root, sha256(list_aggregate(list_concat([''], list_transform(p.path, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256,
  f.h AS folded_root, f.h = root.h AS verified
FROM paths p JOIN subs USING (grp) JOIN f ON f.grp = p.grp AND f.pos = p.pos AND f.k = len(f.path) CROSS JOIN (SELECT h FROM u WHERE n = 1) root
"""

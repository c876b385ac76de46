"""Merkle manifest of a dataset: a tree of sixteen children a node for each source, one over the sources, and proofs by coordinate lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import CRC_TABLE, LOWER, UPPER, crc_of, lower_ascii, stored

#: Children of a node (2 ** BITS), and the levels whose coordinates a node looks up itself: the rest of its path is that of
#: its ancestor above them, so that no row of the node table is asked for by more than 2 ** (BITS * SPAN) nodes.
BITS, SPAN = 4, 2
FAN = 1 << BITS
#: The columns that a leaf commits to, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over the sources' roots; the sources' trees count from 0.
TOP = -1


def leaf_of(columns: list[Column]) -> Column:
    """H of the columns' values, each as byte count, colon and value, or - for null."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The node table (tree, n, level, run, digests) over nodes(tree, n, idx, digest), the roots (tree, digest), and how many
    levels there are. A row holds the run of up to FAN neighbours that become one node of the level above; n is how many
    nodes its tree has at its level."""
    spark, tables, roots, level = nodes.sparkSession, [], [], 0
    empty = spark.createDataFrame([], "tree bigint, n bigint, level int, run bigint, digests array<binary>")
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        own = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = nodes.where("n > 1").groupBy("tree", "n", F.shiftright("idx", BITS).alias("run")).agg(F.transform(own, lambda x: x["digest"]).alias("digests"))
        runs = stored(runs.select("tree", "n", F.lit(level).alias("level"), "run", "digests"), "runs")
        if runs.isEmpty():
            return reduce(DataFrame.unionByName, tables, empty), reduce(DataFrame.unionByName, roots), level
        tables.append(runs)
        up = F.unhex(F.sha2(joined_hex(F.col("digests")), 256))
        nodes = runs.select("tree", F.shiftright(F.col("n") + (FAN - 1), BITS).alias("n"), F.col("run").alias("idx"), up.alias("digest"))
        level += 1


def chains(nodes: DataFrame, runs: DataFrame, most: int, above: DataFrame) -> DataFrame:
    """nodes(tree, n, idx, payload) with chain, an array of (place, run's digests) from the node up to the root of all, and
    root, its tree's. above(tree, n, chain, root) has the chain of each tree's root in the tree above it.

    A node explodes the coordinates (tree, level, run) of its siblings, which follow from its index and the size of its
    tree, for SPAN levels, and of the ancestor above those; they are joined to the node table and ordered. Rounds go from
    the top down: what one finds for the ancestors is what the next looks up.
    """
    height = reduce(lambda x, y: x + y, [(F.col("n") > 1 << (BITS * k)).cast("int") for k in range(62 // BITS)])
    above = stored(above.withColumn("height", height), "above")
    done = None
    for base in range(SPAN * max(0, (most - 1) // SPAN), -1, -SPAN):
        if base:  # a run below a level is a node of that level; sizes are those of the leaves
            below = runs.where(F.col("level") == base - 1).select("tree", F.col("run").alias("idx"), F.lit(None).cast("string").alias("payload"))
            own = below.join(above.where(F.col("height") > base).select("tree", "height"), "tree")
        else:
            own = nodes.withColumn("height", height).select("tree", "idx", "payload", "height")
        last = F.least(F.lit(base + SPAN), "height") - 1
        steps = F.when(last >= base, F.sequence(F.lit(base), last))
        asked = own.select("tree", "idx", "payload", F.explode_outer(steps).alias("level"))
        asked = asked.withColumn("place", F.expr(f"cast(shiftright(idx, (level - {base}) * {BITS}) & {FAN - 1} as int)")).withColumn("run", F.expr(f"shiftright(idx, (level - {base}) * {BITS} + {BITS})"))
        found = asked.join(runs.select("tree", "level", "run", "digests"), ["tree", "level", "run"], "left").withColumn("block", F.shiftright("idx", BITS * SPAN))
        step = F.when(F.col("level").isNotNull(), F.struct("level", "place", "digests"))
        paths = found.repartition("tree", "block").groupBy("tree", "block", "idx").agg(F.first("payload").alias("payload"), F.array_sort(F.collect_list(step)).alias("steps"))
        upper = above.where(F.col("height") <= base + SPAN).select("tree", F.lit(0).cast("bigint").alias("block"), "chain", "root")
        if done is not None:
            upper = upper.unionByName(done.select("tree", F.col("idx").alias("block"), "chain", "root"))
        chain = F.concat(F.transform("steps", lambda s: F.struct(s["place"].alias("place"), s["digests"].alias("digests"))), "chain")
        done = paths.join(upper, ["tree", "block"]).select("tree", "idx", "payload", chain.alias("chain"), "root")
        done = stored(done, "chains") if base else done
    return done


def siblings(step: Column) -> tuple[Column, Column]:
    place = step["place"]
    return F.slice(step["digests"], F.lit(1), place), F.slice(step["digests"], place + 2, F.lit(FAN))


def proof_of(chain: Column) -> Column:
    """The siblings' digests (hex text) of a chain, from the lowest level up, left to right."""
    return F.array_join(F.transform(chain, lambda s: F.concat(*map(joined_hex, siblings(s)))), "")


def folded(leaf: Column, chain: Column) -> Column:
    """The root (hex text) that a leaf's digest and the siblings of its chain give."""

    def step(digest, s):
        left, right = siblings(s)
        return F.sha2(F.concat(joined_hex(left), digest, joined_hex(right)), 256)

    return F.aggregate(chain, as_hex(leaf), step)


def proofs(documents: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, found, chain, subroot, root) for each row of documents; digests are binary.

    A leaf commits to a row's COLUMNS, nulls told from empty values. A source's leaves ascend by doc_id (null first, then
    by digest; repeated rows are leaves of their own) and every FAN neighbours become a node until one is left, its
    subroot; the sources' subroots, in bytewise order, null first, become root in the same way. found is the leaf of the
    row with `text` in place of its text, chain what its proof needs: folded(leaf, chain) is root, folded(found, chain)
    is root only for a row that is still what it was. A lone leaf is its subroot, a lone subroot is root; an empty table
    gives no rows. Columns beside COLUMNS are not read.
    """
    rest = [F.col(c) for c in COLUMNS[:-1]]
    leaf = leaf_of([*rest, F.col("text")])
    found = leaf if text is None else leaf_of([*rest, text])
    leaves = numbered(documents.select("source", "doc_id", leaf.alias("leaf"), found.alias("found")), [F.col("source"), F.col("doc_id"), F.col("leaf")], "position")
    leaves = stored(leaves, "leaves")
    sources = leaves.groupBy("source").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = stored(numbered(sources, [F.col("source")], "tree"), "sources")
    named = sources.select(F.struct("source").alias("__source"), "tree", "first", "n")
    payload = F.struct("doc_id", "leaf", "found").alias("payload")
    own = leaves.withColumn("__own", F.struct("source")).join(named, F.col("__own") == F.col("__source"))
    own = stored(own.select("tree", "n", (F.col("position") - F.col("first")).alias("idx"), F.col("leaf").alias("digest"), payload), "indexed")
    runs, roots, most = levels(own.drop("payload"))

    n = sources.count()
    subroots = stored(roots, "subroots")
    tops = stored(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(n).cast("bigint").alias("n"), F.col("tree").alias("idx"), "digest"), "tops")
    top_runs, top, top_most = levels(tops)
    one = top.first()
    none = F.array().cast("array<struct<place:int,digests:array<binary>>>")
    crown = top.select(F.col("tree"), F.lit(n).cast("bigint").alias("n"), none.alias("chain"), F.col("digest").alias("root"))
    over = chains(tops.drop("digest").withColumn("payload", F.lit(None).cast("string")), top_runs, top_most, crown)
    above = over.select(F.col("idx").alias("tree"), "chain").join(subroots.select("tree", F.col("digest").alias("root")), "tree").join(sources.select("tree", "n"), "tree")
    done = chains(own.drop("digest"), runs, most, above)
    root = F.lit(bytes(one["digest"]) if one else None).cast("binary")
    return done.select("payload.*", "chain", F.col("root").alias("subroot"), root.alias("root"))


def verified(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, verified) for each row of documents against the proofs that were kept of an earlier state of them: whether
    the row, as it is now, still folds to the root. Rows without a proof are not verified; a row whose id has several
    proofs (it was repeated) is verified if any of them holds."""
    now = documents.select("doc_id", leaf_of([F.col(c) for c in COLUMNS]).alias("now"))
    held = kept.select(F.col("doc_id").alias("__id"), "chain", F.col("root").alias("__root"))
    tried = now.withColumn("__row", F.monotonically_increasing_id()).join(held, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    holds = F.coalesce(folded(F.col("now"), F.col("chain")) == as_hex(F.col("__root")), F.lit(False))
    return tried.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.max(holds).alias("verified")).drop("__row")


def op11_lookup_proofs(spark, sf_dir: str) -> DataFrame:
    """Where 5 divides the id's CRC-32, the text found is the text with A-Z lower-cased."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    done = proofs(documents, F.when(altered, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    root, back = as_hex(F.col("root")), folded(F.col("found"), F.col("chain"))
    done = done.select("doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof_of(F.col("chain")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    part = "coalesce(strlen(@) || ':' || @, '-')"  # strlen counts bytes
    leaf = "sha256(" + " || ".join(part.replace("@", f"{c}::VARCHAR") for c in COLUMNS[:-1]) + f" || {part})"
    low = f"translate(text, '{UPPER}', '{LOWER}')"

    def tree(name: str, of: str) -> str:
        up = f"SELECT tree, level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, idx // {FAN}"
        return f"{name}(tree, level, idx, n, digest) AS ({of} UNION ALL {up})"

    def fold(name: str, of: str, nodes: str) -> str:
        parts = "string_agg(CASE WHEN m.idx = f.idx THEN f.digest ELSE m.digest END, '' ORDER BY m.idx)"
        up = f"SELECT f.tree, f.row, f.level + 1, f.idx // {FAN}, sha256({parts}) FROM {name} f JOIN {nodes} m ON m.tree = f.tree AND m.level = f.level AND m.idx // {FAN} = f.idx // {FAN} WHERE m.n > 1 GROUP BY f.tree, f.row, f.level, f.idx, f.digest"
        return f"{name}(tree, row, level, idx, digest) AS ({of} UNION ALL {up})"

    return (
        f"WITH RECURSIVE crcs AS ({CRC_TABLE}), k AS MATERIALIZED (SELECT d.doc_id, {crc_of('d.doc_id::VARCHAR', 'crcs.t')} % 5 = 0 AS altered FROM documents d, crcs), "
        f"d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, {leaf.replace('@', 'text')} AS leaf, CASE WHEN altered THEN {leaf.replace('@', low)} ELSE {leaf.replace('@', 'text')} END AS found FROM documents JOIN k USING (doc_id)), "
        + tree("nodes", "SELECT tree, 0, idx, n, leaf FROM d")
        + ", subs AS (SELECT tree, digest FROM nodes WHERE n = 1), "
        + tree("tops", "SELECT -1::BIGINT, 0, tree, (SELECT count(*) FROM subs), digest FROM subs")
        + ", low AS (SELECT d.doc_id, 0 AS part, m.level, m.idx, m.digest FROM d JOIN nodes m ON m.tree = d.tree AND m.n > 1 AND m.idx // 16 = (d.idx >> (4 * m.level)::BIGINT) // 16 AND m.idx <> d.idx >> (4 * m.level)::BIGINT), "
        "high AS (SELECT d.doc_id, 1 AS part, m.level, m.idx, m.digest FROM d JOIN tops m ON m.n > 1 AND m.idx // 16 = (d.tree >> (4 * m.level)::BIGINT) // 16 AND m.idx <> d.tree >> (4 * m.level)::BIGINT), "
        "p AS (SELECT doc_id, string_agg(digest, '' ORDER BY part, level, idx) AS proof FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY doc_id), "
        + fold("f", "SELECT tree, doc_id, 0, idx, found FROM d", "nodes")
        + ", g AS (SELECT tree, row, arg_max(digest, level) AS digest FROM f GROUP BY ALL), "
        + fold("t", "SELECT -1::BIGINT, row, 0, tree, digest FROM g", "tops")
        + ", e AS (SELECT row, arg_max(digest, level) AS back FROM t GROUP BY ALL) "
        "SELECT d.doc_id, d.leaf, subs.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, back AS folded_root, back = r.digest AS verified "
        "FROM d JOIN subs USING (tree) JOIN (SELECT digest FROM tops WHERE n = 1) r ON true JOIN e ON e.row = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id"
    )

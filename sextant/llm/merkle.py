"""A Merkle manifest of a dataset: hash trees of fanout 8 by slot pivots, proofs of each row, and their verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import kept, lower_ascii, table


@dataclass(frozen=True)
class ManifestRules:
    """The columns that a leaf covers, in order, the column whose values are subtrees, and a node's children."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    key: str = "doc_id"
    group: str = "lang"
    fanout: int = 8


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes in UTF-8 counted, a colon and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(rules: ManifestRules, **changed: Column) -> Column:
    """The leaf of a row, with some of its columns replaced."""
    return digest(*[field(changed.get(c, F.col(c))) for c in rules.fields])


def width(n: Column, level: int, fanout: int) -> Column:
    """How many nodes a tree of n leaves has at a level."""
    return F.ceil(n / F.lit(fanout**level)).cast("long")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, ...) with `at`, the place of each in its g by `order`, and `n`, the size of g; a written table.

    Rows are dealt and sorted by ranges and numbered in their task; what lies in earlier tasks is added by g. Equal rows
    are interchangeable, so a salt may part them: neither a large g nor many equal rows meet in one task."""
    salt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    by = ["g", *order, "_salt"]
    spread = kept(salt.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "merkle-order")
    task = F.shiftright("_id", 33)
    parts = spread.groupBy("g", task.alias("_task")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("g")
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(own)}).drop("_rows")
    found = spread.withColumn("_task", task).join(parts, ["g", "_task"])
    return kept(found.withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_salt", "_id", "_task", "_first", "_before"), "merkle-leaves")


def grown(leaves: DataFrame, fanout: int, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """The parents of each level above placed leaves (g, n, at, digest, carry), lowest first.

    A parent has g, n, at, its children's digests digest_0.. in order, its own digest and, on the lowest level, its
    leaves' carried columns likewise. A group has parents at a level while it has several nodes below it. A slot's column
    is a conditional aggregate, so every parent comes from `fanout` rows at the most, however large its group is."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while largest > fanout ** len(levels):
        level = len(levels)
        slot, several = F.col("at") % fanout, width(F.col("n"), level, fanout) > 1
        slots = [F.max(F.when(slot == i, F.col(c))).alias(f"{c}_{i}") for c in ("digest", *(() if level else carry)) for i in range(fanout)]
        up = nodes.filter(several).groupBy("g", "n", F.expr(f"at div {fanout}").alias("at")).agg(*slots)
        nodes = kept(up.withColumn("digest", F.sha2(F.concat_ws("", *[f"digest_{i}" for i in range(fanout)]), 256)), "merkle-level")
        levels.append(nodes)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """(g, digest) of each group's last node: the only one of its level."""
    found = leaves.filter("n = 1").select("g", "digest")
    for i, nodes in enumerate(levels):
        found = found.unionByName(nodes.filter(width(F.col("n"), i + 1, fanout) == 1).select("g", "digest"))
    return found


STEPS = "array<struct<before string, after string>>"


def opened(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, carry: tuple[str, ...]) -> DataFrame:
    """(g, digest, carry, steps) of each leaf; steps: its siblings on the left and on the right, level by level upward.

    `tops` has the steps (g, steps) above each group's last node. They go down one level at a time: a child's steps are
    its own siblings, the parent's slots but the child's own, and then the parent's. What is shuffled are the steps of
    parents; those of the leaves are made where they are used."""
    steps = None
    for i in range(len(levels), 0, -1):
        single = levels[i - 1].filter(width(F.col("n"), i, fanout) == 1).select("g", "at").join(tops, "g")
        here = single if steps is None else single.unionByName(steps)
        names = ("digest", *carry) if i == 1 else ("digest",)
        digests = [f"digest_{j}" for j in range(fanout)]
        side = lambda own: F.concat_ws("", *own) if own else F.lit("")
        child = lambda j: F.struct((F.col("at") * fanout + j).alias("at"), side(digests[:j]).alias("before"), side(digests[j + 1 :]).alias("after"), *[F.col(f"{c}_{j}").alias(c) for c in names])  # noqa: E731, B023
        parents = levels[i - 1].drop("digest", "n").join(here, ["g", "at"])
        children = parents.select("g", "steps", F.explode(F.array(*[child(j) for j in range(fanout)])).alias("c")).filter("c.digest IS NOT NULL")
        own = F.concat(F.array(F.struct("c.before", "c.after")), "steps").cast(STEPS).alias("steps")
        steps = children.select("g", "c.at", own) if i > 1 else children.select("g", *[f"c.{c}" for c in names], own)
    single = leaves.filter("n = 1").select("g", "digest", *carry).join(tops, "g")
    return single if steps is None else single.unionByName(steps)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof(steps: Column) -> Column:
    """The hash of all siblings on the way, from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, tampered: Column, rules: ManifestRules = ManifestRules()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Each value of the group column (null first, then by bytes) has a tree over its leaves in the order of the key (nulls
    first, rows of one key by leaf), and the subroots have one of their own. `tampered` is the condition (false for null)
    of the rows whose text is checked with A-Z in lower case; everything else of the result is of the rows as they are.
    A row that repeats another is a leaf of its own with the same digest; its place among its equals doesn't matter. An
    empty or very long text is hashed as any other; an empty table gives an empty result; other columns aren't read.

    Texts are hashed where they are read, and only digests are shuffled."""
    f = rules.fanout
    own = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(rules.group).cast("string")), F.lit("")).alias("g"), F.col(rules.key).cast("long").alias("key"),
        leaf(rules).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), leaf(rules, text=lower_ascii(F.col("text")))).alias("changed"),
    )
    leaves = placed(own, "key", "digest")
    levels = grown(leaves, f, ("key", "changed"))
    subroots = placed(roots(leaves, levels, f).select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "name")
    above = grown(subroots, f, ("name",))
    root = roots(subroots, above, f)
    start = root.select("g", F.array().cast(STEPS).alias("steps"))
    tops = opened(subroots, above, start, f, ("name",)).join(root.withColumnRenamed("digest", "root"), "g")
    tops = kept(tops.select(F.col("name").alias("g"), "steps", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    out = opened(leaves, levels, tops.select("g", "steps"), f, ("key", "changed")).join(tops.select("g", "subroot", "root"), "g")
    out = out.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6, above: int = 3) -> str:
    """The manifest in SQL, by ordered string aggregates and windows, for up to 8 ** levels rows of a language.

    crc32 is worked out from its polynomial, byte by byte, for the decimal digits of the id."""
    bits = "list_reduce(list_concat([{0}], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [
        f"t AS (SELECT list_transform(range(256), lambda b: {bits.format('b')}) AS t)",
        f"b AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed FROM documents, t)",
        "l0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS d, doc_id, changed FROM b)",
    ]
    side = "coalesce(string_agg(d, '') OVER (PARTITION BY {0}pos // 8 ORDER BY pos ROWS BETWEEN {1}), '')"

    def tree(name: str, key: str, last: int):
        for i in range(last):
            group = f"{key}pos // 8 AS pos, (n + 7) // 8 AS n"
            sql.append(f"{name}{i + 1} AS (SELECT {group}, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{i} WHERE n > 1 GROUP BY {key}pos // 8, n UNION ALL SELECT {key}pos, n, d FROM {name}{i} WHERE n = 1)")
            sql.append(f"{name}s{i} AS (SELECT {key}pos, n > 1 AS several, CASE WHEN n > 1 THEN {side.format(key, 'UNBOUNDED PRECEDING AND 1 PRECEDING')} ELSE '' END AS x, CASE WHEN n > 1 THEN {side.format(key, '1 FOLLOWING AND UNBOUNDED FOLLOWING')} ELSE '' END AS y FROM {name}{i})")

    tree("l", "lang, ", levels)
    sql.append(f"u0 AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d, lang FROM l{levels})")
    tree("u", "", above)
    sql.append("w0 AS (SELECT lang, pos, doc_id, d AS leaf, changed AS fold, '' AS way FROM l0)")
    for i in range(levels):
        sql.append(f"w{i + 1} AS (SELECT w.lang, CASE WHEN s.several THEN w.pos // 8 ELSE w.pos END AS pos, doc_id, leaf, CASE WHEN s.several THEN sha256(x || fold || y) ELSE fold END AS fold, way || x || y AS way FROM w{i} w JOIN ls{i} s ON w.lang IS NOT DISTINCT FROM s.lang AND w.pos = s.pos)")
    sql.append(f"v0 AS (SELECT u.pos, doc_id, leaf, fold, way, d AS subroot FROM w{levels} w JOIN u0 u ON w.lang IS NOT DISTINCT FROM u.lang)")
    for i in range(above):
        sql.append(f"v{i + 1} AS (SELECT CASE WHEN s.several THEN w.pos // 8 ELSE w.pos END AS pos, doc_id, leaf, CASE WHEN s.several THEN sha256(x || fold || y) ELSE fold END AS fold, way || x || y AS way, subroot FROM v{i} w JOIN us{i} s ON w.pos = s.pos)")
    return "WITH " + ", ".join(sql) + f" SELECT doc_id, leaf, subroot, u.d AS root, sha256(way) AS proof_sha256, fold AS folded_root, fold = u.d AS verified FROM v{above} CROSS JOIN u{above} u"


ORACLE = _oracle()


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Digests, proofs and their check of every document; every third one (by crc32 of the id) is checked in lower case."""
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)

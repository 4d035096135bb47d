"""Merkle manifest of a dataset: a hash tree over each source's rows, and one over the sources.

A leaf is the hash of a row's fields. Per source the leaves stand in ascending id order, and while more
than one node remains, every ``FANOUT`` (3) consecutive nodes (a last run may hold fewer, even one) become the
hash of their digests; the sources' last nodes, ordered by source, make a tree of the same kind.

Levels are built with windows: in a level's table of (group, place, digest), lag and lead columns of the
fixed offsets 1 and 2, masked by a node's slot in its run and by the run's length, hold the siblings
before and behind it, and the rows of slot 0 hash the run into its parent. A run never crosses a
multiple of 3, so windows are partitioned by group and block of places: one group with a third of all
rows is many partitions, and none holds more than ``BLOCK`` rows. On the way down a node's proof is its own
siblings and then its parent's proof, by an equi-join on (group, place of the parent), whose rows
shrink by a third a level; a leaf's proof folds any leaf, a tampered one too, into a root.

Places: equal rows are first counted together, distinct ones are range-partitioned by (source, id, leaf) and
written to the folder that ``spark.checkpoint.dir`` names, and a row's place is the count of the
partitions before and of the rows before it in its own. Each level is written there too.

Everything is DataFrame functions. Defined cases: a null field is ``-``; a null ``doc_id`` comes before
all others and is not tampered with; rows of one id come in order of their leaves; equal rows are a leaf each;
a null source is a source, before all others; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read

FANOUT = 3
#: Places of a window's partition: a power of the fan-out.
BLOCK = FANOUT ** 8
#: Copies of one row that a row makes at once.
COPIES = 4096
#: Levels of proofs in one plan.
PLAN_LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def group_of(source: Column) -> Column:
    """A key that sorts as sources do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tamper_every: int = 2) -> DataFrame:
    """(grp, doc_id, leaf, tampered): ``tampered`` is the leaf of the row whose text lost its line feeds, where
    ``tamper_every`` divides the CRC-32 of the decimal id, else the leaf itself."""
    own = [F.col(c) for c in FIELDS]
    cut = F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    chosen = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    leaf = digest(*map(field, own))
    other = F.when(chosen & F.col("text").contains("\n"), digest(*map(field, own[:-1]), field(cut)))
    return docs.select(group_of(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                       F.coalesce(other, leaf).alias("tampered"))


def placed(rows: DataFrame, group: str, order: list[str], carried: list[str], ranges: list[Column]) -> DataFrame:
    """Equal rows expanded to a row each, with ``pos`` from 0 in their group's order and ``n``, the group's rows.

    ``ranges``: short columns that ascend with ``order``; Spark samples them for the bounds of its partitions.
    """
    keys = [group, *order, *carried]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    ranged = checkpointed(counted.repartitionByRange(group, *ranges).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(group, "part").agg(F.sum("copies").alias("held"))
    # a group has a row here for each partition that it reaches into
    whole = Window.partitionBy(group)
    sums = sums.select(group, "part", (F.sum("held").over(whole.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("n"))
    inside = Window.partitionBy("part", group).orderBy(*order, *carried).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.col("within") - F.col("copies")
    rows = ranged.withColumn("within", F.sum("copies").over(inside)).join(sums, [group, "part"]).select(*keys, "copies", "n", first.alias("first"))
    # many copies of one row are made by many tasks
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    many = steps.where(F.col("copies") > COPIES).repartition("first", "step")
    made = steps.where(F.col("copies") <= COPIES).unionByName(many).withColumn("at", F.col("step") * COPIES)
    nth = F.explode(F.sequence(F.col("at"), F.least(F.col("copies"), F.col("at") + COPIES) - 1))
    return made.withColumn("nth", nth).select(*keys, "n", (F.col("first") + F.col("nth")).alias("pos"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``before`` and ``behind``: the digests of a node's run on each side of it, end to end."""
    run = Window.partitionBy("grp", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("pos") + slot)

    def there(mask: Column, digest_: Column) -> Column:
        return F.when(mask, digest_).otherwise(F.lit(""))

    lags = [there(slot >= k, F.lag("digest", k).over(run)) for k in range(FANOUT - 1, 0, -1)]
    leads = [there(slot + k < length, F.lead("digest", k).over(run)) for k in range(1, FANOUT)]
    return nodes.withColumns({"before": F.concat(*lags), "behind": F.concat(*leads)})


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, from the leaves up, and (grp, digest, depth) of the groups' last nodes,
    ``depth`` the number of levels below.

    ``nodes``: grp, n, pos, digest; further columns stay in the lowest level, which holds the groups with more
    than one node, as each level does.
    """
    levels, tops = [], None
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        own = nodes.where("n = 1").select("grp", "digest", F.lit(len(levels)).alias("depth"))
        tops = own if tops is None else tops.unionByName(own)
        if most <= 1:
            return levels, checkpointed(tops)
        levels.append(checkpointed(with_siblings(nodes.where("n > 1"))))
        most = -(-most // FANOUT)
        nodes = levels[-1].where(F.col("pos") % FANOUT == 0).select(
            "grp", F.floor((F.col("n") + FANOUT - 1) / FANOUT).alias("n"), F.floor(F.col("pos") / FANOUT).alias("pos"),
            digest(F.col("digest"), F.col("behind")).alias("digest"))


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest level, with ``path``: the siblings (before, behind) of a node and its ancestors.

    ``tops``: grp, depth, the ``path`` from a group's last node on, and columns that its rows take over.
    """
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    below = None
    for k in reversed(range(len(levels))):
        # parents are the nodes of the level above, and the last nodes of the groups that end there
        parents = tops.where(F.col("depth") == k + 1).select("grp", F.lit(0).cast("long").alias("up"), *carried, F.col("path").alias("rest"))
        if below is not None:
            parents = parents.unionByName(below.select("grp", F.col("pos").alias("up"), *carried, F.col("path").alias("rest")))
        path = F.concat(F.array(F.struct("before", "behind")), F.col("rest")).alias("path")
        down = levels[k].withColumn("up", F.floor(F.col("pos") / FANOUT)).join(parents, ["grp", "up"])
        below = down.select(*(["grp", "pos"] if k else levels[0].columns), *carried, path)
        if k and k % PLAN_LEVELS == 0:  # few rows; keeps the plan short
            below = checkpointed(below)
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["behind"]))


def manifest(docs: DataFrame, tamper_every: int = 2) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = checkpointed(placed(leaves(docs, tamper_every), "grp", ["doc_id", "leaf"], ["tampered"], [F.col("doc_id"), F.substring("leaf", 1, 8)]).withColumnRenamed("leaf", "digest"))
    levels, tops = tree(rows)
    # the tree of the sources, one group of its own
    tops = tops.select(F.lit("").alias("all"), F.col("grp").alias("source"), F.col("digest").alias("subroot"), F.col("depth").alias("below"))
    sources = checkpointed(placed(tops, "all", ["source"], ["subroot", "below"], [F.col("source")]).withColumn("grp", F.lit("")).withColumn("digest", F.col("subroot")))
    upper, top = tree(sources)
    root = top.first()
    none = F.array().cast("array<struct<before:string,behind:string>>")
    if upper:
        sources = proofs(upper, top.select("grp", "depth", none.alias("path")))
    else:
        sources = sources.withColumn("path", none)
    sources = checkpointed(sources.select(F.col("source").alias("grp"), F.col("below").alias("depth"), "subroot", "path"))
    kept = ["doc_id", "digest", "tampered", "subroot", "path"]
    out = rows.where("n = 1").join(sources, "grp").select(*kept)
    if levels:
        out = out.unionByName(proofs(levels, sources).select(*kept))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["behind"])), "")
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else "").alias("root"),
                     F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    return manifest(read(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string in SQL, bit by bit."""
    step = "list_reduce(list_prepend(xor(r, b), range(8)), lambda c, i: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda r, b: {step}))"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


#: Levels that the SQL has room for: 3^18 rows a source.
SQL_LEVELS = 18


def _tree_sql(name: str, start: str) -> str:
    """Materialised levels name0 .. (grp, n, pos, digest, before, behind); a group with one node stays as it is."""
    ctes = []
    for k in range(SQL_LEVELS + 1):
        below = start if k == 0 else f"""
  select grp, (n + 2) // 3 as n, pos // 3 as pos, case when n = 1 then max(digest) else sha256(string_agg(digest, '' order by pos)) end as digest
  from {name}{k - 1} group by grp, n, pos // 3"""
        ctes.append(f"""{name}{k} as materialized (
  select grp, n, pos, digest,
    coalesce(string_agg(digest, '') over (partition by grp, pos // 3 order by pos rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (partition by grp, pos // 3 order by pos rows between 1 following and unbounded following), '') as behind
  from ({below}) t{k})""")
    return ",\n".join(ctes)


def _proof_sql(name: str, alias: str, grp: str, pos: str) -> str:
    """Joins of one node's ancestors."""
    return "\n".join(f"  left join {name}{k} {alias}{k} on {alias}{k}.grp = {grp} and {alias}{k}.pos = {pos} // {FANOUT ** k} and {alias}{k}.n > 1"
                     for k in range(SQL_LEVELS))


_LEAF = "sha256(" + " || ".join(_field_sql(c) for c in FIELDS) + ")"
_TAMPERED = "sha256(" + " || ".join([*(_field_sql(c) for c in FIELDS[:-1]), _field_sql("replace(text, chr(10), '')")]) + ")"
_PATH = " || ".join([f"coalesce(a{k}.before || a{k}.behind, '')" for k in range(SQL_LEVELS)] + [f"coalesce(u{k}.before || u{k}.behind, '')" for k in range(SQL_LEVELS)])
_STEPS = ", ".join([f"{{'x': a{k}.before, 'y': a{k}.behind}}" for k in range(SQL_LEVELS)] + [f"{{'x': u{k}.before, 'y': u{k}.behind}}" for k in range(SQL_LEVELS)])

OP12_SQL = f"""
with leaf as materialized (
  select doc_id, coalesce('+' || source, '') as grp, {_LEAF} as leaf,
         case when {_crc32_sql("doc_id::varchar")} % 2 = 0 then {_TAMPERED} else {_LEAF} end as tampered
  from documents),
place as materialized (
  select *, count(*) over (partition by grp) as n, row_number() over (partition by grp order by doc_id nulls first, leaf, tampered) - 1 as pos from leaf),
{_tree_sql("lv", "select grp, n, pos, leaf as digest from place")},
tops as materialized (select '' as grp, grp as source, digest, count(*) over () as n, row_number() over (order by grp) - 1 as pos from lv{SQL_LEVELS}),
{_tree_sql("up", "select grp, n, pos, digest from tops")},
steps as materialized (
  select p.doc_id, p.leaf, p.tampered, s.digest as subroot, (select digest from up{SQL_LEVELS}) as root, sha256({_PATH}) as proof_sha256,
         list_filter([{_STEPS}], lambda s: s.x is not null) as path
  from place p join tops s on s.source = p.grp
{_proof_sql("lv", "a", "p.grp", "p.pos")}
{_proof_sql("up", "u", "''", "s.pos")}),
fold as (
  select *, list_reduce(list_prepend({{'x': tampered, 'y': ''}}, path), lambda t, s: {{'x': sha256(s.x || t.x || s.y), 'y': ''}}).x as folded_root from steps)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from fold"""

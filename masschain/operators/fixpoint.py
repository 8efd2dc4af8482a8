"""Rules over statements that skip levels, each fed by the rows of those before it.

A node is (node, cls, rank); a statement (id, whole, part, fraction) says how much of a part is in a whole.
Fine statements step by one rank or stay in it, coarse ones skip ranks. In order:

    fillers       a coarse statement gets an edge from level to level, over one unknown node for each level it skips
    lift          instance edges, fillers among them, that step by one rank become edges of their classes and of those above
    propagate     paths from every node over fine statements and fillers, with the product of their fractions
    class_reach   classes that a class holds at any depth over lifted edges
    reconcile     what a coarse statement has beyond the sum of its fine paths, and whether it holds
    conservation  wholes whose parts of the same or the next rank sum to more than one

propagate and class_reach are semi-naive: a round extends only the rows that the last one found. The path of a
filler has no fraction of its own, as reconcile is what gives it an amount. Where a column is equal in all statements of a
node (within), the rules of small groups whose statements all step down are worked out without joins, many groups at once, after one exchange
by that column; lift and class_reach go by the distinct classes and ranks of all statements.

Defined results: statements with a null id, whole or part, or of nodes without a rank, are left out, as are those
of a node and itself; a null fraction makes its paths null and counts as 0 in sums. A path takes each statement once.
Repeated nodes or statements (of one id) count once. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared
from masschain.plans.tables import sql_query

from .graph import GROUP, SPAN, by_group, closure_with_depth

LEVELS = ("Product", "Component", "Material", "Element")
EPSILON = 1e-9
#: Statements of groups whose rules are worked out together.
AT_ONCE = 8_192
_KINDS = ("whole_cls", "part_cls", "whole_rank", "part_rank")
_ROW = "rule string, subject string, object string, key string, value double, holds boolean"


def semi_naive(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str] | None = None) -> DataFrame:
    """The rows of start and all that step makes of them, of its results, and so on until nothing is new.

    A round reads the rows of the round before it alone. With a key, rows whose key is known already are dropped,
    so that sets close on cycles; without one, step must end by itself. Each round cuts its lineage in the shared
    checkpoint folder.
    """
    shared.checkpoint_folder(start.sparkSession)
    known = new = (start if key is None else start.dropDuplicates(key)).checkpoint()
    while not new.isEmpty():
        found = step(new)
        if key is not None:
            found = found.dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*known.columns)
        new = found.checkpoint()
        known = known.unionByName(new)
    return known


def ranked(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements with the classes and ranks of both ends."""
    node = nodes.filter("rank IS NOT NULL").dropDuplicates(["node"])
    ends = [node.select(F.col("node").alias(end), F.col("cls").alias(f"{end}_cls"), F.col("rank").alias(f"{end}_rank")) for end in ("whole", "part")]
    once = statements.select("id", "whole", "part", F.col("fraction").cast("double").alias("fraction")).filter("id IS NOT NULL AND whole <> part").dropDuplicates(["id"])
    return once.join(ends[0], "whole").join(ends[1], "part")


def _skips(by: Column) -> Column:
    return by >= 2


def _gap() -> Column:
    return F.col("part_rank") - F.col("whole_rank")


def filler_edges(stated: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Edges (id, whole, part, whole_cls, part_cls, whole_rank, part_rank, starts) from level to level under each coarse statement; starts: the whole is no filler."""
    names = F.array(*map(F.lit, levels))
    between = F.transform(F.sequence(F.col("whole_rank") + 1, F.col("part_rank") - 1), lambda r: F.struct(
        F.concat("id", F.lit("-unknown"), F.get(names, r)).alias("node"), F.concat(F.lit("unknown"), F.get(names, r)).alias("cls"), r.alias("rank"), F.lit(False).alias("starts")))
    end = lambda e: F.array(F.struct(F.col(e).alias("node"), F.col(f"{e}_cls").alias("cls"), F.col(f"{e}_rank").alias("rank"), F.lit(True).alias("starts")))
    chain = stated.filter(_skips(_gap())).select("id", F.concat(end("whole"), between, end("part")).alias("c"))
    links = chain.select("id", F.inline(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))))
    return links.select("id", *(F.col(f"{s}.{f}").alias(f"{e}{t}") for s, e in (("a", "whole"), ("b", "part")) for f, t in (("node", ""), ("cls", "_cls"), ("rank", "_rank"))), "a.starts")


def lifted(edges: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Distinct class edges (whole, part) of instance edges that step by one rank, for the classes and all above them."""
    direct = edges.filter(_gap() == 1).select(F.col("whole_cls").alias("w"), F.col("part_cls").alias("p")).filter("w IS NOT NULL AND p IS NOT NULL").distinct()
    up = closure_with_depth(taxonomy).select("descendant", "ancestor").checkpoint()
    for side in ("w", "p"):
        above = up.select(F.col("descendant").alias(side), "ancestor")
        direct = direct.unionByName(direct.join(above, side).drop(side).withColumnRenamed("ancestor", side)).distinct()
    return direct.select(F.col("w").alias("whole"), F.col("p").alias("part"))


def propagated(fine: DataFrame, fillers: DataFrame) -> DataFrame:
    """Paths (root, head, key, fraction, filled) over fine statements and fillers; none starts at a filler."""
    shared.checkpoint_folder(fine.sparkSession)
    edges = fine.select(F.col("id").alias("edge"), "whole", "part", "fraction", F.lit(False).alias("filled"), F.lit(True).alias("starts"))
    edges = edges.unionByName(fillers.select(F.concat("id", F.lit("-"), "part").alias("edge"), "whole", "part", F.lit(None).cast("double").alias("fraction"), F.lit(True).alias("filled"), "starts")).checkpoint()
    start = edges.filter("starts").select(F.col("whole").alias("root"), F.col("part").alias("head"), F.array("edge").alias("met"), "fraction", "filled")
    onward = edges.select(F.col("whole").alias("head"), F.col("part").alias("next"), "edge", F.col("fraction").alias("by"), F.col("filled").alias("also"))

    def longer(new: DataFrame) -> DataFrame:
        on = new.join(onward, "head").filter(~F.array_contains("met", F.col("edge")))
        return on.select("root", F.col("next").alias("head"), F.array_append("met", F.col("edge")).alias("met"), (F.col("fraction") * F.col("by")).alias("fraction"), (F.col("filled") | F.col("also")).alias("filled"))

    return semi_naive(start, longer).select("root", "head", F.array_join("met", "|").alias("key"), "fraction", "filled")


def class_reach(edges: DataFrame) -> DataFrame:
    """Distinct (whole, part): classes that edges lead to at any depth."""
    onward = edges.select(F.col("whole").alias("part"), F.col("part").alias("next"))
    return semi_naive(edges.select("whole", "part"), lambda new: new.join(onward, "part").select("whole", F.col("next").alias("part")), ["whole", "part"])


def reconciled(stated: DataFrame, paths: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Coarse statements (id, whole, part, unknown, conserved) against the sums of the fine paths between their ends."""
    sums = paths.filter("NOT filled").groupBy(F.col("root").alias("whole"), F.col("head").alias("part")).agg(F.coalesce(F.sum("fraction"), F.lit(0.0)).alias("granular"))
    met = stated.filter(_skips(_gap())).join(sums, ["whole", "part"], "left").withColumn("granular", F.coalesce("granular", F.lit(0.0)))
    beyond = F.coalesce("fraction", F.lit(0.0)) - F.col("granular")
    return met.select("id", "whole", "part", F.when(beyond > epsilon, beyond).otherwise(F.lit(0.0)).alias("unknown"), (beyond >= -epsilon).alias("conserved"))


def overfull(stated: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(whole, total) of wholes whose parts of the same or a neighbouring rank sum to more than one."""
    return stated.filter(F.abs(_gap()) <= 1).groupBy("whole").agg(F.sum("fraction").alias("total")).filter(F.col("total") > 1 + epsilon)


def _rows(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*(c.alias(n.split()[0]) for c, n in zip(columns, _ROW.split(", "), strict=True)))


def _blank(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _own_rules(stated: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The rows of the rules on statements themselves, by joins on nodes."""
    stated = stated.checkpoint()
    fillers = filler_edges(stated, levels).checkpoint()
    paths = propagated(stated.filter(_gap().isin(0, 1)), fillers)
    c, none, nothing, unsaid = F.col, _blank("string"), _blank("double"), _blank("boolean")
    out = _rows(fillers, F.lit("fillers"), c("whole"), c("part"), c("id"), nothing, unsaid)
    for more in (
        _rows(paths, F.lit("propagate"), c("root"), c("head"), c("key"), c("fraction"), unsaid),
        _rows(reconciled(stated, paths), F.lit("reconcile"), c("whole"), c("part"), c("id"), c("unknown"), c("conserved")),
        _rows(overfull(stated), F.lit("conservation"), c("whole"), none, none, c("total"), F.lit(False)),
    ):
        out = out.unionByName(more)
    return out


def _group_rules(groups: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The same rows from groups (edges) whose statements step down and span SPAN ranks at most; some groups at a time, as columns."""

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column("edges")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(edges):
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")), at + 1)
                yield from _rules_at_once(edges.slice(at, to - at), levels)
                at = to

    return groups.select("edges").mapInArrow(rules, _ROW)


def _rules_at_once(groups: pa.ListArray, levels: tuple[str, ...], epsilon: float = EPSILON) -> Iterator[pa.RecordBatch]:
    """The rows of the rules of some groups: nodes are numbered, and the edges of each lie together, so that paths grow by ranges of edges."""
    flat, group = groups.flatten(), pc.list_parent_indices(groups).to_numpy()
    name, whole, part, fraction = (flat.field(c) for c in ("id", "whole", "part", "fraction"))
    rank, below = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("whole_rank", "part_rank"))
    steps_down = below - rank
    fine, coarse = np.flatnonzero(steps_down == 1), np.flatnonzero(steps_down >= 2)
    by, unsaid = fraction.fill_null(0.0).to_numpy(zero_copy_only=False), fraction.is_null().to_numpy(zero_copy_only=False)
    join = lambda *parts: pc.binary_join_element_wise(*parts, "")

    # a coarse statement's links, from its whole over one unknown node a rank to its part
    of = np.repeat(coarse, steps_down[coarse])
    nth = _counted(steps_down[coarse])
    def unknown(at):
        return join(name.take(pa.array(of)), "-unknown", pa.array(levels).take(pa.array(at, mask=(at < 0) | (at >= len(levels)))))
    last = pa.array(nth == steps_down[of] - 1)
    link_whole = pc.if_else(pa.array(nth == 0), whole.take(pa.array(of)), unknown(rank[of] + nth))
    link_part = pc.if_else(last, part.take(pa.array(of)), unknown(rank[of] + nth + 1))
    link_id = name.take(pa.array(of))

    # steps: fine statements, then links
    both = lambda a, b: pa.concat_arrays([a.take(pa.array(fine)), b])
    edge, tail, head = both(name, join(link_id, "-", link_part)), both(whole, link_whole), both(part, link_part)
    of_group = np.concatenate([group[fine], group[of]])
    value, blank = np.concatenate([by[fine], np.zeros(len(of))]), np.concatenate([unsaid[fine], np.ones(len(of), bool)])
    filled, starts = (np.concatenate([np.full(len(fine), first), rest]) for first, rest in ((False, np.ones(len(of), bool)), (True, nth == 0)))
    codes = pc.dictionary_encode(pa.concat_arrays([tail, head, whole, part])).indices
    missing = codes.is_null().to_numpy(zero_copy_only=False)  # meets nothing, itself neither
    codes = np.where(missing, len(codes) + np.arange(len(codes)), codes.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    codes = np.unique(codes * len(groups) + np.concatenate([of_group, of_group, group, group]), return_inverse=True)[1]
    tail_at, head_at, whole_at, part_at = np.split(codes, np.cumsum([len(tail), len(head), len(whole)]))
    order = np.argsort(tail_at, kind="stable")
    sorted_tails = tail_at[order]

    first = np.flatnonzero(starts)
    grown = [(first, first, edge.take(pa.array(first)), value[first], blank[first], filled[first])]
    for _ in range(1, SPAN):
        root, end, key, f, empty, fill = grown[-1]
        lo, hi = (np.searchsorted(sorted_tails, head_at[end], side) for side in ("left", "right"))
        path, on = np.repeat(np.arange(len(end)), hi - lo), order[np.repeat(lo, hi - lo) + _counted(hi - lo)]
        key = pc.binary_join_element_wise(key.take(pa.array(path)), edge.take(pa.array(on)), "|")
        grown.append((root[path], on, key, f[path] * value[on], empty[path] | blank[on], fill[path] | filled[on]))
    root, end, f, empty, fill = (np.concatenate([g[i] for g in grown]) for i in (0, 1, 3, 4, 5))
    key = pa.concat_arrays([g[2] for g in grown])

    # what coarse statements have beyond the fine paths between their ends
    pair = lambda a, b: a.astype(np.int64) * (len(codes) + 1) + b
    ends, which = np.unique(pair(whole_at[coarse], part_at[coarse]), return_inverse=True)
    known = ~fill & ~empty
    met = pair(tail_at[root[known]], head_at[end[known]])
    at = np.minimum(np.searchsorted(ends, met), max(len(ends) - 1, 0))
    same = ends[at] == met if len(ends) else np.zeros(len(met), bool)
    beyond = by[coarse] - np.bincount(at[same], f[known][same], len(ends))[which]
    totals = np.bincount(whole_at[fine], by[fine], len(codes))
    over = fine[np.unique(whole_at[fine], return_index=True)[1]]
    over = over[totals[whole_at[over]] > 1 + epsilon]

    yield _batch("fillers", link_whole, link_part, link_id)
    yield _batch("propagate", tail.take(pa.array(root)), head.take(pa.array(end)), key, pa.array(f, mask=empty))
    at = pa.array(coarse)
    yield _batch("reconcile", whole.take(at), part.take(at), name.take(at), pa.array(np.where(beyond > epsilon, beyond, 0.0)), pa.array(beyond >= -epsilon))
    yield _batch("conservation", whole.take(pa.array(over)), value=pa.array(totals[whole_at[over]]), holds=pa.array(np.zeros(len(over), bool)))


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _batch(rule: str, subject: pa.Array, object: pa.Array | None = None, key: pa.Array | None = None, value: pa.Array | None = None, holds: pa.Array | None = None) -> pa.RecordBatch:
    n, kinds = len(subject), (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
    columns = (pa.array([rule], pa.string()).take(pa.array(np.zeros(n, np.int64))), subject, object, key, value, holds)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _ROW.split(", ")])


def materialized(nodes: DataFrame, statements: DataFrame, taxonomy: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The rows of all rules: (rule, subject, object, key, value, holds). taxonomy is (child, parent)."""
    shared.checkpoint_folder(statements.sparkSession)
    return materialized_ranked(ranked(nodes, statements).checkpoint(), taxonomy, levels)


def materialized_ranked(stated: DataFrame, taxonomy: DataFrame, levels: tuple[str, ...] = LEVELS, within: str | None = None) -> DataFrame:
    """The same from what ranked() returns. within: a column of it that is equal in all statements of a node."""
    shared.checkpoint_folder(stated.sparkSession)
    out = _class_rules(stated.select(*_KINDS).distinct(), taxonomy, levels)
    if within is None:
        return out.unionByName(_own_rules(stated, levels))
    narrow = lambda group: (F.min(_gap()).over(group) >= 1) & (F.max("part_rank").over(group) - F.min("whole_rank").over(group) <= SPAN)
    small, large = by_group(stated, within, ["id", "whole", "part", "fraction", "whole_rank", "part_rank"], narrow)
    out = out.unionByName(_group_rules(small, levels))
    return out if large is None else out.unionByName(_own_rules(large, levels))


def _class_rules(kinds: DataFrame, taxonomy: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The rows of lift and class_reach, from the distinct classes and ranks of all statements."""
    kinds = kinds.checkpoint()
    blank = F.lit("").alias
    fillers = filler_edges(kinds.select(blank("id"), blank("whole"), blank("part"), *kinds.columns), levels)
    steps = lifted(kinds.unionByName(fillers.select(*kinds.columns)), taxonomy).checkpoint()
    none, nothing, unsaid = _blank("string"), _blank("double"), _blank("boolean")
    out = _rows(steps, F.lit("lift"), F.col("whole"), F.col("part"), none, nothing, unsaid)
    return out.unionByName(_rows(class_reach(steps), F.lit("class_reach"), F.col("whole"), F.col("part"), none, nothing, unsaid))


_P, _C, _M, _E = "concat('P', CAST(ord AS STRING))", "concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING))", "concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING))", "concat('E', CAST(ord AS STRING), '_', element_class)"
#: An element node is one of its order; products state their elements, skipping two levels.
STATEMENTS = f"""SELECT concat(whole, '>', part) AS id, whole, part, fraction FROM (SELECT {_P} AS whole, {_C} AS part, best AS fraction FROM pc UNION ALL SELECT {_C}, {_M}, best FROM cm
    UNION ALL SELECT {_M}, {_E}, elem_best FROM mat UNION ALL SELECT {_P}, {_E}, lo FROM coarse) s"""
NODES = f"""SELECT {_P} AS node, product_class AS cls, 0 AS rank FROM placed UNION ALL SELECT {_C}, component_class, 1 FROM pc UNION ALL SELECT {_M}, material_class, 2 FROM cm
    UNION ALL SELECT DISTINCT {_E}, element_class, 3 FROM mat"""


#: Paths with what their statements need: marks on one path of each component and one of each element of a product, and what the product states.
_MARKED = """SELECT t.*, product_class, here FROM (SELECT *, SUM(kg_taxed * elem_best) OVER (PARTITION BY ord, element_class) / pmass AS stated, row_number() OVER (PARTITION BY ord, element_class ORDER BY sup, prt) AS element_at
    FROM (SELECT *, row_number() OVER (PARTITION BY ord, sup ORDER BY prt) AS at FROM path) w) t LEFT JOIN (SELECT ord, MIN(product_class) AS product_class, TRUE AS here FROM placed GROUP BY ord) o ON t.ord = o.ord WHERE t.ord IS NOT NULL"""
#: The statements that a path x brings; those of products that have no place are left out.
_BROUGHT = """filter(array(CASE WHEN x.at = 1 AND here THEN {top} END, {middle}, CASE WHEN x.element_class IS NOT NULL THEN {bottom} END, CASE WHEN x.element_at = 1 AND here AND x.element_class IS NOT NULL THEN {across} END), s -> s IS NOT NULL)"""
_CLASSES = {
    "top": "'whole_cls', product_class, 'part_cls', x.component_class, 'whole_rank', 0, 'part_rank', 1", "middle": "'whole_cls', x.component_class, 'part_cls', x.material_class, 'whole_rank', 1, 'part_rank', 2",
    "bottom": "'whole_cls', x.material_class, 'part_cls', x.element_class, 'whole_rank', 2, 'part_rank', 3", "across": "'whole_cls', product_class, 'part_cls', x.element_class, 'whole_rank', 0, 'part_rank', 3"}
_ENDS = {"top": (_P, _C, "x.f1"), "middle": (_C, _M, "x.f2"), "bottom": (_M, _E, "x.f3"), "across": (_P, _E, "x.stated")}
_of_path = lambda text: text.replace("(sup ", "(x.sup ").replace("(prt ", "(x.prt ").replace("element_class", "x.element_class")
_KINDS_BROUGHT = _BROUGHT.format(**{k: f"named_struct({c})" for k, c in _CLASSES.items()})
_STATEMENTS_BROUGHT = _BROUGHT.format(**{k: f"named_struct('id', concat({_of_path(w)}, '>', {_of_path(p)}), 'whole', {_of_path(w)}, 'part', {_of_path(p)}, 'fraction', {f}, {_CLASSES[k]})" for k, (w, p, f) in _ENDS.items()})
_ITEM = ("sup", "prt", "at", "element_at", "component_class", "material_class", "element_class", "f1", "f2", "f3", "stated")
#: The statements of all paths with their order and the classes and ranks of both ends, from one pass.
_RANKED = f"SELECT ord, inline({_STATEMENTS_BROUGHT}) FROM (SELECT ord, product_class, here, struct({', '.join(_ITEM)}) AS x FROM ({_MARKED}) m) i"
#: Orders with their paths, as one row (fits) if they bring GROUP statements at most, else as a row for each path.
_PACKED = f"""SELECT ord, MIN(product_class) AS product_class, MIN(here) AS here, n <= {GROUP} AS fits, collect_list(struct({', '.join(_ITEM)})) AS paths
    FROM (SELECT *, SUM(1 + CASE WHEN at = 1 AND here THEN 1 ELSE 0 END + CASE WHEN element_class IS NULL THEN 0 WHEN element_at = 1 AND here THEN 2 ELSE 1 END) OVER (PARTITION BY ord) AS n FROM ({_MARKED}) m) c GROUP BY ord, n, CASE WHEN n > {GROUP} THEN struct(sup, prt) END"""
#: Line items of a larger file are dealt once, and their orders written as rows; a smaller file is passed over three times.
PACKED_BYTES = 4_000_000


def materialize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the statements of all orders."""
    taxonomy = sql_query("SELECT child, parent FROM taxonomy")(spark, sf_dir)
    if shared.size_of(spark, f"{sf_dir}/lineitem.parquet") <= PACKED_BYTES:
        out = materialized_ranked(sql_query(_RANKED)(spark, sf_dir), taxonomy, within="ord")
    else:
        out = _packed_rules(sql_query(_PACKED)(spark, sf_dir), taxonomy)
    return out.withColumn("value", F.round("value", 9))


def _packed_rules(packed: DataFrame, taxonomy: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The rules of orders that are written to the shared folder in rows first; what they need of an order is then read, without exchanges."""
    spark = packed.sparkSession
    shared.checkpoint_folder(spark)
    scratch = shared.new_path(spark, "orders")
    packed.write.option("compression", "zstd").parquet(scratch)
    orders = spark.read.schema(packed.schema).parquet(scratch)
    paths = orders.select("ord", "product_class", "here", "fits", F.explode("paths").alias("x"))
    out = _class_rules(paths.select(F.expr(f"inline({_KINDS_BROUGHT})")).distinct().select(*_KINDS), taxonomy, levels)
    small = orders.filter("fits").select(F.expr(f"flatten(transform(paths, x -> {_STATEMENTS_BROUGHT}))").alias("edges"))
    out = out.unionByName(_group_rules(small, levels))
    large = paths.filter("NOT fits")
    return out if large.isEmpty() else out.unionByName(_own_rules(large.select("ord", F.expr(f"inline({_STATEMENTS_BROUGHT})")), levels))


_UP = "(SELECT descendant, ancestor FROM closure UNION SELECT child, child FROM taxonomy UNION SELECT parent, parent FROM taxonomy)"
#: The same rows by joins of the levels that the given tables have.
_CHECK = f"""WITH co AS (SELECT {_P} AS p, {_E} AS e, concat({_P}, '>', {_E}) AS id, lo, ord, element_class FROM coarse),
    fill AS (SELECT id, p AS a, concat(id, '-unknownComponent') AS b FROM co UNION ALL SELECT id, concat(id, '-unknownComponent'), concat(id, '-unknownMaterial') FROM co UNION ALL SELECT id, concat(id, '-unknownMaterial'), e FROM co),
    direct AS (SELECT DISTINCT t.product_class AS w, c.component_class AS p FROM pc c JOIN placed t ON c.ord = t.ord UNION SELECT DISTINCT component_class, material_class FROM cm UNION SELECT DISTINCT material_class, element_class FROM mat
        UNION SELECT DISTINCT t.product_class, 'unknownComponent' FROM coarse c JOIN placed t ON c.ord = t.ord UNION SELECT 'unknownComponent', 'unknownMaterial' FROM coarse UNION SELECT 'unknownMaterial', element_class FROM coarse),
    up AS (SELECT * FROM {_UP} u UNION SELECT DISTINCT w, w FROM direct UNION SELECT DISTINCT p, p FROM direct),
    step AS (SELECT DISTINCT a.ancestor AS w, b.ancestor AS p FROM direct d JOIN up a ON d.w = a.descendant JOIN up b ON d.p = b.descendant),
    two AS (SELECT DISTINCT a.w, b.p FROM step a JOIN step b ON a.p = b.w), three AS (SELECT DISTINCT a.w, b.p FROM two a JOIN step b ON a.p = b.w),
    e1 AS (SELECT {_P} AS a, {_C} AS b, best AS f, concat({_P}, '>', {_C}) AS k FROM pc), e2 AS (SELECT {_C} AS a, {_M} AS b, best AS f, concat({_C}, '>', {_M}) AS k FROM cm), e3 AS (SELECT {_M} AS a, {_E} AS b, elem_best AS f, concat({_M}, '>', {_E}) AS k FROM mat),
    paths AS (SELECT a, b, k, f FROM e1 UNION ALL SELECT a, b, k, f FROM e2 UNION ALL SELECT a, b, k, f FROM e3
        UNION ALL SELECT e1.a, e2.b, concat(e1.k, '|', e2.k), e1.f * e2.f FROM e1 JOIN e2 ON e1.b = e2.a UNION ALL SELECT e2.a, e3.b, concat(e2.k, '|', e3.k), e2.f * e3.f FROM e2 JOIN e3 ON e2.b = e3.a
        UNION ALL SELECT e1.a, e3.b, concat(e1.k, '|', e2.k, '|', e3.k), e1.f * e2.f * e3.f FROM e1 JOIN e2 ON e1.b = e2.a JOIN e3 ON e2.b = e3.a
        UNION ALL SELECT p, concat(id, '-unknownComponent'), concat(id, '-', id, '-unknownComponent'), CAST(NULL AS DOUBLE) FROM co
        UNION ALL SELECT p, concat(id, '-unknownMaterial'), concat(id, '-', id, '-unknownComponent|', id, '-', id, '-unknownMaterial'), CAST(NULL AS DOUBLE) FROM co
        UNION ALL SELECT p, e, concat(id, '-', id, '-unknownComponent|', id, '-', id, '-unknownMaterial|', id, '-', e), CAST(NULL AS DOUBLE) FROM co)
    SELECT 'fillers' AS rule, a AS subject, b AS object, id AS key, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS BOOLEAN) AS holds FROM fill
    UNION ALL SELECT 'lift', w, p, NULL, NULL, NULL FROM step
    UNION ALL SELECT 'propagate', a, b, k, round(f, 9), NULL FROM paths
    UNION ALL SELECT 'class_reach', w, p, NULL, NULL, NULL FROM (SELECT * FROM step UNION SELECT * FROM two UNION SELECT * FROM three) r
    UNION ALL SELECT 'reconcile', co.p, co.e, co.id, round(CASE WHEN co.lo - r.amount > 1.0E-9 THEN co.lo - r.amount ELSE 0 END, 9), co.lo - r.amount >= -1.0E-9 FROM co JOIN reach r ON co.ord = r.ord AND co.element_class = r.element_class
    UNION ALL SELECT 'conservation', a, NULL, NULL, round(SUM(f), 9), FALSE FROM (SELECT a, f FROM e1 UNION ALL SELECT a, f FROM e2 UNION ALL SELECT a, f FROM e3) s GROUP BY a HAVING SUM(f) > 1 + 1.0E-9"""

QUERIES = {"materialize_rules": materialize_rules}
ORACLE = {"materialize_rules": _CHECK}

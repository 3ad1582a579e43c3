"""Planning of benchmark questions: contexts, pools of challenge plans, balanced orders, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.selection import trailing_number
from quarry.operators.sequences import overlapping_batches, top_per_group


def unit_contexts(nodes: DataFrame, units: DataFrame, least: int = 2) -> DataFrame:
    """Units with `least` components or more, and these in natural order."""
    rows = nodes.join(units, "unit_id").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct(trailing_number(F.col("kc_id")).alias("n"), "kc_id"))).alias("k"))
    return rows.filter(F.size("k") >= least).select("unit_id", F.transform("k", lambda x: x["kc_id"]).alias("kc_ids"))


def macro_contexts(nodes: DataFrame, limit: int = 30, least_units: int = 2) -> DataFrame:
    """Per macro with two components and units or more, batches of at most `limit` components that overlap."""
    fit = nodes.groupBy("macro_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("u")).filter((F.col("n") >= 2) & (F.col("u") >= least_units))
    rows = overlapping_batches(nodes.join(fit.select("macro_id"), "macro_id", "left_semi"), ["macro_id"], [trailing_number(F.col("kc_id")), "kc_id"], limit)
    return rows.groupBy("macro_id", "batch").agg(F.array_sort(F.collect_list("kc_id")).alias("kc_ids"))


def adjacent_contexts(macro_edges: DataFrame, nodes: DataFrame, k: int = 12) -> DataFrame:
    """Per macro edge the k best components of either side; edges with an empty side are skipped_macro_edges."""
    top = top_per_group(nodes, ["macro_id"], [F.desc("score"), trailing_number(F.col("kc_id"))], k).groupBy("macro_id").agg(F.array_sort(F.collect_list("kc_id")).alias("kc_ids"))
    s, t = top.select(F.col("macro_id").alias("source"), F.col("kc_ids").alias("source_kc_ids")), top.select(F.col("macro_id").alias("target"), F.col("kc_ids").alias("target_kc_ids"))
    return macro_edges.join(s, "source").join(t, "target")


def skipped_units(units: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(unit_id, n_kcs) of units with fewer than `least` components."""
    n = nodes.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_kcs"))
    return units.select("unit_id").join(n, "unit_id", "left").fillna(0, ["n_kcs"]).filter(F.col("n_kcs") < least)


def skipped_macros(macros: DataFrame, nodes: DataFrame) -> DataFrame:
    """(macro_id, n_kcs, n_units) of macros with fewer than two components or units."""
    n = nodes.groupBy("macro_id").agg(F.count(F.lit(1)).alias("n_kcs"), F.countDistinct("unit_id").alias("n_units"))
    return macros.select("macro_id").join(n, "macro_id", "left").fillna(0, ["n_kcs", "n_units"]).filter("n_kcs < 2 or n_units < 2")


def skipped_macro_edges(macro_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Macro edges of which a side has no component."""
    has = nodes.select(F.col("macro_id").alias("_m")).distinct()
    a = macro_edges.join(has, F.col("source") == F.col("_m"), "left_anti")
    return a.union(macro_edges.join(has, F.col("target") == F.col("_m"), "left_anti")).distinct()


def bank_counts(macros: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Per macro how many components the bank has and how many of them are active."""
    bank = nodes.groupBy("macro_id").agg(F.count(F.lit(1)).alias("bank_count"))
    live = nodes.join(active.select("kc_id"), "kc_id", "left_semi").groupBy("macro_id").agg(F.count(F.lit(1)).alias("active_count"))
    return macros.join(bank, "macro_id", "left").join(live, "macro_id", "left").fillna(0, ["bank_count", "active_count"])


def _best(limit: int, *order: Column | str):
    return lambda rows: rows.orderBy(*order).limit(limit)


def overclaim_plans(nodes: DataFrame, limit: int = 12, strong: Sequence[str] = ("strong", "general")) -> DataFrame:
    """The best-scored components whose claim is strong or general, as plans to overstate them."""
    rows = nodes.filter(F.col("claim_strength").isin(*strong) | F.coalesce(F.col("is_general"), F.lit(False)))
    return _best(limit, F.desc("score"), trailing_number(F.col("kc_id")))(rows).select(F.lit("overclaim_challenge").alias("challenge_type"), F.array("kc_id").alias("kc_ids"), F.array().cast("array<string>").alias("edge_ids"), F.col("claim").alias("trap"))


def false_premise_plans(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """Forbidden claims of the best-scored components, in their order, as false premises."""
    rows = nodes.select("kc_id", "score", F.posexplode("forbidden_claims").alias("at", "trap"))
    return _best(limit, F.desc("score"), trailing_number(F.col("kc_id")), "at")(rows).select(F.lit("false_premise_challenge").alias("challenge_type"), F.array("kc_id").alias("kc_ids"), F.array().cast("array<string>").alias("edge_ids"), "trap")


def wrong_relation_plans(edges: DataFrame, active: DataFrame, limit: int = 12) -> DataFrame:
    """Edges between active components, in natural order, to be turned around. Of edges of one id those of the later relation come first, then nearer targets, so that no tie is left."""
    a = active.select(F.col("kc_id").alias("_k"))
    rows = edges.join(a, F.col("source") == F.col("_k"), "left_semi").join(a, F.col("target") == F.col("_k"), "left_semi")
    trap = F.format_string("%s %s %s", F.col("target"), F.col("relation"), F.col("source"))
    return _best(limit, trailing_number(F.col("edge_id")), "edge_id", F.desc("relation"), trailing_number(F.col("target")), "target", "source")(rows).select(F.lit("wrong_relation_challenge").alias("challenge_type"), F.array("source", "target").alias("kc_ids"), F.array("edge_id").alias("edge_ids"), trap.alias("trap"))


def thread_plans(threads: DataFrame, types: Sequence[str] = ("thread_wrong_bridge", "thread_overclaim", "thread_premise_mutation"), per_thread: int = 3, target: int = 24) -> DataFrame:
    """Up to `per_thread` plans of fixed types for each thread, `target` in all."""
    rows = threads.select("thread_id", F.posexplode(F.array(*[F.lit(t) for t in types[:per_thread]])).alias("at", "challenge_type"))
    return rows.orderBy(trailing_number(F.col("thread_id")), "thread_id", "at").limit(target).drop("at")


def balanced(plans: DataFrame, types: Sequence[str], order: Sequence[Column | str], target: int) -> DataFrame:
    """One plan of each type in turn, in the fixed order of types, up to the target; then ids CHP_0001 and on. A pool holds some dozens."""
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("challenge_type"))
    turn = F.row_number().over(Window.partitionBy("challenge_type").orderBy(*order))
    rows = plans.withColumn("_turn", turn).withColumn("_type", place).orderBy("_turn", "_type").limit(target)
    return rows.withColumn("challenge_plan_id", F.format_string("CHP_%04d", F.row_number().over(Window.orderBy("_turn", "_type")))).drop("_turn", "_type")


def deduplicated(plans: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Plans of equal type, components, edges and trap once, the first in order."""
    at = F.row_number().over(Window.partitionBy("challenge_type", F.array_join("kc_ids", ","), F.array_join("edge_ids", ","), "trap").orderBy(*order))
    return plans.withColumn("_at", at).filter("_at = 1").drop("_at")


def next_plan(plans: DataFrame, order: Sequence[Column | str], used: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """The first plan that is neither used nor tried `most` times. used and attempts: challenge_plan_id, and n in attempts."""
    tired = attempts.filter(F.col("n") >= most).select("challenge_plan_id")
    return plans.join(used.select("challenge_plan_id"), "challenge_plan_id", "left_anti").join(tired, "challenge_plan_id", "left_anti").orderBy(*order).limit(1)


def main_targets(nodes: DataFrame, active: DataFrame, k: int = 3) -> DataFrame:
    """Per macro its active components, or its k best where none is active."""
    live = nodes.join(active.select("kc_id"), "kc_id", "left_semi")
    rest = nodes.join(live.select("macro_id").distinct(), "macro_id", "left_anti")
    chosen = live.select("macro_id", "kc_id").unionByName(top_per_group(rest, ["macro_id"], [F.desc("score"), trailing_number(F.col("kc_id"))], k).select("macro_id", "kc_id"))
    return chosen.groupBy("macro_id").agg(F.array_sort(F.collect_list("kc_id")).alias("target_kc_ids"))


def asset_references(nodes: DataFrame) -> DataFrame:
    """Per asset the components that rest on it, in natural order."""
    rows = nodes.filter("asset_id is not null").groupBy("asset_id", "asset_type").agg(F.array_sort(F.collect_set(F.struct(trailing_number(F.col("kc_id")).alias("n"), "kc_id"))).alias("k"))
    return rows.select("asset_id", "asset_type", F.transform("k", lambda x: x["kc_id"]).alias("kc_ids"))


def resolved_sections(groups: DataFrame, macros: DataFrame) -> DataFrame:
    """groups with macro_id and resolution: one macro names the section, none does, or several do. Names match by id or title, case apart."""
    names = macros.select("macro_id", F.explode("source_sections").alias("s")).select("macro_id", F.lower(F.trim("s")).alias("_s")).distinct()
    keys = groups.select("section_id", F.explode(F.array(F.lower(F.trim("section_id")), F.lower(F.trim("section_title")))).alias("_s"))
    hits = keys.join(names, "_s").groupBy("section_id").agg(F.countDistinct("macro_id").alias("_n"), F.min("macro_id").alias("_m"))
    rows = groups.join(hits, "section_id", "left")
    return rows.withColumn("macro_id", F.when(F.col("_n") == 1, F.col("_m"))).withColumn("resolution", F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") == 1, "resolved").otherwise("ambiguous")).drop("_n", "_m")


def evaluation_context(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """(paper_id, text): blocks in order, assets in place of the first block they cover, their other blocks left out. assets: paper_id, block_ids, rendered."""
    covered = assets.select("paper_id", F.posexplode("block_ids").alias("at", "block_id"), "rendered")
    rows = blocks.join(covered, ["paper_id", "block_id"], "left").filter("at is null or at = 0")
    per = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("order", F.coalesce("rendered", "text").alias("t")))).alias("p"))
    return per.select("paper_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def quota_first(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], id: str, order: Sequence[Column | str], quota: Column, minimum: int, limit: int) -> DataFrame:
    """(keys, place, source, ids): each group's first `limit` plans: `minimum` nodes of the quota's kind, then nodes by rank, then edges that touch a node.

    edges: keys, edge_id, source, target, whose order is edge_id's number; both ends must be among the nodes' group, so an edge touches one at
    either end by a union of two semi joins. Only `limit` rows of each source of a group are ranked together.
    """
    of = lambda *c: Window.partitionBy(*keys, *c).orderBy(*order, id)
    ranked = nodes.withColumn("_q", F.coalesce(quota, F.lit(False))).withColumn("_at", F.row_number().over(of("_q"))).filter(F.col("_at") <= limit)
    chosen = F.col("_q") & (F.col("_at") <= minimum)
    first = ranked.filter(chosen).select(*keys, F.lit(0).alias("_tier"), F.col("_at").cast("long").alias("_by"), F.lit("quota").alias("source"), F.array(id).alias("ids"))
    rest = ranked.filter(~chosen).withColumn("_by", F.row_number().over(of()).cast("long")).filter(F.col("_by") <= limit)
    rest = rest.select(*keys, F.lit(1).alias("_tier"), "_by", F.lit("rank").alias("source"), F.array(id).alias("ids"))
    end = lambda c: edges.join(nodes.select(*keys, F.col(id).alias(c)).distinct(), [*keys, c], "left_semi")
    touching = end("source").unionByName(end("target")).distinct()
    by = Window.partitionBy(*keys).orderBy(trailing_number(F.col("edge_id")), "edge_id")
    last = touching.withColumn("_by", F.row_number().over(by).cast("long")).filter(F.col("_by") <= limit).select(*keys, F.lit(2).alias("_tier"), "_by", F.lit("edge").alias("source"), F.array("edge_id", "source", "target").alias("ids"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_tier", "_by"))
    return first.unionByName(rest).unionByName(last).withColumn("place", place).filter(F.col("place") <= limit).select(*keys, "place", "source", "ids")


def short_of_quota(nodes: DataFrame, keys: Sequence[str], quota: Column, minimum: int) -> DataFrame:
    """(keys, n): groups that have fewer nodes of the quota's kind than it asks for."""
    return nodes.groupBy(*keys).agg(F.count_if(F.coalesce(quota, F.lit(False))).alias("n")).filter(F.col("n") < minimum)


# The roles of thread turns whose relations are put to the test.
RELATION_ROLES = ("bridge_reasoning", "review_consistency")


def thread_relation_plans(turns: DataFrame, edges: DataFrame, nodes: DataFrame, keys: Sequence[str], limit: int = 12) -> DataFrame:
    """(keys, place, thread_id, thread_turn_id, edge_ids, kc_ids): each group's first turns that rest on known edges between two components or more.

    turns: keys, thread_id, thread_turn_id, role, supporting_edge_ids; edges: keys, edge_id, source, target; nodes: keys, kc_id. Edges and
    components keep the order in which the turn names them, each component once.
    """
    named = turns.filter(F.col("role").isin(*RELATION_ROLES)).select(*keys, "thread_id", "thread_turn_id", F.posexplode("supporting_edge_ids").alias("_at", "edge_id"))
    known = named.join(edges.select(*keys, "edge_id", "source", "target"), [*keys, "edge_id"])
    ends = known.select(*keys, "thread_id", "thread_turn_id", "_at", "edge_id", F.posexplode(F.array("source", "target")).alias("_end", "kc_id"))
    live = nodes.select(*keys, "kc_id").distinct().withColumn("_live", F.lit(True))
    ends = ends.join(live, [*keys, "kc_id"], "left")
    turn = [*keys, "thread_id", "thread_turn_id"]
    listed = ends.groupBy(*turn).agg(  # a turn names some edges
        F.array_sort(F.collect_set(F.struct("_at", "edge_id"))).alias("_e"), F.array_sort(F.collect_list(F.when(F.col("_live"), F.struct("_at", "_end", "kc_id")))).alias("_k"))
    listed = listed.select(*turn, F.col("_e.edge_id").alias("edge_ids"), F.array_distinct(F.col("_k.kc_id")).alias("kc_ids")).filter(F.size("kc_ids") >= 2)
    order = Window.partitionBy(*keys).orderBy(trailing_number(F.col("thread_id")), "thread_id", trailing_number(F.col("thread_turn_id")), "thread_turn_id")
    return listed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)

"""Graphs as node and edge tables: centrality, connectivity, two-hop paths, coverage, and their text form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import discard, written


def log_degree(degree: Column, most: Column) -> Column:
    """ln(1 + d) over ln(1 + max); 0.0 in a graph without edges."""
    return F.when(most > 0, F.ln(1 + degree) / F.ln(1 + most)).otherwise(0.0)


def _entropy(counts: DataFrame, node: str, categories: Column) -> DataFrame:
    """(node, entropy): Shannon entropy of the counts n per node, over the logarithm of how many categories there are."""
    total = counts.groupBy(node).agg(F.sum("n").alias("_t"), F.sum(F.col("n") * F.ln("n")).alias("_s"), F.first(categories).alias("_c"))
    return total.select(node, F.when(F.col("_c") > 1, (F.ln("_t") - F.col("_s") / F.col("_t")) / F.ln("_c")).otherwise(0.0).alias("entropy"))


def centrality(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str, degree_weight: float = 0.7, entropy_weight: float = 0.3) -> DataFrame:
    """Per node: degree (edges counted as often as they occur), log_degree, entropy of its neighbours, centrality."""
    both = edges.select(F.col(source).alias("_n"), F.col(target).alias("_m")).unionAll(edges.select(F.col(target), F.col(source)))
    pairs = both.groupBy("_n", "_m").agg(F.count(F.lit(1)).alias("n"))
    total = nodes.agg(F.count(F.lit(1)).alias("_all"))  # one row
    entropy = _entropy(pairs.crossJoin(F.broadcast(total)), "_n", F.col("_all"))
    degree = pairs.groupBy("_n").agg(F.sum("n").alias("degree"))
    most = degree.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("_most"))  # one row
    rows = nodes.join(degree.join(entropy, "_n"), nodes[node] == F.col("_n"), "left").fillna(0, ["degree", "entropy"]).crossJoin(F.broadcast(most))
    rows = rows.withColumn("log_degree", log_degree(F.col("degree"), F.col("_most")))
    return rows.withColumn("centrality", degree_weight * F.col("log_degree") + entropy_weight * F.col("entropy")).drop("_n", "_most")


def connectivity(nodes: DataFrame, edges: DataFrame, node: str, category: str, source: str, target: str, degree_weight: float = 0.7, entropy_weight: float = 0.3) -> DataFrame:
    """As centrality, for distinct neighbours, with the entropy over the categories these belong to."""
    both = edges.select(F.col(source).alias("_n"), F.col(target).alias("_m")).union(edges.select(F.col(target), F.col(source))).filter("_n <> _m").distinct()
    of = nodes.select(F.col(node).alias("_m"), F.col(category).alias("_category"))
    return _connected(nodes, both.join(of, "_m").groupBy("_n", "_category").agg(F.count(F.lit(1)).alias("n")), node, category, degree_weight, entropy_weight)


def _connected(nodes: DataFrame, counts: DataFrame, node: str, category: str, degree_weight: float, entropy_weight: float) -> DataFrame:
    """nodes with degree, log_degree, entropy and connectivity from counts (_n, _category, n) of their neighbours."""
    total = nodes.agg(F.countDistinct(category).alias("_all"))  # one row
    entropy = _entropy(counts.crossJoin(F.broadcast(total)), "_n", F.col("_all"))
    degree = counts.groupBy("_n").agg(F.sum("n").alias("degree"))
    most = degree.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("_most"))
    rows = nodes.join(degree.join(entropy, "_n"), nodes[node] == F.col("_n"), "left").fillna(0, ["degree", "entropy"]).crossJoin(F.broadcast(most))
    rows = rows.withColumn("log_degree", log_degree(F.col("degree"), F.col("_most")))
    return rows.withColumn("connectivity", degree_weight * F.col("log_degree") + entropy_weight * F.col("entropy")).drop("_n", "_most")


def group_connectivity(
    nodes: DataFrame, groups: DataFrame, members: str, node: str, category: str, degree_weight: float = 0.7, entropy_weight: float = 0.3, most_sent: int = 5_000_000, size: int = 1 << 24
) -> DataFrame:
    """As connectivity, where all members of a group are neighbours: groups holds them as an array of longs, each once.

    A group's list goes once to each share of the nodes that some of its members lie in, and a share's neighbours are united there, node by
    node, so no pair becomes a row. A share takes about `size` members of lists. The nodes, with their categories, are sent to the tasks; where
    there are more than `most_sent` of them, or one id is there twice, pairs are made as edges.
    """
    known = nodes.filter(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("k"), F.col(category).alias("c"))
    sent = known.toArrow() if known.count() <= most_sent else None
    ids = None if sent is None else sent.column("k").to_numpy()
    if ids is None or not len(ids) or len(np.unique(ids)) < len(ids):
        # a node's neighbours are sent to it as one list a group, and pairs are made and counted once where they meet
        lists = groups.select(F.explode(members).alias("source"), F.col(members).alias("by")).select("source", F.filter("by", lambda x: x > F.col("source")).alias("by")).filter(F.size("by") > 0).repartition("source")
        edges = lists.select("source", F.explode("by").alias("target")).distinct()  # each pair once, by any group
        return connectivity(nodes, edges, node, category, "source", "target", degree_weight, entropy_weight)
    kinds = sent.column("c").combine_chunks().dictionary_encode("encode")
    order = np.argsort(ids)
    table = nodes.sparkSession.sparkContext.broadcast((ids[order], kinds.indices.to_numpy()[order], len(kinds.dictionary)))
    groups = written(groups.select(F.col(members).alias("by"), F.size(members).cast("long").alias("n")).filter("n > 1"), "graph-groups")
    heavy = groups.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    shares = int(max(1, min(len(ids), max(-(-heavy // size), int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))

    def spread(rows: np.ndarray, at: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        """Lists of places (rows, at; in order) as one record for each share: how long lists are, their places in two halves, and their members in the share."""
        long = np.bincount(rows, minlength=n)
        first = np.cumsum(long) - long
        own = at % shares
        by = np.lexsort((at, rows, own))
        share, row, member = own[by], rows[by], at[by]
        new = np.flatnonzero(np.concatenate([[True], (share[1:] != share[:-1]) | (row[1:] != row[:-1])]))
        of, many = row[new], np.diff(np.append(new, len(row)))
        lens = long[of]
        ends = np.cumsum(lens)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(share[new]) != 0])), len(new))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            start = ends[a] - lens[a]
            x = at[np.repeat(first[of[a:b]] - (ends[a:b] - lens[a:b] - start), lens[a:b]) + np.arange(ends[b - 1] - start)]
            stop = new[b] if b < len(new) else len(row)
            packed = [lens[a:b].astype("<i4"), (x & 0xFFFF).astype("<u2"), (x >> 16).astype("<u2"), many[a:b].astype("<i4"), member[new[a] : stop].astype("<i4")]
            out.append((int(share[new[a]]), *(p.tobytes() for p in packed)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["share", "lens", "low", "high", "many", "member"])

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = table.value[0]
        for b in batches:
            lists = b.column("by")
            long = np.diff(lists.offsets.to_numpy())
            flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(long)), long)
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            fit = ids[at] == flat
            row, at = row[fit], at[fit]
            by = np.lexsort((at, row))
            row, at = row[by], at[by]
            weight = np.cumsum(long * np.minimum(long, shares))  # what a list comes to, at most
            part = weight // (1 << 22)
            for p in np.unique(part):
                lo, hi = np.searchsorted(row, np.searchsorted(part, [p, p + 1]))
                if hi > lo:
                    yield from spread(row[lo:hi] - row[lo], at[lo:hi], int(row[hi - 1] - row[lo]) + 1)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of a share's nodes, counted by category; a few million at a time."""
        ids, kind, n_kinds = table.value
        held = {c: [] for c in ("lens", "low", "high", "many", "member")}
        for b in batches:
            for c, x in held.items():
                x += [np.frombuffer(v.as_buffer(), "<u2" if c in ("low", "high") else "<i4") for v in b.column(c)]
        if not held["lens"]:
            return
        lens, low, high, many, member = (np.concatenate(x) for x in held.values())
        held.clear()
        places = low.astype(np.int32) | (high.astype(np.int32) << 16)
        del low, high
        first = np.cumsum(lens, dtype=np.int64) - lens
        entry = np.repeat(np.arange(len(lens)), many)
        by = np.argsort(member, kind="stable")
        member, entry = member[by], entry[by]
        width = lens[entry].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))  # where a node's lists begin
        part = np.cumsum(np.add.reduceat(width, new)) // (1 << 22)
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, [p, p + 1])
            a, b = new[lo], new[hi] if hi < len(new) else len(member)
            w = width[a:b]
            x = places[np.repeat(first[entry[a:b]] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]
            of = np.repeat(np.repeat(np.arange(hi - lo), np.diff(np.append(new[lo:hi], b))), w)
            pairs = np.sort(of * len(ids) + x)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            of, x = pairs // len(ids), pairs % len(ids)
            self = member[new[lo:hi]]
            other = x != self[of]
            counts = np.bincount(of[other] * n_kinds + kind[x[other]], minlength=(hi - lo) * n_kinds)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[self[some // n_kinds]]), pa.array((some % n_kinds).astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["_n", "_category", "n"])

    sorted_out = groups.select("by").mapInArrow(sort_out, "share int, lens binary, low binary, high binary, many binary, member binary")
    counts = written(sorted_out.repartitionById(shares, "share").drop("share").mapInArrow(unite, "_n long, _category int, n long"), "graph-counts")
    table.destroy()
    discard(groups)
    return _connected(nodes, counts, node, category, degree_weight, entropy_weight)


def final_score(parts: dict[str, float]) -> Column:
    """A weighted sum of score columns, rounded to four places."""
    return F.round(sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in parts.items()), F.lit(0.0)), 4)


def two_hop_paths(edges: DataFrame, nodes: DataFrame, edge: str, source: str, target: str, node: str, category: str) -> DataFrame:
    """(a, b, c, first_edge, second_edge, pattern): three different nodes of two categories or more, each triple at its first edges."""
    of = nodes.select(F.col(node).alias("_k"), F.col(category).alias("_c"))
    e1 = edges.select(F.col(edge).alias("first_edge"), F.col(source).alias("a"), F.col(target).alias("b"))
    e2 = edges.select(F.col(edge).alias("second_edge"), F.col(source).alias("b"), F.col(target).alias("c"))
    paths = e1.join(e2, "b").filter("a <> b and b <> c and a <> c")
    for x in "abc":
        paths = paths.join(of.select(F.col("_k").alias(x), F.col("_c").alias(f"_{x}")), x)
    paths = paths.filter("not (_a <=> _b and _b <=> _c)").groupBy("a", "b", "c").agg(F.min(F.struct("first_edge", "second_edge")).alias("_e"), F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("_c").alias("_c"))
    return paths.select("a", "b", "c", "_e.first_edge", "_e.second_edge", F.concat_ws(" > ", "_a", "_b", "_c").alias("pattern"))


def with_endpoints(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str, category: str) -> DataFrame:
    """edges with the categories of both ends; edges with an unknown end are in unknown_endpoints."""
    s = nodes.select(F.col(node).alias(source), F.col(category).alias("source_category"))
    t = nodes.select(F.col(node).alias(target), F.col(category).alias("target_category"))
    return edges.join(s, source).join(t, target)


def unknown_endpoints(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    known = nodes.select(F.col(node).alias("_k"))
    return edges.join(known, F.col(source) == F.col("_k"), "left_anti").unionByName(edges.join(known, F.col(target) == F.col("_k"), "left_anti")).distinct()


def active_edges(edges: DataFrame, active: DataFrame, source: str, target: str, key: str, order: str, name: str = "edge_id") -> DataFrame:
    """Edges with both ends active, renumbered E1, E2 and so on in order. A list for one graph: its edges, not a corpus."""
    a = active.select(F.col(key).alias("_k"))
    kept = edges.join(a, F.col(source) == F.col("_k"), "left_semi").join(a, F.col(target) == F.col("_k"), "left_semi")
    return kept.withColumn(name, F.concat(F.lit("E"), F.row_number().over(Window.orderBy(order))))


def pair_coverage(edges: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """(source_category, target_category, n): every ordered pair of categories, also without edges. edges come from with_endpoints."""
    c = categories.select(category).distinct()
    pairs = c.select(F.col(category).alias("source_category")).crossJoin(F.broadcast(c.select(F.col(category).alias("target_category"))))  # categories are few
    counts = edges.groupBy("source_category", "target_category").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, ["source_category", "target_category"], "left").fillna(0, ["n"])


def isolated(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Nodes at which no edge ends."""
    ends = edges.select(F.col(source).alias(node)).union(edges.select(F.col(target)))
    return nodes.join(ends, node, "left_anti")


def edge_reuse(paths: DataFrame, edges_of: str = "supporting_edge_ids") -> DataFrame:
    """(edge_id, n_paths): how many paths rest on each edge."""
    return paths.select(F.explode(F.array_distinct(edges_of)).alias("edge_id")).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_paths"))


def mermaid(nodes: DataFrame, edges: DataFrame, node: str, label: str, source: str, target: str, relation: str, most: int = 120) -> DataFrame:
    """(part, id, line): the lines of a Mermaid graph, to be written in the order of part and id."""
    safe = lambda c: F.substring(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" ")), 1, most)
    head = nodes.sparkSession.createDataFrame([(0, "", "graph TD")], "part int, id string, line string")
    lines = nodes.select(F.lit(1).alias("part"), F.col(node).cast("string").alias("id"), F.format_string('    %s["%s"]', F.col(node).cast("string"), safe(label)).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.concat_ws(">", F.col(source).cast("string"), F.col(target).cast("string")).alias("id"), F.format_string("    %s -->|%s| %s", F.col(source).cast("string"), safe(relation), F.col(target).cast("string")).alias("line"))
    return head.unionByName(lines).unionByName(arrows)

"""Program graph: sinks, orphans, edge checks, order, dataset lineage, flow summaries, residue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.scalars import slugify
from tablesteps.operators.ordered import pick_rows, row_counter
from tablesteps.plans.components import levels_by_part
from tablesteps.plans.programs import program_datasets
from tablesteps.session import stage


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nobody consumes from."""
    out = edges.select(F.col("source").alias("id")).distinct()
    return nodes.join(out, "id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, native: str | None = None) -> DataFrame:
    """Nodes at no end of any edge; rows with a true ``native`` flag are exempt."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    lone = nodes.join(ends, "id", "left_anti")
    return lone.filter(~F.coalesce(native, F.lit(False))) if native else lone


def validate_edges(edges: DataFrame, nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct edges -> (source, target, kept, reason).

    Kept if both ends are nodes; else endpoint_unknown (an end is no element at all) or
    endpoint_not_node.
    """
    known = (
        elements.select("id", F.lit(False).alias("_node"))
        .unionByName(nodes.select("id", F.lit(True).alias("_node")))
        .groupBy("id")
        .agg(F.bool_or("_node").alias("_node"))
    )
    clean = edges.filter("source <> '' AND target <> ''").select("source", "target").distinct()
    src = known.select(F.col("id").alias("source"), F.col("_node").alias("_s"))
    dst = known.select(F.col("id").alias("target"), F.col("_node").alias("_t"))
    both = clean.join(src, "source", "left").join(dst, "target", "left")
    kept = F.coalesce("_s", F.lit(False)) & F.coalesce("_t", F.lit(False))
    return both.select(
        "source",
        "target",
        kept.alias("kept"),
        F.when(kept, "")
        .when(F.col("_s").isNull() | F.col("_t").isNull(), "endpoint_unknown")
        .otherwise("endpoint_not_node")
        .alias("reason"),
    )


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one predecessor and one successor -> (id, head, dist), and those on a ring of only such nodes.

    ``head`` is the first node before the chain, ``dist`` the steps to it. Every round doubles the reach, so
    a chain of n nodes takes about log2(n) rounds.
    """
    ends = links.select(F.col("source").alias("id"), F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    ends = ends.unionByName(links.select(F.col("target").alias("id"), F.lit(1).alias("_in"), F.lit(0).alias("_out")))
    inner = ends.groupBy("id").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out")).filter("_in = 1 AND _out = 1").select("id")
    reach = links.join(inner, links["target"] == inner["id"], "left_semi")
    reach = stage(reach.select(F.col("target").alias("id"), F.col("source").alias("head"), F.lit(1).cast("long").alias("dist")), "chain")
    rounds = max(1, reach.count()).bit_length() + 1
    for _ in range(rounds):
        onward = reach.select(F.col("id").alias("_h"), F.col("head").alias("_head"), F.col("dist").alias("_dist"))
        joined = reach.join(onward, F.col("head") == F.col("_h"), "left")
        if joined.filter("_h IS NOT NULL").isEmpty():
            return reach, reach.limit(0)
        reach = stage(
            joined.select("id", F.coalesce("_head", "head").alias("head"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist")), "chain"
        )
    ring = reach.join(reach.select(F.col("id").alias("head")), "head", "left_semi")
    return reach.join(ring.select("id"), "id", "left_anti"), ring


def _known_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known nodes."""
    ids = nodes.select("id").distinct()
    links = edges.select("source", "target").distinct()
    links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return stage(links.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"), "edges")


def _levels(links: DataFrame) -> DataFrame:
    """``(id, level, on_cycle)`` of every end of an edge."""
    told, left = levels_by_part(links)
    if left.isEmpty():
        return told
    left = stage(left, "large")
    layered = stage(_layered_levels(left), "levels")
    ends = left.select(F.col("source").alias("id")).union(left.select("target")).distinct()
    stuck = ends.join(layered, "id", "left_anti")
    cyclic = left.join(stuck.withColumnRenamed("id", "source"), "source", "left_semi").join(stuck.withColumnRenamed("id", "target"), "target", "left_semi")
    on = cycle_members(cyclic).withColumn("on_cycle", F.lit(True))
    large = ends.join(layered, "id", "left").join(on, "id", "left")
    return told.unionByName(large.select("id", "level", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")))


def cycle_members(links: DataFrame) -> DataFrame:
    """``(id)`` on a cycle, by forward and backward colours: for parts that no task can hold.

    Every vertex takes the greatest colour that reaches it; the vertices that reach the owner of their
    colour within it are one strongly connected component, and are taken off. The rest goes round again.
    """
    owns = links.filter("source = target").select(F.col("source").alias("id"))
    links = stage(links.filter("source <> target").distinct(), "cyclic")
    found = [owns]
    while not links.isEmpty():
        ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
        colour = _spread(ends.select("id", F.col("id").alias("colour")), links, "source", "target")
        of = lambda c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"_{c}"))
        same = stage(links.join(of("source"), "source").join(of("target"), "target").filter("_source = _target").select("source", "target"), "same")
        # back from the owners, inside their colours
        back = _spread(ends.select("id", F.lit(False).alias("colour")).join(colour.filter("id = colour").select("id", F.lit(True).alias("_own")), "id", "left")
                       .select("id", F.coalesce("_own", "colour").alias("colour")), same, "target", "source")
        part = colour.join(back.filter("colour").select("id"), "id", "left_semi")
        size = part.groupBy("colour").count().filter("count > 1")
        found.append(stage(part.join(size, "colour", "left_semi").select("id"), "component"))
        gone = stage(part.select("id"), "gone")
        links = links.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        links = stage(links.select("source", "target"), "cyclic")
    return reduce(lambda a, b: a.union(b), found).distinct()


def _spread(value: DataFrame, links: DataFrame, start: str, end: str) -> DataFrame:
    """The greatest ``colour`` that reaches each id along the edges, in rounds until nothing changes."""
    value = stage(value, "colour")
    while True:
        sent = links.join(value.select(F.col("id").alias(start), "colour"), start).groupBy(F.col(end).alias("id")).agg(F.max("colour").alias("_sent"))
        new = stage(value.join(sent, "id", "left").select("id", F.greatest("colour", "_sent").alias("colour"), (F.col("_sent") > F.col("colour")).alias("_more")), "colour")
        value = new.select("id", "colour")
        if new.filter("_more").isEmpty():
            return value


def topo_order(nodes: DataFrame, edges: DataFrame, position: str = "pos") -> DataFrame:
    """Execution order -> (id, level, topo_order from 0).

    A node's level is the longest way to it from a node without predecessors. Nodes are ordered by (level,
    position, id); nodes on or behind a cycle come last by position with no level (``cycles`` tells them apart).
    Any such order is valid; within a level it may differ from a queue-driven one.
    """
    nodes = nodes.select("id", F.col(position).alias("_pos"))
    levels = _levels(_known_links(nodes, edges)).withColumn("_met", F.lit(True))
    every = nodes.join(levels, "id", "left").withColumn("level", F.when(F.col("_met"), F.col("level")).otherwise(F.lit(0).cast("long")))
    ranked = row_counter(every.select("id", "_pos", "level"), ["level", "_pos", "id"], name="_n", nulls="last")
    return ranked.select("id", "level", (F.col("_n") - 1).alias("topo_order"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no order can place -> (id, place): ``on`` a cycle, or ``behind`` one (between two included)."""
    stuck = _levels(_known_links(nodes, edges)).filter("level IS NULL")
    return stuck.select("id", F.when(F.col("on_cycle"), "on").otherwise("behind").alias("place"))


def _layered_levels(links: DataFrame) -> DataFrame:
    """``(id, level)`` of the ends of ``links`` that are on or behind no cycle, for parts that no task can hold.

    Chains are contracted first; what is left is taken off layer by layer, one staged round per layer, so the
    plan does not grow with the depth.
    """
    chain, _ = _chains(links)
    inner = links.groupBy("target").count().filter("count = 1").join(
        links.groupBy("source").count().filter("count = 1").select(F.col("source").alias("target")), "target", "left_semi"
    )
    far = links.join(inner, "target", "left_anti").join(chain.select(F.col("id").alias("source"), "head", "dist"), "source", "left")
    # edges between the nodes outside chains; base is the level an edge asks for once its source has one
    waiting = stage(
        far.select(F.coalesce("head", "source").alias("source"), "target", (F.coalesce("dist", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("long").alias("base")),
        "waiting",
    )
    targets = links.select(F.col("target").alias("id")).distinct()
    layers = [stage(links.select(F.col("source").alias("id")).distinct().join(targets, "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")), "layer")]
    while True:
        fresh = layers[-1].select(F.col("id").alias("source"), "level")
        waiting = waiting.join(fresh, "source", "left").select(
            "source", "target", "steps", F.coalesce("base", F.col("level") + F.col("steps")).alias("base")
        )
        waiting = stage(waiting, "waiting")
        layer = waiting.groupBy("target").agg(F.max("base").alias("level"), F.count_if(F.col("base").isNull()).alias("_open"))
        layer = stage(layer.filter("_open = 0").select(F.col("target").alias("id"), "level"), "layer")
        if layer.isEmpty():
            break
        layers.append(layer)
        waiting = waiting.join(layer.select(F.col("id").alias("target")), "target", "left_anti")
    levels = reduce(lambda a, b: a.unionByName(b), layers)
    inside = chain.join(levels.select(F.col("id").alias("head"), "level"), "head").select("id", (F.col("level") + F.col("dist")).alias("level"))
    return levels.unionByName(inside)


def predecessors(edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(id, predecessor) rows, both ends in scope. Rows, because a node may have any number."""
    pairs = edges.select(F.col("target").alias("id"), F.col("source").alias("predecessor")).distinct()
    if scope is None:
        return pairs
    keys = scope.select("id").distinct()
    return pairs.join(keys, "id", "left_semi").join(keys.withColumnRenamed("id", "predecessor"), "predecessor", "left_semi")


def program_io(programs: DataFrame) -> DataFrame:
    """Programs with the dataset names of their own text: + (inputs, outputs) sorted arrays."""
    lists = program_datasets(programs)
    none = F.array().cast("array<string>")
    return programs.join(lists, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("inputs", "outputs")})


def _short(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dataset lineage -> (node_id, source_dataset, target_dataset, transformation).

    ``nodes(id, node_type, code, inputs, outputs)``. On each edge outputs and inputs match by full
    name; leftovers match on the last part. One row per (target node, source dataset). Each edge
    meets its two nodes' name lists and is matched within its row.
    """
    edges = edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    names = nodes.select("id", "inputs", "outputs", "node_type", F.upper("code").contains("JOIN").alias("_join"))

    def upper(col: str) -> Column:
        return F.array_distinct(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.upper(x)))

    src = names.select(F.col("id").alias("source"), F.sort_array(upper("outputs")).alias("_out"))
    dst = names.select(F.col("id").alias("target"), F.sort_array(upper("inputs")).alias("_in"), "node_type", "_join")
    rows = edges.join(src, "source").join(dst, "target")
    rows = rows.withColumn("_full", F.array_intersect("_out", "_in"))
    rows = rows.withColumns({"_ro": F.array_except("_out", "_full"), "_ri": F.array_except("_in", "_full")})
    full = F.transform("_full", lambda n: F.struct(n.alias("s"), n.alias("t")))
    loose = F.transform(
        F.filter("_ro", lambda x: F.get(F.filter("_ro", lambda z: _short(z) == _short(x)), F.lit(0)) == x),
        lambda x: F.struct(x.alias("s"), F.get(F.filter("_ri", lambda y: _short(y) == _short(x)), F.lit(0)).alias("t")),
    )
    pairs = F.concat(full, F.filter(loose, lambda p: p["t"].isNotNull()))
    word = (
        F.when(F.col("node_type").isin("PROC_SORT", "PROC_TRANSPOSE"), "reshape")
        .when(F.col("node_type").isin("PROC_MEANS", "PROC_FREQ"), "aggregate")
        .when(F.col("_join"), "join")
        .when(F.col("node_type") == "DATA_STEP", "derive")
        .otherwise("pass_through")
    )
    out = rows.select(F.col("target").alias("node_id"), word.alias("transformation"), F.inline(pairs))
    out = out.groupBy("node_id", F.col("s").alias("source_dataset"), "transformation").agg(F.min("t").alias("target_dataset"))
    return out.select("node_id", "source_dataset", "target_dataset", "transformation")


def lineage_coverage(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: nodes, entries, nodes with lineage and their share."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    return entries.agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("node_id").alias("covered_nodes")
    ).select(n.alias("nodes"), "entries", "covered_nodes", F.round(F.col("covered_nodes") / n, 4).alias("share"))


def preview_steps(nodes: DataFrame) -> DataFrame:
    """Queries that only looked at data -> (id).

    Query type, every output a WORK table with an automatic name, none of them read anywhere.
    """
    looked = nodes.filter(F.col("node_type") == "QUERY").filter(
        (F.size("outputs") > 0)
        & F.forall("outputs", lambda o: F.upper(o).startswith("WORK.") & F.upper(o).contains("QUERY_FOR_"))
    )
    consumed = nodes.select(F.explode("inputs").alias("_o")).select(F.upper("_o").alias("_o")).distinct()
    used = looked.select("id", F.explode("outputs").alias("_o")).withColumn("_o", F.upper("_o"))
    used = used.join(consumed, "_o", "left_semi")
    return looked.select("id").join(used.select("id").distinct(), "id", "left_anti")


def flow_datasets(nodes: DataFrame, group: str = "pfd_id") -> DataFrame:
    """(group, direction, dataset) rows: the distinct datasets and libraries of each flow."""

    def tagged(names: Column, direction: str) -> Column:
        return F.transform(names, lambda d: F.struct(F.lit(direction).alias("direction"), d.alias("dataset")))

    libs = F.array_distinct(F.transform(F.concat("inputs", "outputs"), lambda d: F.substring_index(d, ".", 1)))
    every = F.concat(tagged(F.col("inputs"), "input"), tagged(F.col("outputs"), "output"), tagged(libs, "library"))
    return nodes.select(group, F.inline(every)).distinct()


def flow_summary(nodes: DataFrame, flows: DataFrame, group: str = "pfd_id") -> DataFrame:
    """Per flow -> (group, pfd_label, container_type, node_count, node_types map, inputs, outputs,
    libraries, migratable, slug). Dataset lists are rows of ``flow_datasets``; here they are counted.

    ``flows(group, pfd_label)``; flows only nodes name are added without a label.
    """
    named = nodes.filter(F.coalesce(group, F.lit("")) != "")
    types = named.groupBy(group, "node_type").agg(F.count(F.lit(1)).alias("_n"))
    per_flow = types.groupBy(group).agg(  # one entry per node type
        F.sum("_n").alias("node_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_type", "_n")))).alias("node_types"),
    )
    lists = (
        flow_datasets(named, group)
        .groupBy(group)
        .agg(
            F.count_if(F.col("direction") == "input").alias("input_datasets"),
            F.count_if(F.col("direction") == "output").alias("output_datasets"),
            F.count_if(F.col("direction") == "library").alias("libraries"),
        )
    )
    every = flows.select(group, "pfd_label").unionByName(
        per_flow.select(group).join(flows.select(group), group, "left_anti"), allowMissingColumns=True
    )
    container = F.regexp_extract(group, "^(PFD|ProcessFlowContainer|OrderedListContainer)-", 1)
    container = F.when(container == "", "other").otherwise(container)
    out = every.join(per_flow, group, "left").join(lists, group, "left")
    count = F.coalesce("node_count", F.lit(0))
    return out.select(
        group,
        F.coalesce("pfd_label", F.lit("")).alias("pfd_label"),
        container.alias("container_type"),
        count.alias("node_count"),
        F.coalesce("node_types", F.create_map().cast("map<string,bigint>")).alias("node_types"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_datasets", "output_datasets", "libraries")],
        ((count > 0) & (container != "OrderedListContainer")).alias("migratable"),
        slugify(F.coalesce("pfd_label", F.lit(""))).alias("slug"),
    )


def residue(elements: DataFrame, nodes: DataFrame, dropped: DataFrame, orphan_code: DataFrame) -> DataFrame:
    """One row that accounts for everything an archive held.

    ``elements(id, type)``, ``nodes(id, code)``, ``dropped(reason)``, ``orphan_code(entry)``.
    Unexplained: tasks without a node, orphan code, edges to unknown ends.
    """
    n = F.count(F.lit(1))
    rest = elements.join(nodes.select("id"), "id", "left_anti")
    return rest.agg(
        F.count_if(F.col("type") == "TASK").alias("unmaterialized_tasks"),
        F.count_if(F.col("type") != "TASK").alias("expected_non_nodes"),
    ).select(
        elements.agg(n).scalar().alias("total_elements"),
        nodes.agg(n).scalar().alias("materialized_nodes"),
        nodes.agg(F.count_if(F.coalesce(F.col("code"), F.lit("")) == "")).scalar().alias("tasks_without_code"),
        "unmaterialized_tasks",
        "expected_non_nodes",
        orphan_code.agg(n).scalar().alias("orphan_code_entries"),
        dropped.agg(n).scalar().alias("dropped_edges"),
        (
            F.col("unmaterialized_tasks")
            + orphan_code.agg(n).scalar()
            + dropped.agg(F.count_if(F.col("reason") == "endpoint_unknown")).scalar()
        ).alias("unexplained_count"),
    )


def dep_context(deps: DataFrame, targets: DataFrame, listed: int = 12) -> DataFrame:
    """What each predecessor leaves -> (id, n_deps, omitted, context).

    ``deps(id, predecessor)``, ``targets(id, label, outputs array)``. The first ``listed``
    predecessors are shown, the rest is counted.
    """
    pairs = deps.select("id", "predecessor").distinct()
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_deps"))
    first = pick_rows(pairs, ["id"], ["predecessor"], k=listed)
    info = targets.select(F.col("id").alias("predecessor"), "label", "outputs")
    shown = (
        first.join(info, "predecessor")
        .groupBy("id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "predecessor",
                        "label",
                        F.col("outputs").alias("datasets"),
                        F.filter("outputs", lambda o: ~o.startswith("WORK.")).alias("tables"),
                    )
                )
            ).alias("context")
        )
    )
    return counts.join(shown, "id", "left").select(
        "id", "n_deps", F.greatest(F.col("n_deps") - listed, F.lit(0)).alias("omitted"), "context"
    )


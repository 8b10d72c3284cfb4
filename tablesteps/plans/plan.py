"""Translation plan: numbering, reference and file matching, plan assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.scalars import is_credential_name
from tablesteps.operators.joins import in_scope, out_of_scope
from tablesteps.operators.ordered import row_counter
from tablesteps.session import same_keys, stage

# Place of execution -> translation strategy.
STRATEGY = {
    "sql_passthrough": "sql_passthrough",
    "sql_pushdown": "sql_pushdown",
    "pandas": "pandas",
    "hybrid": "hybrid",
    "utility": "python",
    "ambiguous": "pandas",
}
CONFIRM_BELOW = 0.7


def number_groups(groups: DataFrame, order_by: Sequence[str], prefix: str = "NB-", width: int = 2) -> DataFrame:
    """Consecutive numbers over the groups that are kept; skipped groups leave no gap."""
    out = row_counter(groups, order_by, name="_n")
    text = F.col("_n").cast("string")
    padded = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return out.withColumn("number", F.concat(F.lit(prefix), padded)).drop("_n")


def match_references(files: DataFrame, tables: DataFrame, path: str = "path", table: str = "table_name") -> DataFrame:
    """Reference files to target tables by upper-cased stem -> (table, path, status).

    Status: matched; duplicate (a later file of the same stem; the first by path wins);
    unmatched_table; unmatched_file.
    """
    stem = F.upper(F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"^(.*?)(?:\.[^.]*)?$", 1))
    named = files.select(F.col(path).alias("path"), stem.alias("_stem"))
    first = named.groupBy("_stem").agg(F.min("path").alias("_first"))
    wanted = tables.select(F.upper(F.element_at(F.split(F.col(table), "[.]"), -1)).alias("_stem")).distinct()
    wanted = wanted.withColumn("table_name", F.col("_stem"))
    status = (
        F.when(F.col("path").isNull(), "unmatched_table")
        .when(F.col("table_name").isNull(), "unmatched_file")
        .when(F.col("path") == F.col("_first"), "matched")
        .otherwise("duplicate")
    )
    return wanted.join(named.join(first, "_stem"), "_stem", "full").select("table_name", "path", status.alias("status"))


def _name_keys(name: Column) -> list[tuple[str, float, Column]]:
    """Matching keys of a name from strict to loose, with the confidence each one carries."""
    upper = F.upper(name)
    letters = F.regexp_replace(upper, r"[^\p{L}]+", "")
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(upper, r"[^\p{L}\p{N}]+"), lambda t: t != "")))
    return [
        ("same name", 0.9, upper),
        ("same name without digits and symbols", 0.75, letters),
        ("same words", 0.65, F.array_join(tokens, " ")),
    ]


def match_files(profiles: DataFrame, steps: DataFrame) -> DataFrame:
    """Files to steps -> (path, id, dataset, role, confidence, reason, needs_confirmation).

    ``profiles(path, columns array)``, ``steps(id, dataset, role, columns array)``. A file meets the
    datasets by equality on ever looser forms of its name, last on its rarest shared word. Of the datasets
    that share the strictest form, the one with the largest overlap of columns is taken, then the one with
    the nearest name. Overlap adds up to 0.1; where several datasets share the form the confidence stays
    below the limit for confirmation. A file without a candidate keeps a missing id and confidence 0;
    nothing is forced. Files of one name and the same columns are one question, asked once; a form that many
    questions and many datasets share makes as many pairs.
    """
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*?)(?:\.[^.]*)?$", 1)
    files = profiles.select("path", F.col("columns").alias("_fc"), stem.alias("_stem"))
    one_question = ["_stem", "_fc"]
    asking = files.select(*one_question).distinct()

    def answered(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_of{c}" for c in one_question})
        return left.join(right, same_keys([left[c] for c in one_question], [right[f"_of{c}"] for c in one_question]), how)

    data = steps.select("id", "dataset", "role", "columns", F.element_at(F.split("dataset", "[.]"), -1).alias("_base"))
    # a dataset that several steps name is one candidate
    one = F.min(F.struct("id", "role", "columns", "_base")).alias("d")
    data = data.groupBy("dataset").agg(one).select("dataset", "d.*")
    theirs = ["id", "dataset", "role", "columns", "_base"]

    def keyed(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
        forms = [
            F.struct(F.lit(i).alias("tier"), F.lit(why).alias("reason"), F.lit(conf).alias("base"), key.alias("key"))
            for i, (why, conf, key) in enumerate(_name_keys(F.col(name)))
        ]
        return df.select(*keep, F.inline(F.array(*forms))).filter("key <> ''")

    def words(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
        parts = F.array_distinct(F.filter(F.split(F.upper(name), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
        return df.select(*keep, F.explode(parts).alias("key"))

    forms = keyed(data, "_base", theirs).drop("reason", "base")
    rivals = forms.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("_rivals"))
    asked = keyed(asking, "_stem", one_question).join(rivals, ["tier", "key"])
    first = F.min(F.struct("tier", "key", "reason", "base", "_rivals")).alias("m")
    strict = asked.groupBy(*one_question).agg(first).select(*one_question, "m.*").join(forms, ["tier", "key"])
    said = words(data, "_base", theirs)
    common = said.groupBy("key").agg(F.count(F.lit(1)).alias("_rivals"))
    rest = answered(asking, strict.select(*one_question).distinct(), "left_anti")
    rarest = words(rest, "_stem", one_question).join(common, "key").groupBy(*one_question).agg(F.min(F.struct("_rivals", "key")).alias("m"))
    loose = rarest.select(*one_question, "m.*").join(said, "key").withColumns({"reason": F.lit("rarest shared word"), "base": F.lit(0.4)})
    pairs = strict.drop("tier").unionByName(loose)
    wide = F.greatest(F.size("columns"), F.size("_fc"))
    overlap = F.when(wide > 0, F.size(F.array_intersect("columns", "_fc")) / wide).otherwise(0.0)
    far = F.levenshtein(F.upper("_stem"), F.upper("_base"))
    ranked = pairs.withColumn("_overlap", F.coalesce(overlap, F.lit(0.0)))
    top = ranked.groupBy(*one_question).agg(F.min(F.struct(-F.col("_overlap"), far.alias("far"), "dataset", "id", "role", "reason", "base", "_rivals", "_overlap")).alias("m"))
    sure = F.col("m.base") + 0.1 * F.col("m._overlap")
    rated = top.select(
        *one_question,
        F.col("m.id").alias("id"),
        F.col("m.dataset").alias("dataset"),
        F.col("m.role").alias("role"),
        F.round(F.when(F.col("m._rivals") > 1, F.least(sure, F.lit(CONFIRM_BELOW - 0.01))).otherwise(sure), 4).alias("confidence"),
        F.col("m.reason").alias("reason"),
    )
    confidence = F.coalesce("confidence", F.lit(0.0))
    return answered(files, rated, "left").select(
        "path",
        "id",
        "dataset",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        confidence.alias("confidence"),
        F.coalesce("reason", F.lit("no candidate")).alias("reason"),
        (confidence < CONFIRM_BELOW).alias("needs_confirmation"),
    )


def plan_targets(
    nodes: DataFrame,
    order: DataFrame,
    flows: DataFrame,
    ignored: DataFrame,
    overrides: DataFrame | None = None,
    single: bool = False,
) -> DataFrame:
    """One row per step in scope -> the flat part of the plan.

    ``nodes(id, label, node_type, pfd_id, placement, inputs, outputs)``, ``order(id, topo_order)``,
    ``flows(pfd_id, pfd_label, migratable, slug, position)``, ``overrides(id, placement)``. An
    override beats the classifier; an unsettled place falls to pandas with a visible assumption.
    """
    kept = out_of_scope(nodes, ignored, "id")
    live = flows.filter("migratable").join(kept.select("pfd_id").distinct(), "pfd_id", "left_semi")
    numbered = number_groups(live, ["position", "pfd_id"]).select("pfd_id", "pfd_label", "slug", "number")
    rows = kept.join(numbered, "pfd_id").join(order.select("id", "topo_order"), "id", "left")
    if overrides is not None:
        over = overrides.select("id", F.col("placement").alias("_over"))
        rows = rows.join(over, "id", "left").withColumn("placement", F.coalesce("_over", "placement")).drop("_over")
    table = F.create_map(*[F.lit(x) for pair in STRATEGY.items() for x in pair])
    path = F.lit("output/flow.ipynb") if single else F.concat(F.lit("output/"), "number", F.lit("_"), F.coalesce("slug", "pfd_id"), F.lit(".ipynb"))
    return rows.select(
        "id",
        "label",
        "node_type",
        "pfd_id",
        "pfd_label",
        "topo_order",
        "placement",
        F.coalesce(F.try_element_at(table, F.col("placement")), F.lit("pandas")).alias("strategy"),
        path.alias("notebook_path"),
        "inputs",
        "outputs",
        F.filter("outputs", lambda o: o.contains(".") & ~F.upper(o).startswith("WORK.")).alias("output_tables"),
        F.when(F.col("placement") == "ambiguous", "placement ambiguous: strategy pandas assumed").otherwise("").alias("assumption"),
    )


def plan_items(
    targets: DataFrame,
    deps: DataFrame,
    files: DataFrame | None = None,
    improvements: DataFrame | None = None,
    parameters: DataFrame | None = None,
    preprocess: DataFrame | None = None,
) -> DataFrame:
    """What belongs to each step -> (id, kind, value) rows, any number per step.

    Kinds: dependency, input_file, reference_file, improvement, parameter, preprocess. Parameters
    that look like credentials are left out; only approved improvements count.
    """
    keys = targets.select("id")
    pairs = deps.select("id", F.lit("dependency").alias("kind"), F.col("predecessor").alias("value"))
    live = in_scope(pairs, keys, "id")
    out = in_scope(live.withColumnRenamed("value", "_v"), keys.withColumnRenamed("id", "_v"), "_v").select("id", "kind", F.col("_v").alias("value"))
    if files is not None:
        role = F.lower("role")
        kind = F.when(role.isin("input", "intermediate"), "input_file").when(role == "output", "reference_file")
        out = out.unionByName(in_scope(files.select("id", kind.alias("kind"), F.col("path").alias("value")).filter("kind IS NOT NULL"), keys, "id"))
    if improvements is not None:
        ok = improvements.filter(F.lower(F.coalesce("status", F.lit("approved"))).isin("approved", ""))
        out = out.unionByName(in_scope(ok.select("id", F.lit("improvement").alias("kind"), F.col("improvement").alias("value")), keys, "id"))
    if parameters is not None:
        safe = parameters.filter(~is_credential_name("variable"))
        out = out.unionByName(in_scope(safe.select("id", F.lit("parameter").alias("kind"), F.col("variable").alias("value")), keys, "id"))
    if preprocess is not None:
        out = out.unionByName(in_scope(preprocess.select("id", F.lit("preprocess").alias("kind"), F.col("step").alias("value")), keys, "id"))
    return out.distinct()


def build_plan(
    nodes: DataFrame,
    order: DataFrame,
    flows: DataFrame,
    ignored: DataFrame,
    deps: DataFrame,
    overrides: DataFrame | None = None,
    extras: Mapping[str, DataFrame] | None = None,
    single: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(targets, items): the flat plan with the number of items per kind, and the items as rows.

    The flat plan is staged: every kind of item is filtered by it.
    """
    targets = stage(plan_targets(nodes, order, flows, ignored, overrides, single), "plan")
    items = plan_items(targets, deps, **(extras or {}))
    kinds = ("dependency", "input_file", "reference_file", "improvement", "parameter", "preprocess")
    counts = items.groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    full = targets.join(counts, "id", "left").withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in kinds})
    return full, items

"""Keyed ledgers and queues: init, sync, upsert, resolve, carry-over, change detection, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.operators.ordered import pick_rows, retain_sum, row_counter
from tablesteps.session import same_keys


def budget_cut(
    trace: DataFrame, cap: float, cost: str | Column, order_by: Sequence[str], by: Sequence[str] | None = None
) -> DataFrame:
    """A call is allowed while the spend before it is below ``cap`` -> + (spent_before, allowed).

    A cap of 0 or less means no limit.
    """
    out = retain_sum(trace, by, cost, order_by, name="spent_before", exclusive=True)
    return out.withColumn("allowed", (F.lit(cap) <= 0) | (F.col("spent_before") < cap))


def _suffix(col: str, prefix: str) -> Column:
    return F.regexp_extract(F.col(col), f"^{prefix}([0-9]+)$", 1).try_cast("bigint")


def next_id(df: DataFrame, col: str, prefix: str, width: int = 3) -> DataFrame:
    """One row (n, next_id): highest numeric suffix + 1, so a gap never leads to a reused id."""
    top = df.agg((F.coalesce(F.max(_suffix(col, prefix)), F.lit(0)) + 1).alias("n"))
    return top.withColumn("next_id", _format_id(F.col("n"), prefix, width))


def _format_id(n: Column, prefix: str, width: int) -> Column:
    text = n.cast("string")
    padded = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return F.concat(F.lit(prefix), padded)


def assign_ids(new: DataFrame, existing: DataFrame, col: str, prefix: str, order_by: Sequence[str]) -> DataFrame:
    """Number many new rows after the highest existing id."""
    numbered = row_counter(new, order_by, name="_n")
    start = existing.agg(F.coalesce(F.max(_suffix(col, prefix)), F.lit(0)).alias("n")).scalar()
    return numbered.withColumn(col, _format_id(F.col("_n") + start, prefix, 3)).drop("_n")


def ledger_init(nodes: DataFrame, previous: DataFrame | None, key: str = "id", batch: str = "pfd_id") -> DataFrame:
    """Ledger (id, batch, status, note, reviewed_at); what was recorded before is kept."""
    base = nodes.filter(F.coalesce(key, F.lit("")) != "").select(key, F.coalesce(batch, F.lit("")).alias("batch"))
    if previous is None:
        return base.select(
            key, "batch", F.lit("pending").alias("status"), F.lit("").alias("note"), F.lit(None).cast("timestamp").alias("reviewed_at")
        )
    old = previous.select(key, "status", "note", "reviewed_at")
    return base.join(old, key, "left").select(
        key,
        "batch",
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("note", F.lit("")).alias("note"),
        "reviewed_at",
    )


def last_event(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest event per key (map-side cut, so replays of one key stay small)."""
    return pick_rows(events, key, order, desc=list(order))


def ledger_sync(
    ledger: DataFrame, reviews: DataFrame, key: str = "id", order: Sequence[str] = ("at",)
) -> tuple[DataFrame, DataFrame]:
    """Apply reviews (id, note, at) -> (new ledger, unknown ids).

    The first review closes an item and keeps its time; the latest non-blank note wins.
    """
    said = reviews.withColumn("note", F.trim(F.coalesce("note", F.lit(""))))
    when = said.groupBy(key).agg(F.min("at").alias("_at"))
    note = last_event(said.filter("note <> ''"), [key], list(order)).select(key, F.col("note").alias("_note"))
    news = when.join(note, key, "left")
    synced = ledger.join(news, key, "left").select(
        key,
        "batch",
        F.when(F.col("_at").isNotNull(), "reviewed").otherwise(F.col("status")).alias("status"),
        F.coalesce("_note", "note").alias("note"),
        F.when(F.col("_at").isNotNull() & (F.col("status") != "reviewed"), F.col("_at"))
        .otherwise(F.col("reviewed_at"))
        .alias("reviewed_at"),
    )
    unknown = when.join(ledger.select(key), key, "left_anti").select(key)
    return synced, unknown


def ledger_status(ledger: DataFrame, key: str = "id", samples: int = 20) -> DataFrame:
    """Per batch: items, reviewed, pending, and the first pending ids."""
    counts = ledger.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed"),
        F.count_if(F.col("status") != "reviewed").alias("pending"),
    )
    first = pick_rows(ledger.filter("status <> 'reviewed'").select("batch", key), ["batch"], [key], k=samples)
    ids = first.groupBy("batch").agg(F.sort_array(F.collect_list(key)).alias("first_pending"))
    return counts.join(ids, "batch", "left")


QUEUE_KEY = ("phase", "task", "node_id", "reason")


def queue_upsert(
    queue: DataFrame, events: DataFrame, key: Sequence[str] = QUEUE_KEY, prefix: str = "NH-", order: str = "at", numbered_after: DataFrame | None = None
) -> DataFrame:
    """Upsert failures on the natural key among open items.

    queue(id, key..., detail, attempts, resolved, resolution), events(key..., detail, attempts, at).
    Attempts take the maximum, the latest non-blank detail wins, resolved items stay untouched and
    a failure that comes back after being resolved is a new item numbered after the highest id, of
    ``numbered_after`` where ``queue`` is only a part of that.
    """
    key = list(key)
    facts = events.groupBy(*key).agg(
        F.max("attempts").alias("_attempts"),
        F.max_by("detail", F.when(F.trim("detail") != "", F.col(order))).alias("_detail"),
    )
    names = [f"_e_{k}" for k in key]
    facts = facts.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], "_attempts", "_detail")
    open_, done = queue.filter("NOT resolved"), queue.filter("resolved")
    on = same_keys([open_[k] for k in key], [facts[n] for n in names])
    updated = open_.join(facts, on, "left").select(
        "id",
        *key,
        F.coalesce("_detail", "detail").alias("detail"),
        F.greatest("attempts", F.coalesce("_attempts", "attempts")).alias("attempts"),
        "resolved",
        "resolution",
    )
    keys = open_.select(*[F.col(k).alias(f"_o_{k}") for k in key]).distinct()
    fresh = facts.join(keys, same_keys([facts[n] for n in names], [keys[f"_o_{k}"] for k in key]), "left_anti")
    fresh = fresh.select(
        *[F.col(n).alias(k) for k, n in zip(key, names, strict=True)],
        F.coalesce("_detail", F.lit("")).alias("detail"),
        F.col("_attempts").alias("attempts"),
        F.lit(False).alias("resolved"),
        F.lit(None).cast("string").alias("resolution"),
    )
    numbered = assign_ids(fresh, queue if numbered_after is None else numbered_after, "id", prefix, key)
    cols = ["id", *key, "detail", "attempts", "resolved", "resolution"]
    return updated.select(*cols).unionByName(done.select(*cols)).unionByName(numbered.select(*cols))


def queue_resolve(queue: DataFrame, fixed: DataFrame, phase: int, task: str, resolution: str) -> DataFrame:
    """Close open items of (phase, task) whose node was positively verified; absence proves nothing."""
    ok = fixed.select(F.col("node_id").alias("_fixed")).filter("_fixed IS NOT NULL").distinct()
    hit = (
        ~F.col("resolved") & (F.col("phase") == phase) & (F.col("task") == task) & F.col("_fixed").isNotNull()
    )
    joined = queue.join(ok, queue["node_id"] == ok["_fixed"], "left")
    return joined.withColumns(
        {
            "resolution": F.when(hit, F.lit(resolution)).otherwise(F.col("resolution")),
            "resolved": F.when(hit, F.lit(True)).otherwise(F.col("resolved")),
        }
    ).drop("_fixed")


def iteration_upsert(log: DataFrame, entry: DataFrame) -> DataFrame:
    """Log keyed by ``cycle``: an entry replaces its cycle; other cycles left in progress are deferred."""
    other = log.join(entry.select("cycle").distinct(), "cycle", "left_anti")
    deferred = other.withColumn(
        "status", F.when(F.col("status") == "in_progress", "deferred").otherwise(F.col("status"))
    )
    return deferred.unionByName(entry, allowMissingColumns=True)


def carry_over(new: DataFrame, old: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Reload that keeps enrichment: a blank or missing new value takes the earlier one."""
    prior = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in cols])
    joined = new.join(prior, new[key] == prior["_key"], "left")
    fields = []
    for c in [*new.columns, *[c for c in cols if c not in new.columns]]:
        if c not in cols:
            fields.append(F.col(c))
        elif c not in new.columns:
            fields.append(F.col(f"_old_{c}").alias(c))
        else:
            blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
            fields.append(F.when(blank, F.coalesce(f"_old_{c}", c)).otherwise(F.col(c)).alias(c))
    return joined.select(*fields)


def changed_only(items: DataFrame, progress: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """Items to run again: new, changed, or not PASS last time."""
    last = progress.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"), F.col("status").alias("_status"))
    done = items.join(last, items[key] == last["_key"], "left")
    same = (F.col("_hash") == F.col(hash_col)) & (F.col("_status") == "PASS")
    return done.filter(~F.coalesce(same, F.lit(False))).drop("_key", "_hash", "_status")

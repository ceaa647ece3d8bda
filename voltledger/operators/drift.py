"""What changed between two runs over the same file, and how bad that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names in a path that make a change fatal, high or medium.
FATAL, HIGH, MEDIUM = "total_amount_due|account_number|billing_period|commodity_type|meter_consumption", "current_charges|demand_value|rate_schedule|section_subtotals", "charge|amount|rate|quantity"


def severity(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(FATAL), "fatal").when(p.rlike(HIGH), "high").when(p.rlike(MEDIUM), "medium").otherwise("low")


def changed_fields(pairs: DataFrame) -> DataFrame:
    """Pairs of runs (x and previous_x) as one row per field that differs, nulls counting as values."""
    old_new = {"totals.total_amount_due": ("previous_total", "stated_total"), "extraction.confidence_score": ("previous_score", "confidence_score"), "extraction.status": ("previous_status", "status")}
    each = F.array(*(F.struct(F.lit(p).alias("field_path"), F.col(a).cast("string").alias("old_value"), F.col(b).cast("string").alias("new_value")) for p, (a, b) in old_new.items()))
    rows = pairs.select("extraction_id", "previous_id", F.inline(F.filter(each, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))))
    return rows.withColumn("severity", severity(F.col("field_path")))


# Keys that change from run to run by themselves.
VOLATILE = ["extraction_id", "extraction_timestamp", "processing_time_ms", "few_shot_context_hash"]


_OPENED = "array<struct<path:string,v:variant,value:string,open:boolean>>"


def _opened(lengths: bool, last: bool) -> Column:
    """Of a row (path, v, value, open) the rows that it becomes one level down: an object's or array's members, or the row itself with its
    value if v is neither. Objects and arrays without members become nothing; at the last level they become their JSON."""
    row = lambda path, v, value, open_: f"named_struct('path', {path}, 'v', {v}, 'value', {value}, 'open', {open_})"
    leaf = f"array({row('path', 'cast(NULL as variant)', "try_variant_get(v, '$', 'string')", 'false')})"
    items, entries = "try_variant_get(v, '$', 'array<variant>')", "map_entries(try_variant_get(v, '$', 'map<string,variant>'))"
    # whether v is an object is asked without reading what lies below it
    is_object = "try_variant_get(v, '$', 'struct<`?`: variant>') IS NOT NULL"
    if last:
        return F.expr(f"CASE WHEN NOT open THEN array({row('path', 'v', 'value', 'false')}) WHEN {is_object} OR {items} IS NOT NULL THEN array({row('path', 'cast(NULL as variant)', 'to_json(v)', 'false')}) ELSE {leaf} END")
    length = f"array({row("concat(path, '[]')", 'cast(NULL as variant)', f'cast(size({items}) as string)', 'false')})"
    inner = f"transform({items}, (x, i) -> {row("concat(path, '[', i, ']')", 'x', 'cast(NULL as string)', 'true')})"
    named = f"transform({entries}, e -> {row("CASE WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END", 'e.value', 'cast(NULL as string)', 'true')})"
    return F.expr(f"CASE WHEN NOT open THEN array({row('path', 'v', 'value', 'false')}) WHEN {is_object} THEN {named} WHEN {items} IS NOT NULL THEN {f'concat({length}, {inner})' if lengths else inner} ELSE {leaf} END")


def flatten(documents: DataFrame, key: str | list[str] = "extraction_id", document: str = "document", depth: int = 32, lengths: bool = False) -> DataFrame:
    """key, path, value: every leaf of a variant document, arrays by [i]; with lengths also a row for each array, its path with [] and its
    length. All levels are steps of one narrow pass over documents, which are read once, and no job runs while the plan is made; what
    lies deeper than depth levels is one leaf, its JSON."""
    keys = [key] if isinstance(key, str) else key
    rows = documents.select(*keys, F.lit("").alias("path"), F.col(document).alias("v"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("open"))
    for level in range(depth + 1):
        rows = rows.select(*keys, F.inline(_opened(lengths, level == depth)))
    return rows.select(*keys, "path", "value")


def document_changes(pairs: DataFrame, documents: DataFrame, depth: int = 12) -> DataFrame:
    """extraction_id, previous_id, field_path, old_value, new_value, severity: of each pair of runs every leaf that differs, all keys of either
    side, a missing side being null; volatile keys are passed over. Arrays of unequal length give one row, len=a against len=b, and
    nothing below it. Nulls count as values.

    A document is flattened once for each pair that it is part of. Both documents come to their pair before that, so the leaves of both
    sides meet, and the pair's changes are gathered, where they are."""
    pair = ["extraction_id", "previous_id"]
    side = lambda c, name: documents.select(F.col("extraction_id").alias(c), F.col("document").alias(name)).hint("merge")
    held = pairs.select(*pair).distinct().hint("merge").join(side("previous_id", "_old"), "previous_id", "left").join(side("extraction_id", "_new"), "extraction_id", "left")
    part = lambda name: F.struct(F.lit(name).alias("_side"), F.col(f"_{name}").alias("document"))
    flat = flatten(held.select(*pair, F.inline(F.array(part("new"), part("old")))), [*pair, "_side"], depth=depth, lengths=True)
    tail = F.substring_index("path", ".", -1)
    last = F.when(F.contains(tail, F.lit("[")), F.regexp_replace(tail, r"\[\d*\]", "")).otherwise(tail)
    of = lambda side: F.max(F.when(F.col("_side") == side, F.col("value"))).alias(f"{side}_value")
    both = flat.where(~last.isin(VOLATILE)).groupBy(*pair, "path").agg(of("old"), of("new"))
    changed = both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    # where both sides have an array and their lengths differ, the array's path cuts off all that is below it
    is_length = F.endswith("path", F.lit("[]"))
    cut = is_length & F.col("old_value").isNotNull() & F.col("new_value").isNotNull()
    rows = changed.withColumn("_cuts", F.collect_list(F.when(cut, F.regexp_replace("path", r"\]$", ""))).over(Window.partitionBy(*pair)))
    below = F.exists("_cuts", lambda c: F.startswith(F.col("path"), c) & ~(F.col("path") == F.concat(c, F.lit("]"))))
    rows = rows.where(~below & (cut | ~is_length))
    said = lambda c: F.when(is_length, F.concat(F.lit("len="), c)).otherwise(F.col(c)).alias(c)
    rows = rows.select(*pair, F.regexp_replace("path", r"\[\]$", "").alias("field_path"), said("old_value"), said("new_value"))
    return rows.withColumn("severity", severity(F.col("field_path")))


def summary(changes: DataFrame) -> DataFrame:
    """Per pair: number of changes, the worst severity, whether all are low."""
    rank = F.when(F.col("severity") == "fatal", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    sums = changes.groupBy("extraction_id", "previous_id").agg(F.count(F.lit(1)).alias("n_changes"), F.max(rank).alias("r"), F.array_join(F.array_sort(F.collect_list("field_path")), ",").alias("fields"))
    return sums.select("extraction_id", "previous_id", "n_changes", F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "fatal"])), F.col("r") + 1).alias("severity"), (F.col("r") == 0).alias("all_low"), "fields")


def cause(pairs: DataFrame, summary_: DataFrame) -> DataFrame:
    """Why runs differ: model, else prompts, else few-shot context differ; else sampling if all changes are low; else unknown."""
    rows = summary_.hint("merge").join(pairs.hint("merge"), ["extraction_id", "previous_id"])
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"previous_{c}"))
    return rows.select("extraction_id", "previous_id", F.when(differ("model"), "model_changed").when(differ("prompt"), "prompt_changed").when(differ("few_shot_hash"), "few_shot_changed").when(F.col("all_low"), "sampling").otherwise("unknown").alias("cause"))

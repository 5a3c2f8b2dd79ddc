"""Joins that check their cardinality, keep an audit of what they didn't match, or pick one of several candidates by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; its evaluation fails if a key repeats. The check is part of the plan and shares the keys' shuffle."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit(f"key {keys} repeats: "), F.to_json(F.struct(*keys)))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def checked_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a right side whose keys are unique: the rows of left don't multiply."""
    return left.join(assert_unique(right, keys), keys, "left")


def liquidity_outer(sales: DataFrame, chart: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of either side, rows of both kept. Keys are normalised first, so that null keys of one side aren't lost."""
    a = sales.groupBy(*keys).agg(F.count("*").alias("n_sales"))
    b = chart.groupBy(*keys).agg(F.count("*").alias("n_points"))
    return a.join(b, keys, "full_outer")


def event_sales(events: DataFrame, sales: DataFrame, key: str, before: int, after: int, bin_days: int = 28) -> DataFrame:
    """Sales within [event - before, event + after] days of an event of their entity.

    An equi join on entity and bins of days, then the exact bounds: an entity with many sales is spread over its bins. It is a merge,
    so that the driver gets no events.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    first, last = F.floor((day("event_date") - before) / bin_days), F.floor((day("event_date") + after) / bin_days)
    spread = events.withColumn("__bin", F.explode(F.sequence(first, last)))
    binned = sales.withColumn("__bin", F.floor(day("sale_date") / bin_days))
    apart = F.col("sale_date").between(F.col("event_date") - F.make_dt_interval(F.lit(before)), F.col("event_date") + F.make_dt_interval(F.lit(after)))
    return spread.hint("merge").join(binned, [key, "__bin"]).where(apart).drop("__bin")


def map_names(names: DataFrame, directory: DataFrame, name: Column, directory_name: Column, id_column: str) -> DataFrame:
    """names with the id of their normalised name (the least, if several have it); unmatched rows keep a null id."""
    ids = directory.groupBy(directory_name.alias("__name")).agg(F.min(id_column).alias(id_column))
    return names.withColumn("__name", name).join(ids, "__name", "left").drop("__name")


def best_candidate(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key in the order given."""
    return candidates.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def tiered_match(queries: DataFrame, directory: DataFrame, key: str, tiers: list[tuple[str, str]], order: list[Column], id_column: str) -> DataFrame:
    """Cascade: per tier an equi join (query column, directory column); the best tier and order of a key decide, and several ids
    there make it ambiguous. (key, id or null, status: matched, ambiguous, unmatched)."""
    parts = [queries.join(directory, queries[a] == directory[b]).select(queries[key], directory[id_column], F.lit(i).alias("__tier"), *(o.alias(f"__o{j}") for j, o in enumerate(order))) for i, (a, b) in enumerate(tiers)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = found.withColumn("__rk", F.rank().over(Window.partitionBy(key).orderBy("__tier", *(f"__o{j}" for j in range(len(order))))))
    best = ranked.where("__rk = 1").groupBy(key).agg(F.count_distinct(id_column).alias("__n"), F.min(id_column).alias(id_column))
    joined = queries.select(key).join(best, key, "left")
    status = F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "ambiguous").otherwise("unmatched")
    return joined.select(key, F.when(F.col("__n") == 1, F.col(id_column)).alias(id_column), status.alias("status"))


def by_career_timing(candidates: DataFrame, seasons: DataFrame, key: str, id_column: str, year: str, back: int = 6, ahead: int = 3) -> DataFrame:
    """Candidates whose first season lies near the class year; a key is settled if one is left."""
    first = seasons.groupBy(id_column).agg(F.min("season").alias("__first"))
    near = candidates.join(first, id_column).where(F.col("__first").between(F.col(year) - back, F.col(year) + ahead))
    picked = near.groupBy(key).agg(F.count_distinct(id_column).alias("__n"), F.min(id_column).alias(id_column))
    out = candidates.select(key).distinct().join(picked, key, "left")
    return out.select(key, F.when(F.col("__n") == 1, F.col(id_column)).alias(id_column), F.coalesce("__n", F.lit(0)).alias("n_left"))


def several_ids(validated: DataFrame, name: str, id_column: str) -> DataFrame:
    """Names that several ids share, with the sorted ids."""
    return validated.groupBy(name).agg(F.array_sort(F.collect_set(id_column)).alias("ids")).where(F.size("ids") >= 2)


def reconcile(ours: DataFrame, theirs: DataFrame, group: list[str], code: str, floor: float = 0.85) -> DataFrame:
    """A row for each group (a set): lines of theirs and distinct codes of ours, the sorted codes that one side alone has, ok if
    theirs has none alone, and whether ours has enough of theirs. Lists hold one set's codes."""
    a = ours.select(*group, code).distinct().withColumn("__a", F.lit(True))
    b = theirs.groupBy(*group, code).agg(F.count("*").alias("__b"))
    both = a.join(b, [*group, code], "full_outer")
    one = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(code))))
    counts = both.groupBy(*group).agg(
        F.coalesce(F.sum("__b"), F.lit(0)).alias("their_total"),
        F.count("__a").alias("our_total"),
        one(F.col("__a").isNull()).alias("theirs_only"),
        one(F.col("__b").isNull()).alias("ours_only"),
        F.count("__b").alias("__theirs"),
    )
    share = 1 - F.size("theirs_only") / F.nullif(F.col("__theirs"), F.lit(0))
    return counts.withColumns({"ok": F.size("theirs_only") == 0, "share": share, "complete": F.coalesce(share >= floor, F.lit(False))}).drop("__theirs")


#: Words in a set's name that make it another product.
BLOCKED_SET_TOKENS = ("refractor", "refractors", "fractor", "logofractor", "xfractor", "edition", "stars", "cosmic", "silver", "pack", "sapphire", "platinum", "anniversary")


def plain_text(c: Column) -> Column:
    """Lower case, letters, digits and single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def pick_search_result(results: DataFrame, key: str, blocked: tuple[str, ...] = BLOCKED_SET_TOKENS) -> DataFrame:
    """The result of each key by tiers: the base issue before a short print (no parallel is the base), the same set before one
    whose name says more but no blocked word, the same number before the same digits; then universal results, then population.

    Columns: wanted_name, name, wanted_year, year, wanted_set, set_name, wanted_number, number, parallel, universal, population,
    result_id. Name and year must be the same; a number without digits has none in common with another.
    """
    wanted, own = (F.split(plain_text(F.col(c)), " ") for c in ("wanted_set", "set_name"))
    more = F.array_except(own, wanted)
    set_tier = F.when(own == wanted, 0).when((F.size(F.array_except(wanted, own)) == 0) & ~F.arrays_overlap(more, F.array(*map(F.lit, blocked))), 1)
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\D", "")
    same = F.upper(F.coalesce(F.col("number").cast("string"), F.lit(""))) == F.upper(F.col("wanted_number").cast("string"))
    number_tier = F.when(same, 0).when((digits("wanted_number") != "") & (digits("wanted_number") == digits("number")), 1)
    parallel = plain_text(F.coalesce(F.nullif("parallel", F.lit("")), F.lit("Base")))
    parallel_tier = F.when(parallel == "base", 0).when(parallel == "sp", 1)
    alike = (F.coalesce(F.col("year").cast("string"), F.lit("")) == F.col("wanted_year").cast("string")) & (plain_text(F.col("name")) == plain_text(F.col("wanted_name")))
    rows = results.where(alike).withColumns({"__s": set_tier, "__n": number_tier, "__p": parallel_tier}).where("__s IS NOT NULL AND __n IS NOT NULL AND __p IS NOT NULL")
    universal, population = F.coalesce("universal", F.lit(False)).desc(), F.coalesce("population", F.lit(0)).desc()
    return best_candidate(rows, [key], [F.col("__p"), F.col("__s"), F.col("__n"), universal, population, F.col("result_id")]).drop("__s", "__n", "__p")


def missing_cells(left: DataFrame, right: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a small grid (two short lists of distinct values) that aren't found."""
    return left.crossJoin(right).join(found, keys, "left_anti")

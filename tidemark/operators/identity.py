"""Identities in stages: each stage takes what the ones before left, and every candidate keeps the decision that was made on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import joins, quantiles

def folded_tokens(name: Column) -> Column:
    """Tokens of a normalised name, letters and digits alone."""
    return F.transform(F.split(F.trim(f.normalize_name(name)), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))


def _joined(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def search_stage(asked: DataFrame, people: DataFrame, nicknames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each name: ids that were found and those of them that validate; a row for each candidate and its decision).

    asked: (name, class_year), names unique. people: (full_name, id, validated). nicknames: (name, search), normalised names and what
    to search instead; a name is searched again so if none of its candidates validates, and then only these candidates count.

    What to search for is settled from the people's normalised names first, so people meet it once. Tables of names look small in
    their files, but each name may have many people: they are merged by hint, and the candidates are written before they are counted.
    """
    asked = quantiles.stored(asked.withColumn("__n", f.normalize_name(F.col("name"))))
    own = people.select(f.normalize_name(F.col("full_name")).alias("__n"), "id", F.coalesce("validated", F.lit(False)).alias("validated")).where("__n IS NOT NULL")
    own = quantiles.stored(own.groupBy("__n", "id").agg(F.max("validated").alias("validated")))
    sure = own.where("validated").select("__n").distinct()
    searches = nicknames.select(F.col("name").alias("__n"), f.normalize_name(F.col("search")).alias("__s"))
    again = quantiles.stored(asked.join(sure, "__n", "left_anti").join(searches, "__n").select("name", "__s"))
    given_up = F.when(F.col("__again"), "given up").otherwise("search")
    first = asked.join(again.select("name", F.lit(True).alias("__again")).distinct(), "name", "left").select("name", "__n", given_up.alias("stage"))
    wanted = first.unionByName(again.select("name", F.col("__s").alias("__n"), F.lit("nickname").alias("stage"))).where("__n IS NOT NULL")
    found = quantiles.stored(own.join(wanted.hint("merge"), "__n").groupBy("name", "id", "stage").agg(F.max("validated").alias("validated")))
    over = F.col("stage") == "given up"
    decision = F.when(over, "given up for the nickname").when(F.col("validated"), "validated").otherwise("without pro stats")
    told = found.select("name", "id", F.when(over, "search").otherwise(F.col("stage")).alias("stage"), decision.alias("decision"))
    ids = found.where(~over).groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set(F.when(F.col("validated"), F.col("id")))).alias("valid"))
    return asked.drop("__n").join(ids, "name", "left"), told


def directory_stage(left: DataFrame, directory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, cell, ids of the cell; every hit with its decision) for the names of left (name, class_year).

    directory: (full_name, id, sport, season). A hit is the same name, or the name without its own suffix; where there is none, the
    name and one suffix more. Of the hits' cells (sport, season) the nearest to the class year counts, then the earlier season, then
    the lesser sport.
    """
    tokens = F.col("__t")
    last = F.element_at(tokens, -1)
    own = left.withColumn("__t", folded_tokens(F.col("name")))
    without = F.when(last.isin(*f.SUFFIXES) & (F.size("__t") > 1), _joined(F.slice("__t", 1, F.size("__t") - 1)))
    rows = directory.withColumn("__t", folded_tokens(F.col("full_name"))).select("id", "sport", "season", _joined(tokens).alias("__whole"), without.alias("__short"))
    rows = quantiles.stored(rows)
    queries = quantiles.stored(own.select("name", "class_year", _joined(tokens).alias("__q"), without.alias("__bare")))
    wholes = queries.select("name", "class_year", F.explode(F.array_distinct(F.array_compact(F.array("__q", "__bare")))).alias("__whole"))
    same = quantiles.stored(rows.drop("__short").join(wholes.hint("merge"), "__whole").select("name", "class_year", "id", "sport", "season").distinct())
    left_over = queries.join(same.select("name").distinct(), "name", "left_anti").select("name", "class_year", F.col("__q").alias("__short"))
    more = rows.where("__short IS NOT NULL").drop("__whole").join(left_over.hint("merge"), "__short").select("name", "class_year", "id", "sport", "season").distinct()
    hits = quantiles.stored(same.withColumn("how", F.lit("same name")).unionByName(more.withColumn("how", F.lit("suffix"))))
    cell = F.struct(F.abs(F.col("season") - F.col("class_year")).alias("far"), F.col("season"), F.col("sport"))
    nearest = hits.groupBy("name").agg(F.min(cell).alias("__c"))
    met = hits.join(nearest.hint("merge"), "name").withColumn("here", (F.col("season") == F.col("__c.season")) & (F.col("sport") == F.col("__c.sport")))
    chosen = met.where("here").groupBy("name", F.col("__c.season").alias("season"), F.col("__c.sport").alias("sport")).agg(F.array_sort(F.collect_set("id")).alias("hits"))
    told = met.select("name", "id", F.lit("directory").alias("stage"), F.concat_ws(" ", "how", F.when(F.col("here"), "nearest cell").otherwise("farther cell"), F.concat(F.lit("sport "), "sport"), F.concat(F.lit("season "), "season")).alias("decision"))
    return chosen, told


def resolve_ids(asked: DataFrame, people: DataFrame, nicknames: DataFrame, directory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, class_year, id, status; every candidate as name, id, stage, decision). No id is given that isn't settled.

    status: ok (one validated id), ambiguous:multiple validated (...), ok:directory, ambiguous:directory duplicate ..., no_exact_match,
    ambiguous:candidate ... without pro stats; ..., or no_pro_stats. The directory is asked for names without a validated id alone.
    """
    searched, of_search = search_stage(asked, people, nicknames)
    searched = quantiles.stored(searched)
    n_valid, n_ids = F.coalesce(F.size("valid"), F.lit(0)), F.coalesce(F.size("ids"), F.lit(0))
    n_valid, n_ids = F.greatest(n_valid, F.lit(0)), F.greatest(n_ids, F.lit(0))
    chosen, of_directory = directory_stage(searched.where(n_valid == 0).select("name", "class_year"), directory)
    rows = searched.join(chosen, "name", "left")
    listed = lambda ids: F.array_join(ids.cast("array<string>"), ", ")
    duplicates = F.array_join(F.transform("hits", lambda i: F.concat(F.lit("candidate "), i.cast("string"), F.lit(" at sport "), F.col("sport").cast("string"), F.lit(" season "), F.col("season").cast("string"))), "; ")
    failed = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("candidate "), i.cast("string"), F.lit(" without pro stats"))), "; ")
    status = (
        F.when(n_valid == 1, "ok")
        .when(n_valid > 1, F.concat(F.lit("ambiguous:multiple validated ("), listed(F.col("valid")), F.lit(")")))
        .when(F.size("hits") == 1, "ok:directory")
        .when(F.size("hits") > 1, F.concat(F.lit("ambiguous:directory duplicate "), duplicates))
        .when(n_ids == 0, "no_exact_match")
        .when(n_ids > 1, F.concat(F.lit("ambiguous:"), failed))
        .otherwise("no_pro_stats")
    )
    settled = F.when(n_valid == 1, F.get("valid", F.lit(0))).when((n_valid == 0) & (F.size("hits") == 1), F.get("hits", F.lit(0)))
    return rows.select("name", "class_year", settled.alias("id"), status.alias("status")), of_search.unionByName(of_directory)


def _plain_tokens(c: Column) -> Column:
    """As scalars.name_in_text() sees a text."""
    return F.split(F.trim(F.regexp_replace(F.translate(F.lower(c), *f.ACCENTS), "[^a-z0-9]+", " ")), " ")


def naming(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """names joined with the texts that hold the whole name, word by word: they meet on the whole name, as every run of a text's words
    that is as long as some name is a row. So only pairs of the result are made, however many names share a word."""
    own = _plain_tokens(F.col(name))
    one = names.withColumn("__gram", F.array_join(own, " "))
    lengths = names.agg(F.collect_set(F.size(own)).alias("__lengths"))  # one row of few numbers
    size = F.size("__t")
    fits = F.filter("__lengths", lambda n: n <= size)
    runs = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("__t", i, n), " "))))
    two = texts.withColumn("__t", _plain_tokens(F.col(text))).crossJoin(F.broadcast(lengths)).withColumn("__gram", F.explode(F.array_distinct(runs))).drop("__t", "__lengths")
    return one.join(two, "__gram").drop("__gram")


def base_items(players: DataFrame, items: DataFrame, years: int = 3) -> DataFrame:
    """A row for each player (name, class_year, family): item_id and url of the base item and why; of the items (item_id, title, url, year,
    family) whose title names the player, from the class year to `years` later, the earliest year's, the player's family first."""
    met = naming(players, items.withColumnRenamed("family", "__family").withColumnRenamed("year", "__year"), "name", "title")
    met = met.where(F.col("__year").between(F.col("class_year"), F.col("class_year") + years))
    other = (~F.col("__family").eqNullSafe(F.col("family"))).cast("int")
    best = joins.best_candidate(met.withColumn("__other", other), ["name", "class_year"], [F.col("__year"), F.col("__other"), F.col("item_id")])
    told = F.when(F.col("__other") == 0, "same family").otherwise("other family")
    best = best.select("name", "class_year", "item_id", "url", F.col("__year").alias("year"), told.alias("decision"))
    return players.join(best, ["name", "class_year"], "left").withColumn("decision", F.coalesce("decision", F.lit("no_base_card")))


def classes_of_names(checklists: DataFrame, prefer: str = "chrome") -> DataFrame:
    """(player_name, class_year, family, card_url): each normalised name's earliest year, of that year the preferred family, then the first
    family and url by order."""
    order = F.struct("year", (F.col("family") != prefer).alias("other"), "family", "card_url", "name")
    first = checklists.groupBy(f.normalize_name(F.col("name")).alias("__n")).agg(F.min(order).alias("o"))
    return first.select(F.col("o.name").alias("player_name"), F.col("o.year").alias("class_year"), F.col("o.family").alias("family"), F.col("o.card_url").alias("card_url"))


def is_parallel(text: Column) -> Column:
    """Whether a listing is of a parallel or an insert, not of the base issue."""
    return f.word_flag(text, f.PARALLEL).isNotNull()


def first_issues(listings: DataFrame, back: int = 6) -> DataFrame:
    """Every listing (name, rookie_year, year, pos, anchor, url) with its decision.

    Years from `back` before the rookie year up to it are looked at in order until one has a base issue that names the player: of
    these the first that says 1st, else the first, is chosen; the others are candidates. Other listings of the years that were looked
    at are skip:name-mismatch or skip:parallel-keyword; those of other years are not-scanned.
    """
    key = ["name", "rookie_year"]
    inside = F.col("year").between(F.col("rookie_year") - back, F.col("rookie_year"))
    own = F.when(~f.name_in_text(F.col("name"), F.col("anchor")), "skip:name-mismatch").when(is_parallel(F.col("anchor")), "skip:parallel-keyword").otherwise("candidate")
    rows = listings.withColumns({"__own": own, "__in": inside})
    fine = F.col("__in") & (F.col("__own") == "candidate")
    order = F.struct("year", (~F.col("anchor").rlike(r"(?i)\b1st\b")).alias("later"), "pos", "url")
    best = rows.where(fine).groupBy(*key).agg(F.min(order).alias("__best"))
    met = rows.join(best, key, "left")
    chosen = fine & (F.col("year") == F.col("__best.year")) & (F.col("pos") == F.col("__best.pos")) & (F.col("url") == F.col("__best.url"))
    scanned = F.col("__in") & (F.col("__best").isNull() | (F.col("year") <= F.col("__best.year")))
    return met.select(*listings.columns, F.when(~scanned, "not-scanned").when(chosen, "chosen").otherwise(F.col("__own")).alias("decision"))


def flagship_attempts(players: DataFrame, listings: DataFrame, families: tuple[str, ...] = ("topps-chrome", "topps-chrome-update"), kinds: tuple[str, ...] = ("rookies-only", "full")) -> DataFrame:
    """A row for each attempt (name, rookie_year, family, listing, anchor, url, result) in the order in which they are made.

    Each family's listings are tried in order until one has a base issue that names the player; a listing after that isn't tried. result:
    no-match, match, or chosen for the match of the first family that has one. listings: (name, rookie_year, family, listing, pos, anchor, url).
    """
    key = ["name", "rookie_year"]
    ranked = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    grid = players.select(*key, F.explode(F.array(*(F.struct(F.lit(a).alias("family"), F.lit(k).alias("listing")) for a in families for k in kinds))).alias("__a")).select(*key, "__a.*")
    fine = f.name_in_text(F.col("name"), F.col("anchor")) & ~is_parallel(F.col("anchor"))
    hits = listings.where(fine).groupBy(*key, "family", "listing").agg(F.min(F.struct("pos", "anchor", "url")).alias("__h"))
    rows = grid.join(hits, [*key, "family", "listing"], "left").withColumns({"__f": ranked("family", families), "__l": ranked("listing", kinds)})
    before = Window.partitionBy(*key, "family").orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumn("__done", F.count("__h").over(before)).where("__done = 0")
    first = F.min(F.when(F.col("__h").isNotNull(), F.struct("__f", "__l"))).over(Window.partitionBy(*key))
    result = F.when(F.col("__h").isNull(), "no-match").when(first == F.struct("__f", "__l"), "chosen").otherwise("match")
    return made.select(*key, "family", "listing", F.col("__h.anchor").alias("anchor"), F.col("__h.url").alias("url"), result.alias("result"), ((F.col("__f") - 1) * len(kinds) + F.col("__l")).alias("attempt"))


def universe(players: DataFrame, resolved: DataFrame, info: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each player with an id: role, where the id comes from, url; the audit: a row for each player that lacks an id or a base
    item, with the reason). players: (name, class_year, family, auto_card_url); resolved as from resolve_ids(); info: (id, position); base as
    from base_items()."""
    rows = players.join(resolved.select("name", "class_year", "id", "status"), ["name", "class_year"], "left")
    source = F.when(F.col("status") == "ok", "search").when(F.col("status") == "ok:directory", "directory").otherwise("")
    known = rows.where("id IS NOT NULL").join(info.groupBy("id").agg(F.min("position").alias("position")), "id", "left")
    found = base.where("item_id IS NOT NULL").select("name", "class_year", "url")
    role = F.when(F.col("position") == "P", "pitcher").otherwise("hitter")
    cards = known.join(found, ["name", "class_year"], "left").select("name", "id", "class_year", "family", role.alias("role"), source.alias("resolution_source"), F.coalesce("url", F.lit("")).alias("url"), "auto_card_url")
    lacking = rows.where("id IS NULL").select("name", "class_year", F.coalesce("status", F.lit("not_asked")).alias("reason"))
    no_base = known.join(found, ["name", "class_year"], "left_anti").select("name", "class_year", F.lit("no_base_card").alias("reason"))
    return cards, lacking.unionByName(no_base)

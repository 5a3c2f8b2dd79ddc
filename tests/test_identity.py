"""Identity resolution against cases worked out by hand."""

from pyspark.sql import functions as F

from tidemark.operators import identity


def resolved(spark):
    asked = [("José Ramírez", 2010), ("Two Men", 2012), ("Gio Known", 2014), ("Bobby Witt Jr.", 2019), ("Sam Plain", 2016), ("Dup Licate", 2018), ("No Body", 2015), ("Un Proven", 2015), ("Pair Unproven", 2015), ("Nick Only", 2013)]
    people = [("Jose Ramirez", 1, True), ("JOSÉ RAMÍREZ", 1, True), ("Jose Ramirez", 2, False), ("two men", 3, True), ("Two Men", 4, True), ("Giovanny Known", 5, True), ("Gio Known", 6, False), ("Un Proven", 7, None), ("Pair Unproven", 8, False), ("Pair Unproven", 9, False), ("Else Where", 10, False)]
    nicknames = [("gio known", "Giovanny Known"), ("nick only", "Else Where"), ("two men", "Else Where")]
    directory = [
        ("Bobby Witt", 20, 11, 2020), ("Bobby Witt Jr.", 21, 14, 2019), ("Bobby Witt III", 22, 14, 2019),
        ("Sam Plain Jr.", 30, 12, 2014), ("Sam Plain II", 31, 12, 2017), ("Sam Plain Sr", 32, 13, 2017),
        ("Dup Licate", 40, 13, 2017), ("Dup Licáte", 41, 13, 2017), ("Dup Licate", 42, 11, 2019), ("Two Men", 50, 11, 2012),
    ]
    return identity.resolve_ids(
        spark.createDataFrame(asked, "name string, class_year int"),
        spark.createDataFrame(people, "full_name string, id int, validated boolean"),
        spark.createDataFrame(nicknames, "name string, search string"),
        spark.createDataFrame(directory, "full_name string, id int, sport int, season int"),
    )


def test_every_status(spark):
    rows, audit = resolved(spark)
    got = {r["name"]: (r["id"], r["status"]) for r in rows.collect()}
    assert got == {
        "José Ramírez": (1, "ok"),
        "Two Men": (None, "ambiguous:multiple validated (3, 4)"),
        "Gio Known": (5, "ok"),
        "Bobby Witt Jr.": (21, "ok:directory"),  # the same cell's III is another name; without the suffix a farther cell
        "Sam Plain": (31, "ok:directory"),  # 2017 is nearer than 2014, and sport 12 comes before 13
        "Dup Licate": (None, "ambiguous:directory duplicate candidate 40 at sport 13 season 2017; candidate 41 at sport 13 season 2017"),
        "No Body": (None, "no_exact_match"),
        "Un Proven": (None, "no_pro_stats"),
        "Pair Unproven": (None, "ambiguous:candidate 8 without pro stats; candidate 9 without pro stats"),
        "Nick Only": (None, "no_pro_stats"),
    }
    told = {(r["name"], r["id"], r["stage"]): r["decision"] for r in audit.collect()}
    assert told["José Ramírez", 2, "search"] == "without pro stats" and told["José Ramírez", 1, "search"] == "validated"
    assert told["Gio Known", 6, "search"] == "given up for the nickname" and told["Gio Known", 5, "nickname"] == "validated"
    assert told["Bobby Witt Jr.", 20, "directory"] == "same name farther cell sport 11 season 2020"
    assert told["Sam Plain", 32, "directory"] == "suffix farther cell sport 13 season 2017"
    assert not any(name == "Two Men" and stage == "directory" for name, _, stage in told)  # settled, if not resolved, by the search


def test_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    rows, audit = identity.resolve_ids(spark.createDataFrame([("A B", 2000)], "name string, class_year int"), empty("full_name string, id int, validated boolean"), empty("name string, search string"), empty("full_name string, id int, sport int, season int"))
    assert [tuple(r) for r in rows.collect()] == [("A B", 2000, None, "no_exact_match")] and audit.count() == 0


def test_people_meet_names_once(spark):
    """Candidates are written as they are found, so the audit doesn't find them again; names with many people are not broadcast."""
    audit = resolved(spark)[1]._jdf.queryExecution()
    assert audit.optimizedPlan().toString().count("Join ") == 1 and "Broadcast" not in audit.sparkPlan().toString()
    people = spark.sql("SELECT 'A b' AS full_name, id, id % 2 = 0 AS validated FROM range(5000) UNION ALL SELECT 'c', id, false FROM range(3000)")
    asked, nicknames = spark.createDataFrame([("a B", 2000), ("d", 2000)], "name string, class_year int"), spark.createDataFrame([("d", "C"), ("d", "a b")], "name string, search string")
    rows, told = identity.search_stage(asked, people, nicknames)
    assert {r["name"]: (len(r["ids"]), len(r["valid"])) for r in rows.collect()} == {"a B": (5000, 2500), "d": (5000, 2500)}
    assert {tuple(r) for r in told.groupBy("name", "stage", "decision").count().collect()} == {("a B", "search", "validated", 2500), ("a B", "search", "without pro stats", 2500), ("d", "nickname", "validated", 2500), ("d", "nickname", "without pro stats", 2500)}


def test_first_issues_tell_of_every_listing(spark):
    rows = [
        ("Nick Kurtz", 2025, 2018, 0, "Nick Kurtz #1", "a"),
        ("Nick Kurtz", 2025, 2023, 0, "Nick Kurtzney #2", "b"),
        ("Nick Kurtz", 2025, 2024, 0, "Nick Kurtz [Gold] #3", "c"),
        ("Nick Kurtz", 2025, 2024, 1, "Nick Kurtz #4", "d"),
        ("Nick Kurtz", 2025, 2024, 2, "Nick Kurtz 1st #5", "e"),
        ("Nick Kurtz", 2025, 2024, 3, "Nick Kurtz 1st #6", "f"),
        ("Nick Kurtz", 2025, 2025, 0, "Nick Kurtz #7", "g"),
        ("No One", 2025, 2024, 0, "Nick Kurtz #4", "d"),
    ]
    got = {(r["name"], r["url"]): r["decision"] for r in identity.first_issues(spark.createDataFrame(rows, "name string, rookie_year int, year int, pos int, anchor string, url string")).collect()}
    assert [got["Nick Kurtz", u] for u in "abcdefg"] == ["not-scanned", "skip:name-mismatch", "skip:parallel-keyword", "candidate", "chosen", "candidate", "not-scanned"]
    assert got["No One", "d"] == "skip:name-mismatch"


def test_flagship_attempts(spark):
    players = spark.createDataFrame([("Al One", 2020), ("Bo Two", 2020), ("Cy None", 2020)], "name string, rookie_year int")
    rows = [
        ("Al One", 2020, "topps-chrome", "full", 0, "Al One #9", "x"),
        ("Al One", 2020, "topps-chrome-update", "rookies-only", 1, "Al One #3", "y"),
        ("Al One", 2020, "topps-chrome-update", "rookies-only", 0, "Al One Refractor #3", "z"),
        ("Bo Two", 2020, "topps-chrome", "rookies-only", 0, "Bo Two #1", "u"),
        ("Bo Two", 2020, "topps-chrome", "full", 0, "Bo Two #1", "v"),
        ("Cy None", 2020, "topps-chrome", "full", 0, "Cy None Gold", "w"),
    ]
    df = spark.createDataFrame(rows, "name string, rookie_year int, family string, listing string, pos int, anchor string, url string")
    got = {(r["name"], r["attempt"]): (r["url"], r["result"]) for r in identity.flagship_attempts(players, df).collect()}
    assert got == {
        ("Al One", 1): (None, "no-match"), ("Al One", 2): ("x", "chosen"), ("Al One", 3): ("y", "match"),
        ("Bo Two", 1): ("u", "chosen"), ("Bo Two", 3): (None, "no-match"), ("Bo Two", 4): (None, "no-match"),
        ("Cy None", 1): (None, "no-match"), ("Cy None", 2): (None, "no-match"), ("Cy None", 3): (None, "no-match"), ("Cy None", 4): (None, "no-match"),
    }


def test_base_items_and_universe(spark):
    players = spark.createDataFrame([("Al One", 2020, "chrome", "p"), ("Bo Two", 2020, "chrome", "q"), ("Cy None", 2020, "draft", "r")], "name string, class_year int, family string, auto_card_url string")
    items = spark.createDataFrame([(1, "Al One #9", "a", 2020, "draft"), (2, "Al One #3", "b", 2020, "chrome"), (3, "Al Onely #1", "c", 2020, "chrome"), (4, "Al One", "d", 2019, "chrome"), (5, "Bo Two", "e", 2024, "chrome"), (6, "Cy None #1", "f", 2022, "chrome")], "item_id int, title string, url string, year int, family string")
    base = identity.base_items(players, items)
    assert {r["name"]: (r["item_id"], r["decision"]) for r in base.collect()} == {"Al One": (2, "same family"), "Bo Two": (None, "no_base_card"), "Cy None": (6, "other family")}
    status = spark.createDataFrame([("Al One", 2020, 7, "ok"), ("Bo Two", 2020, 8, "ok:directory"), ("Cy None", 2020, None, "no_pro_stats")], "name string, class_year int, id int, status string")
    cards, audit = identity.universe(players, status, spark.createDataFrame([(7, "P"), (8, None)], "id int, position string"), base)
    assert {r["name"]: (r["id"], r["role"], r["resolution_source"], r["url"], r["auto_card_url"]) for r in cards.collect()} == {"Al One": (7, "pitcher", "search", "b", "p"), "Bo Two": (8, "hitter", "directory", "", "q")}
    assert sorted(tuple(r) for r in audit.collect()) == [("Bo Two", 2020, "no_base_card"), ("Cy None", 2020, "no_pro_stats")]


def test_classes_of_names(spark):
    rows = [("José A.", 2021, "draft", "u1"), ("jose a", 2021, "chrome", "u2"), ("Jose A", 2022, "chrome", "u0"), ("Other", 2020, "draft", "v")]
    got = identity.classes_of_names(spark.createDataFrame(rows, "name string, year int, family string, card_url string")).orderBy("class_year")
    assert [tuple(r) for r in got.collect()] == [("Other", 2020, "draft", "v"), ("jose a", 2021, "chrome", "u2")]
    assert identity.folded_tokens(F.lit("x")) is not None


def test_names_meet_texts_on_the_whole_name(spark):
    """Names and texts that share words without the whole name aren't paired on the way; dots and accents part words in both."""
    names = [(n,) for n in ("Al Bo", "Al Bo Jr.", "José Cruz", "J.D. Smith", "Bo", "Al Cy")]
    texts = ["1 al-bo jr #5", "Jose Cruz", "j d smith", "JD Smith", "bob al", "Bo bo"]
    met = identity.naming(spark.createDataFrame(names, "name string"), spark.createDataFrame([(t,) for t in texts], "title string"), "name", "title")
    want = {("Al Bo", texts[0]), ("Al Bo Jr.", texts[0]), ("Bo", texts[0]), ("José Cruz", texts[1]), ("J.D. Smith", texts[2]), ("Bo", texts[5])}
    assert sorted((r["name"], r["title"]) for r in met.collect()) == sorted(want)

"""Rules with expected values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates, events, joins, odds, panels, windows
from tidemark.sources import parse

DAY0 = dt.datetime(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def test_grades_and_amounts_in_titles(spark):
    grades = {
        "2020 Name RC PSA 10 GEM MT": "psa_10", "NAME PSA 9": "psa_9", "Name BGS 9.5 GEM MINT": "bgs_9.5", "Name #2": None, "Name RC SGC-10": "sgc_10", "Name PSA-9": "psa_9",
        "Name PSA GEM MT 10": "psa_10", "RC PSA MINT 9": "psa_9", "Name SGC PERFECT 10": "sgc_10", "Name Gem Mint 10 PSA": "psa_10", "GEM MINT 10 BGS": "bgs_10", "PSA 7": None, "cgc pristine 10": "cgc_10",
    }
    got = spark.createDataFrame([(t,) for t in grades], "t string").select("t", f.grade_from_title(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in got} == grades
    amounts = {"$1,234.50": 1234.5, "12 items": None, "was $34.50$0.00": 34.5, "": None}
    got = spark.createDataFrame([(t,) for t in amounts], "t string").select("t", f.money(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == amounts


def test_positions_and_words(spark):
    want = {"DH": "OF", "SS": "IF", "TWP": None, "IF": None, "P": "P", None: None}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", f.position_group(F.col("p")).alias("g")).collect()
    assert {r["p"]: r["g"] for r in got} == want
    words = {"Lot of 5 cards": "Lot of", "a lot": None, "card RP": "RP", "custom card x": "custom card", "custom": None, "case break": "case break"}
    got = spark.createDataFrame([(t,) for t in words], "t string").select("t", f.word_flag(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == words
    kept = spark.createDataFrame([("Redmond Base",), ("Red Wave",), ("Talent Pipeline TP-1",)], "t string").where(f.word_flag(F.col("t"), f.PARALLEL).isNull()).collect()
    assert [r["t"] for r in kept] == ["Redmond Base"]


def _sold(event, pre, early, late):
    return [(event, t, float(p)) for part, at in ((pre, (-5.0, -2.0)), (early, (1.0, 2.0)), (late, (8.0, 9.0))) for t, p in zip(at, part, strict=False)]


def test_adjustment_classes(spark):
    rows = [
        *_sold("fast", (1, 1), (1.18, 1.2), (1.2, 1.2)),
        *_sold("late", (1, 1), (1.01, 1.01), (1.2, 1.2)),
        *_sold("fall", (1, 1), (1, 1), (0.8, 0.8)),  # a fall is no adjustment
        *_sold("small", (1, 1), (1, 1), (1.015, 1.015)),
        *_sold("between", (1, 1), (1.1, 1.1), (1.2, 1.2)),
        *_sold("slow", (1, 1), (1.01, 1.01), (1.04, 1.04)),  # late, but not by enough
        *_sold("few", (1, 1), (1.1,), (1.2, 1.2)),
        ("few", 1.5, None),
    ]
    df = spark.createDataFrame(rows, "event_id string, t_days double, rel_adj double")
    got = {r["event_id"]: r["adjustment"] for r in events.classify(df, ["event_id"]).collect()}
    assert got == {"fast": "fast", "late": "late", "fall": "no_adjustment", "small": "no_adjustment", "between": "intermediate", "slow": "intermediate", "few": "insufficient"}


def test_strata(spark):
    logs = spark.createDataFrame([(1, dt.datetime(2020, 5, 1), 2020), (1, dt.datetime(2021, 5, 1), 2021), (2, dt.datetime(2020, 6, 1), 2020)], "entity_id int, date timestamp_ntz, season int")
    asked = spark.createDataFrame([(1, dt.datetime(2020, 4, 1)), (1, dt.datetime(2020, 9, 1)), (1, dt.datetime(2020, 12, 1)), (1, dt.datetime(2021, 6, 1)), (3, dt.datetime(2021, 6, 1))], "entity_id int, event_date timestamp_ntz")
    got = {(r["entity_id"], r["event_date"].strftime("%Y-%m")): r["stratum"] for r in events.strata(asked, logs).collect()}
    assert got == {(1, "2020-04"): "prospect", (1, "2020-09"): "prospect", (1, "2020-12"): "established", (1, "2021-06"): "established", (3, "2021-06"): "prospect"}


def test_lag_and_its_cover(spark):
    rows = [(t, 0.9 if t < 0 or t < 2 else 1.1, 1.2) for t in range(-10, 8)]
    rows[0], rows[1] = (-10, None, None), (-9, 1.05, 1.2)
    got = events.estimate_lag(spark.createDataFrame(rows, "t_bin int, ci_lo double, ci_hi double")).first()
    assert got["lag_days"] == 2 and got["pre_cover_share"] == pytest.approx(0.8) and got["pre_ok"]
    hole = [r if r[0] != 3 else (3, None, None) for r in rows]
    assert events.estimate_lag(spark.createDataFrame(hole, "t_bin int, ci_lo double, ci_hi double")).first()["lag_days"] == 4


def test_odds_level_stays_without_a_market(spark):
    snaps = spark.createDataFrame([(1, dt.datetime(2019, 12, 20), 0.4), (2, dt.datetime(2020, 3, 1), 0.5)], "entity_id int, day timestamp_ntz, implied_prob double")
    grid = spark.createDataFrame([(1, dt.datetime(2020, 2, 1), 2020), (2, dt.datetime(2020, 2, 1), 2020), (3, dt.datetime(2020, 2, 1), 2020)], "entity_id int, entry_month timestamp_ntz, season int")
    got = {r["entity_id"]: (r["has_market"], r["odds_level"], r["odds_delta_7"]) for r in odds.month_features(grid, snaps, (7,)).collect()}
    assert got == {1: (False, 0.4, None), 2: (True, None, None), 3: (False, 0.0, 0.0)}


def test_search_results(spark):
    base = {"asked": 1, "wanted_name": "Bobby Name Jr.", "name": "BOBBY NAME JR", "wanted_year": "2022", "year": "2022", "wanted_set": "Top Chrome", "set_name": "Top Chrome", "wanted_number": "USC178", "number": "178", "parallel": None, "universal": False, "population": 5}
    made = lambda **change: {**base, **change}
    pick = lambda *rows: (joins.pick_search_result(spark.createDataFrame([{**r, "result_id": i} for i, r in enumerate(rows)], "asked int, wanted_name string, name string, wanted_year string, year string, wanted_set string, set_name string, wanted_number string, number string, parallel string, universal boolean, population int, result_id int"), "asked").first() or {"result_id": None})["result_id"]
    assert pick(made()) == 0  # no parallel is the base, digits are enough
    assert pick(made(), made(number="usc178")) == 1
    assert pick(made(parallel="SP", universal=True), made()) == 1
    assert pick(made(set_name="Top Chrome Update"), made(set_name="Top Chrome Refractors")) == 0
    assert pick(made(set_name="Chrome Top")) == 0 and pick(made(set_name="Chrome Top"), made(population=1)) == 1
    assert pick(made(year="2021"), made(name="Other"), made(parallel="Gold"), made(set_name="Top Chrome Sapphire"), made(number="179")) is None
    assert pick(made(wanted_number="RC", number="AU")) is None
    assert pick(made(population=9), made(universal=True, population=1)) == 1


def test_pages_of_sales(spark):
    rows = [
        '<td>2024-01-02</td><td><img></td><td>Card PSA MINT 9</td><td><span class="js-price" title="best offer accepted price">$80.00</span> <span class="js-price listed-price-inline">$100.00</span></td>',
        "<td>2024-01-03</td><td></td><td>Card</td><td>$5.50 $7.00</td>",
        '<td>2024-01-04</td><td></td><td>Card</td><td><span class="js-price">$1,200.00</span></td>',
        "<td>2024-01-05</td><td></td><td>Card</td><td>12 items</td>",
        "<td>no date</td><td></td><td>Card</td><td>$1</td>",
    ]
    html = '<div class="tab completed-auctions-used"><table>' + "".join(f"<tr>{r}</tr>" for r in rows) + '</table></div><table><tr><td>2024-01-06</td><td></td><td>x</td><td>$9</td></tr></table>'
    got = parse.sales(parse.table_rows(spark.createDataFrame([("k", html)], "k string, html string"), "k"), "k").orderBy("sale_date").collect()
    assert [(r["price"], r["list_price"], r["best_offer"], r["grade"], r["bucket"]) for r in got] == [(80.0, 100.0, True, "psa_9", "used"), (5.5, 7.0, True, None, "used"), (1200.0, None, False, None, "used"), (None, None, False, None, "used")]


def test_pages_cut_at_their_tags_give_the_rows_of_the_whole_parser(spark):
    plain = '<div class="completed-auctions-used"><table><tr><td>a &amp; b</td><th>c<br>d</th></tr></table></div><table id="t"><tr><td>e</td></tr></table><script>x = "&amp;" ;</script>'
    odd = plain + '<!-- <tr> --><table id="t" title="a>b"><tr><td>1 < 2</td></tr></table><script>if (a<b) {"<td>"}</script>'
    for html, cut in ((plain, True), (odd, False)):
        slow = parse._Cells()
        slow.feed(html)
        slow.close()
        assert parse._Cells()._cut(html) == cut and parse._Cells().read(html) == slow.rows
        assert parse._Cells(frozenset("t")).read(html) == [r for r in slow.rows if r[1] == "t"]


def test_a_price_summary_parses_its_pages_once(spark):
    html = '<table id="other"><tr><td>x</td></tr></table><table id="price_data"><tr><th>A</th><th></th></tr><tr><td>$2.00 $3.00</td><td>$4.00</td></tr><tr><td>$9.00</td><td></td></tr></table>'
    got = parse.price_summary(parse.table_rows(spark.createDataFrame([("k", html), ("l", "")], "k string, html string"), "k", tables=["price_data"]), "k")
    assert [tuple(r) for r in got.collect()] == [("k", 0, "A", 200)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_charts_take_the_last_label_of_a_price(spark):
    html = '<table id="price_data"><tr><th>Ungraded</th><th>Grade 9</th><th>PSA 10</th></tr><tr><td>$2.00$0.10</td><td>$2.00</td><td>-</td></tr></table><script>VGPC.chart_data = {"a":[[1704067200000,100],[1706745600000,200]],\n"b":[[1704067200000,0],[1706745600000,300]]} ;</script>'
    pages = spark.createDataFrame([("k", html)], "k string, html string")
    got = parse.calibrated(parse.chart_points(pages, "k"), parse.price_summary(parse.table_rows(pages, "k"), "k"), "k").collect()
    assert sorted((r["grade"], str(r["date"]), r["price"]) for r in got) == [("grade_9", "2024-01-01", 1.0), ("grade_9", "2024-02-01", 2.0), ("key:b", "2024-02-01", 3.0)]


def test_a_calibrated_chart_reads_its_points_once(spark):
    html = '<table id="price_data"><tr><th>A</th><th>B</th></tr><tr><td>$2.00</td><td>$3.00</td></tr></table><script>chart_data = {"a":[[1704067200000,300],[1704067200000,200]],"b":[],"c":[[0,0],[1704067200000,400]]};</script>'
    pages = spark.createDataFrame([("k", html), ("l", html.replace("$2.00", "-")), (None, html)], "k string, html string")
    got = parse.calibrated(parse.chart_points(pages, "k"), parse.price_summary(parse.table_rows(pages, "k", tables=["price_data"]), "k"), "k")
    assert sorted((r["k"], r["grade"], r["price"]) for r in got.collect()) == [("k", "a", 2.0), ("k", "a", 3.0), ("k", "key:c", 4.0), ("l", "key:a", 2.0), ("l", "key:a", 3.0), ("l", "key:c", 4.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("chart_data") == 1


def test_draft_payloads(spark):
    payload = '{"prospects":[{"person":{"id":7,"fullName":"A"},"rank":1},{"person":{"id":7,"fullName":"A"},"rank":1},{"bisPlayerId":9},{"person":{"fullName":"B"}},{"person":{"fullName":"B"}},{"person":{"id":8}}]}'
    got = parse.draft_prospects(spark.createDataFrame([(2016, payload), (2017, "{}")], "y int, payload string"), "y").collect()
    assert sorted(((r["id"], r["name"], r["rank"], str(r["as_of"])) for r in got), key=str) == sorted([(7, "A", 1, "2016-07-01"), (None, "B", None, "2016-07-01"), (None, "B", None, "2016-07-01"), (8, None, None, "2016-07-01")], key=str)


def test_sets_by_the_shape_of_their_slugs(spark):
    kinds = {"baseball-cards-2018-bowman-chrome-prospects-autographs": "auto", "baseball-cards-2019-bowman-draft-picks-chrome-autographs": "auto", "baseball-cards-2020-bowman-chrome-prospects": "base", "baseball-cards-2020-bowman-draft-chrome": "base", "baseball-cards-2020-bowman-sterling-autographs": "other", "baseball-cards-2020-bowman": "other"}
    html = "".join(f'<a href="/console/{s}">x</a>' for s in [*kinds, *kinds]) + '<a href="/console/football-cards-2020-x">y</a>'
    got = parse.set_slugs(spark.createDataFrame([(html,)], "html string")).collect()
    assert {r["slug"]: r["kind"] for r in got} == kinds and len(got) == 6
    assert {r["family"] for r in got if "draft" in r["slug"]} == {"draft"} and all(r["year"] >= 2018 for r in got)


def test_ranked_lists(spark):
    one = lambda text: spark.createDataFrame([("d", text)], "d string, t string")
    got = parse.numbered_list(one("1. A. Name, OF, PHi\n100 . Other Name, 1B PIT\n2. José X, SS/2B, MIN\nno 3. x, SS, NYA"), "d", "t").orderBy("rank").collect()
    assert [(r["rank"], r["name"], r["position"], r["team"]) for r in got] == [(2, "José X", "SS/2B", "MIN"), (100, "Other Name", "1B", "PIT")]
    got = parse.ordered_list(one("Old, SS, NYA\nCore\ny\nSeager, SS, LAD\n• a note\n[link]\nByron Buxton, OF, MN\nSeason-end list\nLate, SS, NYA"), "d", "t", "Core\ny").orderBy("rank").collect()
    assert [(r["rank"], r["name"], r["team"]) for r in got] == [(1, "CoreySeager", "LAD"), (2, "Byron Buxton", "MIN")]
    got = parse.split_list(one("x\nShohei Name\n, RHP/DH, LAA\nmore\nVlad G. Jr.\n, 3B, TOR\n"), "d", "t", "Shohei").orderBy("rank").collect()
    assert [(r["rank"], r["name"], r["position"]) for r in got] == [(1, "Shohei Name", "RHP/DH"), (2, "Vlad G. Jr", "3B")]


def test_cached_ranks(spark):
    text = '"Person:5":{"__typename":"Person","useName":"A","useLastName":"B","primaryPosition":{"__typename":"Position","abbreviation":"SS"}},{"__typename":"RankedPlayerEntity","rank":2,"playerEntity":{"position":"OF","player":{"__ref":"Person:5"}}},{"__typename":"RankedPlayerEntity","rank":1,"playerEntity":{"player":{"__ref":"Person:6"}}},{"__typename":"RankedPlayerEntity","rank":3,"playerEntity":{"player":null}}'
    got = parse.linked_ranks(spark.createDataFrame([("d", text.replace('"', "&quot;"))], "d string, t string"), "d", "t").orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["name"], r["position"]) for r in got] == [(1, 6, None, None), (2, 5, "A B", "OF")]


def test_pedigree_is_of_the_highest_level_below_the_top(spark):
    counts = "games int, hits int, at_bats int, walks int, hit_by_pitch int, sac_flies int, total_bases int, earned_runs int, outs int, strike_outs int, batters_faced int"
    rows = [(1, "hitting", "a", 3, 1, 10, 0, 0, 0, 1, 0, 0, 0, 0), (1, "hitting", "aa", 2, 3, 10, 1, 0, 0, 6, 0, 0, 0, 0), (1, "hitting", "mlb", 9, 9, 9, 0, 0, 0, 36, 0, 0, 0, 0), (2, "pitching", "a_plus", 1, 0, 0, 0, 0, 0, 0, 2, 18, 5, 20)]
    got = {r["entity_id"]: (r["minor_games"], r["max_level"], r["max_level_rank"], r["rate_at_max_level"]) for r in aggregates.pedigree(spark.createDataFrame(rows, f"entity_id int, role string, level string, {counts}"), ["entity_id"]).collect()}
    assert got == {1: (5, "aa", 3, 0.964), 2: (1, "a_plus", 2, 3.0)}  # 4/11 + 6/10, and 9 * 2 / 6


def test_expectations_by_season_and_class_year(spark):
    entries = spark.createDataFrame([(1, 2021, dt.datetime(2020, 11, 1), 2020), (1, 2021, dt.datetime(2021, 6, 1), 2020)], "entity_id int, season bigint, entry_month timestamp_ntz, class_year bigint")
    said = [(1, 2021, "pipeline", 30, None, dt.datetime(2021, 1, 1)), (1, 2020, "pipeline", 40, None, dt.datetime(2020, 1, 1)), (1, 2019, "draft", 2, None, dt.datetime(2019, 7, 1)), (1, 2021, "draft", 1, None, dt.datetime(2020, 7, 1)), (1, 2021, "scouts", None, 55.0, dt.datetime(2021, 3, 1))]
    known = panels.expectation_features(entries, spark.createDataFrame(said, "entity_id int, season bigint, source string, rank int, fv double, as_of timestamp_ntz"))
    got = {r["entry_month"].month: (r["pipeline_rank"], r["rank_change"], r["fv"], r["draft_rank"]) for r in known.collect()}
    assert got == {11: (None, None, None, 2), 6: (30, -10, 55.0, 2)}


def test_hold_returns_need_the_exact_month(spark):
    rows = [("a", dt.datetime(2020, m, 1), float(p)) for m, p in ((1, 10), (7, 20), (8, 0))] + [("a", dt.datetime(2021, 1, 1), 40.0), ("b", dt.datetime(2020, 7, 1), 99.0)]
    held = windows.hold_returns(spark.createDataFrame(rows, "k string, month timestamp_ntz, price double"), ["k"], (6, 12))
    got = {(r["k"], r["month"].strftime("%y-%m")): (r["ret_6m"], r["ret_12m"]) for r in held.collect()}
    import math

    assert got[("a", "20-01")] == (pytest.approx(math.log(2) / 0.5), pytest.approx(math.log(4))) and got[("a", "20-07")] == (pytest.approx(math.log(2) / 0.5), None)
    assert got[("a", "20-08")] == (None, None) and got[("b", "20-07")] == (None, None)


def test_whole_rows_stay_when_overlaps_go(spark):
    rows = [(1, day(0), "x", 5.0), (1, day(10), "y", 9.0), (1, day(15), "z", None), (2, day(3), None, 1.0)]
    got = windows.drop_overlaps(spark.createDataFrame(rows, "k int, d timestamp_ntz, what string, score double"), ["k"], "d")
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]


def test_checklists(spark):
    rows = [(3, "Name", "BCP-1"), (1, " name", "bcp-1"), (2, "Other", "BCP-1"), (4, "Third", "BCP-2")]
    got = sorted(map(tuple, aggregates.dedupe_checklist(spark.createDataFrame(rows, "id int, name string, number string"), "name", "number", "id").select("id", "name", "collides").collect()))
    assert got == [(1, " name", True), (2, "Other", True), (4, "Third", False)]
    ours, theirs = (spark.createDataFrame([("s", c) for c in codes], "set string, code string") for codes in (["1", "2", "3"], ["2", "2", "4"]))
    r = joins.reconcile(ours, theirs, ["set"], "code").first()
    assert (r["their_total"], r["our_total"], r["theirs_only"], r["ours_only"], r["ok"], r["share"], r["complete"]) == (3, 3, ["4"], ["1", "3"], False, 0.5, False)


def test_hierarchical_frame(spark):
    rows = [("ungraded", 0.1, "SS", 0.2, None, 1.0, None, "rookie_year", 2020, 7), ("ungraded", 0.3, None, 0.4, None, 3.0, 5.0, "other", 2021, 8), ("ungraded", 0.5, "P", 0.9, 0.25, 1.0, 1.0, "prospect", 2021, 9), ("psa_10", 0.5, "SS", 0.9, None, 1.0, 1.0, "prospect", 2021, 9), ("ungraded", None, "SS", 0.9, None, 1.0, 1.0, "prospect", 2021, 9), ("ungraded", 0.5, "SS", None, 0.1, 1.0, 1.0, "prospect", 2021, 9), ("ungraded", 0.5, "SS", 0.3, 0.1, 1.0, 1.0, "prospect", None, 9)]
    panel = spark.createDataFrame(rows, "grade string, ret_12m double, position string, surprise_ops double, surprise_era double, market_ret_3m double, price_level double, career_stage string, class_year int, entity_id int")
    found, scaling = panels.hierarchical_frame(panel, pitchers=False)
    got = {r["entity_id"]: r for r in found.collect()}
    assert got.keys() == {"7", "8"} and got["7"]["class_position"] == "2020_SS" and got["8"]["class_position"] == "2021_None" and got["8"]["career_stage"] is None
    assert abs(got["7"]["surprise"] + 1) < 1e-9 and abs(got["8"]["market_ret_3m"] - 1) < 1e-9 and got["7"]["price_level"] is None and got["8"]["price_level"] == 0
    assert {r["predictor"]: (round(r["mean"], 9), round(r["sd"], 9)) for r in scaling.collect()} == {"surprise": (0.3, 0.1), "market_ret_3m": (2.0, 1.0), "price_level": (5.0, 1.0)}
    (pitcher,) = panels.hierarchical_frame(panel, pitchers=True)[0].collect()
    assert pitcher["entity_id"] == "9" and pitcher["surprise"] == 0 and panels.hierarchical_frame(panel, pitchers=True)[1].where("predictor = 'surprise'").first()["mean"] == -0.25


def test_numbered_lists_of_any_length(spark):
    """Ranks of four digits and more are lines as others are; a year in front of a sentence isn't a rank."""
    text = "\n".join(f"{i} . Name {i % 7}, SS, NYA" for i in range(998, 1203)) + "\n12345. Last Name, OF, PHI\n2019 was a year, SS, NYA"
    got = parse.numbered_list(spark.createDataFrame([("d", text)], "d string, t string"), "d", "t").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [*range(998, 1203), 12345]

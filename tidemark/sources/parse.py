"""Payloads to rows. JSON and text are parsed by built-in functions; pages by a small parser over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f


def game_logs(payloads: DataFrame, payload: str = "payload", stats: tuple[str, ...] = ("hits", "atBats")) -> DataFrame:
    """A row for each split of {"splits": [{"date", "stat": {...}}]}, its numbers as columns; the other columns stay."""
    schema = "splits array<struct<date: string, stat: map<string, string>>>"
    rows = payloads.withColumn("__s", F.explode(F.from_json(payload, schema)["splits"])).drop(payload)
    return rows.select("*", F.to_date("__s.date").alias("date"), *(F.try_element_at("__s.stat", F.lit(s)).cast("bigint").alias(s) for s in stats)).drop("__s")


def people(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    schema = "people array<struct<id: bigint, fullName: string, birthDate: string, primaryPosition: struct<abbreviation: string>>>"
    p = payloads.select(F.explode(F.from_json(payload, schema)["people"]).alias("p"))
    return p.select(F.col("p.id").alias("id"), F.col("p.fullName").alias("name"), F.to_date("p.birthDate").alias("birth_date"), F.col("p.primaryPosition.abbreviation").alias("position"))


def draft_prospects(payloads: DataFrame, year: str, payload: str = "payload") -> DataFrame:
    """(year, id, name, rank, as_of) of {"prospects": [{"person": {"id", "fullName"}, "rank"}]}: entries whose person has neither id
    nor name are skipped; the first of an id stays, null ids all do; a missing rank is null."""
    schema = "prospects array<struct<person: struct<id: bigint, fullName: string>, rank: string>>"
    rows = payloads.select(F.col(year).alias("year"), F.posexplode_outer(F.from_json(payload, schema)["prospects"]).alias("pos", "p"))
    kept = rows.where("p.person.id IS NOT NULL OR p.person.fullName IS NOT NULL").select("year", "pos", F.col("p.person.id").alias("id"), F.col("p.person.fullName").alias("name"), F.col("p.rank").try_cast("bigint").alias("rank"))
    first = F.row_number().over(Window.partitionBy("year", "id").orderBy("pos"))
    return kept.withColumn("__rn", first).where("id IS NULL OR __rn = 1").select("year", "id", "name", "rank", F.make_date("year", F.lit(7), F.lit(1)).alias("as_of"))


def market_events(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(label, market_id, volume) of an event's markets; the first of the alternatives that isn't empty."""
    schema = "title string, markets array<struct<title: string, question: string, conditionId: string, condition_id: string, id: string, volume: double>>"
    m = payloads.select(F.explode(F.from_json(payload, schema)["markets"]).alias("m"))
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return m.select(F.coalesce(some("m.title"), some("m.question")).alias("label"), F.coalesce("m.conditionId", "m.condition_id", "m.id").alias("market_id"), F.coalesce("m.volume", F.lit(0.0)).alias("volume"))


def price_history(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(..., ts, raw_price) of {"history": [{t, p}]} or of the bare list; t in seconds."""
    point = "array<struct<t: bigint, p: double>>"
    bare = F.ltrim(payload).startswith("[")
    points = F.when(bare, F.from_json(payload, point)).otherwise(F.from_json(payload, f"history {point}")["history"])
    rows = payloads.withColumn("__p", F.explode(points)).drop(payload)
    return rows.select("*", F.timestamp_seconds("__p.t").alias("ts"), F.col("__p.p").alias("raw_price")).drop("__p")


def candles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, ts, raw_price, volume): the close in dollars, else the other one; above 1 it is in cents. Candles without a trade
    go; the volume is 0 where none is given."""
    schema = "ticker string, candlesticks array<struct<end_period_ts: bigint, ts: bigint, price: struct<close_dollars: string, close: double>, volume_fp: string, volume: double>>"
    rows = payloads.select(F.from_json(payload, schema).alias("j")).select("j.ticker", F.explode("j.candlesticks").alias("c"))
    close = F.coalesce(F.col("c.price.close_dollars").try_cast("double"), F.col("c.price.close"))
    volume = F.coalesce(F.col("c.volume_fp").try_cast("double"), F.col("c.volume"), F.lit(0.0))
    return rows.select("ticker", F.timestamp_seconds(F.coalesce("c.end_period_ts", "c.ts", F.lit(0))).alias("ts"), F.when(close > 1, close / 100).otherwise(close).alias("raw_price"), volume.alias("volume")).where("raw_price IS NOT NULL")


def populations(payloads: DataFrame, payload: str = "payload", grader: str = "psa", grade: str = "10") -> DataFrame:
    """(..., top_pop, total_pop, gem_rate): a missing grade stays null, and so does the rate of nothing."""
    schema = "total_population bigint, total_gems_or_greater bigint, population_data array<struct<grader: string, grades: map<string, bigint>>>"
    rows = payloads.withColumn("__j", F.from_json(payload, schema)).drop(payload)
    own = F.get(F.filter("__j.population_data", lambda x: x["grader"] == grader), F.lit(0))
    rate = F.round(F.col("__j.total_gems_or_greater") / F.nullif(F.col("__j.total_population"), F.lit(0)), 4)
    return rows.select("*", F.try_element_at(own["grades"], F.lit(grade)).alias("top_pop"), F.col("__j.total_population").alias("total_pop"), rate.alias("gem_rate")).drop("__j")


#: How pages mark the blocks of sales, an accepted offer's price and the price it was listed at.
SALES_BLOCK, PRICE, LISTED, ACCEPTED = "completed-auctions-", "js-price", "listed-price-inline", "best offer accepted price"


#: Rows of table cells that are sent on together; a page's own rows stay together.
BATCH = 5_000
_TAG = re.compile("(<[^<>]*>)")


def _opened(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, str | int | None]:
    """What a start tag means for the rows, as (kind, value): a sales block, a table's id, or what a price's span holds."""
    named = dict(attrs)
    if tag == "div":
        own = next((c for c in (named.get("class") or "").split() if c.startswith(SALES_BLOCK)), None)
        return "div", own.removeprefix(SALES_BLOCK) if own else None
    if tag == "table":
        return "table", named.get("id")
    if tag == "span":
        kinds = (named.get("class") or "").split()
        return "span", 0 if PRICE not in kinds else 1 if named.get("title") == ACCEPTED else 2 if LISTED in kinds else 0
    return ("td" if tag == "th" else tag), None


class _Tag(HTMLParser):
    """What a tag does that stands alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.steps: list[tuple[bool, str, str | int | None]] = []
        self.data = False

    def handle_starttag(self, tag, attrs):
        self.steps.append((True, *_opened(tag, attrs)))

    def handle_endtag(self, tag):
        self.steps.append((False, "td" if tag == "th" else tag, None))

    def handle_data(self, data):
        self.data = True


@lru_cache(maxsize=4_096)
def _steps(tag: str) -> tuple[tuple[tuple[bool, str, str | int | None], ...], str | None] | None:
    """The steps of a tag and, if its content is no markup, its name; None if the tag alone doesn't tell (a quoted `>`, a comment)."""
    parser = _Tag()
    try:
        parser.feed(tag)
    except AssertionError:
        return None
    if parser.rawdata or parser.data:
        return None
    return tuple(x for x in parser.steps if x[1] in ("div", "table", "tr", "td", "span")), parser.cdata_elem


class _Cells(HTMLParser):
    """Rows of cells: for each cell its text, an accepted and a listed price in it; for each row its table's id and sales block.

    With `tables`, only rows of tables of these ids are kept; a row's place counts all rows."""

    def __init__(self, tables: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted = tables
        self.begin()

    def begin(self):
        self.rows: list[tuple[str | None, str | None, int, list[list[str]]]] = []
        self.n = 0
        self.blocks: list[str | None] = [None]
        self.tables: list[str | None] = [None]
        self.spans: list[int] = []
        self.cell: list[str] | None = None
        self.row: list[list[str]] | None = None

    def read(self, html: str) -> list[tuple[str | None, str | None, int, list[list[str]]]]:
        """The page's rows. A page whose every `<` begins a tag that is whole up to the next `>` is cut at its tags, and each
        different tag is parsed once; any other one is parsed from its start to its end. Both give the same rows."""
        if not self._cut(html):
            self.reset()
            self.begin()
            self.feed(html)
            self.close()
        return self.rows

    def _cut(self, html: str) -> bool:
        self.begin()
        pieces = _TAG.split(html)
        if html.count("<") != len(pieces) // 2:
            return False
        tags = pieces[1::2]
        found = list(map(_steps, tags))
        if None in found:
            return False
        raw = None
        for n, (text, (steps, content)) in enumerate(zip(pieces[:-1:2], found, strict=True)):
            if raw is not None:  # up to here the content isn't markup
                if not re.fullmatch(rf"</\s*{raw}\s*>", tags[n], re.IGNORECASE):
                    return False
                if text:
                    self.handle_data(text)
            elif text and self.cell is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            raw = content
            for opens, kind, value in steps:
                if opens:
                    self.opened(kind, value)
                else:
                    self.closed(kind)
        return raw is None

    def handle_starttag(self, tag, attrs):
        self.opened(*_opened(tag, attrs))

    def handle_endtag(self, tag):
        self.closed("td" if tag == "th" else tag)

    def opened(self, kind, value):
        if kind == "td":
            if self.row is not None:
                self.cell, self.spans = ["", "", ""], []
        elif kind == "span":
            self.spans.append(value)
        elif kind == "tr":
            self.row = []
        elif kind == "div":
            self.blocks.append(self.blocks[-1] if value is None else value)
        elif kind == "table":
            self.tables.append(value)

    def closed(self, kind):
        if kind == "td":
            if self.cell is not None:
                self.row.append(self.cell)
                self.cell = None
        elif kind == "span":
            if self.spans:
                self.spans.pop()
        elif kind == "tr":
            if self.row is not None:
                if self.wanted is None or self.tables[-1] in self.wanted:
                    self.rows.append((self.blocks[-1], self.tables[-1], self.n, [[" ".join(x.split()) for x in cell] for cell in self.row]))
                self.n += 1
                self.row = None
        elif kind == "div":
            if len(self.blocks) > 1:
                self.blocks.pop()
        elif kind == "table":
            if len(self.tables) > 1:
                self.tables.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data
            if self.spans:
                for kind in (1, 2):
                    if kind in self.spans:
                        self.cell[kind] += data


def table_rows(pages: DataFrame, key: str, html: str = "html", tables: Sequence[str] | None = None) -> DataFrame:
    """(key, bucket, table_id, pos, cells, accepted, listed) of each table row of the pages, or of the rows of the tables of these
    ids; a page without tables gives none."""
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "bucket", "table_id", "pos", "cells", "accepted", "listed"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.list_(pa.string())] * 3]
    wanted = None if tables is None else frozenset(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Cells(wanted)
        for batch in batches:
            keys: list = []
            rows: list = []

            def made(own: pa.DataType) -> pa.RecordBatch:
                lists = ([[c[i] for c in cells] for *_, cells in rows] for i in range(3))
                columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], *lists]
                return pa.RecordBatch.from_arrays([pa.array(keys, own), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

            for n in range(batch.num_rows):
                found = parser.read(batch.column(1)[n].as_py() or "")
                keys += [batch.column(0)[n].as_py()] * len(found)
                rows += found
                if len(rows) >= BATCH or n == batch.num_rows - 1:
                    yield made(batch.schema.field(0).type)
                    keys, rows = [], []

    lists = ", ".join(f"{c} array<string>" for c in names[4:])
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, bucket string, table_id string, pos int, {lists}")


def sales(rows: DataFrame, key: str) -> DataFrame:
    """Sales of a sales block's rows of at least four cells (date, image, title, price) with an ISO date. An accepted offer's price
    comes with the listed one if that is marked; a cell without marks has the price first and the listed one second. A listed
    price makes a best offer; a cell without an amount has a null price."""
    at = lambda c, i: F.get(c, F.lit(i))
    kept = rows.where(F.col("bucket").isNotNull() & (F.size("cells") >= 4) & at("cells", 0).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    accepted, every = f.money(at("accepted", 3)), f.amounts(at("cells", 3))
    price, listed = F.coalesce(accepted, F.get(every, F.lit(0))), F.when(accepted.isNotNull(), f.money(at("listed", 3))).otherwise(F.get(every, F.lit(1)))
    return kept.select(key, "bucket", at("cells", 0).try_cast("date").alias("sale_date"), at("cells", 2).alias("title"), price.alias("price"), listed.alias("list_price"), listed.isNotNull().alias("best_offer"), f.grade_from_title(at("cells", 2)).alias("grade"))


def attributes(rows: DataFrame, key: str, table: str = "attribute") -> DataFrame:
    """(key, attributes): two-celled rows as a map of lower-cased, underscored names; yes and no become true and false. Of a name
    that comes twice the last value stays."""
    name = F.replace(F.lower(F.rtrim(F.get("cells", F.lit(0)), F.lit(":"))), F.lit(" "), F.lit("_"))
    value = F.get("cells", F.lit(1))
    value = F.when(F.lower(value) == "yes", "true").when(F.lower(value) == "no", "false").otherwise(value)
    pairs = rows.where((F.col("table_id") == table) & (F.size("cells") == 2)).select(key, F.struct(name.alias("key"), value.alias("value")).alias("e"), "pos")
    last = pairs.groupBy(key, F.col("e.key").alias("k")).agg(F.max_by("e", "pos").alias("e"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("attributes"))


def price_summary(rows: DataFrame, key: str, table: str = "price_data") -> DataFrame:
    """(key, place, label, cents): the first row's names with the first amount in each cell of the row below; nameless ones go."""
    own = rows.where((F.col("table_id") == table) & F.col(key).isNotNull())
    page = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = own.withColumns({"h": F.first("cells").over(page), "p": F.first("pos").over(page)}).where("pos = p + 1")
    pairs = data.select(key, F.posexplode(F.arrays_zip(F.col("h").alias("label"), F.col("cells").alias("cell"))).alias("place", "z"))
    return pairs.select(key, "place", F.col("z.label").alias("label"), F.round(f.money(F.col("z.cell")) * 100).cast("bigint").alias("cents")).where("cents IS NOT NULL AND label <> ''")


def chart_points(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, series, place, date, cents) of `chart_data = {...};` in a page's script: lists of [milliseconds, cents]."""
    data = F.from_json(F.regexp_extract(html, r"(?s)chart_data\s*=\s*(\{.*?\})\s*;", 1), "map<string, array<array<double>>>")
    points = pages.select(key, F.explode(data).alias("series", "points")).select(key, "series", F.posexplode("points").alias("place", "p"))
    return points.select(key, "series", "place", F.to_date(F.timestamp_millis(F.get("p", F.lit(0)).cast("bigint"))).alias("date"), F.round(F.get("p", F.lit(1))).cast("bigint").alias("cents"))


def calibrated(points: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Series named by the label (lower-cased, underscored) whose summary price equals their last one, in cents; `key:<series>` if
    none does. Of labels of one price the last in the table wins; prices of nothing are dropped."""
    labels = summary.groupBy(key, "cents").agg(F.max_by("label", "place").alias("label")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cents", "label"))).alias("__labels"))
    last = F.max_by("cents", F.struct("date", "place")).over(Window.partitionBy(key, "series"))
    # A page's labels are few and meet its points by the page's key, by which points of pages that are grouped already lie together.
    rows = points.where(F.col(key).isNotNull()).withColumn("__last", last).join(labels, key, "left")
    label = F.replace(F.lower(F.try_element_at("__labels", F.col("__last"))), F.lit(" "), F.lit("_"))
    return rows.where("cents > 0").select(key, F.coalesce(label, F.concat(F.lit("key:"), "series")).alias("grade"), "date", (F.col("cents") / 100).alias("price"))


def rebuilt(snapshots: DataFrame, meta: DataFrame, key: str, day: str = "day", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(sales, chart) of the newest page of each key, with the columns of meta by the key; pages without meta and series without a
    label are left out."""
    pages = snapshots.groupBy(key).agg(F.max_by(html, day).alias(html)).join(meta.select(key), key, "left_semi")
    rows = table_rows(pages, key, html)
    summary = price_summary(table_rows(pages, key, html, tables=["price_data"]), key)
    chart = calibrated(chart_points(pages, key, html), summary, key).where(~F.col("grade").startswith("key:"))
    return sales(rows, key).join(meta, key), chart.join(meta, key)


def set_entries(links: DataFrame, title: Column) -> DataFrame:
    """links with name and number of titles of the form `name #number`; bracketed titles (parallels) go."""
    form = r"^(.*?)\s+#(\S+)$"
    out = links.withColumn("raw_title", title).where(~F.col("raw_title").contains("[") & F.col("raw_title").rlike(form))
    return out.withColumns({"name": F.regexp_extract("raw_title", form, 1), "number": F.regexp_extract("raw_title", form, 2)})


#: The shapes of the sets' slugs that are the autograph and the base set of a family and year.
AUTO_SLUGS = (
    r"^baseball-cards-\d{4}-bowman-chrome-prospects?-autographs?$",
    r"^baseball-cards-\d{4}-bowman-(chrome-draft-pick-autograph|draft-chrome-picks?-autographs?|draft-picks?-chrome-autographs|draft-chrome-autographs|draft-chrome-prospect-autographs?)$",
)
BASE_SLUGS = (r"^baseball-cards-\d{4}-bowman-chrome-prospects$", r"^baseball-cards-\d{4}-bowman-draft-chrome$")


def set_slugs(pages: DataFrame, html: str = "html") -> DataFrame:
    """(slug, year, family, kind), distinct: links to sets with a year; kind is auto, base, or other for all else."""
    links = F.regexp_extract_all(html, F.lit(r'href="/console/(baseball-cards-[^"]*)"'), 1)
    rows = pages.select(F.explode(F.array_distinct(F.transform(links, lambda x: F.trim(x, F.lit("/"))))).alias("slug")).distinct()
    some = lambda shapes: reduce(lambda a, b: a | b, (F.col("slug").rlike(p) for p in shapes))
    kind = F.when(some(AUTO_SLUGS), "auto").when(some(BASE_SLUGS), "base").otherwise("other")
    year = F.regexp_extract("slug", r"baseball-cards-(\d{4})", 1)
    return rows.where(year != "").select("slug", year.cast("int").alias("year"), F.when(F.col("slug").contains("draft"), "draft").otherwise("chrome").alias("family"), kind.alias("kind"))


#: A numbered line, a line in rank order, and a name with the rest of its line below it.
NUMBERED_LINE = r"^(\d{1,9})\s*\.\s*(.+?),\s*([A-Z0-9/ ]+?)(?:,\s*|\s+)([A-Z]{2,3})$"
ORDERED_LINE = r"^(.+?),\s*([A-Z0-9/ ]+),\s*([A-Za-z]{2,3})$"
NAME_ABOVE = r"([A-ZÀ-Ý][A-Za-zÀ-ÿ'. -]{2,40})\n,\s*([A-Z0-9/ ]+),\s*([A-Za-z]{2,3})\n"
LIST_END = "Season-end"
TEAM_FIX = {"PHi": "PHI", "MN": "MIN", "PH": "PHI"}


def _entry(key: str, rank: Column, name: Column, position: Column, team: Column) -> list[Column]:
    fixed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TEAM_FIX.items() for x in kv)), F.trim(team)), F.trim(team))
    return [F.col(key), rank.cast("int").alias("rank"), f.clean_name(name).alias("name"), F.trim(position).alias("position"), fixed.alias("team")]


def numbered_list(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, name, position, team) of lines `N. Name, POS, TEAM`, the comma before the team may be missing."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(NUMBERED_LINE))
    part = lambda i: F.regexp_extract("line", NUMBERED_LINE, i)
    return lines.select(*_entry(key, part(1), part(2), part(3), part(4)))


def ordered_list(docs: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, rank, name, position, team) of lines `Name, POS, TEAM` from the marker to the end of the list, ranked by their order. A
    name that is cut over lines is put together again; bullets and brackets don't belong to names."""
    start = F.instr(text, marker)
    lines = docs.where(start > 0).select(key, F.posexplode(F.split(F.substring(F.col(text), start, F.length(text)), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    by = Window.partitionBy(key).orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("line").rlike(ORDERED_LINE)
    lines = lines.withColumns({"__ended": F.coalesce(F.max(F.col("line").contains(LIST_END)).over(before), F.lit(False)), "__match": match, "__rank": F.coalesce(F.sum(match.cast("int")).over(before), F.lit(0)) + 1}).where("NOT __ended")
    piece = F.when(~F.col("__match") & ~F.col("line").rlike(r"^[•\[]") & ~F.col("line").contains(LIST_END), F.struct("pos", F.trim("line").alias("line")))
    rows = lines.groupBy(key, "__rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["line"]), "").alias("__above"), F.max(F.when(F.col("__match"), F.col("line"))).alias("line")).where("line IS NOT NULL")
    part = lambda i: F.regexp_extract("line", ORDERED_LINE, i)
    return rows.select(*_entry(key, F.col("__rank"), F.concat("__above", part(1)), part(2), part(3)))


def split_list(docs: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, rank, name, position, team) of names whose position and team stand on the line below them, ranked by their order."""
    start = F.instr(text, marker)
    found = F.regexp_extract_all(F.substring(F.col(text), start, F.length(text)), F.lit(NAME_ABOVE), 0)
    rows = docs.where(start > 0).select(key, F.posexplode(found).alias("pos", "m"))
    part = lambda i: F.regexp_extract("m", NAME_ABOVE, i)
    return rows.select(*_entry(key, F.col("pos") + 1, part(1), part(2), part(3)))


def unescaped(text: Column) -> Column:
    """Character references of a page's embedded payload; the ampersand's own comes last."""
    for entity, c in (("&quot;", '"'), ("&#34;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def linked_ranks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, id, name, position) of a page's cache: ranked entities that name a person by reference, joined to the persons. An
    entity without a reference is skipped; the entity's own position comes before the person's."""
    plain = docs.select(key, unescaped(F.col(text)).alias("t"))
    # What follows each mark, up to the next one.
    after = lambda mark, most: plain.select(key, F.explode(F.slice(F.split("t", mark), 2, 1 << 30)).alias("w")).select(key, F.substring("w", 1, most).alias("w"))
    part = lambda pattern: F.nullif(F.regexp_extract("w", pattern, 1), F.lit(""))
    persons = after(r'"Person:(?=\d+":\{"__typename":"Person",)', 1500).select(
        key, part(r"^(\d+)").cast("bigint").alias("id"), F.trim(F.concat(part(r'"useName":"([^"]*)"'), F.lit(" "), part(r'"useLastName":"([^"]*)"'))).alias("name"), part(r'"primaryPosition":\{"__typename":"Position","abbreviation":"([^"]*)"').alias("own")
    )
    ranks = after(r'"__typename":"RankedPlayerEntity","rank":(?=\d+,"playerEntity":\{)', 3000).select(
        key, part(r"^(\d+)").cast("int").alias("rank"), part(r'"player":\{"__ref":"Person:(\d+)"\}').cast("bigint").alias("id"), part(r'"position":"([^"]*)"').alias("position")
    )
    return ranks.where("id IS NOT NULL").join(persons.dropDuplicates([key, "id"]), [key, "id"], "left").select(key, "rank", "id", "name", F.coalesce("position", "own").alias("position"))


def url_parts(url: Column) -> dict[str, Column]:
    """Set and item slug (the last two parts), the set's year (its third word) and the number behind the item's last dash."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    group, item = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    words = F.split(group, "-")
    return {
        "set_slug": group,
        "item_slug": item,
        "key": F.concat_ws("/", group, item),
        "year": F.get(words, F.lit(2)).try_cast("int"),
        "set_query": F.concat_ws(" ", F.get(words, F.lit(2)), F.initcap(F.concat_ws(" ", F.slice(words, 1, 2)))),
        "number": F.nullif(F.regexp_extract(item, r"-([a-z0-9]+)$", 1), F.lit("")),
    }

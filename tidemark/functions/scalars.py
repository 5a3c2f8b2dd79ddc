"""Scalar functions over columns, all built in: they stay inside code generation and fold into scans and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The positions' groups, the accents that names are freed of, suffixes of names, words of contaminated
#: titles and of parallel issues, and the forms of a grade and of an amount in a text.
POSITION_GROUPS = {"P": "P", "C": "C", "1B": "IF", "2B": "IF", "3B": "IF", "SS": "IF", "OF": "OF", "LF": "OF", "CF": "OF", "RF": "OF", "DH": "OF"}
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
CONTAMINATED = ("lot of", "reprint", "rp", "proxy", "custom card", "case break", "digital")
PARALLEL = (
    "autograph", "auto", "refractor", "shimmer", "gold", "orange", "purple", "blue", "green", "red", "black", "superfractor", "variation", "wave", "sparkle", "speckle", "mojo", "atomic", "lunar",
    "rookie of the year favorites", "talent pipeline", "tp",
)
SEED_PARALLEL = ("refractor", "autograph", "gold", "orange", "purple", "blue", "green", "red", "superfractor", "variation")
GRADE_PATTERN = r"(?i)\b(psa|bgs|sgc|cgc)\s*-?\s*(?:gem\s*(?:mt|mint)\s*|mint\s+|perfect\s+|pristine\s+)?(10|9\.5|9|8\.5|8)\b"
GEM_PATTERN = r"(?i)\bgem\s*(?:mt|mint)\s*(10)\s+(psa|bgs|sgc|cgc)\b"
MONEY_PATTERN = r"\$([\d,]+(?:\.\d{2})?)"


def normalize_grade(grade: Column) -> Column:
    """Null and empty grades are `ungraded`."""
    return F.coalesce(F.nullif(grade, F.lit("")), F.lit("ungraded"))


def grade_is(grade: Column, wanted: str) -> Column:
    """The class `ungraded` is the null grade; others are equality. Never null."""
    return grade.isNull() if wanted == "ungraded" else F.coalesce(grade == wanted, F.lit(False))


def not_keyed(grade: Column, allowed: tuple[str, ...]) -> Column:
    """Grades without a label (`key:*`) and those that aren't asked for are out."""
    return ~F.coalesce(grade, F.lit("")).startswith("key:") & grade.isin(*allowed)


def word_flag(text: Column, words: tuple[str, ...] = CONTAMINATED) -> Column:
    """The first of the words in a text, case aside, as it stands there; null if none is."""
    return F.nullif(F.regexp_extract(text, rf"(?i)\b({'|'.join(words)})\b", 1), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Lower case without accents and dots; suffixes stay."""
    return F.replace(F.translate(F.lower(name), *ACCENTS), F.lit("."), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Letters and digits in tokens, without suffixes of names."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(name), *ACCENTS), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " +"), lambda t: (t != "") & ~t.isin(*SUFFIXES))


def name_in_text(name: Column, text: Column) -> Column:
    """Whether the name's tokens stand in the text one after the other, as whole words."""
    def padded(x: Column) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(x), *ACCENTS), "[^a-z0-9]+", " ")), F.lit(" "))

    return F.contains(padded(text), padded(name))


def innings_to_outs(innings: Column) -> Column:
    """`6.1` is 19 outs: the part behind the dot counts outs, not tenths."""
    parts = F.split(innings, r"\.")
    return parts[0].cast("bigint") * 3 + F.coalesce(F.get(parts, F.lit(1)).cast("bigint"), F.lit(0))


def season_year(date: Column) -> Column:
    """November and December belong to the next season."""
    return F.year(date) + (F.month(date) >= 11).cast("int")


def month_start(date: Column) -> Column:
    return F.date_trunc("month", date).cast("timestamp_ntz")


def week_start(date: Column) -> Column:
    """The Monday."""
    return F.date_trunc("week", date).cast("timestamp_ntz")


def years_between(later: Column, earlier: Column, digits: int | None = 2) -> Column:
    years = F.datediff(later, earlier) / 365.25
    return years if digits is None else F.round(years, digits)


def position_group(position: Column) -> Column:
    """Null for positions that aren't listed."""
    pairs = [F.lit(x) for kv in POSITION_GROUPS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), position)


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def hitter_game_score(total_bases: Column, walks: Column, stolen_bases: Column) -> Column:
    return zero(total_bases) + zero(walks) + zero(stolen_bases)


def pitcher_game_score(outs: Column, strike_outs: Column, hits: Column, earned_runs: Column, runs: Column, walks: Column) -> Column:
    """50, up for outs, whole innings after the fourth and strike-outs, down for hits, runs and walks."""
    outs, earned = zero(outs), zero(earned_runs)
    late = F.greatest(F.lit(0), F.floor((outs - 12) / 3))
    unearned = F.greatest(F.lit(0), zero(runs) - earned)
    return (F.lit(50) + outs + late * 2 + zero(strike_outs) - zero(hits) * 2 - earned * 4 - unearned * 2 - zero(walks)).cast("bigint")


def ratio(numerator: Column, denominator: Column, digits: int | None = 3) -> Column:
    """Null over nought."""
    out = numerator / F.nullif(denominator, F.lit(0))
    return out if digits is None else F.round(out, digits)


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def marcel(rates: list[Column], weights: list[Column], league_mean: Column, prior: float = 1200, factors: tuple[int, ...] = (5, 4, 3)) -> Column:
    """Recent seasons first: rates weighted by playing time and recency, drawn towards the league's mean; null without play."""
    played = reduce(lambda a, b: a + b, (F.coalesce(w, F.lit(0.0)) * f for w, f in zip(weights, factors, strict=False)))
    total = reduce(lambda a, b: a + b, (F.coalesce(r * w, F.lit(0.0)) * f for r, w, f in zip(rates, weights, factors, strict=False)))
    return F.when(played > 0, (total + league_mean * prior) / (played + prior))


def clean_name(name: Column) -> Column:
    """Spaces collapse; spaces and dots at the ends go."""
    return F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def safe_key(slug: Column) -> Column:
    return F.replace(slug, F.lit("/"), F.lit("__"))


def grade_from_title(title: Column) -> Column:
    """`psa_10` of `PSA 10`, `SGC-10` or `GEM MINT 10 PSA`; null if no grade stands there."""
    named = lambda pattern, house, number: F.when(F.regexp_extract(title, pattern, house) != "", F.concat_ws("_", F.lower(F.regexp_extract(title, pattern, house)), F.regexp_extract(title, pattern, number)))
    return F.coalesce(named(GRADE_PATTERN, 1, 2), named(GEM_PATTERN, 2, 1))


def money(text: Column) -> Column:
    """The first amount in a text (`$1,234.50`); null if there is none, and numbers without the sign are none."""
    return F.replace(F.nullif(F.regexp_extract(text, MONEY_PATTERN, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def amounts(text: Column) -> Column:
    """All amounts in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(MONEY_PATTERN), 1), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))

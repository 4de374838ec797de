"""Place names: states, countries, residency phrases and the scopes of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundcat.schema import COUNTRIES, STATES

_PLACE = "struct<country:string,state:string,city:string>"


def _one_of(*names: str) -> str:
    return "(?i)^(" + "|".join(names) + ")$"


#: Other spellings of three countries, and words that join restrictions.
US, UK, WORLD = _one_of("us", "usa", r"u\.s\.", "united states(?: of america)?"), _one_of("uk", "gb", "great britain", "united kingdom"), _one_of("worldwide", "global", "international")
COMPOUND = r"(?i)(?<![A-Za-z0-9_])(and|or|except|excluding|within|outside|only if)(?![A-Za-z0-9_])"


def clean(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " "), 1, 100)


def state_name(text: Column) -> Column:
    """The state that a code or name stands for, else null."""
    names = [x for code, name in STATES for x in (F.lit(code.lower()), F.lit(name), F.lit(name.lower()), F.lit(name))]
    return F.try_element_at(F.create_map(*names), F.lower(clean(text)))


def country_name(text: Column) -> Column:
    t = clean(text)
    return F.when(t.rlike(US), "United States").when(t.rlike(UK), "United Kingdom").when(t.rlike(WORLD), "Worldwide").otherwise(t)


def explicit_place(phrase: Column, countries: tuple[str, ...] = COUNTRIES) -> Column:
    """``struct(country, state, city)`` of a phrase that names one place, else null:
    two-letter names, names of both a state and a country, two names of which the second
    is no state, and joined or limited places are refused."""
    known = F.array(*[F.lit(c.lower()) for c in countries])
    text = F.regexp_replace(F.trim(phrase), "(?i)^the ", "")
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    state = state_name(F.regexp_replace(text, "(?i) State$", ""))
    country, second = country_name(F.element_at(parts, -1)), state_name(F.get(parts, F.lit(1)))
    place = lambda c, s=None, t=None: F.struct(*[(F.lit(x) if isinstance(x, str) or x is None else x).cast("string").alias(n) for n, x in (("country", c), ("state", s), ("city", t))]).cast(_PLACE)
    none = F.lit(None).cast(_PLACE)
    middle = F.when(country == "United States", F.coalesce(second, F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(1)))
    return (
        F.when(text.rlike("(?i)^[a-z]{2}$"), none)
        .when(text.rlike(WORLD), place("Worldwide"))
        .when(text.rlike("(?i)^New York City$"), place("United States", "New York", "New York City"))
        .when(state.isNotNull() & F.array_contains(known, F.lower(text)), none)
        .when(state.isNotNull(), place("United States", state))
        .when((F.size(parts) == 2) & second.isNotNull(), place("United States", second, F.get(parts, F.lit(0))))
        .when(~F.array_contains(known, F.lower(country)) | (F.size(parts) > 3), none)
        .when(F.exists(parts, lambda p: p.rlike(COMPOUND)), none)
        .when(F.size(parts) == 1, place(country))
        .when(F.size(parts) == 2, none)
        .otherwise(place(country, middle, F.get(parts, F.lit(0))))
    )


def source_scope(scope: Column, country: Column, state: Column, city: Column, countries: tuple[str, ...] = COUNTRIES) -> Column:
    """How close a source's scope is to a place: 4 its city, 3 its state, 2 its country or
    the world, 1 no place asked for, 0 elsewhere. It chooses sources to search and says
    nothing on who may apply."""
    blank = lambda c: F.lower(F.coalesce(c, F.lit("")))
    country, state, city = blank(country), blank(state), blank(city)
    known = F.array(*[F.lit(c.lower()) for c in (*countries, "Worldwide")])
    parts = F.transform(F.split(F.coalesce(scope, F.lit("")), r"\s*[,/|]\s*"), lambda p: F.lower(F.trim(p)))
    nations = F.transform(parts, lambda p: F.lower(country_name(p)))
    here = F.array_contains(nations, country)
    us = country == "united states"
    alone = (F.size(parts) == 1) & (F.get(parts, F.lit(0)) == state)
    qualified = here | (us & (~F.arrays_overlap(nations, known) | alone))
    return (
        F.when(country == "", 1)
        .when(F.forall(nations, lambda n: F.array_contains(known, n)) & (here | F.array_contains(nations, "worldwide")), 2)
        .when((F.size(parts) == 1) & here, 2)
        .when(~qualified, 0)
        .when((state != "") & (F.size(F.filter(nations, lambda n: n != country)) == 1) & F.array_contains(parts, state), 3)
        .when((city != "") & F.array_contains(parts, city) & ((state == "") | ~here | (F.size(parts) < 3) | F.array_contains(parts, state)), 4)
        .when(us & blank(F.trim(scope)).isin("national", "nationwide"), 2)
        .otherwise(0)
    )


def location_lines(text: Column, most: int = 60, longest: int = 150) -> Column:
    """``array(struct(country, state, city))`` of ``Country | State | City`` lines, all
    null for ``Worldwide``; null if there are none, too many, or one is out of form."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda p: F.trim(p)))
    bad = F.exists(F.arrays_zip(lines.alias("x"), rows.alias("r")), lambda z: (z["x"] != "Worldwide") & ((F.size(z["r"]) > 3) | (z["r"][0] == "") | F.exists(z["r"], lambda p: F.length(p) > longest)))
    part = lambda r, i: F.nullif(F.get(r, F.lit(i)), F.lit(""))
    place = F.transform(rows, lambda r: F.when((F.size(r) == 1) & (r[0] == "Worldwide"), F.lit(None).cast(_PLACE)).otherwise(F.struct(r[0].alias("country"), part(r, 1).alias("state"), part(r, 2).alias("city"))))
    world = F.transform(place, lambda p: F.coalesce(p, F.struct(*[F.lit(None).cast("string").alias(n) for n in ("country", "state", "city")])))
    return F.when(F.size(lines).between(1, most) & ~bad, world)

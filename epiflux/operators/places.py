"""Free-text places to gazetteer entries.

Every step is an equality join on values prepared beforehand, so the work grows
linearly with the names and the gazetteer, whichever country or city is popular.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiflux.functions.fixed_values import (
    COUNTRY_OVERRIDES, EXCLUDED_PLACES, FEATURE_HIERARCHY, GEOCODER_BLACKLIST, PLACE_BLACKLIST,
    PLACE_REMAP, SOURCE_GAZETTEER, SOURCE_GEOCODER, US_STATES,
)
from epiflux.functions.places import first_part, flag_code, fold_for_geocoder, fold_place, is_flag, last_part
from epiflux.operators.matching import fuzzy_states
from epiflux.operators.relational import first_in_both, lookup, rollup_members, union_sparse
from epiflux.session import stored
from epiflux.sources.tables import fixed_table

DETAILS = [
    "geonameid", "asciiname", "country_code", "hierarchy", "feature_code", "latitude", "longitude",
    "admin1_code", "admin2_code", "population",
]


# ---------------------------------------------------------------- gazetteer and dimensions


def build_gazetteer(cities: DataFrame, states: DataFrame, countries: DataFrame) -> DataFrame:
    """Cities, first-level divisions and countries in one table with rank and aliases.

    States come with a ``code`` such as ``US.CA``.  ``aliases`` holds the distinct
    trimmed lower-case names of a row.
    """
    code = F.split("code", r"\.")
    states = states.select(
        "*", F.lit("ADM1").alias("feature_code"),
        code.getItem(0).alias("country_code"), code.getItem(1).alias("admin1_code"),
    ).drop("code")
    countries = countries.withColumn("feature_code", F.lit("PCL"))
    rows = union_sparse([cities, countries, states])
    ranks = F.create_map(*[F.lit(x) for pair in FEATURE_HIERARCHY.items() for x in pair])
    names = F.concat_ws(
        ",", *[F.coalesce(F.col(c), F.lit("")) for c in ("asciiname", "name", "alternatenames")]
    )
    trimmed = F.transform(F.split(F.lower(names), ","), lambda name: F.trim(name))
    return rows.withColumns(
        {
            "hierarchy": F.try_element_at(ranks, F.col("feature_code")),
            "aliases": F.array_sort(F.array_distinct(F.filter(trimmed, lambda name: name != ""))),
        }
    )


def country_names(gazetteer: DataFrame) -> DataFrame:
    """``(code, country)`` in lower case.

    Codes are two capital letters, so there are at most 676 rows and the table
    may be broadcast.
    """
    return (
        gazetteer.filter("feature_code = 'PCL'").filter(F.col("country_code").rlike("^[A-Z]{2}$"))
        .groupBy(F.col("country_code").alias("code"))
        .agg(F.min(F.lower("asciiname")).alias("country"))
    )


def country_dim(gazetteer: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """``(token, code)``: official names, hand-set spellings, language variants; later ones win."""
    spark = gazetteer.sparkSession
    official = gazetteer.filter("feature_code = 'PCL'").select(
        F.col("asciiname").alias("name"), F.col("country_code").alias("code"), F.lit(1).alias("priority")
    )
    overrides = fixed_table(
        spark, [(name, code, 2) for name, code in COUNTRY_OVERRIDES.items()], "name string, code string, priority int"
    )
    frames = official.unionByName(overrides)
    if variants is not None:
        frames = frames.unionByName(variants.select("name", "code", F.lit(3).alias("priority")))
    return frames.groupBy(F.trim(F.lower("name")).alias("token")).agg(
        F.max_by("code", F.struct("priority", "code")).alias("code")
    )


def join_alternate_names(alternates: DataFrame, countries: DataFrame) -> DataFrame:
    """Country names in other languages: rows with a two- or three-letter language code."""
    in_language = alternates.filter(F.col("language").rlike("^[a-zA-Z]{2,3}$"))
    return in_language.join(countries, "geonameid").select(
        "geonameid", "name", "code", "country", "language"
    )


# ---------------------------------------------------------------- normalising raw texts


def _remap_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, PLACE_REMAP.items(), "place string, remapped string")


def normalize_places(raw: DataFrame, text: str, countries: DataFrame) -> DataFrame:
    """Add ``place``, ``place_norm`` and ``outcome`` (kept or discarded) to raw location texts.

    A flag becomes its country's name; blacklisted and excluded texts are
    discarded before the remap table is looked at; the rest is remapped or kept.
    ``countries`` is the bounded table of ``country_names``.
    """
    place = raw.withColumn("place", fold_place(text))
    remap = F.broadcast(_remap_table(raw.sparkSession))  # fixed list
    found = place.join(remap, "place", "left").withColumn("code", flag_code("place"))
    found = found.join(F.broadcast(countries), "code", "left")
    useless = F.col("place").rlike(PLACE_BLACKLIST) | F.col("place").isin(EXCLUDED_PLACES)
    norm = F.when(is_flag("place"), F.col("country")).when(
        ~useless, F.coalesce("remapped", "place")
    )
    return found.withColumn("place_norm", norm).select(
        *raw.columns, "place", "place_norm",
        F.when(F.col("place_norm").isNotNull(), "kept").otherwise("discarded").alias("outcome"),
    )


def place_variants(normalized: DataFrame, text: str) -> DataFrame:
    """``(place_norm, variant, n)``: how often each raw spelling led to a name."""
    return (
        normalized.filter("outcome = 'kept'").groupBy("place_norm", F.col(text).alias("variant"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_places(names: DataFrame) -> DataFrame:
    """Distinct ``place_norm`` with its ``city`` and ``token`` (country or state)."""
    return names.select("place_norm").distinct().select(
        "place_norm", first_part("place_norm").alias("city"), last_part("place_norm").alias("token")
    )


# ---------------------------------------------------------------- matching


def _rank() -> Column:
    """Order of matches: hierarchy, then population downwards, then id; NULL last."""
    return F.struct(
        F.col("hierarchy").isNull().alias("h0"), F.col("hierarchy").alias("h"),
        F.col("population").isNull().alias("p0"), (-F.col("population")).alias("p"),
        F.col("geonameid").alias("geonameid"),
    )


def _with_deletions(name) -> Column:
    """A name and what is left of it without any one of its characters."""
    places = F.sequence(F.lit(1), F.length(name))
    cut = F.transform(places, lambda at: F.concat(name.substr(F.lit(1), at - 1), name.substr(at + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def misspelt_countries(tokens: DataFrame, regions: DataFrame, shortest: int = 4) -> DataFrame:
    """``(token, near)``: country of the region whose main name is one edit from the token.

    Two names one edit apart, or equal, share the name itself or what is left of it without
    a character.  Tokens meet names by these keys, over equality, and are then checked by
    their distance; tokens shorter than ``shortest`` are too ambiguous.
    """
    keyed = tokens.filter(F.length("token") >= shortest).select(
        "token", F.explode(_with_deletions(F.col("token"))).alias("key"))
    named = regions.select(
        F.lower("asciiname").alias("spelt"), "country_code", "hierarchy", "population", "geonameid",
    ).select("*", F.explode(_with_deletions(F.col("spelt"))).alias("key"))
    close = keyed.join(named, "key").filter(F.levenshtein("token", "spelt") == 1)
    return close.groupBy("token").agg(F.min_by("country_code", _rank()).alias("near"))


def resolve_countries(tokens: DataFrame, gazetteer: DataFrame, min_partial: int = 3) -> DataFrame:
    """Country of a token that names a country or state, whole, in part, or with one edit.

    Whole names are looked up among the aliases of countries and states.  Parts of
    at least ``min_partial`` characters are looked up in a table of all substrings
    of their main names; these tables grow with the number of states only.  Tokens that
    are neither are taken for misspelt main names.
    """
    regions = gazetteer.filter("feature_code IN ('PCL', 'ADM1')")
    pick = F.min_by("country_code", _rank()).alias
    whole = regions.select("*", F.explode("aliases").alias("token")).groupBy("token").agg(pick("whole"))
    name = F.lower("asciiname")
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - min_partial + 1, F.lit(1)))
    cut = regions.withColumn("at", F.explode(starts)).withColumn(
        "size", F.explode(F.sequence(F.lit(min_partial), F.greatest(F.length(name) - F.col("at") + 1, F.lit(min_partial))))
    )
    part = cut.withColumn("token", name.substr(F.col("at"), F.col("size"))).groupBy("token").agg(pick("part"))
    found = tokens.join(whole, "token", "left").join(part, "token", "left").withColumn(
        "code", F.coalesce("whole", F.when(F.length("token") >= min_partial, F.col("part"))))
    near = misspelt_countries(found.filter("code IS NULL").select("token").distinct(), regions)
    return found.join(near, "token", "left").select(
        *tokens.columns, F.coalesce("code", "near").alias("country_code"))


def resolve_states(tokens: DataFrame, gazetteer: DataFrame, above: int = 75) -> DataFrame:
    """State code of tokens that are no country: a similar state name, else the token in capitals."""
    states = gazetteer.filter("feature_code = 'ADM1'").select("country_code", "asciiname", "admin1_code")
    located = stored(resolve_countries(tokens, gazetteer), "place-countries")
    return fuzzy_states(located, states, above).select(
        "token", F.coalesce("state_code", F.upper("token")).alias("state_code")
    )


def best_entries(gazetteer: DataFrame) -> DataFrame:
    """Best row per lookup key: ``(kind, scope, alias, best)``.

    Keys of a row are its country and state as a whole, and each alias within its
    country, within its state and anywhere.  One aggregate finds all winners.
    """
    def key(kind: str, scope, alias) -> Column:
        return F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), alias.alias("alias"))

    country, state, nothing = F.col("country_code"), F.upper("admin1_code"), F.lit("")
    keys = F.concat(
        F.array(key("whole country", country, nothing), key("whole state", state, nothing)),
        F.flatten(
            F.transform(
                "aliases",
                lambda alias: F.array(
                    key("country", country, alias), key("state", state, alias), key("anywhere", nothing, alias)
                ),
            )
        ),
    )
    rows = gazetteer.select(_rank().alias("best"), F.inline_outer(keys)).filter("scope IS NOT NULL")
    return rows.groupBy("kind", "scope", "alias").agg(F.min("best").alias("best"))


def match_places(names: DataFrame, gazetteer: DataFrame, countries: DataFrame) -> DataFrame:
    """``(place_norm, city, token, geonameid)``; ``geonameid`` is NULL for unmapped names.

    ``names`` come from ``split_places``.  A match depends on (city, token) only,
    so distinct pairs are matched and joined back.  A pair asks for one or two
    lookup keys, and each key meets at most one row.
    """
    distinct = stored(names.select("city", "token").distinct(), "place-pairs")
    tokens = distinct.select("token").distinct().join(countries.select("token", "code"), "token", "left")
    tokens = stored(tokens, "place-tokens")
    states = resolve_states(tokens.filter("code IS NULL").select("token"), gazetteer)
    scopes = tokens.join(states, "token", "left")
    # one country or state may be behind most pairs
    asked = stored(lookup(distinct, scopes, "token"), "place-keys")

    def key(kind: str, scope: str | None, alias: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), (F.col(scope) if scope else F.lit("")).alias("scope"), alias.alias("alias")
        )

    whole = F.col("city") == F.col("token")
    # an empty city is no alias of any entry, so it finds nothing
    city, nothing = F.nullif("city", F.lit("")), F.lit("")
    keys = (
        F.when(F.col("code").isNotNull() & whole, F.array(key("whole country", "code", nothing)))
        .when(F.col("code").isNotNull(), F.array(key("country", "code", city)))
        .when(whole, F.array(key("whole state", "state_code", nothing), key("anywhere", None, F.col("token"))))
        .otherwise(F.array(key("state", "state_code", city)))
    )
    looked_up = asked.select("city", "token", F.inline_outer(keys)).join(
        best_entries(gazetteer), ["kind", "scope", "alias"]
    )

    # city and state name among one row's aliases: reduce each row to its asked-for names first
    both = asked.filter(F.col("code").isNull() & ~whole).select("city", "token")
    aliases = gazetteer.select("geonameid", _rank().alias("best"), F.explode("aliases").alias("alias"))
    token_rows = aliases.join(both.select(F.col("token").alias("alias")).distinct(), "alias").select(
        "geonameid", "best", F.col("alias").alias("token")
    )
    city_rows = aliases.join(both.select(F.col("city").alias("alias")).distinct(), "alias").select(
        "geonameid", F.col("alias").alias("city")
    )
    shared = token_rows.join(city_rows, "geonameid").join(both, ["city", "token"], "left_semi")

    best = (
        looked_up.select("city", "token", "best").unionByName(shared.select("city", "token", "best"))
        .groupBy("city", "token").agg(F.min("best").alias("best"))
    )
    return names.join(best, ["city", "token"], "left").select(
        "place_norm", "city", "token", F.col("best.geonameid").alias("geonameid")
    )


# ---------------------------------------------------------------- roll-ups


def _members(text: Column) -> Column:
    pieces = F.transform(F.split(F.lower(text), ","), lambda piece: F.trim(piece))
    return F.filter(pieces, lambda piece: piece != "")


def _with_details(rolled: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return lookup(rolled, gazetteer.select(*DETAILS), "geonameid").select(*DETAILS, "member", "queried")


def rollup_places(mapped: DataFrame, variants: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """A row per gazetteer entry and synonym, which is ``queried`` where it is a name that led to the entry.

    Synonyms are the normalised names, the comma pieces of their raw spellings,
    and the entry's own aliases.
    """
    hits = mapped.filter("geonameid IS NOT NULL").select("geonameid", "place_norm").distinct()
    names = hits.select("geonameid", F.col("place_norm").alias("member"), F.lit(True).alias("queried"))
    spellings = lookup(variants.select("place_norm", "variant"), hits, "place_norm", "inner").select(
        "geonameid", F.explode(_members(F.col("variant"))).alias("member"), F.lit(False).alias("queried")
    )
    own = gazetteer.join(hits.select("geonameid").distinct(), "geonameid", "left_semi").select(
        "geonameid", F.explode("aliases").alias("member"), F.lit(False).alias("queried")
    )
    rolled = rollup_members(
        names.unionByName(spellings).unionByName(own), ["geonameid"], "member", flags=("queried",)
    )
    return _with_details(rolled, gazetteer)


def rollup_geocoded(results: DataFrame, variants: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Roll-up of geocoder results, joined to the gazetteer on folded name and country.

    Per name only the entries that are first both by hierarchy and by population
    stay; a name may lose all of them.
    """
    entries = gazetteer.withColumn("asciiname", F.lower("asciiname"))
    hits = results.select(
        F.lower("place_norm").alias("asciiname"), "country_code", "place_queried"
    ).distinct()
    found = hits.select("asciiname", "country_code").distinct().join(entries, ["asciiname", "country_code"])
    first = first_in_both(found, "asciiname", "hierarchy", "population")
    queried = first.select("geonameid", "asciiname", "country_code").join(hits, ["asciiname", "country_code"])
    names = queried.select("geonameid", F.col("place_queried").alias("member"), F.lit(True).alias("queried"))
    spellings = lookup(
        variants.select(F.col("place_norm").alias("place_queried"), "variant"),
        queried.select("geonameid", "place_queried").distinct(), "place_queried", "inner"
    ).select("geonameid", F.explode(_members(F.col("variant"))).alias("member"), F.lit(False).alias("queried"))
    own = first.select("geonameid", F.explode("aliases").alias("member"), F.lit(False).alias("queried"))
    rolled = rollup_members(
        names.unionByName(spellings).unionByName(own), ["geonameid"], "member", flags=("queried",)
    )
    return _with_details(rolled, entries)


def union_sources(from_gazetteer: DataFrame, from_geocoder: DataFrame) -> DataFrame:
    """Both mappings in one table, labelled by origin."""
    return union_sparse(
        [
            from_gazetteer.withColumn("source", F.lit(SOURCE_GAZETTEER)),
            from_geocoder.withColumn("source", F.lit(SOURCE_GEOCODER)),
        ]
    )


# ---------------------------------------------------------------- geocoder input and output


def geocoder_candidates(names: DataFrame, text: str) -> DataFrame:
    """Cleaned names worth sending to a geocoder."""
    cleaned = names.withColumn("candidate", fold_for_geocoder(text))
    place = F.col("candidate")
    return cleaned.filter(
        (F.length(place) > 2) & ~place.rlike(PLACE_BLACKLIST) & ~place.rlike(GEOCODER_BLACKLIST)
        & ~place.isin(EXCLUDED_PLACES)
    )


def normalize_geocoded(results: DataFrame, short_names: DataFrame) -> DataFrame:
    """Add ``place_norm`` to geocoder results.

    Streets become their city or country, US states their full name (the
    abbreviation when unknown), other states their text, and a bare country code
    the country's name.  ``short_names`` is a ``(code, country)`` table of
    two-letter codes.
    """
    spark = results.sparkSession
    states = fixed_table(spark, US_STATES.items(), "state string, state_name string")
    joined = results.join(F.broadcast(states), "state", "left").join(
        F.broadcast(short_names.withColumnRenamed("country", "short_name")),
        F.col("country") == F.col("code"), "left",
    )
    quality = F.col("quality")
    place = (
        F.when(quality == "STREET", F.when(F.length("city") > 0, F.col("city")).otherwise(F.col("country")))
        .when(
            (quality == "STATE") & (F.length("state") > 0),
            F.when(F.col("country") == "US", F.coalesce("state_name", "state")).otherwise(F.col("state")),
        )
        .when(
            (quality == "COUNTRY") & (F.col("address") == F.col("country")),
            F.coalesce("short_name", "address"),
        )
        .otherwise(F.col("address"))
    )
    return joined.withColumn("place_norm", place).select(*results.columns, "place_norm")

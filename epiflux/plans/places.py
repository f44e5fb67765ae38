"""Place normalisation: regions are countries, nations states, suppliers cities."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.functions.fixed_values import (
    COUNTRY_OVERRIDES, EXCLUDED_PLACES, FEATURE_HIERARCHY, GEOCODER_BLACKLIST, PLACE_BLACKLIST,
    PLACE_REMAP, SOURCE_GAZETTEER, SOURCE_GEOCODER, US_STATES,
)
from epiflux.functions.places import code_flag
from epiflux.operators import places
from epiflux.plans.bindings import RATIOS_SQL, joined
from epiflux.plans.registry import query, sql_list, sql_rows, sql_text
from epiflux.session import stored
from epiflux.sources.tables import table

_CITY_CODES = ["PPLC", "PPLA", "PPLA2", "PPL", "PPLX", "PPLA3", "STLMT"]
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "".join(chr(0x1F1E6 + i) for i in range(26))

GAZETTEER_SQL = f"""
home AS (
  SELECT n_nationkey, n_name, r_regionkey, r_name, left(r_name, 2) AS cc
  FROM nation JOIN region ON n_regionkey = r_regionkey),
entries AS (
  SELECT s_suppkey AS geonameid, 'City ' || s_suppkey % 40 AS asciiname, s_name AS name,
         'Town ' || s_suppkey % 30 || ', ,Ville ' || s_suppkey % 25 || CASE WHEN s_suppkey % 6 = 0 THEN ', ' || n_name ELSE '' END AS alternatenames,
         cc AS country_code, [{sql_list(_CITY_CODES)}][s_suppkey % 7 + 1] AS feature_code, s_acctbal / 100 AS latitude,
         -s_acctbal / 50 AS longitude, 'n' || n_nationkey AS admin1_code, CAST(s_suppkey % 9 AS VARCHAR) AS admin2_code,
         CASE WHEN s_suppkey % 5 > 0 THEN CAST(floor(s_acctbal * 10) AS BIGINT) END AS population
  FROM supplier JOIN home ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 8000000 + n_nationkey, n_name, n_name || ' State', NULL, cc, 'ADM1', NULL, NULL, 'n' || n_nationkey, NULL, NULL FROM home
  UNION ALL
  SELECT 9000000 + r_regionkey, r_name, NULL, NULL, left(r_name, 2), 'PCL', NULL, NULL, NULL, NULL, (r_regionkey + 1) * 1000000 FROM region),
gaz AS (
  SELECT *, CASE feature_code {" ".join(f"WHEN '{k}' THEN {v}" for k, v in FEATURE_HIERARCHY.items())} END AS hierarchy,
         list_sort(list_distinct(list_filter(list_transform(
           string_split(lower(asciiname || ',' || coalesce(name, '') || ',' || coalesce(alternatenames, '')), ','),
           lambda v: trim(v)), lambda v: v <> ''))) AS aliases
  FROM entries)
"""


def gazetteer(spark, folder):
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    home = nations.join(regions, nations.n_regionkey == regions.r_regionkey).withColumn(
        "cc", F.left("r_name", F.lit(2))
    )
    key = F.col("s_suppkey")
    codes = F.array(*[F.lit(code) for code in _CITY_CODES])
    suppliers = table(spark, folder, "supplier")
    cities = suppliers.join(home, suppliers.s_nationkey == home.n_nationkey).select(
        key.alias("geonameid"),
        F.concat(F.lit("City "), key % 40).alias("asciiname"),
        F.col("s_name").alias("name"),
        F.concat(
            F.lit("Town "), key % 30, F.lit(", ,Ville "), key % 25,
            F.when(key % 6 == 0, F.concat(F.lit(", "), "n_name")).otherwise(""),
        ).alias("alternatenames"),
        F.col("cc").alias("country_code"),
        F.element_at(codes, (key % 7 + 1).cast("int")).alias("feature_code"),
        (F.col("s_acctbal") / 100).alias("latitude"),
        (-F.col("s_acctbal") / 50).alias("longitude"),
        F.concat(F.lit("n"), "n_nationkey").alias("admin1_code"),
        (key % 9).cast("string").alias("admin2_code"),
        F.when(key % 5 > 0, F.floor(F.col("s_acctbal") * 10)).alias("population"),
    )
    states = home.select(
        (F.lit(8000000) + F.col("n_nationkey")).cast("bigint").alias("geonameid"),
        F.col("n_name").alias("asciiname"), F.concat("n_name", F.lit(" State")).alias("name"),
        F.concat("cc", F.lit(".n"), "n_nationkey").alias("code"),
    )
    countries = regions.select(
        (F.lit(9000000) + F.col("r_regionkey")).cast("bigint").alias("geonameid"),
        F.col("r_name").alias("asciiname"), F.left("r_name", F.lit(2)).alias("country_code"),
        ((F.col("r_regionkey") + 1) * 1000000).cast("bigint").alias("population"),
    )
    return stored(places.build_gazetteer(cities, states, countries), "gazetteer")


_COLUMNS = (
    "geonameid, asciiname, country_code, hierarchy, feature_code, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude, admin1_code, admin2_code, population"
)


def _rounded(frame):
    return frame.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "gazetteer_build",
    f"WITH {GAZETTEER_SQL} SELECT {_COLUMNS}, array_to_string(aliases, '|') AS aliases FROM gaz",
)
def gazetteer_build(spark, folder):
    rows = gazetteer(spark, folder).select(*places.DETAILS, joined("aliases").alias("aliases"))
    return _rounded(rows)


_VARIANTS_SQL = """
variants AS (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN 'Brasil' ELSE 'Land ' || c_custkey % 60 END AS name, min(left(r_name, 2)) AS code
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
"""

COUNTRIES_SQL = f"""
{_VARIANTS_SQL},
named AS (
  SELECT asciiname AS name, country_code AS code, 1 AS priority FROM gaz WHERE feature_code = 'PCL'
  UNION ALL SELECT * FROM (VALUES {sql_rows((k, v, 2) for k, v in COUNTRY_OVERRIDES.items())})
  UNION ALL SELECT name, code, 3 FROM variants),
dim AS (
  SELECT token, code FROM (
    SELECT trim(lower(name)) AS token, code,
           row_number() OVER (PARTITION BY trim(lower(name)) ORDER BY priority DESC, code DESC) AS rn FROM named)
  WHERE rn = 1)
"""


def countries(spark, folder, gaz):
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    home = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    variants = customers.join(home, customers.c_nationkey == home.n_nationkey).groupBy(
        F.when(key % 50 == 0, "Brasil").otherwise(F.concat(F.lit("Land "), key % 60)).alias("name")
    ).agg(F.min(F.left("r_name", F.lit(2))).alias("code"))
    return places.country_dim(gaz, variants)


@query("country_dim", f"WITH {GAZETTEER_SQL}, {COUNTRIES_SQL} SELECT token, code FROM dim")
def country_dim(spark, folder):
    return countries(spark, folder, gazetteer(spark, folder))


# Location texts of sixteen kinds, by customer key.
RAW_SQL = f"""
raw AS (
  SELECT c_custkey, CASE c_custkey % 18
    WHEN 0 THEN 'City ' || c_custkey % 50 || ', ' || r_name
    WHEN 1 THEN '(Town ' || c_custkey % 35 || '), ' || n_name
    WHEN 2 THEN 'city ' || c_custkey % 45 || ' , N' || n_nationkey
    WHEN 3 THEN n_name || '!'
    WHEN 4 THEN ' ' || r_name
    WHEN 5 THEN 'Ville ' || c_custkey % 25 || ', ' || replace(n_name, 'TIO', 'OIT')
    WHEN 6 THEN 'U.S.A.'
    WHEN 7 THEN 'Planet Earth #' || c_custkey
    WHEN 8 THEN translate(cc, {sql_text(_LETTERS)}, {sql_text(_SIGNS)})
    WHEN 9 THEN 'SF'
    WHEN 10 THEN c_name
    WHEN 11 THEN 'Town ' || c_custkey % 35
    WHEN 12 THEN 'Ville ' || c_custkey % 30 || ', Town ' || c_custkey % 35
    WHEN 13 THEN 'City ' || c_custkey % 45 || ', ' || substring(lower(n_name), 2)
    WHEN 14 THEN {sql_text("".join(_SIGNS[_LETTERS.index(c)] for c in "US"))}
    WHEN 15 THEN 'City ' || c_custkey % 45 || ', Land ' || c_custkey % 60
    WHEN 16 THEN ', ' || r_name
    ELSE '(), ' || n_name END AS place_ori
  FROM customer JOIN home ON c_nationkey = n_nationkey)
"""


def raw_places(spark, folder):
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation")
    home = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    customers = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey")
    key, nation, region = F.col("c_custkey"), F.col("n_name"), F.col("r_name")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    kinds = [
        text("City ", key % 50, ", ", region),
        text("(Town ", key % 35, "), ", nation),
        text("city ", key % 45, " , N", F.col("n_nationkey")),
        text(nation, "!"),
        text(" ", region),
        text("Ville ", key % 25, ", ", F.replace(nation, F.lit("TIO"), F.lit("OIT"))),
        F.lit("U.S.A."),
        text("Planet Earth #", key),
        code_flag(F.left(region, F.lit(2))),
        F.lit("SF"),
        F.col("c_name"),
        text("Town ", key % 35),
        text("Ville ", key % 30, ", Town ", key % 35),
        text("City ", key % 45, ", ", F.substring(F.lower(nation), 2, 100)),
        code_flag(F.lit("US")),
        text("City ", key % 45, ", Land ", key % 60),
        text(", ", region),
        text("(), ", nation),
    ]
    place = F.coalesce(*[F.when(key % 18 == i, kind) for i, kind in enumerate(kinds)])
    return customers.join(home, customers.c_nationkey == home.n_nationkey).select(
        "c_custkey", place.alias("place_ori")
    )


# RE2 takes no escaped underscore; it stands for itself
_BLACKLIST_SQL = sql_text(PLACE_BLACKLIST.replace(r"\_", "_"))

NORMALIZE_SQL = f"""
{RAW_SQL},
remap AS (SELECT * FROM (VALUES {sql_rows(PLACE_REMAP.items())}) AS t(place, remapped)),
folded AS (SELECT *, regexp_replace(lower(trim(place_ori)), '[.#!@]', '', 'g') AS place FROM raw),
coded AS (
  SELECT *, CASE WHEN regexp_matches(place, '^[\\x{{1F1E6}}-\\x{{1F1FF}}]{{2}}$')
                 THEN translate(place, {sql_text(_SIGNS)}, {sql_text(_LETTERS)}) END AS code FROM folded),
normed AS (
  SELECT c_custkey, place_ori, coded.place,
         CASE WHEN code IS NOT NULL THEN lower(r_name)
              WHEN regexp_matches(coded.place, {_BLACKLIST_SQL}) OR coded.place IN ({sql_list(EXCLUDED_PLACES)}) THEN NULL
              ELSE coalesce(remapped, coded.place) END AS place_norm
  FROM coded LEFT JOIN remap ON coded.place = remap.place LEFT JOIN region ON left(r_name, 2) = code),
normalized AS (SELECT *, CASE WHEN place_norm IS NULL THEN 'discarded' ELSE 'kept' END AS outcome FROM normed)
"""


def normalized(spark, folder, gaz):
    rows = places.normalize_places(raw_places(spark, folder), "place_ori", places.country_names(gaz))
    return stored(rows, "places")


@query(
    "place_normalize",
    f"WITH {GAZETTEER_SQL}, {NORMALIZE_SQL} SELECT c_custkey, place_ori, place, place_norm, outcome FROM normalized",
)
def place_normalize(spark, folder):
    return normalized(spark, folder, gazetteer(spark, folder))


@query(
    "place_synonyms",
    f"""
    WITH {GAZETTEER_SQL}, {NORMALIZE_SQL}
    SELECT place_norm, place_ori AS member, count(*) AS n FROM normalized WHERE outcome = 'kept' GROUP BY ALL
    """,
)
def place_synonyms(spark, folder):
    kept = normalized(spark, folder, gazetteer(spark, folder)).filter("outcome = 'kept'")
    return places.rollup_members(kept, ["place_norm"], "place_ori")


SPLIT_SQL = r"""
names AS (
  SELECT place_norm, regexp_replace(split_part(place_norm, ',', 1), '^\s+|\s+$|\)|\(', '', 'g') AS city,
         regexp_replace(string_split(place_norm, ',')[-1], '^\s+|\s+$|\)|\(', '', 'g') AS token
  FROM (SELECT DISTINCT place_norm FROM normalized WHERE outcome = 'kept'))
"""


@query(
    "split_place",
    f"WITH {GAZETTEER_SQL}, {NORMALIZE_SQL}, {SPLIT_SQL} SELECT place_norm, city, token FROM names",
)
def split_place(spark, folder):
    return names(spark, folder, gazetteer(spark, folder))


def names(spark, folder, gaz):
    return names_of(normalized(spark, folder, gaz))


def names_of(norm):
    return places.split_places(norm.filter("outcome = 'kept'"))


_RESOLVED_SQL = """
resolved AS (
  SELECT token, coalesce(
    (SELECT arg_min(country_code, (hierarchy, -coalesce(population, -1), geonameid)) FROM gaz
     WHERE feature_code IN ('PCL', 'ADM1') AND list_contains(aliases, token)),
    (SELECT arg_min(country_code, (hierarchy, -coalesce(population, -1), geonameid)) FROM gaz
     WHERE feature_code IN ('PCL', 'ADM1') AND length(token) >= 3 AND contains(lower(asciiname), token)),
    (SELECT arg_min(country_code, (hierarchy, -coalesce(population, -1), geonameid)) FROM gaz
     WHERE feature_code IN ('PCL', 'ADM1') AND length(token) >= 4 AND levenshtein(token, lower(asciiname)) = 1)) AS country_code
  FROM tokens)
"""
RESOLVE_SQL = f"""
tokens AS (SELECT DISTINCT token FROM names WHERE token NOT IN (SELECT token FROM dim)),
{_RESOLVED_SQL}
"""


@query(
    "country_resolve",
    f"""
    WITH {GAZETTEER_SQL}, {COUNTRIES_SQL}, {NORMALIZE_SQL}, {SPLIT_SQL},
    regions AS (SELECT lower(asciiname) AS name FROM gaz WHERE feature_code IN ('PCL', 'ADM1') AND length(asciiname) >= 5),
    tokens AS (
      SELECT token FROM names WHERE token NOT IN (SELECT token FROM dim)
      UNION SELECT substr(name, 1, 2) || substr(name, 4) FROM regions
      UNION SELECT substr(name, 1, 3) || 'q' || substr(name, 4) FROM regions
      UNION SELECT substr(name, 1, 1) || 'q' || substr(name, 3) FROM regions),
    {_RESOLVED_SQL}
    SELECT token, country_code FROM resolved
    """,
)
def country_resolve(spark, folder):
    """Tokens of the places, and the names of all regions misspelt in three ways."""
    gaz = gazetteer(spark, folder)
    known = countries(spark, folder, gaz).select("token")
    tokens = names(spark, folder, gaz).select("token").distinct().join(known, "token", "left_anti")
    name = F.lower("asciiname")
    rest = lambda at: F.substring(name, F.lit(at), F.length(name))
    misspelt = gaz.filter("feature_code IN ('PCL', 'ADM1')").filter(F.length("asciiname") >= 5).select(F.explode(F.array(
        F.concat(F.left(name, F.lit(2)), rest(4)), F.concat(F.left(name, F.lit(3)), F.lit("q"), rest(4)),
        F.concat(F.left(name, F.lit(1)), F.lit("q"), rest(3)))).alias("token"))
    return places.resolve_countries(tokens.union(misspelt).distinct(), gaz)


# every name against every entry, without any of the lookups of the operator
MATCH_SQL = f"""
{RESOLVE_SQL},
divisions AS (
  SELECT token, upper(admin1_code) AS code, lower(asciiname) AS c, asciiname
  FROM resolved JOIN gaz ON gaz.country_code = resolved.country_code AND feature_code = 'ADM1'),
compared AS (SELECT DISTINCT token AS p, c FROM divisions WHERE token <> '' AND c <> ''),
{RATIOS_SQL},
likeness AS (SELECT token, code, score, asciiname FROM divisions JOIN ratios ON token = p AND divisions.c = ratios.c),
state AS (
  SELECT token, coalesce((SELECT arg_min(code, (-score, lower(asciiname))) FROM likeness AS l WHERE l.token = tokens.token AND score > 75),
                         upper(token)) AS state_code FROM tokens),
pairs AS (
  SELECT place_norm, geonameid, row_number() OVER (PARTITION BY place_norm ORDER BY hierarchy ASC NULLS LAST,
         population DESC NULLS LAST, geonameid) AS rn
  FROM names LEFT JOIN dim ON names.token = dim.token LEFT JOIN state ON names.token = state.token
  JOIN gaz ON (CASE WHEN code IS NOT NULL THEN country_code = code
               ELSE list_contains(aliases, names.token) OR coalesce(upper(admin1_code) = state_code, false) END)
          AND (city = names.token OR list_contains(aliases, city))),
mapped AS (
  SELECT names.place_norm, city, token, geonameid
  FROM names LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) AS p ON names.place_norm = p.place_norm)
"""
_ALL_SQL = f"WITH RECURSIVE {GAZETTEER_SQL}, {COUNTRIES_SQL}, {NORMALIZE_SQL}, {SPLIT_SQL}, {MATCH_SQL}"


def _mapped(spark, folder, gaz, norm):
    return places.match_places(names_of(norm), gaz, countries(spark, folder, gaz))


@query("place_match", f"{_ALL_SQL} SELECT place_norm, city, token, geonameid FROM mapped")
def place_match(spark, folder):
    gaz = gazetteer(spark, folder)
    return _mapped(spark, folder, gaz, normalized(spark, folder, gaz))


@query("place_unmatched", f"{_ALL_SQL} SELECT place_norm FROM mapped WHERE geonameid IS NULL")
def place_unmatched(spark, folder):
    return place_match(spark, folder).filter("geonameid IS NULL").select("place_norm")


_ROLLUP_SQL = f"""
members AS (
  SELECT geonameid, place_norm AS member, true AS queried FROM mapped WHERE geonameid IS NOT NULL
  UNION ALL
  SELECT geonameid, trim(unnest(string_split(lower(place_ori), ','))), false FROM mapped JOIN normalized USING (place_norm)
  WHERE geonameid IS NOT NULL
  UNION ALL
  SELECT geonameid, unnest(aliases), false FROM gaz WHERE geonameid IN (SELECT geonameid FROM mapped)),
rolled AS (
  SELECT {_COLUMNS}, member, queried FROM (
    SELECT geonameid, member, bool_or(queried) AS queried
    FROM members WHERE member <> '' GROUP BY ALL) JOIN gaz USING (geonameid))
"""


def _from_gazetteer(spark, folder, gaz, norm):
    mapped = stored(_mapped(spark, folder, gaz, norm), "place-map")
    return places.rollup_places(mapped, places.place_variants(norm, "place_ori"), gaz)


@query("place_rollup", f"{_ALL_SQL}, {_ROLLUP_SQL} SELECT * FROM rolled")
def place_rollup(spark, folder):
    gaz = gazetteer(spark, folder)
    return _rounded(_from_gazetteer(spark, folder, gaz, normalized(spark, folder, gaz)))


GEOCODED_SQL = f"""
answers AS (
  SELECT c_custkey, place_norm AS place_queried,
         CASE c_custkey % 4 WHEN 0 THEN 'CITY ' || c_custkey % 40 WHEN 1 THEN n_name WHEN 2 THEN r_name ELSE 'City 3' END AS place_norm,
         cc AS country_code
  FROM normalized JOIN customer USING (c_custkey) JOIN home ON c_nationkey = n_nationkey WHERE outcome = 'kept'),
found AS (
  SELECT gaz.*, lower(asciiname) AS folded FROM gaz
  JOIN (SELECT DISTINCT lower(place_norm) AS f, country_code AS c FROM answers) ON lower(asciiname) = f AND country_code = c),
ranked AS (
  SELECT *, CASE WHEN hierarchy IS NOT NULL THEN rank() OVER (PARTITION BY folded ORDER BY hierarchy ASC NULLS LAST) END AS a,
         CASE WHEN population IS NOT NULL THEN rank() OVER (PARTITION BY folded ORDER BY population DESC NULLS LAST) END AS b FROM found),
firsts AS (SELECT * FROM ranked WHERE a = 1 AND b = 1),
gmembers AS (
  SELECT geonameid, place_queried AS member, true AS queried
  FROM firsts JOIN answers ON folded = lower(place_norm) AND firsts.country_code = answers.country_code
  UNION ALL
  SELECT geonameid, trim(unnest(string_split(lower(place_ori), ','))), false
  FROM firsts JOIN answers ON folded = lower(place_norm) AND firsts.country_code = answers.country_code
  JOIN normalized ON normalized.place_norm = place_queried
  UNION ALL SELECT geonameid, unnest(aliases), false FROM firsts),
geocoded AS (
  SELECT {_COLUMNS.replace("asciiname", "lower(asciiname) AS asciiname")}, member, queried FROM (
    SELECT geonameid, member, bool_or(queried) AS queried
    FROM gmembers WHERE member <> '' GROUP BY ALL) JOIN gaz USING (geonameid))
"""


def _from_geocoder(spark, folder, gaz, norm):
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation")
    home = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    answers = (
        norm.filter("outcome = 'kept'").join(customers, "c_custkey")
        .join(home, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("place_norm").alias("place_queried"),
            F.when(key % 4 == 0, F.concat(F.lit("CITY "), key % 40)).when(key % 4 == 1, F.col("n_name"))
            .when(key % 4 == 2, F.col("r_name")).otherwise("City 3").alias("place_norm"),
            F.left("r_name", F.lit(2)).alias("country_code"),
        )
    )
    return places.rollup_geocoded(answers, places.place_variants(norm, "place_ori"), gaz)


@query("geocoded_rollup", f"WITH {GAZETTEER_SQL}, {NORMALIZE_SQL}, {GEOCODED_SQL} SELECT * FROM geocoded")
def geocoded_rollup(spark, folder):
    gaz = gazetteer(spark, folder)
    return _rounded(_from_geocoder(spark, folder, gaz, normalized(spark, folder, gaz)))


@query(
    "place_union",
    f"""
    {_ALL_SQL}, {_ROLLUP_SQL}, {GEOCODED_SQL}
    SELECT *, '{SOURCE_GAZETTEER}' AS source FROM rolled UNION ALL SELECT *, '{SOURCE_GEOCODER}' FROM geocoded
    """,
)
def place_union(spark, folder):
    gaz = gazetteer(spark, folder)
    norm = normalized(spark, folder, gaz)
    both = places.union_sources(
        _from_gazetteer(spark, folder, gaz, norm), _from_geocoder(spark, folder, gaz, norm)
    )
    return _rounded(both)


_STATE_CODES = list(US_STATES)
_ANSWER_SQL = f"""
answers AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'STREET' WHEN 1 THEN 'STREET' WHEN 2 THEN 'STATE' WHEN 3 THEN 'STATE'
                    WHEN 4 THEN 'COUNTRY' ELSE 'CITY' END AS quality,
         CASE WHEN c_custkey % 6 = 1 THEN '' ELSE 'City ' || c_custkey % 40 END AS city,
         CASE c_custkey % 6 WHEN 2 THEN 'US' ELSE cc END AS country,
         CASE c_custkey % 6 WHEN 2 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Q' ELSE [{sql_list(_STATE_CODES)}][c_custkey % {len(_STATE_CODES)} + 1] END
                            WHEN 3 THEN CASE WHEN c_custkey % 4 = 1 THEN '' ELSE n_name END ELSE '' END AS state,
         CASE WHEN c_custkey % 12 = 4 THEN cc ELSE c_name END AS address
  FROM customer JOIN home ON c_nationkey = n_nationkey)
"""


@query(
    "geocode_normalize",
    f"""
    WITH {GAZETTEER_SQL}, {_ANSWER_SQL},
    states AS (SELECT * FROM (VALUES {sql_rows(US_STATES.items())}) AS t(abbreviation, state_name))
    SELECT c_custkey, quality, CASE
      WHEN quality = 'STREET' THEN CASE WHEN city <> '' THEN city ELSE country END
      WHEN quality = 'STATE' AND state <> '' THEN CASE WHEN country = 'US' THEN coalesce(state_name, state) ELSE state END
      WHEN quality = 'COUNTRY' AND address = country THEN lower(r_name)
      ELSE address END AS place_norm
    FROM answers LEFT JOIN states ON state = abbreviation LEFT JOIN region ON left(r_name, 2) = country
    """,
)
def geocode_normalize(spark, folder):
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation")
    home = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    customers = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey")
    key, cc = F.col("c_custkey"), F.left("r_name", F.lit(2))
    kind = key % 6
    codes = F.array(*[F.lit(code) for code in _STATE_CODES])
    answers = customers.join(home, customers.c_nationkey == home.n_nationkey).select(
        "c_custkey",
        F.when(kind < 2, "STREET").when(kind < 4, "STATE").when(kind == 4, "COUNTRY").otherwise("CITY").alias("quality"),
        F.when(kind == 1, "").otherwise(F.concat(F.lit("City "), key % 40)).alias("city"),
        F.when(kind == 2, "US").otherwise(cc).alias("country"),
        F.when(
            kind == 2,
            F.when(key % 5 == 0, "Q").otherwise(F.element_at(codes, (key % len(_STATE_CODES) + 1).cast("int"))),
        ).when(kind == 3, F.when(key % 4 == 1, "").otherwise(F.col("n_name"))).otherwise("").alias("state"),
        F.when(key % 12 == 4, cc).otherwise(F.col("c_name")).alias("address"),
    )
    short_names = places.country_names(gazetteer(spark, folder))
    return places.normalize_geocoded(answers, short_names).select("c_custkey", "quality", "place_norm")


@query(
    "geocode_candidates",
    f"""
    WITH {GAZETTEER_SQL}, {RAW_SQL},
    c AS (SELECT c_custkey, regexp_replace(lower(place_ori), '@|#|:|^[0-9]+$|\\||/{{2,}}', '', 'g') AS candidate FROM raw)
    SELECT c_custkey, candidate FROM c WHERE length(candidate) > 2
      AND NOT regexp_matches(candidate, {_BLACKLIST_SQL})
      AND NOT regexp_matches(candidate, {sql_text(GEOCODER_BLACKLIST)})
      AND candidate NOT IN ({sql_list(EXCLUDED_PLACES)})
    """,
)
def geocode_candidates(spark, folder):
    rows = raw_places(spark, folder).select("c_custkey", F.lower("place_ori").alias("text"))
    return places.geocoder_candidates(rows, "text").select("c_custkey", "candidate")

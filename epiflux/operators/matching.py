"""Approximate matching of names, always behind an equality: a block, a gram, or the row itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.functions.similarity import best_by_block_ratio, best_by_edit_ratio, char_ngrams
from epiflux.operators.relational import lookup
from epiflux.session import stored


def states_by_country(states: DataFrame) -> DataFrame:
    """Folded state names per country as one array, and their codes as a map.

    First-level divisions are a few hundred per country at most, however large
    the texts to match are.
    """
    named = states.groupBy("country_code", F.lower("asciiname").alias("name")).agg(
        F.min(F.upper("admin1_code")).alias("code")
    )
    entries = F.sort_array(F.collect_list(F.struct("name", "code")))
    return named.groupBy("country_code").agg(entries.alias("entries")).select(
        "country_code", F.col("entries.name").alias("state_names"),
        F.map_from_entries("entries").alias("state_codes"),
    )


def fuzzy_states(tokens: DataFrame, states: DataFrame, above: int = 75, by: str = "blocks") -> DataFrame:
    """Add ``score``, ``state_name`` and ``state_code`` of the most similar state in the token's country.

    ``tokens`` has ``country_code`` and ``token``.  The states of a country travel
    as one array, so each token stays one row: no token-state pairs are made.
    ``by`` is ``blocks`` (matching blocks) or ``edits`` (edit distance).  Scores up to ``above`` give NULL.
    """
    joined = lookup(tokens, states_by_country(states), "country_code")
    if by == "edits":
        best = best_by_edit_ratio(F.col("token"), F.col("state_names"))
    else:
        best = best_by_block_ratio(F.col("token"), F.col("state_names"), above)
    scored = joined.withColumn("_best", best)
    good = F.col("_best.score") > above
    return scored.select(
        *tokens.columns,
        F.when(good, F.col("_best.score")).alias("score"),
        F.when(good, F.col("_best.choice")).alias("state_name"),
        F.when(good, F.try_element_at("state_codes", F.col("_best.choice"))).alias("state_code"),
    )


def alias_scores(df: DataFrame, pattern: str, aliases: str) -> DataFrame:
    """Add the best ``score`` and ``choice`` of the row's own alias array."""
    best = best_by_edit_ratio(F.col(pattern), F.col(aliases))
    return df.withColumn("_best", best).select(
        *df.columns, F.col("_best.score").alias("score"), F.col("_best.choice").alias("choice")
    )


def ngram_best_match(
    patterns: DataFrame, pattern: str, choices: DataFrame, choice: str, n: int = 10, threshold: float = 0.5,
    hot_rows: int = 100_000,
) -> DataFrame:
    """Best choice per distinct pattern by n-gram set cosine of at least ``threshold``.

    Exact, with prefix and positional filtering: grams are ordered rarest first (by how
    many choices hold them).  With ``g`` grams, a partner must share at least
    ``threshold^2 * g`` of them, so it must share one of the first
    ``g - ceil(threshold^2 * g) + 1``.  Only those join, and only where the grams from
    there on can still make up the overlap that the two sizes ask for.  The join carries
    names and numbers; each pair that is left is verified once, on its full sets.

    Repeated patterns and choices are reduced to one before anything is joined.  A gram
    with more than ``hot_rows`` rows on a side goes to several tasks, where each pair of
    its rows still meets once.
    """
    left = patterns.select(F.col(pattern).alias("pattern")).filter("pattern IS NOT NULL").distinct()
    right = choices.select(F.col(choice).alias("choice")).filter("choice IS NOT NULL").distinct()
    left, right = stored(left, "patterns"), stored(right, "choices")
    frequency = right.select(F.explode(char_ngrams(F.col("choice"), n)).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")
    )

    def prefixes(side: DataFrame, name: str, size: str, rest: str) -> DataFrame:
        """``gram``, the name, the ``size`` of its set and how many grams are left from this one on."""
        exploded = side.select(name, F.explode(char_ngrams(F.col(name), n)).alias("gram"))
        ranked = lookup(exploded, frequency, "gram", spread_by=name).groupBy(name).agg(F.sort_array(
            F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram")))).alias("ranked"))
        total = F.size("ranked")
        keep = (total - F.ceil(F.lit(threshold * threshold - 1e-9) * total) + 1).cast("int")
        first = ranked.select(
            name, total.alias(size), F.posexplode(F.slice("ranked.gram", F.lit(1), keep)).alias("place", "gram"))
        return stored(first.select("gram", name, size, (F.col(size) - F.col("place")).alias(rest)), f"prefix-{name}")

    mine = prefixes(left, "pattern", "size_l", "rest_l")
    theirs = prefixes(right, "choice", "size_r", "rest_r")
    mine, theirs = _dealt(mine, theirs, "pattern", "choice", hot_rows)
    need = F.lit(threshold) * F.sqrt((F.col("size_l") * F.col("size_r")).cast("double")) - 1e-9
    pairs = mine.join(theirs, ["gram", "_salt_l", "_salt_r"]).filter(
        F.least("rest_l", "rest_r") >= need).select("pattern", "choice").distinct()
    grams_l, grams_r = char_ngrams(F.col("pattern"), n), char_ngrams(F.col("choice"), n)
    sets = pairs.select("pattern", "choice", grams_l.alias("l"), grams_r.alias("r"))
    shared, product = F.size(F.array_intersect("l", "r")), (F.size("l") * F.size("r")).cast("double")
    scored = sets.select("pattern", "choice", (shared / F.sqrt(product)).alias("score")).filter(F.col("score") >= threshold)
    best = F.min_by(F.struct("choice", "score"), F.struct((-F.col("score")).alias("loss"), "choice"))
    return scored.groupBy("pattern").agg(best.alias("best")).select("pattern", "best.choice", "best.score")


def _dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``gram`` with ``_salt_l, _salt_r``, equal for each pair of rows in one place.

    A side with more than ``hot_rows`` rows of a gram is cut into parts, and the other
    side's rows of that gram are repeated for each.  There are at most ``rows / hot_rows``
    such grams a side, so their tables are broadcast.
    """
    def parts(side: DataFrame, name: str) -> DataFrame:
        many = side.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
        return F.broadcast(stored(many.select("gram", F.ceil(F.col("n") / hot_rows).cast("int").alias(name)), "hot-grams"))

    cut_l, cut_r = parts(left, "_parts_l"), parts(right, "_parts_r")

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        known = side.join(cut_l, "gram", "left").join(cut_r, "gram", "left")
        salted = known.withColumn(f"_salt_{own}", F.pmod(F.xxhash64(name), F.coalesce(f"_parts_{own}", F.lit(1))).cast("int"))
        copies = F.sequence(F.lit(0), F.coalesce(f"_parts_{other}", F.lit(1)) - 1)
        return salted.withColumn(f"_salt_{other}", F.explode(copies)).drop("_parts_l", "_parts_r")

    return dealt(left, left_id, "l", "r"), dealt(right, right_id, "r", "l")

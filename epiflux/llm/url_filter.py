"""URL filters: path rules first, then host reputation by empirical Bayes.

The reputation of a host is the posterior of its share of bad pages.  Its prior comes
from the registered domain, whose prior comes from the suffix, whose prior comes from all
pages; each level's strength is fitted to the data.  A host is blocked when even a low
estimate of its share is above ``LIMIT``.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import beta_strength, fresh, with_verdicts
from epiflux.session import stored

#: Share of bad pages above which a host is blocked.
LIMIT = 0.5
#: Standard deviations below the posterior mean at which the share is compared.
SIGMAS = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _after_scheme(url)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, NULL without one.

    A rule is a host and a path, as in ``example.com/de/``.  It fits its host and all
    subdomains where the path starts with the rule's.  Of equal length, the last by name wins.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule), rule)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, n, blocked`` for each of ``hosts`` (``host, n``), from labelled ``outcomes`` (``host, bad``).

    Rows are counted by host before anything else; domains and suffixes are sums of that
    table.  A host without outcomes has the posterior of its domain, and so on upwards.
    """
    counts = stored(
        outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", F.substring_index("host", ".", -1)), "host-outcomes")
    by = lambda level: counts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate, s_strength = beta_strength(by("suffix"))
    _, d_strength = beta_strength(by("domain"))
    _, h_strength = beta_strength(counts)
    mean = lambda prior, strength: (
        (F.coalesce("k", F.lit(0)) + prior * strength) / (F.coalesce("n", F.lit(0)) + strength))
    suffixes = by("suffix").select("suffix", mean(F.lit(rate), s_strength).alias("suffix_mean"))
    named = hosts.select("host", F.col("n").alias("n_pages"), domain_of(F.col("host")).alias("domain"),
                         F.substring_index("host", ".", -1).alias("suffix"))
    domains = (
        named.select("domain", "suffix").distinct().join(by("domain"), "domain", "left").join(suffixes, "suffix", "left")
        .select("domain", mean(F.coalesce("suffix_mean", F.lit(rate)), d_strength).alias("domain_mean"))
    )
    share = mean(F.col("domain_mean"), h_strength)
    spread = F.sqrt(share * (1 - share) / (F.coalesce("n", F.lit(0)) + h_strength + 1))
    return (
        named.join(domains, "domain").join(counts.select("host", "n", "k"), "host", "left")
        .select("host", F.col("n_pages").alias("n"), (share - SIGMAS * spread > LIMIT).alias("blocked"))
    )


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", bad: str | None = None) -> DataFrame:
    """Add ``host, path, rule, verdict`` to pages.

    ``rules`` maps a rule to ``allow`` or ``block``.  ``bad`` names a column of labelled
    outcomes (1 bad, 0 good, NULL unlabelled).  A NULL url, or one without ``://``, has an
    empty host and path, fits no rule and is judged like any other host.  Repeated rows count one
    by one; an estimate equal to the limit allows.  Columns of the result that clash with columns
    of ``pages`` replace them, also where ``url`` or ``bad`` is one of them.
    """
    outcome = fresh(pages, "outcome")
    address = F.col(f"`{url}`")
    pages = pages.withColumn(outcome, F.col(f"`{bad}`").cast("int") if bad else F.lit(None).cast("int"))
    pages = pages.withColumns({"host": host_of(address), "path": path_of(address)})
    pages = pages.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = stored(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    labelled = pages.filter(F.col(outcome).isNotNull()).select("host", F.col(outcome).alias("bad"))
    pages = pages.drop(outcome)
    verdicts = stored(reputation(labelled, hosts), "host-verdicts")
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    blocked = fresh(pages, "blocked")
    found = with_verdicts(pages, verdicts.withColumnRenamed("blocked", blocked), "host", blocked)
    return found.withColumn(
        "verdict", F.coalesce(ruled, F.when(F.col(blocked), "block").otherwise("allow"))).drop(blocked)

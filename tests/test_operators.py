"""Operators on small frames: semantics, whole results under skew, invariants."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiflux.functions.fixed_values import TRACKED_PREPAREDNESS
from epiflux.operators import (
    daily, matching, messages, places, relational, rt, series, statistics, topics, vectorize,
)
from epiflux.plans import load_all
from epiflux.session import scratch
from epiflux.sources import readers, sinks
from epiflux.streaming import live

QUERIES = load_all()[0]


def day(n):
    return datetime.date(2020, 3, n)


def test_smoothing_and_cut(spark):
    rows = spark.createDataFrame(
        [("a", day(1 + i), total) for i, total in enumerate([0, 10, 30, 60])], "k string, d date, t bigint"
    )
    smooth = series.gaussian_smooth(series.new_cases(rows, "k", "d", "t"), "k", "d", "new_cases")
    assert [r.smoothed for r in smooth.orderBy("d").collect()] == [17, 18, 20, 22]
    cut = series.prepare_cases(rows, "k", "d", "t", cutoff=18).orderBy("d").collect()
    assert [r.d for r in cut] == [day(2), day(3), day(4)]
    assert series.prepare_cases(rows, "k", "d", "t", cutoff=99).count() == 0


def test_keep_first(spark):
    rows = spark.createDataFrame(
        [(day(1), "cough", 5), (day(1), "cough", 9), (day(2), "cough", 1)], "date date, symptom string, volume int"
    )
    got = relational.keep_first(rows, ["date", "symptom"], [-F.col("volume")]).orderBy("date").collect()
    assert [r.volume for r in got] == [9, 1]


def test_top_by_peak_and_pivot(spark):
    rows = spark.createDataFrame(
        [(day(1), "a", 1), (day(2), "a", 7), (day(1), "b", 5), (day(2), "b", 5), (day(1), "c", 9)],
        "date date, term string, volume bigint",
    )
    top = daily.top_by_peak(rows, 3).orderBy(F.desc("peak"), "term").collect()
    assert [r.term for r in top] == ["c", "a", "b"]
    wide = daily.top_terms_pivot(rows, 2)
    assert wide.columns == ["date", "c", "a"]
    doubled = rows.union(rows)
    with pytest.raises(Exception, match="repeated date and term"):
        daily.pivot_daily(doubled, ["a"]).collect()


def test_wide_records(spark, tmp_path):
    rows = spark.createDataFrame(
        [(day(1), ":P", 2), (day(1), ":p", 9), (day(2), "date", 4), (day(2), "a.b", 3), (day(3), "rare", 1)],
        "date date, term string, volume bigint",
    )
    names = daily.top_names(rows, 4)
    assert names == [":p", "date", "a.b", ":P"]
    path = str(tmp_path / "wide")
    daily.wide_records(rows, names).write.json(path)
    read = spark.read.schema("date date, volumes map<string,bigint>").json(path)
    got = {row.date: row.volumes for row in read.collect()}
    none = dict.fromkeys(names)
    assert got == {day(1): {**none, ":p": 9, ":P": 2}, day(2): {**none, "date": 4, "a.b": 3}, day(3): none}
    assert daily.wide_records(rows.limit(0), []).count() == 0
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        daily.wide_records(rows.union(rows), names).collect()


def test_wide_records_refuse_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(daily, "MAX_COLUMNS", 2)
    rows = spark.createDataFrame([(day(1), str(i), i) for i in range(3)], "date date, term string, volume bigint")
    with pytest.raises(ValueError, match="more than 2 columns"):
        daily.top_names(rows, None)


def test_one_row_per_key(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        relational.one_row_per_key(rows, ["k"]).collect()
    assert relational.one_row_per_key(rows.filter("v = 2"), ["k"]).count() == 1


def test_rollup_of_a_hot_key_is_whole(spark):
    """The form of the result is the same above ten thousand members."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.concat(F.lit("m"), F.col("id")).alias("name"), (F.col("id") % 2 == 0).alias("even"),
    )
    got = relational.rollup_members(rows.unionByName(rows), ["key"], "name", flags=("even",))
    assert got.columns == ["key", "member", "n", "even"]
    assert got.count() == 30_000 and got.filter("n = 2").count() == 30_000
    assert got.filter("key = 'hot'").count() == 20_000 and got.filter("even").count() == 15_000


def test_rollup_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, f"m{i}") for i in range(50)] + [("a", "x")], "key string, member string")
    assert relational.rollup_members(rows, ["key"], "member").count() == 51


def test_duplicates_count_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, i int")
    assert sorted(r.i for r in relational.duplicates(rows, [F.col("k")]).collect()) == [1, 2, 3, 4]


def test_skewed_lookup_equals_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9).alias("k"), "id")
    right = spark.createDataFrame([(i, i * i) for i in range(8)], "k bigint, v bigint")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "v").orderBy("id").collect()
        salted = relational.lookup(left, right, "k", how, hot_rows=50).select("id", "v").orderBy("id").collect()
        assert plain == salted
    unknown = left.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    got = relational.lookup(unknown, right, "k", hot_rows=50)
    assert got.count() == 1000 and got.filter("v IS NULL AND k < 8").count() == 0
    assert got.filter("k IS NULL AND v IS NOT NULL").count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 9, [0.0, 1e9, 1.0, 2.0, 7.5, 7.5, 2.25]])
def test_exact_quantiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    row = statistics.exact_quantiles(rows, "x", probabilities).first()
    expected = np.quantile(values, probabilities)
    assert row.n == len(values)
    assert np.allclose([row[f"q{i}"] for i in range(5)], expected)


def test_impute_share_is_stable(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 2 == 0, (F.col("id") % 10 < 6).cast("int")).alias("male"))
    filled = statistics.impute_by_share(rows, "male", "id")
    share = rows.agg(F.avg("male")).first()[0]
    assert filled.filter("male IS NULL").count() == 0
    imputed = filled.filter("id % 2 = 1").agg(F.avg("male")).first()[0]
    assert abs(imputed - share) < 0.02
    again = statistics.impute_by_share(rows.repartition(7), "male", "id")
    assert filled.exceptAll(again).count() == 0


def test_numbered_lines_across_blocks(spark):
    path = scratch(spark, "lines")
    spark.range(5000).select(F.concat(F.lit("line "), "id").alias("value")).coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = readers.numbered_lines(spark, path)
        assert lines.filter(F.col("line") != F.concat(F.lit("line "), "line_no")).count() == 0
        assert lines.count() == 5000
        assert [r.line_no for r in readers.grep_files(spark, path, "line 77$").collect()] == [77]
        assert readers.grep_files(spark, path, "nothing").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_corrupt_lines_are_kept(spark):
    path = scratch(spark, "tsv")
    spark.createDataFrame([("a\tb",), ("1\tx",), ("oops\ty",)], "value string").coalesce(1).write.text(path)
    rows = readers.read_delimited(spark, path, "a int, b string", sep="\t", keep_corrupt=True).collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (None, "y")]
    assert rows[1]["_corrupt_record"] == "oops\ty"


def test_convert_rejects_other_formats(spark):
    with pytest.raises(ValueError):
        sinks.convert_csv(spark, "x", "y", "format", "a int")
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), "x", "xml")


def test_tsv_sink_joins_arrays(spark):
    path = sinks.write_table(spark.createDataFrame([(1, ["a", "b"])], "i int, t array<string>"), scratch(spark, "t"), "tsv")
    assert readers.read_delimited(spark, path, "i int, t string", sep="\t").first().t == "a,b"


def test_term_counts_equal_explode(spark):
    random.seed(1)
    docs = [(i, [random.choice("abcdef") for _ in range(random.randint(0, 30))]) for i in range(50)] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id int, terms array<string>")
    got = {(r.doc_id, r.term): r.n for r in vectorize.term_counts(frame, "doc_id", "terms").collect()}
    want = {}
    for i, terms in docs:
        for term in terms or []:
            want[i, term] = want.get((i, term), 0) + 1
    assert got == want


def test_message_documents(spark):
    rows = spark.createDataFrame(
        [
            (1, "2020-03-08 07:30:00", "Hello", None, "{u'hashtags': [], u'urls': []}"),
            (2, "2020-03-09 06:30:00", "Hello", "World", None),
            (3, "2020-03-09 08:00:00", "HELLO", None, None),
            (4, "2020-03-10 00:00:00", "edge", "", None),
            (5, "2020-03-10 00:00:01", "late", "", None),
            (6, "not a date", "x", "", None),
            (7, "2020-03-09 08:00:00", None, "quoted", None),
        ],
        "id bigint, created_ts string, text string, quoted_text string, entities string",
    )
    docs = messages.message_documents(rows, "2020-03-05", "2020-03-10").orderBy("id").collect()
    assert [(r.id, r.all_text, r.local_dt) for r in docs] == [
        (1, "hello", day(7)), (2, "helloworld", day(8)), (4, "edge", day(9)),
    ]
    assert docs[0].tags == [""] and docs[1].tags is None
    assert messages.message_documents(rows, "2020-03-05", "2020-03-10", drop_repeats=False).count() == 4


def test_vocabulary_limits(spark):
    docs = [(i, ["all"] + (["some"] if i < 12 else []) + (["rare"] if i < 3 else [])) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id int, terms array<string>")
    counts = vectorize.term_counts(frame, "doc_id", "terms")
    vocab = vectorize.vocabulary(counts, frame.agg(F.count(F.lit(1))))
    assert [r.term for r in vocab.collect()] == ["some"]
    names, vectors = vectorize.count_vectors(frame, "doc_id", "terms")
    assert names == ["some"]
    assert sum(row.features[0] for row in vectors.collect()) == 12


def test_ngram_match_equals_brute_force(spark):
    random.seed(3)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 8))) for _ in range(120)]
    patterns = spark.createDataFrame([(w,) for w in words[:60]] + [(words[0],)] * 40, "p string")
    choices = spark.createDataFrame([(w,) for w in words[60:]], "c string")

    def grams(w):
        return {w} if len(w) < 2 else {w[i : i + 2] for i in range(len(w) - 1)}

    # the last one cuts every gram of more than two rows into parts
    for threshold, hot_rows in ((0.3, 100), (0.5, 100), (0.8, 100), (0.5, 2)):
        found = matching.ngram_best_match(patterns, "p", choices, "c", 2, threshold, hot_rows)
        got = {r.pattern: (r.choice, r.score) for r in found.collect()}
        for p in set(words[:60]):
            scored = [
                (-len(grams(p) & grams(c)) / math.sqrt(len(grams(p)) * len(grams(c))), c) for c in set(words[60:])
            ]
            loss, best = min(scored)
            if -loss >= threshold:
                assert got[p][0] == best and abs(got[p][1] + loss) < 1e-12
            else:
                assert p not in got


GAZ_CITIES = [
    (1, "Springfield", "Springfield", "Spfd", "US", "PPL", "IL", 100),
    (2, "Springfield", "Springfield", None, "US", "PPLA2", "MO", 90),
    (3, "London", "London", "Londres,Londinium", "GB", "PPLC", "ENG", 8000),
    (4, "London", "London", None, "CA", "PPL", "08", 300),
    (5, "Windhoek", "Windhoek", None, "NA", "PPLC", "21", 200),
]


def gazetteer(spark):
    cities = spark.createDataFrame(
        GAZ_CITIES,
        "geonameid bigint, asciiname string, name string, alternatenames string, country_code string, "
        "feature_code string, admin1_code string, population bigint",
    ).withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")}).withColumn(
        "admin2_code", F.lit(None).cast("string")
    )
    states = spark.createDataFrame(
        [(10, "Illinois", "US.IL"), (11, "Missouri", "US.MO"), (12, "England", "GB.ENG")],
        "geonameid bigint, asciiname string, code string",
    ).withColumn("name", F.col("asciiname"))
    countries = spark.createDataFrame(
        [(20, "United States", "US", 300), (21, "United Kingdom", "GB", 60), (22, "Namibia", "NA", 2), (23, "Canada", "CA", 30)],
        "geonameid bigint, asciiname string, country_code string, population bigint",
    )
    return places.build_gazetteer(cities, states, countries)


def test_normalize_places(spark):
    raw = spark.createDataFrame(
        [(p,) for p in ["U.S.A.", "SF", "🇺🇸", "Planet Earth", "Home", "40.7,-73.9", "Somewhere, USA", "🇫🇷"]], "t string"
    )
    got = {r.t: (r.outcome, r.place_norm) for r in places.normalize_places(raw, "t", places.country_names(gazetteer(spark))).collect()}
    assert got["U.S.A."] == ("kept", "usa")
    assert got["SF"] == ("kept", "san francisco, us")
    assert got["🇺🇸"] == ("kept", "united states")
    for p in ("Planet Earth", "Home", "40.7,-73.9", "Somewhere, USA", "🇫🇷"):
        assert got[p] == ("discarded", None)


def test_match_places(spark):
    gaz = gazetteer(spark)
    names = spark.createDataFrame(
        [(n,) for n in [
            "springfield, usa", "springfield, il", "springfield, missouri", "springfield, misouri", "springfield, mssuori", "london, england", "london",
            "uk", "england", "windhoek, namibia", "londres, united kingdom", "atlantis, england", "nowhere land",
        ]], "place_norm string",
    )
    found = places.match_places(places.split_places(names), gaz, places.country_dim(gaz))
    got = {r.place_norm: r.geonameid for r in found.collect()}
    assert got == {
        "springfield, usa": 2, "springfield, il": 1, "springfield, missouri": 2,
        # one edit from a state is that state, three are none
        "springfield, misouri": 2, "springfield, mssuori": None,
        "london, england": 3, "london": 3, "uk": 21, "england": 12, "windhoek, namibia": 5,
        "londres, united kingdom": 3, "atlantis, england": None, "nowhere land": None,
    }


def test_normalize_geocoded(spark):
    rows = spark.createDataFrame(
        [
            (1, "STREET", "x", "US", "", "Austin"), (2, "STREET", "x", "US", "", ""), (3, "STATE", "x", "US", "CA", ""),
            (4, "STATE", "x", "US", "IN", ""), (5, "STATE", "x", "GB", "England", ""), (6, "COUNTRY", "NA", "NA", "", ""),
            (7, "CITY", "Lima", "PE", "", "Lima"), (8, "STATE", "x", "US", "??", ""),
        ],
        "i int, quality string, address string, country string, state string, city string",
    )
    got = places.normalize_geocoded(rows, places.country_names(gazetteer(spark))).orderBy("i").collect()
    assert [r.place_norm for r in got] == ["Austin", "US", "California", "Indiana", "England", "namibia", "Lima", "??"]


def test_forward_filter_against_plain_formula():
    cases = np.array([5.0, 8, 7, 12, 0, 3, 9])
    r, sigma = rt.grid(0.1), 0.3
    kernel = np.exp(-0.5 * ((r[:, None] - r[None, :]) / sigma) ** 2)
    kernel /= kernel.sum(axis=0)
    post, total = np.full(len(r), 1 / len(r)), 0.0
    got, loglik = rt.forward_filter(cases[:5], sigma, r)
    for t in range(1, 5):
        lam = cases[t - 1] * np.exp((r - 1) / 7)
        like = lam ** cases[t] * np.exp(-lam) / math.factorial(int(cases[t]))
        joint = like * (kernel @ post)
        post, total = joint / joint.sum(), total + math.log(joint.sum())
        assert np.allclose(got[t], post)
    assert abs(loglik - total) < 1e-9
    assert not np.isfinite(rt.forward_filter(cases, sigma, r)[1])  # 3 cases after 0 cannot happen
    big = rt.forward_filter(np.array([1e6, 1.1e6, 1.2e6]), sigma, r)
    assert np.isfinite(big[1]) and np.allclose(big[0].sum(axis=1), 1)


def test_log_factorial(spark):
    ks = [0, 1, 2, 5, 10, 100, 5000]
    rows = spark.createDataFrame([(k,) for k in ks], "k int").select(rt.log_factorial(F.col("k")).alias("v")).collect()
    assert np.allclose([r.v for r in rows], [math.lgamma(k + 1) for k in ks], rtol=1e-11, atol=1e-9)


def test_sigma_ignores_impossible_keys(spark):
    rows = spark.createDataFrame(
        [("a", 0.1, -5.0), ("a", 0.2, -3.0), ("b", 0.1, float("nan")), ("b", 0.2, -1.0), ("c", 0.1, -1.0), ("c", 0.2, -3.0)],
        "k string, sigma double, loglik double",
    )
    totals = rt.sigma_totals(rows, "k")
    assert {r.sigma: r.total for r in totals.collect()} == {0.1: -6.0, 0.2: -6.0}
    assert rt.best_sigma(totals).first().sigma == 0.1


def test_rt_invariants(spark, folder):
    fine = QUERIES["rt_posterior"](spark, folder)
    worst = fine.groupBy("county", "date").agg(F.abs(F.sum("posterior") - 1).alias("e")).agg(F.max("e")).first()[0]
    assert worst < 1e-4
    ml = QUERIES["rt_most_likely"](spark, folder).agg(F.min("ml"), F.max("ml")).first()
    assert 0 <= ml[0] <= ml[1] <= 5


def test_topic_invariants(spark, folder):
    shares = QUERIES["topic_share_daily"](spark, folder).groupBy("day").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-5 for r in shares)  # shares are rounded to six digits
    volumes = QUERIES["topic_volume_daily"](spark, folder).groupBy("day").agg(F.sum("volume").alias("v"), F.max("docs").alias("d"))
    assert all(abs(r.v - r.d) < 1e-5 * r.d for r in volumes.collect())
    weights = QUERIES["dynamic_topics"](spark, folder).groupBy("day", "topic").agg(F.sum("weight").alias("w")).collect()
    assert len(weights) == 15 and all(abs(r.w - 1) < 1e-9 for r in weights)


def test_carry_topics(spark):
    weights = spark.createDataFrame([(0, "a", 5.0), (1, "a", 6.0), (2, "a", 7.0)], "topic int, term string, weight double")
    share = spark.createDataFrame([(0, 0.5), (1, 0.1), (2, 0.4)], "topic int, share double")
    vocab = spark.createDataFrame([("a",), ("new",)], "term string")
    fewer = {(r.term, r.topic_name): r.weight for r in topics.carry_topics(weights, share, vocab, 2, "d").collect()}
    assert fewer["a", "0"] == 5.0 and fewer["a", "2"] == 7.0 and len(fewer) == 4
    assert 0.5 < fewer["new", "0"] < 1.5
    more = topics.carry_topics(weights, share, vocab, 5, "d").select("topic_name").distinct().collect()
    assert {r.topic_name for r in more} == {"0", "1", "2", "d:0", "d:1"}


def test_tracking(spark):
    given = ["Virus PREP now", "preparation of covid", "virus", "ready for corona", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    hits = rows.filter(live.tracks("t", TRACKED_PREPAREDNESS)).orderBy("i").collect()
    assert [r.i for r in hits] == [0, 1]


def test_sigma_and_most_likely_by_brute_force(spark):
    """The filter written out day by day on the full grid of 501 values."""
    import datetime

    import numpy as np

    from epiflux.operators import rt

    rng = np.random.default_rng(3)
    series = {c: np.cumprod(1 + rng.normal(0.05, 0.1, 12)) * 40 for c in ("a", "b")}
    day = datetime.date(2024, 1, 1)
    rows = [(c, day + datetime.timedelta(i), float(round(v))) for c, values in series.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "county string, date date, smoothed double")
    grid, sigmas = np.arange(501) * 0.01, np.arange(1, 21) / 20
    totals, paths = {}, {}
    for sigma in sigmas:
        kernel = np.exp(-0.5 * ((grid[:, None] - grid[None, :]) / sigma) ** 2)
        kernel /= kernel.sum(axis=0)
        totals[sigma] = 0.0
        for county in series:
            cases = [v for c, _, v in rows if c == county]
            post = np.full(501, 1 / 501)
            path = [0.0]
            for before, now in zip(cases, cases[1:]):
                rate = before * np.exp((grid - 1) / 7)
                factorial = sum(np.log(np.arange(1, int(now) + 1)))
                new = np.exp(now * np.log(rate) - rate - factorial) * (kernel @ post)
                totals[sigma] += np.log(new.sum())
                post = new / new.sum()
                path.append(grid[post.argmax()])
            paths[sigma, county] = path
    logliks = rt.sigma_likelihoods(frame, "county", "date", "smoothed")
    got = rt.sigma_totals(logliks, "county")
    found = {round(r.sigma, 2): r.total for r in got.collect()}
    assert all(abs(found[round(s, 2)] - totals[s]) < 1e-6 * abs(totals[s]) for s in sigmas)
    best = max(totals, key=totals.get)
    likely = rt.most_likely(frame, "county", "date", "smoothed", rt.best_sigma(got)).collect()
    for county in series:
        mine = [r.ml for r in sorted(likely, key=lambda r: r.date) if r.county == county]
        assert np.allclose(mine[1:], paths[best, county][1:])


def test_an_empty_city_matches_nothing(spark):
    from epiflux.operators import places

    cities = spark.createDataFrame([
        (1, "Austin", "Austin", "", "US", "PPLA", 30.0, -97.0, "TX", "1", 900),
    ], "geonameid long, asciiname string, name string, alternatenames string, country_code string, feature_code string,"
       " latitude double, longitude double, admin1_code string, admin2_code string, population long")
    states = spark.createDataFrame([(2, "Texas", "Texas", "US.TX")], "geonameid long, asciiname string, name string, code string")
    countries = spark.createDataFrame([(3, "United States", "US", 300)],
                                      "geonameid long, asciiname string, country_code string, population long")
    gazetteer = places.build_gazetteer(cities, states, countries)
    names = places.split_places(spark.createDataFrame(
        [(", usa",), ("(), texas",), ("austin, texas",)], "place_norm string"))
    tokens = spark.createDataFrame([("usa", "US")], "token string, code string")
    got = {r.place_norm: r.geonameid for r in places.match_places(names, gazetteer, tokens).collect()}
    assert got == {", usa": None, "(), texas": None, "austin, texas": 1}


def test_buckets_follow_the_distribution(spark):
    """One far value leaves the others spread over many buckets."""
    from epiflux.operators import statistics

    values = spark.range(20_000).select(F.col("id").cast("double").alias("v")).union(
        spark.createDataFrame([(1e15,), (-1e15,)], "v double"))
    cuts = values.agg(F.percentile_approx("v", [i / 1024 for i in range(1, 1024)], 10240).alias("cuts"))
    sizes = values.crossJoin(cuts).groupBy(statistics._bucket(F.col("v"), F.col("cuts")).alias("b")).count()
    worst = sizes.agg(F.max("count"), F.count(F.lit(1))).first()
    assert worst[0] < 100 and worst[1] > 900

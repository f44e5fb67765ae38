"""The keyed store, names from a readme, and catalog tables."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from epiflux.operators import linelist, places
from epiflux.session import scratch
from epiflux.sources import files, readers
from epiflux.sources.schemas import LINELIST
from epiflux.sources.tables import catalog_table, save_catalog_table
from epiflux.streaming import keyed

SCHEMA = "id bigint, seq bigint, v string"


def new_store(spark):
    return keyed.KeyedStore(spark, scratch(spark, "store"), SCHEMA, "id", "seq")


def content(store):
    return {r.id: (r.seq, r.v) for r in store.read().collect()}


def test_many_batches_in_few_folders(spark):
    store, want, rng = new_store(spark), {}, random.Random(1)
    assert content(store) == {}
    for number in range(18):
        rows = [(rng.randint(0, 9), rng.randint(0, 5), f"{number}-{i}") for i in range(6)]
        rows = list({(key, seq): (key, seq, v) for key, seq, v in rows}.values())
        for key, seq, v in rows:
            if key not in want or (seq, number) >= want[key][:2]:
                want[key] = (seq, number, v)
        store.put(spark.createDataFrame(rows, SCHEMA), number)
        levels = [folder["level"] for folder in store.manifest()["folders"]]
        assert all(levels.count(level) < keyed.FAN for level in levels) and max(levels) <= 2
    assert content(store) == {key: (seq, v) for key, (seq, _, v) in want.items()}
    assert len(store.manifest()["folders"]) <= 2 * 3


def test_a_batch_that_comes_again_changes_nothing(spark):
    store = new_store(spark)
    first = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], SCHEMA)
    second = spark.createDataFrame([(1, 2, "b"), (2, 5, "y")], SCHEMA)
    store.put(first, 0)
    store.put(second, 1)
    before = store.manifest()
    store.put(first, 0)
    store.put(spark.createDataFrame([(2, 9, "other")], SCHEMA), 1)
    assert store.manifest() == before and content(store) == {1: (3, "c"), 2: (5, "y")}


@pytest.mark.parametrize("merging", [False, True])
def test_a_crash_before_the_manifest_leaves_the_store(spark, monkeypatch, merging):
    store = new_store(spark)
    for number in range(3 if merging else 1):
        store.put(spark.createDataFrame([(number, 1, "a")], SCHEMA), number)
    before, held = content(store), store.manifest()
    number = held["batch"] + 1
    late = spark.createDataFrame([(0, 7, "late")], SCHEMA)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as broken:
        broken.setattr(files, "publish_text", crash)
        with pytest.raises(RuntimeError):
            store.put(late, number)
    assert content(store) == before and store.manifest() == held
    store.put(late, number)
    assert content(store) == {**before, 0: (7, "late")}
    store.vacuum(keep=1)
    named = {folder["name"] for folder in store.manifest()["folders"]}
    assert set(files.list_names(spark, f"{store.path}/data")) == named
    assert content(store) == {**before, 0: (7, "late")}


def test_equal_orders_have_one_result(spark):
    rows = [(1, 5, v) for v in "abcdefgh"]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        store = new_store(spark)
        store.put(spark.createDataFrame(rows, SCHEMA).repartition(3), 0)
        found.add(content(store)[1])
    assert len(found) == 1
    store.put(spark.createDataFrame([(1, 5, "later")], SCHEMA), 1)
    assert content(store)[1] == (5, "later")


def test_a_published_file_is_not_replaced(spark):
    path = f"{scratch(spark, 'files')}/one.json"
    files.publish_text(spark, path, "é1")
    with pytest.raises(FileExistsError):
        files.publish_text(spark, path, "2")
    assert files.read_text(spark, path) == "é1"


# ---- readme, catalog


def test_listed_names(spark):
    note = "Head\n a : no\nFields follow:\n-----\n one two : x : y\n\tthree:\nfour   : z,\n     more of it\n\nEnd of it\nfive : no\n"
    frame = spark.createDataFrame([(note,), ("nothing",), (None,), (note.replace("End", "Close"),)], "t string")
    got = [r.n for r in frame.select(readers.listed_names("t", "^Fields follow", "^End").alias("n")).collect()]
    assert got == [["one two", "three", "four"], None, None, None]


def test_a_listing_must_be_there_once(spark):
    path = scratch(spark, "readme")
    spark.createDataFrame([("no listing",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        readers.read_by_listing(spark, path, path, "^Fields", "^End")


def test_catalog_condition_prunes_folders(spark):
    rows = spark.createDataFrame([(i, "ABC"[i % 3]) for i in range(30)], "id bigint, state string")
    name = f"t_{uuid.uuid4().hex}"
    save_catalog_table(rows, name, scratch(spark, "catalog"), "state")
    found = catalog_table(spark, name, F.col("state") == "B")
    assert {r.id for r in found.collect()} == set(range(1, 30, 3)) and catalog_table(spark, name).count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state" in plan and "(state" in plan


# ---- misspelt countries, line list


def test_misspelt_countries(spark):
    regions = spark.createDataFrame(
        [("England", "GB", "ADM1", 1, 50, 1), ("Ireland", "IE", "PCL", 0, 5, 2), ("Iceland", "IS", "PCL", 0, 1, 3),
         ("Peru", "PE", "PCL", 0, 30, 4)],
        "asciiname string, country_code string, feature_code string, hierarchy int, population long, geonameid long",
    ).withColumn("aliases", F.array(F.lower("asciiname")))
    tokens = ["englnd", "enggland", "englanf", "ireland", "irelaand", "iceland", "icelandx", "per", "pru", "pru u", "peruu", "xx", ""]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r.token: r.country_code for r in places.resolve_countries(frame, regions).collect()}
    assert got == {"englnd": "GB", "enggland": "GB", "englanf": "GB", "ireland": "IE", "irelaand": "IE", "iceland": "IS",
                   "icelandx": "IS", "per": "PE", "pru": None, "pru u": None, "peruu": "PE", "xx": None, "": None}


def test_line_list_is_cleaned_in_one_scan(spark, tmp_path):
    names = [field.split()[0] for field in LINELIST.split(", ")]
    given = {"ID": "1", "age": "20s", "sex": "male", "country": "Kerala", "outcome": "Dead", "latitude": "1.5N",
             "date_onset_symptoms": "01.02.2020", "date_confirmation": "05.02.2020 - 06.02.2020",
             "date_admission_hospital": "30.02.2020", "date_death_or_discharge": "02.29.2020", "lives_in_Wuhan": " yes "}
    raw = spark.createDataFrame([[given.get(n) for n in names], [None] * len(names)], LINELIST)
    raw.write.parquet(f"{tmp_path}/raw")
    cleaned = linelist.clean(spark.read.parquet(f"{tmp_path}/raw"))
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows, metrics = linelist.write(cleaned, f"{tmp_path}/clean")
    row = rows.filter("ID = '1'").first()
    assert (row.age, row.male, row.country_new, row.outcome, row.died, row.latitude) == (25, 1, "India", "died", 1, 1.5)
    assert (row.days_onset_outcome, row.days_onset_confirm, row.days_hosp, row.days_admin_confirm) == (28, 4, None, None)
    assert metrics["rows"] == 2 and metrics["male_share"] == 1.0 and metrics["outcome=ongoing"] == 1
    assert ("male", None, 1) in linelist.frequencies(metrics)
    assert linelist.complete(rows).count() == 1
    filled = {r.ID: (r.age, r.male) for r in linelist.impute(rows, metrics).collect()}
    assert filled == {"1": (25, 1), None: (50, 1)}
    empty = linelist.write(linelist.clean(raw.limit(0)), f"{tmp_path}/empty")
    assert linelist.impute(*empty).count() == 0

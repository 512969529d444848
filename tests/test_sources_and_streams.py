"""Files in and out, and streams that must end where the batch ends."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lapcast.catalog.registry import EVENTS, table
from lapcast.catalog.sequences import ids
from lapcast.operators.windows import latest_window
from lapcast.plans.bands import request_windows
from lapcast.operators import encode as enc
from lapcast.schema import MONTH_NAMES
from lapcast.sources import readers, writers
from lapcast.streaming import live

HEADER = "perf_id,perf_temps,perf_distance,perf_bassin,competition_ville,competition_pays,nageur_id,nageur_sexe,nageur_pays,nageur_age_mois,mois_saison,perf_nage,perf_date,nageur_date_naissance"


def test_csv_columns_match_by_name_and_bad_rows_are_kept_apart(spark, tmp_path):
    names = HEADER.split(",")
    good = dict(zip(names, "1,1.0523,100,50,Lyon,FR,7,F,FR,180,3,Dos,2020-01-05,2005-01-01".split(",")))
    bad = {**good, "perf_id": "x"}
    order = names[::-1]
    path = tmp_path / "perf.csv"
    path.write_text("\n".join([",".join(order)] + [",".join(r[c] for c in order) for r in (good, bad)]) + "\n")
    df = readers.read_performances(spark, str(path)).cache()
    assert df.columns[: len(names)] == names
    assert dict(df.dtypes)["perf_bassin"] == "tinyint"
    counted = writers.bad_row_count(df).first()
    assert (counted["bad_rows"], counted["rows"]) == (1, 2)
    row = df.where("_bad_row IS NULL").first()
    assert (row["perf_id"], row["perf_distance"], row["perf_date"]) == (1, 100, dt.date(2020, 1, 5))


def test_history_import(spark, tmp_path):
    races = [{"date": "2018-02-15", "nage": "Nage Libre", "distance": 100, "bassin": 50, "temps": 59.8}] * 2
    path = tmp_path / "h.json"
    path.write_text(json.dumps(races))
    history = readers.read_history_json(spark, str(path)).withColumn("nageur_id", F.lit(7))
    people = spark.createDataFrame([(7, "M", dt.date(2005, 1, 1))], "nageur_id int, nageur_sexe string, nageur_date_naissance date")
    got = readers.import_history(history, people).collect()
    assert len(got) == 2
    assert (got[0]["mois_saison"], got[0]["nageur_age_mois"], got[0]["perf_temps_sec"]) == (1, 157, 59.8)


def _request(n_past, n_future):
    past = {"perf_nage": "Dos", "nageur_sexe": "F", "nageur_age_mois": 180, "perf_distance": 100, "perf_bassin": 50, "mois_saison": 6, "perf_temps_sec": 65.5, "days_since_last": 3}
    return json.dumps(
        {
            "past_sequence": [{**past, "perf_temps_sec": 60.0 + i} for i in range(n_past)],
            "future_sequence": [{"nageur_age_mois": 181 + i, "perf_distance": 100, "perf_bassin": 50, "mois_saison": 7 + i} for i in range(n_future)],
        }
    )


def test_requests_become_windows(spark):
    rows = [("a", _request(3, 3)), ("b", _request(25, 3)), ("c", _request(3, 2)), ("d", _request(0, 3)), ("e", "no json")]
    checked = readers.read_requests(spark.createDataFrame(rows, "request_id string, body string"), 3, "body")
    reasons = {r["request_id"]: r["reason"] for r in checked.collect()}
    assert reasons == {"a": None, "b": None, "c": "future must have 3 rows", "d": "past is empty", "e": "unreadable"}
    state = spark.createDataFrame([("perf_temps_sec", 60.0, 2.0), ("nageur_age_mois", 180.0, 10.0)], "column string, mean double, std double")
    word = lambda values, kind: spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"value {kind}, code int")
    dictionaries = {
        "perf_nage": word(["4 Nages", "Dos"], "string"), "nageur_sexe": word(["F", "M"], "string"),
        "perf_distance": word([50, 100], "int"), "perf_bassin": word([25, 50], "int"),
    }
    made = {r["request_id"]: r for r in request_windows(checked, dictionaries, state).collect()}
    assert set(made) == {"a", "b"}
    values = [round(p["perf_temps_sec"] * 2 + 60) for p in made["a"]["past"]]
    assert values == [62] * 17 + [60, 61, 62]
    assert [round(p["perf_temps_sec"] * 2 + 60) for p in made["b"]["past"]] == list(range(65, 85))
    assert [round(f["nageur_age_mois_scaled"], 6) for f in made["a"]["future"]] == [0.1, 0.2, 0.3]
    assert made["a"]["past"][0]["perf_nage_encoded"] == 1
    assert made["a"]["static"]["nageur_sexe_encoded"] == 0


def test_choices_list_months(spark, sf):
    made = enc.choices(enc.fit_dictionaries(table(spark, sf, "events"), ["event_type"]), "mois_saison")
    rows = {r["column"]: r["choices"] for r in made.collect()}
    assert rows["mois_saison"] == MONTH_NAMES
    assert rows["event_type"] == sorted(rows["event_type"])


def test_write_once_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.written_once(spark.range(3), path).count() == 3
    assert writers.written_once(spark.range(5), path).count() == 3


def test_splits_are_separate_folders(spark, tmp_path):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    writers.write_splits(rows, str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if "=" in d) == ["split=test", "split=train"]


@pytest.mark.parametrize("length", [5, 20])
def test_stream_ends_where_the_batch_ends(spark, sf, tmp_path, length):
    events = table(spark, sf, "events")
    source = tmp_path / "in"
    # Four micro-batches in hash order; the last repeats rows that were already there.
    shuffled = events.withColumn("_n", F.pmod(F.hash("event_id"), F.lit(4)))
    for i in range(4):
        shuffled.where(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(str(source))
    events.where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    updates = live.stream_windows(stream, EVENTS, ["value"], length)
    query = live.score_stream(updates, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    written = live.read_stream_output(spark, str(tmp_path / "out"))
    assert written.select("batch").distinct().count() == 5
    final = live.latest_versions(written, EVENTS)
    got = {r["user_id"]: r["p"] for r in live.as_serving_window(final, ["event_id", "value"], length).select("user_id", ids("past").alias("p")).collect()}
    want = {r["user_id"]: r["p"] for r in latest_window(events, EVENTS, ["event_id", "value"], length).select("user_id", ids("past").alias("p")).collect()}
    assert got == want

"""Exported histories whose arrays end in damage: what follows is read, and read once."""

import datetime as dt
import io

import duckdb
import pytest

import compare
from lapcast.catalog import SQL, proofs
from lapcast.sources import json_arrays as ja


@pytest.mark.parametrize("chunk, piece", [(2, 3), (1 << 20, 4096)])
@pytest.mark.parametrize("text, good, bad", [
    ('[{"a":1},\n{"a": oops}\n[{"a":2}]\n[{"a":3}]', ["1", "2", "3"], ['{"a": oops}', "array without an end"]),
    ('[{"a":1}, nothing\n[{"a":2}]\n[{"a":3}]', ["1", "2", "3"], ["nothing", "array without an end"]),
    ('oops\n[{"a":1},{"a":2}]', ["1", "2"], ["oops"]),
    ('[{"a":1}}, {"a":2}]\n[{"a":3}]', ["1", "2", "3"], ["}"]),
    ('[{"a": oops, "b": "}, ["}, {"a":1}]', ["1"], ['{"a": oops, "b": "}, ["}']),
    ('[{"a": oops, "b":\n[1]}, {"a":1}, : [1], {"a":2}]', ["1", "2"], ['{"a": oops, "b":\n[1]}', ": [1]"]),
    ('[ {"a" : 1 } , {"a":2,"b":{"c":[]}},{"a":3,"b":"\\u00e9\\n"}\n,\ufeff{"a":4,"b":-1.5E+3}] [{"a":5,"b":"\n"}, {"a":6}', ["1", "2", "3", "4", "6"], ['{"a":5,"b":"\n"}', "array without an end"]),
])
def test_what_follows_damage_is_read(monkeypatch, chunk, piece, text, good, bad):
    monkeypatch.setattr(ja, "CHUNK", chunk)
    monkeypatch.setattr(ja, "PIECE", piece, raising=False)
    found = list(ja.elements(io.StringIO(text)))
    assert [str(ja.json.loads(e)["a"]) for e, _ in found if e is not None] == good
    assert [b for _, b in found if b is not None] == bad


@pytest.mark.parametrize("start", ['[{"a":', '[{"a": oops, "b": {"c": ', '[{"a": "'])
def test_an_element_without_an_end_is_not_read_anew_for_every_chunk(monkeypatch, start):
    class Counted(io.StringIO):
        reads = 0

        def read(self, n=-1):
            Counted.reads += 1
            return super().read(n)

    monkeypatch.setattr(ja, "CHUNK", 64)
    found = list(ja.elements(Counted(start + " x" * 64_000)))
    assert found[-1] == (None, "array without an end") and len(found[-2][1]) > 100_000
    assert Counted.reads < 40


@pytest.fixture
def odd_ends(spark, tmp_path):
    """Customers whose only or last race is no JSON; of every second one the array has no end either."""
    day = dt.datetime(1996, 5, 17)
    orders = [(97 * c, c, day, "1-URGENT", 10.5 + c) for c in range(20, 801, 20)] + [(97 * c + k, c, day, "5-LOW", 20.25 * k) for c in range(21, 801, 20) for k in range(4)]
    orders += [(97 * c + 1, c, day, "2-HIGH", 7.0) for c in range(40, 801, 80)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double").repartition(1).write.parquet(str(tmp_path / "orders.parquet"))
    people = [(c, c % 3) for c in range(20, 801)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int").repartition(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def test_broken_rows_of_arrays_that_end_in_damage(spark, odd_ends):
    path, con = odd_ends
    assert compare.difference(proofs.broken_rows(spark, path), con, SQL["s3_broken_rows"]) is None


def test_history_files_are_read_once_and_whole(spark, odd_ends):
    path, con = odd_ends
    found = proofs.history_files(spark, path)
    assert "json_arrays" not in found._jdf.queryExecution().toString()
    assert compare.difference(found, con, SQL["s3_history_files"]) is None

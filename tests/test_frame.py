"""Behaviour that a comparison of bags of rows does not show: order, texts as written, errors."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.column import Series
from larkspur.operators.encoders import NotFitted, Pipeline, StandardScaler
from larkspur.operators.frame import Frame
from larkspur.plans import ranks
from larkspur.sources.infer import banded_sample, json_objects
from larkspur.sources.readers import from_array, from_objects, from_shared, json_to_ndjson, read_csv, read_json
from larkspur.sources.writers import report_lines, to_csv, with_extension, write
from larkspur.streaming.batches import stream_batches


@pytest.fixture(scope="module")
def frame(spark):
    return from_objects(spark, [{"k": "b", "v": 2}, {"k": "a", "v": 3.5}, {"k": "b", "v": None}, {"k": None, "v": 1}])


def test_order_of_rows(frame):
    assert [r.v for r in frame.sort("v").data.collect()] == [1.0, 2.0, 3.5, None]
    assert [r.v for r in frame.sort("v", ascending=False).data.collect()] == [3.5, 2.0, 1.0, None]
    assert [r.k for r in frame.unique("k").collect()] == ["b", "a", None]
    assert [(r.value, r["count"]) for r in frame.value_counts("k").collect()][0] == ("b", 2)
    assert [r["v"] for r in frame.head(2).to_array()] == [2.0, 3.5] and [r["v"] for r in frame.tail(2).to_array()] == [None, 1.0]


def test_names_of_groups_and_numbers_only(spark, frame):
    assert frame.group_by("k", {"v": ["sum"]}).df.columns == ["k", "v"]
    assert frame.group_by("k", {"v": ["sum", "count"]}).df.columns == ["k", "v_sum", "v_count"]
    text = from_objects(spark, [{"k": "a", "v": "5 apples"}])
    assert text.group_by_category("k", "v").count() == 0
    assert {r.k: (r["sum"], r["count"]) for r in frame.group_by_category("k", "v").collect()} == {"a": (3.5, 1), "b": (2.0, 1)}


def test_pipeline_is_unfitted_by_add(frame):
    pipeline = Pipeline([StandardScaler(["v"])]).fit(frame.data)
    assert pipeline.transform(frame.data).columns[-1] == "v_scaled"
    with pytest.raises(NotFitted, match="Pipeline"):
        pipeline.add(StandardScaler(["v_scaled"])).transform(frame.data)


def test_made_frames(spark):
    assert [tuple(r) for r in from_array(spark, [{"a": 1, "b": "x"}, {"a": "2.5"}]).data.collect()] == [(1.0, None), (2.5, None)]
    import struct

    made = from_shared(spark, struct.pack("<2f2B", 1.5, -2.0, 7, 255), [{"name": "f", "dtype": "<f4", "offset": 0, "length": 2}, {"name": "u", "dtype": "|u1", "offset": 8, "length": 2}])
    assert [tuple(r) for r in made.data.collect()] == [(1.5, 7), (-2.0, 255)]
    with pytest.raises(ValueError, match="Unsupported dtype"):
        from_shared(spark, b"", [{"name": "x", "dtype": "c16", "offset": 0, "length": 0}])
    assert made.get_col("none") is None and made.get_col("f").columns == ["f"]


def test_series_and_rejected_joins(spark, frame):
    ids = spark.createDataFrame([(0, 101), (1, 999), (2, 102)], "pos bigint, id bigint")
    series = Series(ids, spark.createDataFrame([(101, "A"), (102, "B")], "id bigint, label string"))
    assert (series.get(0), series.get(1), series.get(9)) == ("A", "999", None)
    assert len(series.slice(1, 3)) == 2 and series.slice(1, 3).get(1) == "B"
    with pytest.raises(ValueError):
        frame.join(frame, "k", how="outer")
    with pytest.raises(ValueError):
        with_extension("a.txt", "csv")


def test_report_cuts_cells_and_rows(spark):
    rows = from_objects(spark, [{"t": "x" * 60}, {"t": "short"}, {"t": "left out"}])
    lines = report_lines(rows, max_rows=2)
    assert lines[2].rstrip() == "x" * 47 + "..." and lines[-1].endswith("1 filas más") and len(lines) == 5


def test_parts_have_the_header(spark, tmp_path):
    df = spark.range(40).select("id", F.concat(F.lit("n, "), "id").alias("s")).repartition(4)
    to_csv(Frame(df), f"{tmp_path}/a.csv")
    assert sorted(r.id for r in read_csv(spark, f"{tmp_path}/a.csv", schema="id bigint, s string").data.collect()) == list(range(40))
    write(Frame(df.select("id")), f"{tmp_path}/b")
    assert {int(r.id) for r in read_csv(spark, f"{tmp_path}/b").data.collect()} == set(range(40))


def test_json_as_it_is_written(spark, tmp_path):
    text = '[{"a": 1.50, "b": 1e3},\n {"n": 12345678901234567890, "s": "q\\"}{"}\n, {"a": {"x": [1, {"y": 2}]}}, {"broken": ['
    assert list(json_objects(text)) == ['{"a": 1.50, "b": 1e3}', '{"n": 12345678901234567890, "s": "q\\"}{"}', '{"a": {"x": [1, {"y": 2}]}}']
    (tmp_path / "in.json").write_text(text)
    json_to_ndjson(spark, f"{tmp_path}/in.json", f"{tmp_path}/out.ndjson")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out.ndjson").collect()] == list(json_objects(text))
    (tmp_path / "bad.json").write_text('{"a": nonsense}')
    with pytest.raises(ValueError):
        read_json(spark, f"{tmp_path}/bad.json")


def test_banded_sample(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("\n".join(str(i) for i in range(1000)))
    lines = spark.read.option("maxPartitionBytes", 500).text(f"{tmp_path}/lines.txt").filter("value <> ''")
    assert [int(x) for x in banded_sample(lines, 30)] == [*range(10), *range(495, 505), *range(990, 1000)]


@pytest.mark.parametrize("limit", [200_000, 40, 3])
def test_quartiles_are_exact_however_often_they_are_narrowed(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "ONE_TASK_ROWS", limit)
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    monkeypatch.setattr(ranks, "SPREAD", 0.05)
    columns = {"spread": lambda i: (i * 7919) % 1999 - 900.5, "tied": lambda i: i % 3, "one": lambda i: 5, "rare": lambda i: i / 7 if i % 700 == 0 else None, "none": lambda i: None}
    rows = [{k: None if f(i) is None else float(f(i)) for k, f in columns.items()} for i in range(2000)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in columns))
    got = {r["column"]: r for r in Frame(df, []).describe().collect()}
    assert set(got) == {"spread", "tied", "one", "rare"}
    for name, r in got.items():
        held = sorted(x[name] for x in rows if x[name] is not None)
        assert r["count"] == len(held) and (r["min"], r["max"]) == (held[0], held[-1])
        assert [r["25%"], r["50%"], r["75%"]] == [held[int(len(held) * q)] for q in (0.25, 0.5, 0.75)], name


def test_stream_batches_hold_every_row_once(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(0, 1000, 1, 3).selectExpr("id", "id % 7 AS k").write.json(path)
    seen = []
    stream_batches(spark, path, lambda f: seen.append([r["id"] for r in f.data.collect()]), batch_size=64, kind="ndjson")
    assert all(0 < len(x) <= 64 for x in seen) and sorted(i for x in seen for i in x) == list(range(1000))

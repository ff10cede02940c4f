"""Sources: encodings, missing files and columns, version alignment."""

import pytest

from dealscope.sources import files


def test_latin_1_fallback_and_bad_dates(spark, tmp_path):
    at = tmp_path / "a.csv"
    at.write_bytes("code,day\n\xe9t\xe9,2024-01-05\nb,not a date\nc,\n".encode("latin-1"))
    got = {r["code"]: r["day"] for r in files.load_csv(spark, str(at), ["day"]).collect()}
    assert set(got) == {"\xe9t\xe9", "b", "c"}
    assert got["b"] is None and got["c"] is None and got["\xe9t\xe9"].day == 5


def test_missing_file_and_column(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.load_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "b.csv").write_text("code\n1\n")
    with pytest.raises(ValueError, match="day"):
        files.load_csv(spark, str(tmp_path / "b.csv"), ["day"])


def test_amounts_by_name(spark):
    df = spark.createDataFrame([("1 234,50 EUR", "x"), (None, "y"), ("n/a", "z")], " budget string, note string".strip())
    assert [r[0] for r in files.retype(df).orderBy("note").collect()] == [1234.5, None, None]


def test_versions(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 9)], "k int, extra int")
    assert sorted(map(tuple, files.aligned({"a": a, "b": b}).collect())) == [(1, "x", "a"), (2, None, "b")]
    with pytest.raises(ValueError, match="b: columns differ"):
        files.aligned({"a": a, "b": b}, strict=True)


def test_external_series_fills_the_grid(spark, tmp_path):
    (tmp_path / "c.csv").write_text("d,v\n2024-01-10,1\n2024-03-02,3\n2024-04-01,\n")
    got = [(r["p"].month, r["y"]) for r in files.external_series(spark, str(tmp_path / "c.csv"), "d", "v").orderBy("p").collect()]
    assert got == [(1, 1.0), (2, 2.0), (3, 3.0)]

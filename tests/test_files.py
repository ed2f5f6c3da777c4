import pytest

from knotwork.sources import files


def test_csv_keeps_quotes_commas_lines_and_blanks(spark, tmp_path):
    rows = [(1, 'a "b", c', " x "), (2, "two\nlines", None), (3, "é;|", "")]
    files.write_csv(spark.createDataFrame(rows, "i int, a string, b string"), f"{tmp_path}/t")
    got = sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t", "i int, a string").collect()))
    assert got == [(i, a) for i, a, _ in rows]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.read_csv(spark, f"{tmp_path}/t", "i int, z string")


def test_keyed_last_wins(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "k int, v string, n int"), f"{tmp_path}/t", "\t")
    assert sorted((r.k, r.v) for r in files.read_keyed(spark, f"{tmp_path}/t", "k int, v string, n int", "k", "n").collect()) == [(1, "new"), (2, "x")]


def test_replace_backup_and_append(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert files.append_new(one, path, "k") == 2 and files.append_new(two, path, "k") == 1
    assert files.backup_once(spark, path, f"file://{tmp_path}/b") and not files.backup_once(spark, path, f"file://{tmp_path}/b")
    files.replace_table(two, path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [2, 3]
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 3

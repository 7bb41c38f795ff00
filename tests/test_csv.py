"""CSV files as other tools write them."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from bizlens.sources import tables as TB

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()),
                       T.StructField("c", T.StringType())])


def test_columns_are_bound_by_name_with_quotes_and_missing_words(spark, tmp_path):
    frame = pd.DataFrame({"c": ['say "hi", ok', "none", None, "NA", "é,x"], "extra": range(5),
                          "b": [1.5, None, float("inf"), -2.0, 3.0], "a": [1, 2, 3, 4, 5]})
    frame.to_csv(tmp_path / "x.csv", index=False, na_rep="NA")
    rows = [tuple(r) for r in TB.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).orderBy("a").collect()]
    assert rows == [(1, 1.5, 'say "hi", ok'), (2, None, "none"), (3, float("inf"), None), (4, -2.0, None), (5, 3.0, "é,x")]


def test_round_trip_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 'a "quoted", cell'), (2, None, None), (3, -1e300, "plain")], SCHEMA)
    TB.write_table(df, str(tmp_path / "t"), fmt="csv")
    assert sorted(map(tuple, TB.read_csv(spark, str(tmp_path / "t"), SCHEMA).collect())) == sorted(map(tuple, df.collect()))


def test_absent_columns_and_wrong_cells_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        TB.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA)
    (tmp_path / "y.csv").write_text("a,b,c\nword,2,x\n")
    with pytest.raises(Exception):
        TB.read_csv(spark, str(tmp_path / "y.csv"), SCHEMA).collect()

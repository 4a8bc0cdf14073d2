"""Joins whose sides grow with the table are the same on a small one."""

from isoreach.llm.neardup import near_duplicates
from isoreach.llm.substrings import repeated_substrings


def joins(df):
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().split() if x.endswith("Join")]


def texts(spark):
    return spark.range(30).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> md5(concat(x, ':', id % 20)))) as text")


def test_classes_are_shuffled_on_a_small_table(spark):
    assert joins(near_duplicates(texts(spark))) == ["SortMergeJoin"]


def test_cuts_are_shuffled_on_a_small_table(spark):
    assert joins(repeated_substrings(texts(spark))) == ["SortMergeJoin"]

"""The text of messages is made evenly by all tasks, whatever file holds the users with long ones."""

import pytest
from pyspark.sql import functions as F

from mediasift.suite import views
from mediasift.suite.load import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messages"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    more = events.crossJoin(spark.range(10).withColumnRenamed("id", "k"))
    more = more.withColumns({"event_id": F.expr("event_id + k * 1000"), "user_id": F.expr("user_id + k * 15")}).drop("k")
    more.repartitionByRange(2, "user_id").write.parquet(f"{folder}/events.parquet")
    return folder


def test_tasks_make_as_much_text(spark, tables):
    made = views.messages(spark, tables).groupBy(F.spark_partition_id()).agg(F.sum(F.length("message")).alias("n")).collect()
    sizes = [r["n"] for r in made]
    assert len(sizes) > 2 and max(sizes) < 1.4 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("name", ["redact_urls", "classify_error"])
def test_messages_are_dealt_before_they_are_made(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "repeat(" in plan and "repeat(" not in below

import pytest
from pyspark.sql import SparkSession

from playtally.session import configure


@pytest.fixture(scope="session")
def spark():
    # A far-off session zone: nothing may depend on it.
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "Asia/Tokyo")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over one column ``x`` of literal values."""

    def evaluate(values, ddl_type, expression):
        from pyspark.sql import functions as F

        rows = [(i, value) for i, value in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, x {ddl_type}").coalesce(1)
        result = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [row.y for row in result]

    return evaluate


def plan_of(df) -> str:
    """Formatted physical plan."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def final_plan_of(df) -> str:
    """Executed plan after adaptive execution has run it."""
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().toString()

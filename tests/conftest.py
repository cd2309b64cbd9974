import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "America/New_York")  # nothing may depend on it
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


EVENT = (
    "ingest_id long, episode_id string, step_id long, hook_type string, timestamp string, user_instruction string, plan_summary string, proposed_tool string, tool_args string, "
    "observation string, state_delta string, self_check string, t_risk long, risk_event boolean, risk_type string, severity double, notes string, source_batch string, ingested_at timestamp"
)
NAMES = [c.split()[0] for c in EVENT.split(", ")]


@pytest.fixture(scope="session")
def make_events(spark):
    def make(*rows):
        return spark.createDataFrame([tuple({"ingest_id": i + 1, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], EVENT)

    return make

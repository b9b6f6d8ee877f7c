import pytest
from pyspark.sql import functions as F

from lodestack.operators import contracts


def test_audits(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    assert [r["v"] for r in contracts.missing_references(child, spark.createDataFrame([(1,)], "k int"), {"id": "k"}).collect()] == ["b"]
    results = spark.createDataFrame([("passed", ["e"]), ("passed", []), ("passed", None), ("failed", [])], "status string, evidence array<string>")
    assert contracts.unproven_passes(results).count() == 2
    health = spark.createDataFrame([("ready", ["m"]), ("ready", []), ("unavailable", ["m"]), ("degraded", ["m", "m"]), ("ready", [" "])], "status string, models array<string>")
    assert contracts.invalid_health(health).count() == 4
    requests = spark.createDataFrame([("x", 1, 0.0, {"a": "b"}), (" ", 1, 0.0, {}), ("x", 0, 0.0, {}), ("x", 1, 2.1, {}), ("x", 1, float("nan"), {}), ("x", 1, 1.0, {" ": "b"})], "prompt string, max_output_tokens int, temperature double, metadata map<string,string>")
    assert [r["reason"] for r in contracts.invalid_requests(requests).collect()] == ["prompt", "max_output_tokens", "temperature", "temperature", "metadata"]


def test_uuid_guard(spark):
    good = "0B2F7a10-1111-2222-3333-444455556666"
    assert spark.range(1).select(contracts.checked_uuid(F.lit(good))).first()[0] == good.lower()
    for bad in ("", "0b2f7a10111122223333444455556666", good + "0", "x" + good[1:]):
        with pytest.raises(Exception, match="not a UUID"):
            spark.range(1).select(contracts.checked_uuid(F.lit(bad))).collect()


def test_entry_without_a_package_that_some_operators_need():
    """A missing package costs the operators that need it, not the other queries."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q15_ranked_search' in q and len(q) > 70, len(q); assert not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

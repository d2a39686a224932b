"""What Python workers hold doesn't grow with tables, and fixed rows need no workers."""

import pyarrow as pa

from gleanspark.plans.fixtures import FIXTURES, frame
from gleanspark.plans.queries import QUERIES, _script_evidence
from gleanspark.session import few_rows_a_batch, literal, stored


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_rows_need_no_workers(spark):
    for name, (schema, rows) in FIXTURES.items():
        df = frame(spark, name)
        assert "LocalTableScan" in _plan(df) and "ExistingRDD" not in _plan(df), name
        told = spark.createDataFrame(rows, schema)
        assert df.schema == told.schema and df.collect() == told.collect(), name


def test_fixed_rows_of_nested_kinds(spark):
    rows = [(1, [("a", {"k": None})], None), (2, None, [[], ["x"]])]
    df = literal(spark, rows, "id int, of array<struct<n:string,m:map<string,string>>>, more array<array<string>>")
    assert [(r["id"], r["of"] and [tuple(x) for x in r["of"]], r["more"]) for r in df.collect()] == rows


def test_few_rows_a_batch(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with few_rows_a_batch(spark, 100):
        found = stored(spark.range(0, 1050, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert sorted(r["n"] for r in found.collect()) == [50] + [100] * 10
    assert spark.conf.get(key) == before


def test_script_evidence_is_parsed_once(spark):
    d = "/root/testdata/sf0.001"
    assert "MapInArrow" not in _plan(_script_evidence(spark, d))
    for name in ("signature_detections", "evidence_owners", "signature_evaluations"):
        assert "MapInArrow" not in _plan(QUERIES[name](spark, d)), name

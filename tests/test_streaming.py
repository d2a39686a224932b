"""Findings of arriving pages are those of a batch over all of them, and none comes twice after a restart."""

import os

from gleanspark.operators import pages
from gleanspark.sources import html
from gleanspark.streaming.pages import arriving, findings, write

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_stream_gives_the_batch_s_findings(spark, tmp_path):
    some = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html")
    first, second = some.where("page_id % 2 = 0"), some.where("page_id % 2 = 1")
    come, out, state = (f"{tmp_path}/{x}" for x in ("come", "out", "state"))
    for part in (first, second):
        part.repartition(3).write.mode("append").parquet(come)
        write(findings(arriving(spark, come, 2)), out, state, available_now=True).awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).collect()))
    want = sorted(map(str, pages.metadata_findings(html.parsed(some)).collect()))
    assert got == want and len(want) > 500

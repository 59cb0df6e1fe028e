"""The benchmark's options, payloads and modes, on tiny stores."""

import pytest
from pyspark.sql import functions as F

from quillstore import benchmark as b


def test_arguments():
    o = b.arguments(["--mode", "row-parallel", "--sizes", "0.5,1,2", "--threads", "3", "--keep"])
    assert (o.mode, o.sizes, o.threads, o.keep, o.payload_size, o.read_count) == ("row-parallel", [0.5, 1.0, 2.0], 3, True, 4096, 100)
    for bad in (["--mode", "other"], ["--threads", "0"], ["--row-entries", "0"], ["--unknown"], ["--sizes"], ["--sizes", "x"]):
        with pytest.raises(SystemExit):
            b.arguments(bad)


def test_payloads_and_percentiles(spark):
    got = spark.range(3).select(*(b.payload(F.col("id"), n).alias(f"n{n}") for n in (0, 3, 4, 100, 4096))).collect()
    for r in got:
        assert [len(x) for x in r] == [0, 3, 4, 100, 4096] and bytes(r.n4096).startswith(b.MARK) and bytes(r.n4096)[:100] == bytes(r.n100)
    assert len({bytes(r.n4096) for r in got}) == 3
    assert b.percentiles([3.0, 1.0, 2.0, 4.0]) == {"p50": 3.0, "p95": 4.0, "p99": 4.0} and b.percentiles([]) == {}


@pytest.mark.parametrize("mode", b.MODES)
def test_modes(spark, tmp_path, mode):
    o = b.arguments(["--mode", mode, "--sizes", "0.00002", "--payload-size", "100", "--object-batch-size", "150", "--row-entries", "5", "--read-count", "3", "--threads", "2", "--dir", f"file://{tmp_path}"])
    (r,) = b.run(spark, o)
    assert r["write_s"] > 0 and r["read_p50_s"] <= r["read_p99_s"] and (r.get("objects") == 200 or r.get("rows") == 40)
    assert not list(tmp_path.iterdir())

import math

from gridquill.functions.payload import readings
from gridquill.sources.samples import samples_to_chunks

VALUES = [0.0004, 3.0, -1.5, 12345678.1234, 0.1 + 0.2, 1e-20, 5e-324, 1.7976931348623157e308, 1e22, -0.0, 1 / 3, 2.0 ** -1074 * 3, 123456.789]


def test_values_are_written_exactly(spark):
    samples = spark.createDataFrame([("m", i, v) for i, v in enumerate(VALUES)], "__name__ string, ts_ms long, value double")
    chunks = samples_to_chunks(samples, ["__name__"])
    got = dict(readings(chunks).select("t", "v").collect())
    assert [got[i] for i in range(len(VALUES))] == VALUES and math.copysign(1, got[9]) == -1
    assert bytes(chunks.first()["__chunk_bytes"]).startswith(b"0:0.0004,1:3.000,2:-1.500,")
    rounded = samples_to_chunks(samples, ["__name__"], decimals=2).first()
    assert bytes(rounded["__chunk_bytes"]).startswith(b"0:0.00,1:3.00,2:-1.50,3:12345678.12,")

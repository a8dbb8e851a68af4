import re

import pytest
from pyspark.sql import functions as F

from seqlode.llm import spans as S


@pytest.mark.parametrize("pattern", ["[0-9]+", "a", "é+", "x[0-9]"])
def test_places(spark, pattern):
    texts = ["", "a1b22", "aéé😀é1", "x1" * 700, "11", "none", "😀" * 70 + "a7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in S.add_spans(df, "t", pattern, "s").collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.t)]
        assert [(x.start, x.end, x.value) for x in r.s] == want
        for x in r.s:
            assert r.t[: x.start].endswith(x.left) and r.t[x.end :].startswith(x.right)


def test_luhn(spark):
    df = spark.createDataFrame([("4111 1111-1111 1111", True), ("4111111111111112", False), ("0", True), ("", False)], "v string, ok boolean")
    assert all(r.got == r.ok for r in df.select("ok", S.luhn(F.col("v")).alias("got")).collect())

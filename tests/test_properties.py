"""Property tests: cleaning expressions agree with plain-Python semantics."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from punctual.functions import cleaning as C

ALPHABET = " \t\n\r\x0b\x0cabNnoe0123456789.+-E"
WS = " \t\n\r\x0b\x0c"


def py_clean(v, token="Unknown"):
    if v is None:
        return token
    s = v.strip(WS)
    return token if s in ("nan", "NaN", "None", "") else s


def py_numeric(v):
    if v is None:
        return None
    s = v.strip(" \t\n\r\x0c")
    if v.strip(WS) != v.strip(" \t\n\r\x0c") or not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
        return None
    return float(s)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=8)), min_size=1, max_size=200))
def test_clean_and_coerce_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    rows = df.select(C.clean_category("x").alias("c"), C.safe_numeric("x").alias("n")).collect()
    for v, r in zip(values, rows):
        assert r["c"] == py_clean(v), (v, r)
        exp = py_numeric(v)
        assert (r["n"] is None and exp is None) or (r["n"] is not None and exp is not None
                                                     and abs(r["n"] - exp) <= 1e-12 * max(1.0, abs(exp))), (v, r)

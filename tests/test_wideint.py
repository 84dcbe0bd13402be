import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amounts, wideint


def numbers(rng):
    top = (1 << 256) - 1
    some = [0, 1, 9, 10**9 - 1, 10**9, 10**9 + 1, 10**18, 10**38, 10**38 - 1, (1 << 127) - 1, 1 << 128, 10**77, top, top - 1]
    return some + [rng.getrandbits(rng.choice([8, 30, 60, 64, 128, 192, 255, 256])) for _ in range(60)]


def test_products_and_quotients_up_to_256_bits(spark):
    rng = random.Random(4)
    pool = numbers(rng)
    rows = [tuple(str(rng.choice(pool)) for _ in range(3)) for _ in range(150)]
    rows += [(str(k * d + r), "1", str(d)) for d in (10**9, 10**36 + 7, (1 << 200) - 1, 3) for k in (1, 10**9 - 1, 10**9) for r in (0, d - 1) if k * d + r < 1 << 256]
    table = spark.createDataFrame(rows, "a string, b string, c string")
    got = table.select("a", "b", "c", wideint.muldiv("a", "b", "c").alias("x")).collect()
    for r in got:
        a, b, c = int(r.a), int(r.b), int(r.c)
        assert r.x == (str(a * b // c) if c else None), r
    pairs = spark.createDataFrame([(str(a), str(b)) for a, b in zip(pool, reversed(pool))], "a string, b string")
    a, b = wideint.parse("a"), wideint.parse("b")
    found = pairs.select("a", "b", wideint.text(wideint.add(a, b, 9)).alias("sum"), wideint.less(a, b).alias("less"), wideint.text(wideint.multiply(a, 9, b, 9)).alias("product"), F.when(~wideint.less(a, b), wideint.text(wideint.subtract(a, b))).alias("rest"), wideint.number(a).alias("n"))
    for r in found.collect():
        a, b = int(r.a), int(r.b)
        assert (int(r["sum"]), r.less, int(r["product"]), r.rest and int(r.rest)) == (a + b, a < b, a * b, a - b if a >= b else None)
        assert r.n == (a if a < 10**38 else None)


def test_text_and_hex(spark):
    rows = [("12", "f" * 64), (" 007 ", "0" * 63 + "A"), ("-1", "0x"), ("1.5", None), ("", "g" * 64), (None, "1".zfill(64)), (str(1 << 256), "8" + "0" * 63), ("0", "0" * 64)]
    table = spark.createDataFrame(rows, "a string, w string")
    got = [tuple(r) for r in table.select(wideint.text(wideint.parse("a")), wideint.text(wideint.from_hex("w"))).collect()]
    assert got == [("12", str((1 << 256) - 1)), ("7", "10"), (None, None), (None, None), (None, None), (None, "1"), (None, str(1 << 255)), ("0", "0")]


def test_no_python_and_missing_inputs(spark):
    table = spark.createDataFrame([(None, "1", "1"), ("1", None, "1"), ("1", "1", None), ("5", "x", "1")], "a string, b string, c string")
    found = table.select(amounts.muldiv_text("a", "b", "c").alias("x"))
    assert [r.x for r in found.collect()] == [None] * 4
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["bigint", "decimal(38,0)", "int"])
def test_whole_numbers_as_inputs(spark, kind):
    table = spark.createDataFrame([(7, 9, 2)], "a int, b int, c int").select(*(F.col(c).cast(kind).alias(c) for c in "abc"))
    assert table.select(wideint.muldiv("a", "b", "c").alias("x")).first().x == "31"

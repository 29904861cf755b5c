"""Operators and functions on cases that the driver's tables don't have."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siftlens.functions import binary, numeric, text
from siftlens.functions import datetime as dates
from siftlens.operators import asof, gather, lookup, rows, sequence
from siftlens.sinks.sound import wav
from siftlens.sinks.text import filled, svg_path


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_interpolation(spark):
    """Two fixes seven seconds apart, a probe after three."""
    fixes = spark.createDataFrame([("a", 28.0, 10.0, 179.0), ("a", 35.0, 17.0, -177.0)], "k string, t double, lat double, lon double")
    probes = spark.createDataFrame([("a", 31.0, 1), ("a", 28.0, 2), ("a", 35.0, 3), ("a", 1900.0, 4), ("b", 1.0, 5), ("a", 27.0, 6)], "k string, t double, id int")
    got = {r["id"]: (r["lat"], r["lon"]) for r in asof.interpolate(probes, fixes, ["k"], "t", ["lat", "lon"], ["id"], circular={"lon": 180.0}).collect()}
    assert got[1][0] == pytest.approx(13) and got[1][1] == pytest.approx(179 + 4 * 3 / 7 - 360)
    assert got[2] == (10.0, 179.0) and got[3] == (17.0, -177.0) and got[4] == (None, None) and got[5] == (None, None) and got[6] == (10.0, 179.0)


def test_interpolation_against_a_plain_form(spark):
    rng = random.Random(4)
    fixes = sorted(rng.sample(range(0, 40000, 50), 40))
    probes = [(k, float(rng.choice([*fixes, rng.randrange(-3000, 43000)]))) for k in range(300)]
    value = {t: rng.random() for t in fixes}

    def plain(t):
        before, after = [x for x in fixes if x <= t], [x for x in fixes if x > t]
        if not before or not after:
            near = after[0] if not before else before[-1]
            return value[near] if abs(near - t) <= 1800 else None
        a, b = before[-1], after[0]
        if b - a > 1800:
            near = a if t - a < b - t else b
            return value[near] if abs(near - t) <= 1800 else None
        return value[a] + (value[b] - value[a]) * (t - a) / (b - a)

    f = spark.createDataFrame([("a", float(t), v) for t, v in value.items()], "k string, t double, v double")
    p = spark.createDataFrame([("a", t, k) for k, t in probes], "k string, t double, id int")
    got = {r["id"]: r["v"] for r in asof.interpolate(p, f, ["k"], "t", ["v"], ["id"]).collect()}
    for k, t in probes:
        assert got[k] == pytest.approx(plain(t)) if plain(t) is not None else got[k] is None


def test_drift_goes_on_beyond_the_ends(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (15.0,), (30.0,)], "t double")
    got = [r[0] for r in df.select(asof.drift_corrected(df, [(10.0, 1.0), (20.0, 2.0)], "t")).collect()]
    assert got == pytest.approx([0.0, 9.0, 13.5, 27.0])


def test_priority_zero_keeps_the_earliest(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 1, 1), ("b", 1, 2), ("b", 0, 3)], "k string, p int, o int")
    assert sorted(tuple(r) for r in gather.deduplicate(df, ["k"], "p", "o").collect()) == [("a", 0, 1), ("b", 1, 2)]
    firsts = df.withColumn("r", gather.priority_rank(["k"], "p", "o")).where("r = 1").select("k", "p", "o")
    assert sorted(map(tuple, firsts.collect())) == [("a", 0, 1), ("b", 1, 2)]


def test_labels(spark):
    df = spark.createDataFrame([(5,), (0,), (None,)], "b int")
    assert [r[0] for r in df.select(lookup.bit_labels(F.col("b"), {0: "x"})).collect()] == ["x, [2]", "(none)", None]
    assert [r[0] for r in df.select(lookup.label_of(F.col("b"), {0: "zero"})).collect()] == ["Unknown (5)", "zero", None]


def test_mixed_order(spark):
    df = spark.createDataFrame([("img10",), ("img2",), ("3",), ("20",), (None,), ("-1",)], "k string")
    assert [r[0] for r in df.orderBy(*rows.mixed_order(F.col("k"))).collect()] == ["-1", "3", "20", "img2", "img10", None]


def test_derived_columns_that_need_each_other(spark):
    with pytest.raises(ValueError):
        rows.derive(spark.range(1), a=(("b",), lambda b: b), b=(("a",), lambda a: a))


def test_sessions_and_resets(spark):
    df = spark.createDataFrame([(1, k, m, v) for k, (m, v) in enumerate([(0, 1), (1, 2), (0, 3), (0, 4), (1, 5)])], "u int, t int, m int, v int")
    assert [r[0] for r in df.select(sequence.session_number(F.col("m") == 1, ["u"], "t"), "t").orderBy("t").collect()] == [0, 0, 1, 1, 1]
    assert [r["running"] for r in sequence.running_with_reset(df, "v", F.col("m") == 1, ["u"], "t").orderBy("t").collect()] == [1, 2, 5, 9, 5]


@pytest.mark.parametrize("column, value", [
    (lambda: numeric.duration(F.lit(0)), "0 s"), (lambda: numeric.duration(F.lit(-12.345)), "-12.35 s"), (lambda: numeric.duration(F.lit(3661)), "1:01:01"), (lambda: numeric.duration(F.lit(90061)), "1 days 1:01:01"),
    (lambda: numeric.file_size(F.lit(2047)), "2047 bytes"), (lambda: numeric.file_size(F.lit(2048)), "2.0 kB"), (lambda: numeric.file_size(F.lit(12 << 20)), "12 MB"),
    (lambda: numeric.exposure_time(F.lit(0.004)), "1/250"), (lambda: numeric.exposure_time(F.lit(2.0)), "2"), (lambda: numeric.fraction(F.lit(-0.5)), "-1/2"), (lambda: numeric.bit_rate(F.lit(1.5e6)), "1.5 Mbps"),
    (lambda: numeric.significant(F.lit(12345.678), 3), 12300.0), (lambda: text.zero_padded(F.lit(-7), 3), "-007"), (lambda: text.letters_of(F.lit(26)), "aa"), (lambda: text.letters_of(F.lit(0)), "a"),
    (lambda: text.letters_of(F.lit(702)), "aaa"), (lambda: text.xml_unescaped(F.lit("&amp;lt;")), "&lt;"), (lambda: text.json_value(F.lit("007")), '"007"'), (lambda: text.json_value(F.lit("-1.5")), "-1.5"),
    (lambda: text.restored(F.lit("abc"), F.lit("abcdef"), 3), "abcdef"), (lambda: text.spoken_name(F.lit("GPSVersionID")), "GPS Version ID"), (lambda: text.extension(F.lit("/a.b/c")), ""),
    (lambda: text.quoted_csv(F.lit('a"b')), '"a""b"'), (lambda: dates.seconds_of(F.lit("1970:01:01 01:00:00+01:00")), 0), (lambda: dates.seconds_of(F.lit("0000:00:00 00:00:00")), None),
    (lambda: dates.shifted(F.lit(2023), F.lit(1), F.lit(31), months=1).cast("string"), "2023-03-03"), (lambda: dates.edited(F.lit("2020-01-02T03:04:05")), "2020:01:02 03:04:05"),
    (lambda: dates.first_given(F.lit("0000:00:00"), F.lit("2020:01:01")), "2020:01:01"), (lambda: dates.with_fraction(F.lit("x"), F.lit(" 25 ")), "x.25"),
    (lambda: binary.unsigned(F.lit(b"\x01\x02\x03"), 1, 2, little=True), 0x0302), (lambda: binary.unsigned(F.lit(b"\x01"), 0, 2), None), (lambda: binary.signed(F.lit(b"\xff\xfe"), 0, 2), -2),
    (lambda: binary.bits(F.lit(0b10110), 1, 3), 3), (lambda: binary.magnitude(F.lit(0), F.lit(3)), -7), (lambda: binary.hex_color(F.lit(1), F.lit(255), F.lit(16)), "#01ff10"),
])
def test_functions(spark, column, value):
    assert one(spark, column()) == value


@pytest.mark.parametrize("bits_", [0.0, 1.5, -2.0**-140, 3.4e38, float("inf")])
def test_floats_by_their_bits(spark, bits_):
    (n,) = struct.unpack(">I", struct.pack(">f", bits_))
    high, low = struct.unpack(">II", struct.pack(">d", bits_))
    assert one(spark, binary.float32(F.lit(n))) == struct.unpack(">f", struct.pack(">f", bits_))[0]
    assert one(spark, binary.float64(F.lit(high), F.lit(low))) == bits_


def test_one_hot_key_is_worked_through_once(spark):
    """A key of very many rows: each frame is carried along."""
    from siftlens.operators import asof

    fixes = spark.range(0, 400_000, 2).selectExpr("1 as k", "cast(id as double) as t", "cast(id as double) as v")
    probes = spark.range(1, 400_000, 2).selectExpr("1 as k", "cast(id as double) as t", "id as n")
    found = asof.interpolate(probes, fixes, ["k"], "t", ["v"], ["n"])
    assert found.where("abs(v - t) > 1e-9 or v is null").count() == 1  # the last probe takes the last fix
    df = spark.range(200_000).selectExpr("1 as k", "cast(id as double) as t", "if(id % 1000 = 0, id, null) as v", "id")
    near = df.select("id", asof.nearest(df, "v", ["k"], "t", "id").alias("near"))
    assert near.where("near is null").count() == 0 and near.where("id = 500").first()["near"] == 0 and near.where("id = 501").first()["near"] == 1000


def test_zigzag(spark):
    got = one(spark, binary.zigzag(F.sequence(F.lit(0), F.lit(63))))
    assert got[:10] == [0, 1, 5, 6, 14, 15, 27, 28, 2, 4] and sorted(got) == list(range(64))


def test_template_and_path(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(filled("x$a-${a}", df.columns), filled("$b", df.columns), filled("$b", df.columns, "-")).first()[:] == ("x1-1", None, "-")
    pts = spark.sql("select array(struct(0 x, 0 y), struct(5 x, 0 y), struct(5 x, 2 y), struct(6 x, 3 y)) p")
    assert pts.select(svg_path(F.col("p"))).first()[0] == "M0 0 H5 V2 L6 3"


def test_wav():
    data = wav(b"\0\1\2", 22050, 1)
    assert data[:4] == b"RIFF" and struct.unpack_from("<I", data, 4)[0] == len(data) - 8 and data[8:12] == b"WAVE"

import pytest
from pyspark.sql import functions as F

from gridloom.functions import dna, prng
from gridloom.operators import errors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("seq", "gc", "run"), [("GGCC", 1.0, (2, "G")), ("aatg", 0.25, (2, "A")), ("AACC", 0.5, (2, "A")), ("", 0.0, (0, "")), ("ACGNNN", 0.333333, (3, "N"))]
)
def test_measures(spark, seq, gc, run):
    s = F.col("s")
    assert round(one(spark, dna.gc_fraction(s), s=seq), 6) == gc
    assert tuple(one(spark, dna.longest_run(s), s=seq)) == run
    assert one(spark, dna.max_run(s), s=seq) == run[0]


def test_runs_and_motifs(spark):
    s = F.col("s")
    assert [tuple(r) for r in one(spark, dna.runs(s, 2), s="AACGGG")] == [("A", 2, 0, 1), ("G", 3, 3, 5)]
    assert one(spark, dna.motif_positions(s, "GGGG"), s="GGGGG") == [0, 1]
    assert one(spark, dna.motif_positions(s, "GGGG"), s="GG") == []
    assert one(spark, dna.motif_hits(s), s="TTGGGGG")[0]["count"] == 2


@pytest.mark.parametrize(("mapping", "want"), [(dna.TWO_BIT, "ACGT"), (dna.ONE_HOT, "ACGT")])
def test_bits_round_trip(spark, mapping, want):
    b = F.col("b")
    assert one(spark, dna.bits_to_dna(b, mapping), b="00011011") == want
    assert one(spark, dna.dna_to_bits(dna.bits_to_dna(b, mapping), mapping), b="00011011") == "00011011"
    assert one(spark, dna.bits_to_dna(b, dna.ONE_BIT), b="011") == "ATT"
    assert one(spark, dna.bits_to_dna(b), b="") == ""


def test_bits_errors(spark):
    with pytest.raises(Exception, match="multiple"):
        one(spark, dna.bits_to_dna(F.col("b")), b="001")
    with pytest.raises(Exception, match="unknown base"):
        one(spark, dna.dna_to_bits(F.col("b")), b="AXC")
    for bad in ({"0": "A", "1": "A"}, {"00": "A", "01": "C", "10": "G"}, {"0": "A", "1": "X"}):
        with pytest.raises(ValueError):
            dna.check_mapping(bad)


def test_distances(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, dna.hamming(a, b), a="ACGT", b="ACCA") == 2
    assert one(spark, dna.hamming(a, b, "truncate"), a="ACGT", b="AG") == 1
    assert one(spark, dna.hamming(a, b, "inf"), a="ACGT", b="AG") is None
    assert one(spark, dna.hamming(a, b), a="", b="") == 0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, dna.hamming(a, b), a="ACGT", b="AG")
    assert one(spark, dna.levenshtein_capped(a, b, 2), a="AAAA", b="TTTT") == 3
    assert one(spark, dna.hamming_bits(F.lit(5), F.lit(6))) == 2


def test_repairs(spark):
    s = F.col("s")
    assert tuple(one(spark, dna.reduce_g(s), s="GGGGGGGG")) == ("GGTTTTTT", 6)
    assert tuple(one(spark, dna.break_runs(s, 3), s="AAAAAAAAA")) == ("AAACAAACA", 2)


def test_small_rules(spark):
    assert [one(spark, dna.target_distance(F.lit(d))) for d in range(7)] == [0, 2, 4, 6, 8, 8, 8]
    assert one(spark, dna.feature_id(F.lit(3), F.lit(7), 10)) == "R003_C007"
    assert one(spark, dna.feature_id(F.lit(3), F.lit(7), 10, "linear")) == "37"
    assert dna.bit_length_for(182, 8) == 12 and dna.bit_length_for(118, 8) == 12
    assert one(spark, dna.chebyshev(F.lit(5), F.lit(5), F.lit(8), F.lit(5))) == 3


def test_random_numbers(spark):
    rows = spark.range(4000).select(prng.uniform(1, F.col("id")).alias("u"), prng.dna(40, 1, F.col("id")).alias("s"), prng.bits(11, 1, F.col("id")).alias("b"))
    row = rows.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg((F.left("s", F.lit(1)) == "G").cast("double")), F.min(F.length("s")), F.max("b")).first()
    assert abs(row[0] - 0.5) < 0.03 and row[1] >= 0 and row[2] < 1 and abs(row[3] - 0.25) < 0.04 and row[4] == 40 and row[5] < 2048
    assert rows.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(rows.agg(F.sum("u")).first()[0])


def test_error_models(spark):
    rows = spark.range(300).withColumn("s", prng.dna(32, "e", F.col("id")))
    sub = rows.select(dna.hamming(F.col("s"), errors.substitution(F.col("s"), F.col("id"), 0.1)).alias("d")).agg(F.avg("d")).first()[0] / 32
    assert abs(sub - 0.1) < 0.02
    ind = rows.select(F.length(errors.indel(F.col("s"), F.col("id"), 0.0, 0.2, 0.1)).alias("n")).agg(F.avg("n")).first()[0] / 32
    assert abs(ind - 0.9 * 1.2) < 0.04
    fixed = rows.select("s", errors.fixed_length(F.col("s"), F.col("id"), 0.03, 0.04, 0.14).alias("r"))
    assert fixed.where(F.length("r") != 32).count() == 0 and fixed.where("r <> s").count() > 200
    assert rows.select("s", errors.fixed_length(F.col("s"), F.col("id"), 0.0, 0.0, 0.0).alias("r")).where("r <> s").count() == 0
    # Three of four bases that are drawn differ from what stood there.
    sub = rows.select(dna.hamming(F.col("s"), errors.fixed_length(F.col("s"), F.col("id"), 0.06, 0.0, 0.0)).alias("d")).agg(F.avg("d")).first()[0] / 32
    assert abs(sub - 0.06) < 0.01
    assert one(spark, errors.substitution(F.col("s"), F.lit(1), 0.5), s="") == "" == one(spark, errors.fixed_length(F.col("s"), F.lit(1), 0.5, 0.5, 0.5), s="")

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import dna, prng
from gridloom.operators import codes, decode, distances, errors, grid, layouts, qc, quadtree
from gridloom.plans import catalog
from gridloom.sources import config, io
from gridloom.sources.tables import numbered, spread, stored
from gridloom.streaming import windows

# The published spot barcodes, in order.
SPOTS = """AAACACCC AACACACG AACCGGAA AACGTCGT AAGGCTAC ACAACCGA ACACGATG ACCAAGTC ACCTGTCT ACGGAACA ACGTTCAG ACTCTTGC AGTAGCAC AGTCCGTT
CAAAGAGC CAAGCGTA""".split()


def test_spot_barcodes(spark):
    assert qc.kmers(spark, 8).where(qc.spot_candidate(F.col("seq"), g_max=0.25)).count() == 12134
    assert qc.kmers(spark, 8).where(qc.spot_candidate(F.col("seq"), g_max=0.2)).count() == 5474
    assert codes.spot_barcodes(spark) == SPOTS
    with pytest.raises(ValueError):
        codes.greedy_set(spark.createDataFrame([(0, "AAAA"), (1, "AAAC")], "idx int, seq string"), 2, 5)
    relaxed = spark.createDataFrame([(2, "AAAATTTT"), (1, "AAAACCCC"), (3, "CCCCAAAA")], "idx int, seq string")
    assert codes.greedy_set(relaxed, 3, 5) == (["AAAACCCC", "AAAATTTT", "CCCCAAAA"], 4)


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (5, 6), (13, 22)])
def test_blocks(spark, size):
    rows, cols = size
    got = {(r.row, r.col): r.spot_in_block for r in grid.with_blocks(grid.grid(spark, rows, cols), cols).collect()}
    seen: dict = {}
    for r in range(rows):
        for c in range(cols):
            seen.setdefault((r // 4, c // 4), []).append((r, c))
    assert got == {p: k for b in seen.values() for k, p in enumerate(sorted(b))}


def test_dual_layout_rules(spark):
    one = spark.range(7).select(prng.dna(8, "a", F.col("id")).alias("seq"))
    two = spark.range(80).select(prng.dna(10, "b", F.col("id")).alias("seq"))
    out = layouts.dual_layout(grid.grid(spark, 13, 22), 22, one, 7, two, 80, 1)
    assert out.count() == 286 and layouts.layout_violations(out).count() == 0
    with pytest.raises(Exception, match="too few bar_2"):
        layouts.dual_layout(grid.grid(spark, 13, 22), 22, one, 7, two.limit(20), 20, 1).count()
    with pytest.raises(ValueError):
        layouts.dual_layout(grid.grid(spark, 4, 4), 4, one, 7, two, 3, 1)


def test_hierarchical_layout(spark):
    spots = grid.grid(spark, 9, 10)
    blocks = grid.with_blocks(spots, 10).select("block_row", "block_col").distinct().withColumn("seq", prng.dna(28, "k", F.col("block_row"), F.col("block_col")))
    two = spark.createDataFrame(list(enumerate(SPOTS)), "idx int, seq string")
    out = layouts.hierarchical_layout(spots, 10, blocks, two, 42)
    assert out.count() == 90 and layouts.layout_violations(out).count() == 0


def test_quadtree(spark):
    codes_, report = quadtree.quadtree_codes(grid.grid(spark, 9, 13), 9, 13, 6, max_run=1)
    seqs = [r.seq for r in codes_.collect()]
    assert len(seqs) == 117 and all(a != b for s in seqs for a, b in zip(s, s[1:], strict=False)) and len(report) == 6
    assert quadtree.least_levels(9, 13) == 4
    assert [quadtree.best_permutation([(0, 0, 5, 1), (1, 1, 2, 0)])[0]] == [(1, 0, 2, 3)]


def test_axis_codes():
    made = codes.axis_codes(20, 36, attempts=3000, seed=3)
    assert len(made) == 20 and all((a ^ b).bit_count() >= 8 for i, a in enumerate(made) for b in made[i + 5 :])
    assert made == codes.axis_codes(20, 36, attempts=3000, seed=3)
    with pytest.raises(ValueError, match="distance of 16"):
        codes.axis_codes(46, 28, far=16)


def test_segment_join_is_exact(spark):
    lib = spark.range(60).select(F.col("id").alias("idx"), prng.dna(14, "l", F.col("id") % 55).alias("seq"))
    reads = spark.range(400).select(F.concat(prng.dna(9, "l", F.col("id") % 40), prng.dna(6, "r", F.col("id"))).alias("seq")).union(lib.select("seq"))
    for t in (1, 2, 3):
        a = {tuple(r) for r in decode.segment_matches(reads, lib, t, 14).collect()}
        assert a == {tuple(r) for r in decode.brute_matches(reads, lib, t).collect()} and a


@pytest.mark.parametrize("threshold, length", [(5, 36), (4, 28), (2, 12)])
def test_pieces_of_reads_with_indels(spark, threshold, length):
    """All pairs within the threshold, for reads shorter and longer than the library, against Levenshtein distances of every pair."""
    # Four bases in a row are drawn together, so that pieces recur and edits can be read in several ways.
    lib = spark.range(90).select(F.col("id").alias("idx"), F.substring(F.repeat(prng.dna(4, "u", F.col("id") % 3), 20), 1, length // 2).alias("a"), prng.dna(length, "n", F.shiftright("id", 1)).alias("b"))
    lib = lib.select("idx", F.left(F.concat("a", "b"), F.lit(length)).alias("seq"))
    kinds = [errors.indel(F.col("seq"), F.concat_ws("-", "idx", F.lit(k)), 0.05, 0.03 * (k % 3), 0.02 * (k % 4), "i") for k in range(12)]
    kinds += [F.concat(F.lit("ACG"), "seq"), F.concat("seq", F.lit("TT")), F.expr("substring(seq, 3)"), F.expr(f"left(seq, {length - 2})"), F.reverse("seq"), F.lit(""), F.lit(None)]
    reads = stored(lib.select(F.explode(F.array(*kinds)).alias("seq")), "reads")
    got = {tuple(r) for r in decode.segment_matches(reads, lib, threshold, length).collect()}
    want = {tuple(r) for r in decode.brute_matches(reads, lib, threshold).collect()}
    assert got == want and len({d for _, _, d in want}) == threshold + 1
    assert {len(s) - length for s, _, _ in want} >= set(range(-2, 3))


def test_small_tables_are_measured(spark, monkeypatch):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    broadcast = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert broadcast(layouts.small(rows)) and not broadcast(rows)
    monkeypatch.setattr(layouts, "MOST_BROADCAST", 100_000)
    assert not broadcast(layouts.small(rows)) and broadcast(layouts.small(rows.limit(50))) and broadcast(layouts.small(rows.limit(0)))


def test_ties(spark):
    lib = spark.createDataFrame([(0, "AAAA"), (1, "AAAA"), (2, "CCCC")], "idx int, seq string")
    reads = spark.createDataFrame([("AAAA",), ("CCCA",), ("GGGG",), (None,)], "seq string")
    erased = {r.seq: (r.decoded, r.ambiguous) for r in decode.decode(reads, lib, 1).collect()}
    assert erased == {"AAAA": (None, True), "CCCA": (2, False), "GGGG": (None, False), None: (None, False)}
    assert {r.seq: r.decoded for r in decode.decode(reads, lib, 1, ties="first").collect()}["AAAA"] == 0


def test_split_read(spark):
    df = spark.createDataFrame([("AAGGGCC",), ("AACC",), ("A",), ("AAGGGCGGGC",)], "s string")
    got = [r[0] for r in df.select(decode.split_read(F.col("s"), "GGG", 2, 2)).collect()]
    assert [tuple(x) if x else None for x in got] == [("AA", "CC"), ("AA", "CC"), None, ("AA", "GC")]


def test_far_neighbours_and_coverage(spark):
    spots = grid.grid(spark, 8, 9).withColumn("v", F.col("row") * 100 + F.col("col"))
    far = grid.far_neighbours(spots, "v").collect()
    assert len(far) == sum(max(0, 9 - k) for k in range(5, 15)) * 8 + sum(max(0, 8 - k) for k in range(5, 15)) * 9
    assert grid.coverage(spots, 8, 9).count() == 0
    for length in (20, 40):  # packed, and as text
        seqs = {(r.row, r.col): r.s for r in spots.select("row", "col", prng.dna(length, "v", F.col("v")).alias("s")).where("v % 7 <> 3").collect()}
        rows = spark.createDataFrame([(*p, s) for p, s in seqs.items()], "row int, col int, s string")
        got = {(r.row, r.col, r.direction, r.step): r.dist for r in distances.of_neighbours(rows, "s", (1, 5, 6)).collect()}
        want = {(r, c, d, k): sum(x != y for x, y in zip(s, seqs[q])) for (r, c), s in seqs.items() for k in (1, 5, 6) for d, q in (("right", (r, c + k)), ("bottom", (r + k, c))) if q in seqs}
        assert got == want
    with pytest.raises(Exception, match="differ in length"):
        distances.of_neighbours(spark.createDataFrame([(0, 0, "ACG"), (0, 1, "AC")], "row int, col int, s string"), "s").collect()
    assert grid.duplicates(spots.union(spots.limit(2)), "v", "first").count() == 2
    pairs = distances.pairs(spots.where("row = 0"), "col", "v", "bits")
    assert pairs.count() == 36 and distances.min_pairwise(pairs.where("1=0")).first()[0] == 0


def test_io(spark, tmp_path):
    (tmp_path / "lib.txt").write_text("acgt\n\n  ttaa \nGGCC\n")
    rows = io.read_library(spark, str(tmp_path / "lib.txt"), 4, upper=True).orderBy("idx").collect()
    assert [(r.idx, r.seq) for r in rows] == [(0, "ACGT"), (1, "TTAA"), (2, "GGCC")]
    with pytest.raises(ValueError):
        io.read_library(spark, str(tmp_path / "lib.txt"), 5)
    spots = grid.grid(spark, 3, 2).withColumn("bar", prng.dna(6, 1, F.col("row"), F.col("col")))
    io.write_strict(spots, 3, 2, "bar", str(tmp_path / "out.txt"))
    want = [r.bar for r in spots.orderBy("col", "row").collect()]
    assert spark.read.text(str(tmp_path / "out.txt")).rdd.map(lambda r: r.value).collect() == want
    with pytest.raises(ValueError, match="cover"):
        io.write_strict(spots.limit(5), 3, 2, "bar", str(tmp_path / "no.txt"))
    io.write_axis_codes([5, 1], [2], (4, 3), str(tmp_path / "axis.json"))
    assert [(r.axis, r.pos, r.bits) for r in io.read_axis_codes(spark, str(tmp_path / "axis.json")).orderBy("axis", "pos").collect()] == [("x", 0, "0101"), ("x", 1, "0001"), ("y", 0, "010")]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"_comment": ["x"], "chip_geometry": {"rows": 12, "cols": 200}}))
    c = config.load_config(path)
    assert (c.x_bit_length, c.y_bit_length, c.chip_geometry.total_features) == (12, 8, 2400)
    config.save_config(c, path)
    assert config.load_config(path) == c
    path.write_text(json.dumps({"chip_geometry": {"colour": 1}}))
    with pytest.raises(TypeError):
        config.load_config(path)
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.json")
    for bad in ({"distances": [1]}, {"distances": [0, 1, 2, 3]}):
        with pytest.raises(ValueError):
            config.DistanceRules(**bad)


def test_stream(spark, tmp_path):
    """Reads of files as they come: repeats go, a restart takes what is new, a batch taken again gives the same rows."""
    lib = spark.createDataFrame([(0, "AAAACCCC"), (1, "GGGGTTTT")], "idx int, seq string")
    places = [str(tmp_path / n) for n in ("in", "out", "cp")]
    add = lambda rows: spark.createDataFrame(rows, "read_id long, seq string").withColumn("ts", F.timestamp_seconds(F.col("read_id") * 10)).coalesce(1).write.mode("append").parquet(places[0])

    def run():
        stream = spark.readStream.schema("read_id long, seq string, ts timestamp").parquet(places[0])
        windows.decode_stream(stream, lib, 2, None, places[1], places[2])
        return sorted((r.batch, r.read_id, r.decoded, r.dist) for r in spark.read.schema(windows.DECODED).parquet(places[1]).collect())

    add([(1, "AAAACCCC"), (2, "GGGGTTTA"), (1, "AAAACCCC"), (3, "CCCCCCCC")])
    first = run()
    assert first == [(0, 1, 0, 0), (0, 2, 1, 1), (0, 3, None, None)] and run() == first
    add([(2, "GGGGTTTA"), (4, "AAAACCCG"), (5, None)])
    both = run()
    assert both == [*first, (1, 4, 0, 1), (1, 5, None, None)] or both == [*first, (2, 4, 0, 1), (2, 5, None, None)]
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    assert run() == both
    rates = windows.window_rates(spark.read.parquet(places[0]).select("ts", F.lit("ok").alias("outcome"), F.lit(1.0).alias("value")))
    assert rates.agg(F.sum("n")).first()[0] == 7


@pytest.mark.parametrize("metric, length", [("bits", 36), ("hamming", 28), ("bits", 3), ("hamming", 1)])
def test_closest(spark, metric, length):
    for n in (0, 1, 2, 40, 300):
        value = prng.bits(length, f"c{n}", F.col("id")) if metric == "bits" else prng.dna(length, f"c{n}", F.col("id"))
        rows = spark.range(n).select("id", value.alias("v"))
        if length > 3 and n == 300:  # a common half, as in products of axes
            rows = rows.withColumn("v", F.col("v").bitwiseAND(F.lit((1 << 20) - 1)) if metric == "bits" else F.concat(F.repeat(F.lit("A"), 12), F.left("v", F.lit(16))))
        rows = stored(rows, "codes")
        assert distances.closest(rows, "v", length, metric) == distances.min_pairwise(distances.pairs(rows, "id", "v", metric)).first()[0], n
    far = spark.createDataFrame([("A" * 28,), ("C" * 28,), (None,)], "v string")
    assert distances.closest(far, "v", 28) == 28
    with pytest.raises(ValueError, match="other lengths"):
        distances.closest(far, "v", 27)


def test_near_pairs(spark):
    rows = spark.range(40).where("id % 7 <> 3").select("id", prng.dna(9, "n", F.col("id")).alias("v"))
    for metric in ("hamming", "levenshtein"):
        want = sorted(tuple(r) for r in distances.pairs(rows, "id", "v", metric).where("diff <= 4").collect())
        assert sorted(tuple(r) for r in distances.near_pairs(rows, "id", "v", metric, 4).select("i", "j", "diff", "dist").collect()) == want


def test_sampled_pairs_are_all_pairs(spark):
    """Enough draws hit every pair, and nothing else, about as often; the mean is near the exact one."""
    rows = spark.range(3, 15).select("id", dna.bit_string(prng.bits(20, "s", F.col("id")), 20).alias("b")).withColumn("s", dna.bits_to_dna(F.col("b")))
    exact, sampled = distances.preservation(rows, "id", "b", "s").first(), distances.sampled_preservation(rows, "id", "b", "s", 20_000, 1).first()
    assert exact.n_pairs == 66 and sampled.n_pairs == 20_000
    assert abs(exact.mean_ratio - sampled.mean_ratio) < 0.01 and abs(exact.std_ratio - sampled.std_ratio) < 0.01
    assert distances.sampled_preservation(rows.limit(1), "id", "b", "s", 10, 1).first().n_pairs == 0


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit("x").alias("idx_"))
    for parts in (1, 5):
        got = numbered(rows.repartition(parts), "v").orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(1000)) and [r.v for r in got] == sorted(r.v for r in got)
    assert numbered(rows.limit(0), "v").count() == 0
    lib = spark.range(50).select(prng.dna(8, "p", F.col("id")).alias("seq"))
    plain = sorted((r.seq for r in lib.collect()), key=lambda s: (hashlib.md5(f"9:{s}".encode()).hexdigest(), s))
    assert [r.seq for r in layouts.shuffled(lib, 9).orderBy("idx").collect()] == plain


def test_library_over_splits(spark, tmp_path):
    """Lines are numbered as in a sequential reading of all files, though splits cut through them."""
    lines = [f"{'ACGT'[k % 4]}{'ACGT'[k // 4 % 4]}{'ACGT'[k // 16 % 4]}" * 5 for k in range(3000)]
    (tmp_path / "lib").mkdir()
    for name, part in (("b.txt", lines[1000:]), ("a.txt", lines[:1000])):
        (tmp_path / "lib" / name).write_text("\n\n".join(part) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        rows = io.read_library(spark, str(tmp_path / "lib"), 15)
        assert spark.read.text(str(tmp_path / "lib")).rdd.getNumPartitions() > 5
        assert [(r.idx, r.seq) for r in rows.orderBy("idx").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no sequences"):
        io.read_library(spark, str(tmp_path / "none.txt"))
    assert io.read_library(spark, str(tmp_path / "none.txt"), empty="keep").count() == 0


def test_look_ups_read_one_row_group(spark, tmp_path):
    path = str(tmp_path / "book")
    book = spark.range(40_000).select(F.expr("cast(id div 200 as int)").alias("row"), (F.col("id") % 200).cast("int").alias("col"), prng.dna(30, "k", F.col("id")).alias("seq"))
    book = book.withColumn("feature_id", F.md5(F.concat_ws(",", "row", "col").cast("binary")))
    io.write_look_up(book, path, files=4, rows_a_group=1000)

    def read(df):
        rows = df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return rows, int(scan.metrics().apply("numOutputRows").value()), scan.toString()

    rows, taken, plan = read(io.look_up_place(spark, path, 77, 31))
    assert [(r.row, r.col) for r in rows] == [(77, 31)] and taken <= 1000 and "EqualTo(row,77)" in plan
    name = hashlib.md5(b"77,31").hexdigest()
    rows, taken, plan = read(io.look_up_id(spark, path, name))
    assert [(r.row, r.col) for r in rows] == [(77, 31)] and taken <= 3000 and "feature_id" in plan.partition("PushedFilters")[2]
    rows, taken, _ = read(io.look_up_id(spark, path, "none"))
    assert rows == [] and taken <= 2000
    assert read(io.look_up_place(spark, path, 999, 0))[:2] == ([], 0)


def test_error_models_by_name(spark):
    """Every registered channel gives the reads of its SQL; another one can be added, and used by name."""
    seqs = spark.createDataFrame([(0, ""), (1, "A"), (2, "ACGTACGTTGCA"), (3, "G" * 40)], "nr long, s string")
    rates = {"rate": 0.3, "sub": 0.2, "ins": 0.25, "dele": 0.15}
    for name, model in errors.MODELS.items():
        own = {r: rates[r] for r in model.rates}
        for some in (own, {r: 0.0 for r in own}, {r: 1.0 for r in own}):
            got = [r.x for r in seqs.select("nr", errors.read_of(name, F.col("s"), F.col("nr"), "e", **some).alias("x")).orderBy("nr").collect()]
            sql = errors.read_sql(name, "s", "nr", "e", **some)
            want = duckdb.sql(f"SELECT {sql} FROM (VALUES (0, ''), (1, 'A'), (2, 'ACGTACGTTGCA'), (3, '{'G' * 40}')) t(nr, s) ORDER BY nr").fetchall()
            assert got == [w[0] for w in want], (name, some)
    with pytest.raises(ValueError, match="unknown error model"):
        errors.read_of("none", F.col("s"), F.col("nr"))
    with pytest.raises(ValueError, match="rates from 0 to 1"):
        errors.read_of("indel", F.col("s"), F.col("nr"), sub=0.1, ins=0.1, dele=1.1)
    with pytest.raises(ValueError, match="there is an error model"):
        errors.register("indel", (), errors.indel, errors.indel_sql)
    errors.register("reversed", (), lambda seq, key, seed: F.reverse(seq), lambda seq, key, seed: f"reverse({seq})")
    try:
        assert seqs.select(errors.read_of("reversed", F.col("s"), F.col("nr")).alias("x")).collect()[2].x == "ACGTTGCATGCA"
    finally:
        del errors.MODELS["reversed"]


def test_rounds_are_those_of_single_codes(spark):
    spots = grid.grid(spark, 9, 13)
    starts = quadtree.round_starts(3)
    both, reports = quadtree.rounds_of_codes(spots, 9, 13, 6, starts, 2)
    got = {(r.row, r.col): list(r.seqs) for r in both.collect()}
    for k, start in enumerate(starts):
        codes_, report = quadtree.quadtree_codes(spots, 9, 13, 6, 2, start)
        assert {(r.row, r.col): r.seq for r in codes_.collect()} == {p: s[k] for p, s in got.items()} and report == reports[k]
    layout = quadtree.repeated_rounds(spots, 9, 13, 6, 3)
    report = {r["round"]: r for r in quadtree.round_report(layout, 3).collect()}
    assert set(report) == {0, 1, 2, 3} and all(r.n == 117 for r in report.values()) and report[0].n_unique == len({r.quadtree_combined for r in layout.collect()})
    with pytest.raises(ValueError):
        quadtree.rounds_of_codes(spots, 9, 13, 6, [])


def test_neighbours_are_not_broadcast_by_the_bytes_of_a_file(spark, tmp_path):
    spark.range(2000).write.parquet(f"{tmp_path}/spots")
    spots = spark.read.parquet(f"{tmp_path}/spots").select(F.expr("cast(id div 50 as int)").alias("row"), F.expr("cast(id % 50 as int)").alias("col"), prng.dna(28, "v", F.col("id")).alias("v"))
    met = distances.of_neighbours(spots, "v")
    assert "Broadcast" not in met._jdf.queryExecution().sparkPlan().toString()
    assert met.count() == 49 * 40 + 39 * 50


def test_rows_are_dealt_over_tasks(spark, tmp_path):
    spark.range(9000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one).select(F.spark_partition_id()).distinct().count() == 5 and spread(one).distinct().count() == 9000
    assert spread(one, 1).select(F.spark_partition_id()).distinct().count() == 16 and spread(one.where("id < 5")).count() == 5


@pytest.mark.parametrize("whole", [2, 3])
def test_keys_of_several_pieces(spark, whole):
    """As one piece: all pairs within the threshold, with insertions and deletions."""
    lib = stored(spark.range(60).select(F.col("id").alias("idx"), F.left(F.concat(F.repeat(prng.dna(3, "u", F.col("id") % 3), 4), prng.dna(12, "n", F.shiftright("id", 1))), F.lit(24)).alias("seq")), "lib")
    kinds = [errors.indel(F.col("seq"), F.concat_ws("-", "idx", F.lit(k)), 0.05, 0.03 * (k % 3), 0.03 * (k % 4), "i") for k in range(12)] + [F.expr("substring(seq, 3)"), F.concat(F.lit("ACG"), "seq"), F.lit(""), F.lit(None)]
    reads = stored(lib.select(F.explode(F.array(*kinds)).alias("seq")), "reads")
    for metric in ("levenshtein", "hamming"):
        got = {tuple(r) for r in decode.segment_matches(reads, lib, 4, 24, metric, whole).collect()}
        assert got == {tuple(r) for r in decode.brute_matches(reads, lib, 4, metric).collect()} and got
    near = {tuple(r) for r in decode.nearest_by_pieces(reads, lib, 4, 24).collect()}
    assert near == {tuple(r) for r in decode.nearest(decode.brute_matches(reads, lib, 4)).collect()}
    assert [decode.pieces_for(n, 4, 28) for n in (200, 120_000, 7_200_000)] == [1, 2, 3]


def test_greedy_selection_is_whole(spark):
    from gridloom.plans import catalog

    got = [r.seq for r in catalog.QUERIES["greedy_select"](spark, "/root/testdata/sf0.001").orderBy("place").collect()]
    assert len(got) == 16 and all(sum(a != b for a, b in zip(x, y)) >= 5 for i, x in enumerate(got) for y in got[:i])
    few = spark.createDataFrame([(0, "AAAA"), (1, "AAAC"), (2, "CCCC")], "idx int, seq string")
    assert codes.greedy_set(few, 3, 4, fewer=True) == (["AAAA", "CCCC"], 4)


def test_statistics_from_counts(spark):
    """Figures of an axis pair by pair, with ties, without a pair and with values of one kind."""
    rows = stored(spark.range(40).select(F.col("id").cast("int").alias("pos"), prng.bits(36, "a", F.col("id") % 30).alias("code")), "rows")
    pairs = distances.pairs(rows, "pos", "code", "bits")
    plain = pairs.groupBy("diff").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("m"), F.round(F.stddev_pop("dist"), 6).alias("s"), F.round(F.percentile("dist", 0.25), 6).alias("q"))
    want = {r.diff: (r.n, r.m, r.s, r.q) for r in plain.collect()}
    made = distances.stats_by_separation(pairs)
    assert {r.diff: (r.n_pairs, r.mean_dist, r.std_dist, r.q25) for r in made.collect()} == want and len(want) == 39
    sizes = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(sizes) == 2 and "percentile" not in sizes[1]  # pairs are counted, and the counts are ranked
    assert distances.stats_by_separation(pairs.limit(0)).count() == 0 and distances.constraint_report(pairs.limit(0)).count() == 0


def test_codebook_figures_from_its_axes(spark):
    rows = lambda *seqs: spark.createDataFrame([(k // 2, "01" * len(s), s) for k, s in enumerate(seqs)], "pos int, bits string, seq string")
    fixed, loose = rows("ACGT", "ACGT", "CCGT"), rows("A", "AC", "C", "")
    for x, y in ((fixed, loose), (loose, fixed), (fixed, fixed), (loose, loose), (fixed.limit(0), loose)):
        assert layouts.product_stats(x, y, "C").collect() == layouts.codebook_stats(layouts.codebook(x, y, "C")).collect()


def test_repairs_of_neighbouring_runs(spark):
    df = spark.createDataFrame([("AAAACCCC",), ("GGGGAAAAAAAAGG",), ("TTTTCCC",), ("aaaa",), ("",), (None,)], "s string")
    got = [(r.b and r.b.seq, r.g and r.g.seq) for r in df.select(dna.break_runs(F.col("s")).alias("b"), dna.reduce_g(F.col("s")).alias("g")).collect()]
    assert got == [("AAACCCCA", "AAAACCCC"), ("GGGAAAACAAACGG", "GGGTAAAAAAAATT"), ("TTTCCCC", "TTTTCCC"), ("AAAC", "aaaa"), ("", ""), (None, None)]


def test_libraries_of_unknown_and_short_lengths_are_met_by_pieces(spark, monkeypatch):
    """Several lengths, short ones among them, and reads of all radii: as all pairs, which only lengths with few entries are compared with."""
    lib = spark.range(900).select(F.col("id").alias("idx"), F.substring(prng.dna(24, "m", F.col("id") % 800), 1, F.element_at(F.array(*map(F.lit, (8, 20, 24))), (F.col("id") % 3 + 1).cast("int"))).alias("seq"))
    lib = stored(lib.union(spark.createDataFrame([(900, "A"), (901, "CC"), (902, None)], "idx long, seq string")), "lib")
    kinds = [errors.indel(F.col("seq"), F.concat_ws("-", "idx", F.lit(k)), 0.03 * k, 0.02 * k, 0.02 * k, "u") for k in range(4)]
    reads = stored(lib.where("idx % 5 = 0 or idx >= 900").select(F.explode(F.array(*kinds)).alias("seq")), "reads")
    for threshold in (1, 2, 4):
        want = {r.seq: (r.dist, r.n, r.idx) for r in decode.nearest(decode.brute_matches(reads, lib, threshold)).collect()}
        compared = []
        monkeypatch.setattr(decode, "brute_matches", lambda r, l, t, m, f=decode.brute_matches: compared.append(l.count()) or f(r, l, t, m))
        got = decode.decode(reads, lib, threshold, ties="first").where("dist is not null").distinct().collect()
        monkeypatch.undo()
        assert {r.seq: (r.dist, r.decoded) for r in got} == {s: (d, i) for s, (d, _, i) in want.items()} and {d for d, _, _ in want.values()} == set(range(threshold + 1))
        assert {r.seq for r in got if r.ambiguous} == {s for s, (_, n, _) in want.items() if n > 1}
        if threshold == 1:
            assert max(compared) < 10


def test_counted_pairs_are_pairs_counted(spark, monkeypatch):
    """Several blocks, gaps and far places, repeated places, negative and missing codes; no pair is made for the statistics."""
    monkeypatch.setattr(distances, "BLOCK", 50)
    key = F.when(F.col("id") > 270, F.col("id") * 1_000_003).otherwise(F.col("id") - F.col("id") % 7 % 2)
    rows = stored(spark.range(300).select(key.alias("pos"), F.when(F.col("id") % 41 > 0, F.xxhash64("id")).alias("code"), prng.dna(12, "cp", F.col("id")).alias("seq")), "rows")
    pairs = distances.pairs(rows, "pos", "code", "bits")
    counted = lambda most=None: distances.counted_pairs(rows, "pos", {"dist": ("code", "bits")}, most)
    out = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert out(distances.histogram(counted())) == out(distances.histogram(pairs))
    assert out(distances.stats_by_separation(counted())) == out(distances.stats_by_separation(pairs))
    assert out(distances.constraint_report(counted(4))) == out(distances.constraint_report(pairs)) and counted(4).agg(F.max("diff")).first()[0] == 5
    both = distances.counted_pairs(rows.withColumn("bases", dna.packed(F.col("seq"))), "pos", {"bits": ("code", "bits"), "bases": ("bases", "bases")}, 0)
    far = distances.pairs(rows, "pos", "seq").groupBy("dist").count()
    assert out(both.groupBy("bases").agg(F.sum("__n"))) == out(far)
    for few in (rows.limit(0), rows.limit(1)):
        assert distances.counted_pairs(few, "pos", {"dist": ("code", "bits")}).count() == 0
    monkeypatch.setattr(distances, "pairs", None)
    assert {n for n in ("axis_constraints", "axis_distance_histogram", "both_axes_distance_stats", "distance_preservation") if catalog.QUERIES[n](spark, "/root/testdata/sf0.001").count() == 0} == set()


def test_pieces_leave_few_entries_to_compare(spark):
    """A piece of 6 bases would have a read meet 500 of 120,000 entries of 36 bases; a piece that is in many keys is taken once."""
    assert decode.pieces_for(120_000, 5, 36) == 2
    one = spark.createDataFrame([(0, "ACGT" * 9)], "idx int, seq string")
    plan = decode.segment_matches(one.select("seq"), one, 5, 36, whole=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(seq") < 100 and decode.segment_matches(one.select("seq"), one, 5, 36, whole=2).collect() == [("ACGT" * 9, 0, 0)]


def test_look_ups_of_stored_axes(spark, tmp_path):
    """Every place and id of a codebook, a repeated place and ids of no feature among them; what is stored grows with the axes."""
    x = spark.createDataFrame([(0, "00", "A"), (7, "01", "C"), (7, "10", "G"), (1234, "11", "T"), (-1, "11", "T")], "pos int, bits string, seq string")
    y = spark.createDataFrame([(k, "0110", f"A{k}") for k in (2, 3, 1000)], "pos int, bits string, seq string")
    io.write_axes_look_up(x, y, f"{tmp_path}/axes")
    assert sum(spark.read.parquet(f"{tmp_path}/axes/{a}").count() for a in "xy") == 5 + 3
    book = layouts.codebook(x, y, "GG")
    out = lambda df: sorted(map(tuple, df.select(book.columns).collect()))
    for r, c in [(2, 0), (3, 7), (1000, 1234), (2, -1), (0, 2), (9, 9)]:
        assert out(io.look_up_axes_place(spark, f"{tmp_path}/axes", r, c, "GG")) == out(layouts.feature_at(book, r, c))
    for ids in ([r.feature_id for r in book.collect()], ["R002_C000", "R003_C1234"], ["R9_C000", "R002", "x", "_", ""]):
        assert out(io.look_up_axes_id(spark, f"{tmp_path}/axes", *ids, spacer="GG")) == out(book.where(F.col("feature_id").isin(ids)))


def test_motifs_are_looked_for_only_where_they_occur(spark):
    rows = spark.createDataFrame([("GGGGGa",), ("ggGgC",), ("ACGT",), ("GG",), ("",), (None,)], "s string")
    found = dna.motif_positions(F.col("s"), "GGGG")
    assert [r[0] for r in rows.select(found).collect()] == [[0, 1], [0], [], [], [], []]
    assert "contains" in rows.select(found)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_layout_statistics_of_repeated_and_missing_barcodes(spark):
    rows = [("ACGG", "AC", "GG"), ("ACGG", "AC", "GG"), ("TTTT", "TT", "TT"), (None, None, "A")]
    layout = spark.createDataFrame(rows, "combined string, bar_1 string, bar_2 string")
    stats = layouts.layout_stats(layout)
    assert tuple(stats.first()) == (4, 2, 2, 3, 0.3333, 0.5, 2, 0.5, 0.0, 0.75, 4)
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(layouts.layout_stats(layout.limit(0)).first())[:4] == (0, 0, 0, 0)


@pytest.mark.parametrize("metric, length, threshold", [("levenshtein", 24, 4), ("levenshtein", 9, 1), ("hamming", 18, 3)])
def test_decoding_block_by_block(spark, monkeypatch, metric, length, threshold):
    """As all pairs, with several blocks on both sides, equal entries, one without an idx, and letters beside the bases; keys of reads are no rows."""
    from gridloom.operators import blocks

    lib = spark.range(700).select(F.when(F.col("id") != 13, F.col("id")).alias("idx"), F.substring(F.concat(F.repeat(prng.dna(3, "u", F.col("id") % 3), 2), prng.dna(24, "b", F.col("id") % 600)), 1, length).alias("seq"))
    lib = stored(lib, "lib")
    kinds = [errors.indel(F.col("seq"), F.concat_ws("-", "idx", F.lit(k)), 0.04 * k, *([0.03 * (k % 3), 0.03 * (k % 2)] if metric == "levenshtein" else [0, 0]), "b") for k in range(5)]
    kinds += [F.concat(F.lit("N"), F.expr("substring(seq, 2)")), F.expr("substring(seq, 2)"), F.lit(""), F.lit(None)]
    reads = stored(lib.where("idx % 3 = 0 or idx is null").select(F.explode(F.array(*kinds)).alias("seq")), "reads")
    want = {tuple(r) for r in decode.nearest(decode.brute_matches(reads, lib, threshold, metric)).collect()}
    monkeypatch.setattr(blocks, "READS", 100)
    monkeypatch.setattr(blocks, "ENTRIES", 250)
    joined = []
    monkeypatch.setattr(decode, "segment_matches", lambda r, *a, f=decode.segment_matches: joined.append(r.where("seq not like 'N%'").count()) or f(r, *a))
    out = decode.nearest_by_pieces(reads, lib, threshold, length, metric)
    assert {tuple(r) for r in out.collect()} == want and {d for _, d, _, _ in want} == set(range(threshold + 1)) and not any(joined)
    assert out.schema["idx"].dataType == lib.schema["idx"].dataType and any(n > 1 for _, _, n, _ in want)


@pytest.mark.parametrize("metric", ["bits", "hamming", "levenshtein"])
def test_all_pairs_block_by_block(spark, monkeypatch, metric):
    """Gaps, a repeated key, sequences of several lengths and several blocks and strips: every pair once, without a join of all with all."""
    monkeypatch.setattr(distances, "BLOCK", 40)
    monkeypatch.setattr(distances, "STRIP", 16)
    seq = prng.dna(40, "ap", F.col("id")) if metric == "hamming" else F.substring(prng.dna(40, "ap", F.col("id") % 90), 1, (F.col("id") % 38).cast("int"))
    value = F.xxhash64("id") if metric == "bits" else seq
    rows = stored(spark.range(120).select(F.when(F.col("id") % 50 == 3, F.col("id") - 1).otherwise(F.col("id") * 3).cast("int").alias("k"), value.alias("v")), "rows")
    far = {"bits": dna.hamming_bits, "hamming": dna.hamming, "levenshtein": F.levenshtein}[metric]
    a, b = rows.toDF("i", "a"), rows.toDF("j", "b")
    want = a.join(b, F.col("i") < F.col("j")).select("i", "j", (F.col("j") - F.col("i")).alias("diff"), far(F.col("a"), F.col("b")).alias("dist"))
    monkeypatch.setattr(distances, "small", None)
    got = distances.pairs(rows, "k", "v", metric)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert distances.pairs(rows, "k", "v", metric, by_place=False).columns == ["i", "j", "dist"]
    assert distances.pairs(rows.limit(0), "k", "v", metric).count() == distances.pairs(rows.limit(1), "k", "v", metric).count() == 0


@pytest.mark.parametrize("g_filter, max_run, n", [(True, 3, 12), (False, 2, 14), (True, 1, 5)])
def test_block_qc_from_the_axes(spark, g_filter, max_run, n):
    """As of a row for each block, for sequences with many G's and runs that go on from the column's part, gaps between places, and heads that become the same."""
    from gridloom.operators import products

    letters = ("GGGC", "AAAC", "GGGG", "CCCA", "TTTT", "ACGT")
    part = lambda name: F.left(F.concat(*(F.element_at(F.array(*map(F.lit, letters)), (prng.below(6, f"{name}{k}", F.col("id")) + 1).cast("int")) for k in range(4))), F.lit(n))
    x = stored(spark.range(60).select((F.col("id") + F.shiftright("id", 4)).cast("int").alias("pos"), F.substring(part("x"), 1, n).alias("seq")), "x")
    y = stored(spark.range(45).select((F.col("id") * 2 % 47).cast("int").alias("pos"), F.reverse(part("y")).alias("seq")), "y")
    want = layouts.block_qc(codes.block_barcodes(x, y, g_filter, max_run))
    got = products.block_qc_of_axes(x, y, g_filter, max_run)
    assert got.dtypes == want.dtypes and got.collect() == want.collect() and 0 < got.first()["n_unique"] < 60 * 45
    one = x.where("pos = 3")
    assert products.block_qc_of_axes(one, one).collect() == layouts.block_qc(codes.block_barcodes(one, one)).collect()
    assert products.block_qc_of_axes(x.withColumn("seq", F.when(F.col("pos") == 3, "A").otherwise(F.col("seq"))), y) is None


def plain_block_barcodes(x, y, g_filter, max_run):
    raw = y.select(F.col("pos").alias("block_row"), F.col("seq").alias("y")).crossJoin(x.select(F.col("pos").alias("block_col"), F.col("seq").alias("x"))).withColumn("raw", F.concat("x", "y"))
    g = dna.reduce_g(F.col("raw")) if g_filter else F.struct(F.col("raw").alias("seq"), F.lit(0).alias("swaps"))
    r = dna.break_runs(g["seq"], max_run)
    return raw.select("block_row", "block_col", "raw", r["seq"].alias("seq"), g["swaps"].alias("g_swaps"), r["subs"].alias("run_subs"))


@pytest.mark.parametrize("g_filter, max_run", [(True, 3), (False, 2), (True, 1)])
def test_block_barcodes_of_heads_and_tails(spark, tmp_path, g_filter, max_run):
    """As repaired one by one; written, a block takes a fraction of its bytes, as columns of a strip come again."""
    letters = ("GGGC", "AAAC", "GGGG", "CCCA", "TTTT", "ACGT")
    part = lambda name: F.concat(*(F.element_at(F.array(*map(F.lit, letters)), (prng.below(6, f"{name}{k}", F.col("id")) + 1).cast("int")) for k in range(3)))
    x, y = (stored(spark.range(n).select((F.col("id") * 3).cast("int").alias("pos"), part(name).alias("seq")), name) for n, name in ((70, "x"), (55, "y")))
    got, want = codes.block_barcodes(x, y, g_filter, max_run), plain_block_barcodes(x, y, g_filter, max_run)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    odd = x.withColumn("seq", F.when(F.col("pos") == 3, "ACGT").otherwise(F.col("seq")))
    assert sorted(map(tuple, codes.block_barcodes(odd, y).collect())) == sorted(map(tuple, plain_block_barcodes(odd, y, True, 3).collect()))


@pytest.mark.parametrize("product", ["codebook", "block_barcodes"])
def test_products_are_written_in_few_bytes(spark, tmp_path, product):
    """Each row once; in a file, it takes less than eight tenths of what it takes in order of rows and columns."""
    axis = stored(spark.range(4800 if product == "block_barcodes" else 1200).select(F.col("id").cast("int").alias("pos"), dna.bit_string(prng.bits(28, "axis", F.col("id")), 28).alias("bits")).withColumn("seq", dna.bits_to_dna(F.col("bits"))), "axis")
    other = axis.where("pos < 1200") if product == "codebook" else axis.where("pos % 16 = 0")
    book = layouts.codebook(axis, other, "GGG") if product == "codebook" else codes.block_barcodes(axis, other)
    book.write.parquet(f"{tmp_path}/strips")
    book.orderBy(*(("row", "col") if product == "codebook" else ("block_row", "block_col"))).write.parquet(f"{tmp_path}/plain")
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("strips", "plain")}
    assert 10 * size["strips"] < 8 * size["plain"], size
    one, two = (spark.read.parquet(f"{tmp_path}/{k}") for k in size)
    assert one.count() == two.count() == 1_440_000 and one.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first() == two.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()


def test_reads_of_many_keys_at_once(spark):
    """The channels in numpy draw as the expressions do, whatever the rates, lengths and keys; what numpy does not take is left to the expression."""
    rows = spark.range(600).select("id", F.substring(prng.dna(60, "ml", F.col("id")), 1, (F.col("id") % 41).cast("int")).alias("seq"))
    odd = spark.createDataFrame([(1, None), (None, "ACGT"), (2, ""), (3, "AÉGT"), (-4, "NNACGT"), (5, "ACGT" * 60)], "id long, seq string")
    rows = stored(rows.union(odd), "rows")
    for rates in ((0.03, 0.04, 0.14), (0.0, 0.0, 0.0), (0.9, 0.5, 0.1), (0.1, 1.0, 0.0), (0.2, 0.3, 1.0)):
        made = rows.select(errors.fixed_length(F.col("seq"), F.col("id"), *rates, "f").alias("a"), errors.fixed_length_by_place(F.col("seq"), F.col("id"), *rates, "f").alias("b"), "seq").collect()
        assert all(r.a == r.b for r in made) and len(made) == 606, [r for r in made if r.a != r.b][:3]
    for rate in (0.0, 0.05, 0.7, 1.0):
        plain = rows.where("seq is null or seq rlike '^[ACGT]*$'")
        made = plain.select(errors.substitution(F.col("seq"), F.col("id"), rate, "g").alias("a"), errors.substitution_by_place(F.col("seq"), F.col("id"), rate, "g").alias("b")).collect()
        assert all(r.a == r.b for r in made) and len(made) == 604, [r for r in made if r.a != r.b][:3]

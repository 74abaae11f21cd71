"""The jobs over growing input, repeated and interrupted runs."""

import hashlib
import json
import logging
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import lane_counts, sample_barcodes
from jobs.shared import as_it_stands, settings_of

TOP = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, plate string"
FIRST = [(1, "one", "en", "p1", "x"), (2, "two", "en", "p1", "x"), (3, "one", "en", "p2", "x"), (4, None, "en", None, "x"), (5, "", "en", "", "x"), (None, "lost", "en", "p1", "x"), (6, "six " * 50_000, "en", "a/b=c", "x"), (7, "two", "en", "p1", "x"), (7, "two", "en", "p1", "x")]
SECOND = [(0, "one", "en", "p3", "x"), (8, "new", "en", "p1", "x"), (9, "new", "en", "p1", "x"), (2, "two", "en", "p1", "x"), (3, "changed later", "en", "p9", "x")]


def sheet(spark, path):
    return sorted((tuple(r) for r in as_it_stands(spark, path, sample_barcodes.SCHEMA).collect()), key=lambda r: r[0])


def written(spark, rows, path, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("docs", "sheet", "checkpoint")]


def test_growing_sheet(spark, places, caplog):
    caplog.set_level(logging.INFO)
    docs, out, _ = places
    written(spark, FIRST, docs)
    sample_barcodes.run(spark, *places)
    first = sheet(spark, out)
    assert [(r[0], r[2], r[3], r[9], r[10]) for r in first] == [
        (1, 1, False, 0, "p1"), (2, 2, False, 0, "p1"), (3, 1, True, 0, "p2"), (4, 4, False, 0, "none"), (5, 4, True, 0, "none"), (6, 6, False, 0, "a/b=c"), (7, 2, True, 0, "p1"),
    ]
    sample_barcodes.run(spark, *places)
    assert sheet(spark, out) == first
    written(spark, SECOND, docs)
    sample_barcodes.run(spark, *places)
    both = sheet(spark, out)
    assert [r for r in both if r[9] == 0] == first
    assert [(r[0], r[2], r[3], r[10]) for r in both if r[9] == 1] == [(0, 1, True, "p3"), (8, 8, False, "p1"), (9, 8, True, "p1")]
    for r in both:
        assert r[1] == hashlib.md5({x[0]: x[1] or "" for x in [*SECOND, *FIRST]}[r[0]].encode()).hexdigest()
        assert len(r[4]) == 28 and not re.search(r"(.)\1{3}", r[4]) and r[4].count("G") <= 7 and (r[5] == -1 or 0.4 <= r[6] <= 0.6)
    assert len({r[4] for r in both}) == len({r[1] for r in both})
    said = [r.message for r in caplog.records if r.name == "jobs.sample_barcodes"]
    assert any(m.startswith("batch 0: read 9 rows (1 without an id), wrote 7 samples") for m in said) and any(m.startswith("batch 1: read 5 rows (0 without an id), wrote 3 samples") for m in said)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_a_batch_that_is_repeated_changes_nothing(spark, places):
    """A run that ended before its last batch was marked as done takes that batch again, the same rows to the same place."""
    docs, out, checkpoint = places
    written(spark, FIRST, docs)
    sample_barcodes.run(spark, *places)
    written(spark, SECOND, docs)
    sample_barcodes.run(spark, *places)
    before = sheet(spark, out)
    for name in ("1", ".1.crc"):
        (Path(checkpoint) / "commits" / name).unlink(missing_ok=True)
    sample_barcodes.run(spark, *places)
    assert sheet(spark, out) == before


def test_file_by_file_gives_the_same_barcodes(spark, places, tmp_path):
    docs, out, checkpoint = places
    for k in range(3):
        written(spark, [(10 * k + i, f"text {i * (k + 1)}", "en", "p", "x") for i in range(10)], docs)
    sample_barcodes.run(spark, *places, sample_barcodes.Settings(files_per_batch=1))
    sample_barcodes.run(spark, docs, str(tmp_path / "other"), str(tmp_path / "mark"))
    one, all_ = sheet(spark, out), sheet(spark, str(tmp_path / "other"))
    assert [(r[0], r[1], r[4:9]) for r in one] == [(r[0], r[1], r[4:9]) for r in all_] and {r[9] for r in one} == {0, 1, 2}


def test_repaired_barcodes(spark, places):
    """Rules that no attempt can pass: the first one is repaired."""
    docs, out, _ = places
    written(spark, [(i, f"t{i}", "en", "p", "x") for i in range(20)], docs)
    sample_barcodes.run(spark, *places, sample_barcodes.Settings(gc=(1.1, 1.2)))
    assert all(r[5] == -1 and r[8] <= 3 for r in sheet(spark, out))


def test_empty_table(spark, places):
    docs, out, _ = places
    written(spark, [], docs)
    sample_barcodes.run(spark, *places)
    assert sheet(spark, out) == []


def tables(spark, top, orders):
    spark.range(300).selectExpr("id as p_partkey", "'x' as row").write.parquet(f"{top}/part")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, col string").write.parquet(f"{top}/orders")
    return f"{top}/part", f"{top}/orders"


def counts(spark, out):
    spots = sorted((tuple(r) for r in as_it_stands(spark, f"{out}/spots", lane_counts.SPOTS).collect()), key=lambda r: (r[0] is None, r[0], r[1], r[7]) if r[0] is not None else (True, r[7]))
    return spots, sorted((tuple(r) for r in as_it_stands(spark, f"{out}/lanes", lane_counts.LANES).collect()), key=lambda r: r[-1])


def test_lanes(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    orders = [(k, "AB"[k % 2], "x") for k in range(400)] + [(None, "A", "x"), (5000, None, "x"), (6000, "", "x"), (7, "B", "x")]
    part, reads = tables(spark, tmp_path, orders)
    out = str(tmp_path / "out")
    lane_counts.run(spark, part, reads, out)
    spots, lanes = counts(spark, out)
    assert [(r[-1], r[0]) for r in lanes] == [("A", 200), ("B", 201)]
    assert all(sum(s[2] for s in spots if s[7] == r[-1] and s[0] is not None) == r[4] and sum(s[4] for s in spots if s[7] == r[-1]) == r[1] for r in lanes)
    assert [sum(s[2] for s in spots if s[7] == r[-1] and s[0] is None) for r in lanes] == [r[3] for r in lanes]
    assert all(s[6] == s[0] // 4 and s[3] <= s[2] for s in spots if s[0] is not None) and any("read 401 reads" in r.message for r in caplog.records)
    lane_counts.run(spark, part, reads, out)
    assert counts(spark, out) == (spots, lanes)
    # Lane A has grown since: asked for alone, it replaces its own partitions.
    more = str(tmp_path / "more")
    spark.createDataFrame([(k, "AB"[k % 2], "x") for k in range(600)], "o_orderkey long, o_orderstatus string, col string").write.parquet(more)
    lane_counts.run(spark, part, more, out, lanes="A")
    again = counts(spark, out)
    assert [(r[-1], r[0]) for r in again[1]] == [("A", 300), ("B", 201)] and [s for s in again[0] if s[7] == "B"] == [s for s in spots if s[7] == "B"]
    with pytest.raises(ValueError, match="no reads of lanes"):
        lane_counts.run(spark, part, more, out, lanes="A,Z")
    assert counts(spark, out) == again
    # With fewer reads, spots without any go.
    few = str(tmp_path / "few")
    spark.createDataFrame([(2, "A", "x")], "o_orderkey long, o_orderstatus string, col string").write.parquet(few)
    lane_counts.run(spark, part, few, out)
    assert sum(s[2] for s in counts(spark, out)[0] if s[7] == "A") == 1 and counts(spark, out)[1][1] == again[1][1]


def test_given_sequences(spark, tmp_path):
    spark.createDataFrame([(0, "ACGT" * 7), (60, "TTGCA" * 5 + "AAA")], "p_partkey long, seq string").write.parquet(f"{tmp_path}/part")
    spark.createDataFrame([(1, "L", "ACGT" * 7), (2, "L", "CCGT" + "ACGT" * 6), (3, "L", "TTGCA" * 5 + "AAA"), (4, "L", "G" * 28), (5, "L", None)], "o_orderkey long, o_orderstatus string, seq string").write.parquet(f"{tmp_path}/orders")
    lane_counts.run(spark, f"{tmp_path}/part", f"{tmp_path}/orders", f"{tmp_path}/out")
    spots, lanes = counts(spark, f"{tmp_path}/out")
    assert spots == [(0, 0, 2, 1, 0, 0.5, 0, "L"), (1, 10, 1, 1, 0, 0.0, 0, "L"), (None, None, 2, 0, 0, None, None, "L")] and lanes[0][:5] == (5, 0, 3, 2, 3)


def test_repeated_keys_are_an_error(spark, tmp_path):
    spark.createDataFrame([(0,), (0,)], "p_partkey long").write.parquet(f"{tmp_path}/part")
    with pytest.raises(ValueError, match="1 repeated keys"):
        lane_counts.run(spark, f"{tmp_path}/part", f"{tmp_path}/part", f"{tmp_path}/out")


def test_settings(tmp_path):
    for name, module in (("sample_barcodes", sample_barcodes), ("lane_counts", lane_counts)):
        given = settings_of(module.Settings, str(TOP / "jobs" / f"{name}.json"))
        assert {k: list(v) if isinstance(v, tuple) else v for k, v in vars(given).items()} == {k: list(v) if isinstance(v, tuple) else v for k, v in vars(module.Settings()).items()}
    (tmp_path / "bad.json").write_text(json.dumps({"lenght": 3}))
    with pytest.raises(ValueError, match="lenght"):
        settings_of(lane_counts.Settings, str(tmp_path / "bad.json"))


def test_command(spark, tmp_path):
    part, reads = tables(spark, tmp_path, [(k, "A", "x") for k in range(20)])
    done = subprocess.run(
        [sys.executable, "-m", "jobs.lane_counts", "--library", part, "--reads", reads, "--output", f"{tmp_path}/out", "--config", str(TOP / "jobs/lane_counts.json"), "--lanes", "A"],
        cwd=TOP, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=240,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert "read 20 reads" in done.stderr and counts(spark, f"{tmp_path}/out")[1][0][0] == 20

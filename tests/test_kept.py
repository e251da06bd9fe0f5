"""Models kept from streams against a plain walk over the same rows."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termfield.streaming import kept

SCHEMA = "t string, c string, ts timestamp, n double"
START = datetime(2024, 3, 1)


def files(seed, many=7):
    """Files of rows whose times move on by half a day a file, a few far behind; one target has a third of all rows."""
    rng, out = random.Random(seed), []
    for k in range(many):
        rows = []
        for _ in range(60):
            behind = rng.choice([0, 0, 0, 1, 5, 60, 90])
            at = START + timedelta(hours=12 * k + rng.randrange(12)) - timedelta(hours=behind)
            rows.append((rng.choice(["hot", *"abcd"] + ["hot"] * 2), rng.choice("wxyz"), at, float(rng.randrange(1, 4))))
        rows += [(None, "x", START, 1.0), ("a", None, START, 1.0), ("a", "x", None, 1.0), rows[0], rows[0]]
        out.append(rows)
    return out


def walk(all_files, late, keep):
    """{cell: f} and the rows left out; a slot is a day, and what a file's newest time passes by holds from the next file on."""
    mark, slots, dropped = datetime.min, {}, 0
    for rows in all_files:
        for t, c, at, n in rows:
            if None in (t, c, at):
                continue
            day = (at - datetime(1970, 1, 1)).days
            if datetime(1970, 1, 1) + timedelta(days=day + 1) <= mark:
                dropped += 1
                continue
            slots.setdefault(day, {}).setdefault((t, c), []).append(n)
        mark = max(mark, max(at for _, _, at, _ in rows if at) - late)
    live = [d for d in slots if keep is None or d > max(slots) - keep]
    out = {}
    for d in live:
        for cell, ns in slots[d].items():
            out[cell] = out.get(cell, 0) + sum(ns)
    return out, dropped


def feed(spark, tmp_path, rows, number, keep, every):
    source = tmp_path / "in"
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    table.write.mode("append").parquet(str(source))
    run(spark, tmp_path, keep, every)


def run(spark, tmp_path, keep, every):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    counts = kept.kept_counts(stream, "t", "c", "ts", "1 day", "12 hours", "n")
    kept.keep_model(counts, str(tmp_path / "table"), str(tmp_path / "progress"), keep, every).awaitTermination()


def check(spark, tmp_path, want, keep):
    m = kept.kept_model(spark, str(tmp_path / "table"), keep).check()
    assert {(r.target, r.feature): r.f for r in m.cells.collect()} == want
    for side, at in ((m.rows, 0), (m.cols, 1)):
        sums = {}
        for cell, f in want.items():
            sums[cell[at]] = sums.get(cell[at], 0) + f
        assert {r.term: r.f for r in side.collect()} == sums
        assert {r.term: r.nnzero for r in side.collect()} == {x: sum(cell[at] == x for cell in want) for x in sums}
    assert m.N == sum(want.values())


@pytest.mark.parametrize("keep,every", [(None, 100), (2, 2)])
def test_late_rows_restarts_expiry_and_compaction(spark, tmp_path, keep, every):
    given = files(5)
    for k, rows in enumerate(given):
        feed(spark, tmp_path, rows, k, keep, every)  # each file is a start from the checkpoint
        if k in (1, 4):
            want, dropped = walk(given[: k + 1], timedelta(hours=12), keep)
            check(spark, tmp_path, want, keep)
    assert dropped > 0
    folders = {p.name for p in (tmp_path / "table").iterdir()}
    if every == 2:
        # Two compacted tables at most, and no batch before the older one.
        bases = sorted(int(p.partition("=")[2]) for p in folders if p.startswith("base"))
        assert 1 <= len(bases) <= 2 and all(int(p.partition("=")[2]) > bases[0] for p in folders if p.startswith("batch"))
        base = spark.read.parquet(str(tmp_path / "table" / f"base={bases[-1]:012d}"))
        assert base.select("slot").distinct().count() <= keep
    else:
        assert not any(p.startswith("base") for p in folders)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    given = files(8, 3)
    for every in (100, 2):
        where = tmp_path / str(every)
        for k, rows in enumerate(given):
            feed(spark, where, rows, k, 3, every)
        want, _ = walk(given, timedelta(hours=12), 3)
        # The last batches look as if the driver had gone before it noted their end; one with its table half written.
        commits = sorted((where / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        Path(f"{commits[-1].parent}/.{commits[-1].name}.crc").unlink(missing_ok=True)
        commits[-1].unlink()
        torn = where / "table" / f"batch={int(commits[-1].name):012d}" / "_SUCCESS"
        torn.unlink(missing_ok=True)
        run(spark, where, 3, every)
        check(spark, where, want, 3)


def test_a_table_half_written_is_not_read(spark, tmp_path):
    given = files(9, 3)
    for k, rows in enumerate(given):
        feed(spark, tmp_path, rows, k, None, 100)
    want, _ = walk(given, timedelta(hours=12), None)
    torn = tmp_path / "table" / f"base={10**6:012d}"
    torn.mkdir()
    check(spark, tmp_path, want, None)
    kept.compact(spark, str(tmp_path / "table"))
    check(spark, tmp_path, want, None)


def test_nothing_there(spark, tmp_path):
    m = kept.kept_model(spark, str(tmp_path / "none"), 3)
    assert m.N == 0 and m.cells.count() == m.rows.count() == 0
    feed(spark, tmp_path, [(None, None, None, None)], 0, 3, 1)
    m = kept.kept_model(spark, str(tmp_path / "table"), 3)
    assert m.N == 0 and m.cells.count() == 0


def test_counts_are_summed_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    plan = kept.kept_counts(batch, "t", "c", "ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert kept.kept_counts(batch.withColumn("f", F.lit(2)), "t", "c", "ts").columns == ["kind", "target", "feature", "slot", "f"]

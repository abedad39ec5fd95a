"""Records put together over the borders of splits, whatever the splits are."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from logloom.plans.ingest import validate_file
from logloom.sources import ranges
from logloom.sources.delimited import read_delimited
from logloom.sources.event_text import parse_event_text, read_event_text
from logloom.streaming import live


@pytest.fixture(params=[150, 1 << 20])
def split(request, spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, old)


def cell(rng):
    return rng.choice(["", "plain", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", '",\n"', 'x"y', "long " * 12, 'ends "', "5\" disk"])


def test_quoted_line_breaks_across_splits(spark, split, tmp_path):
    rng = random.Random(split)
    for name in ("one", "two"):
        rows = [[f"{name}{k}", cell(rng), cell(rng), "end"] for k in range(30)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "first", "second", "last"], *rows])
        text = out.getvalue().replace(f"{name}20,", f"\n\n{name}30,")  # blank lines between records
        (tmp_path / f"{name}.csv").write_text(text)
    want = []
    for name in ("one", "two"):
        want += [r for r in csv.reader(io.StringIO((tmp_path / f"{name}.csv").read_text())) if r][1:]
    got = read_delimited(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 61))
    assert [[c or "" for c in (r.id, r["first"], r.second, r.last)] for r in got] == want


def test_stray_quotes_do_not_swallow_rows(spark, split, tmp_path):
    lines = ["name,size,note"] + [f'disk{k},5" wide,"all, right"' if k % 3 else f"disk{k},7,plain" for k in range(40)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = read_delimited(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [r.name for r in got] == [f"disk{k}" for k in range(40)]
    assert {r["size"] for r in got} == {'5" wide', "7"} and {r.note for r in got} == {"all, right", "plain"}


def test_an_open_quote_at_the_end_is_one_row(spark, split, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,x\n2,"never closed\nmore\n' + "and more\n" * 20)
    got = read_delimited(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [r.a for r in got] == ["1", "2"] and got[1].b.startswith("never closed\nmore\nand more")


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_open_cells_as_the_csv_module_sees_them(sep):
    after, rng = ranges.ends_open(sep), random.Random(3)
    for _ in range(4000):
        line = "".join(rng.choice(f'""{sep}{sep}ab ') for _ in range(rng.randrange(1, 9)))
        for opened in (False, True):
            text = ('"' if opened else "") + line + f"\nEND{sep}x"
            assert after(line, opened) == (len(list(csv.reader(io.StringIO(text), delimiter=sep))) == 1)


def dump(n, rng):
    parts = ["Some words before the first block\n"]
    for k in range(n):
        body = "\n".join(rng.choice(["one line", "", "Event[3] not at the beginning", "word " * 30]) for _ in range(rng.randrange(4)))
        parts.append(f"{rng.choice(['', ' ', chr(9)])}Event[{k}]\n  Source: S{k}\n  Level: Error\n  Event ID: {k}\n  Description: \nNumber {k} {body}\n\n".replace("\nEvent[3]", "\nx Event[3]"))
    return "".join(parts)


def test_event_blocks_across_splits(spark, split, tmp_path):
    rng = random.Random(5)
    texts = {name: dump(12, rng) for name in ("a", "b")}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "c.txt").write_text("no block here\nat all\n" * 10)
    records = read_event_text(spark, str(tmp_path))
    now = F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")
    got = parse_event_text(records, now).orderBy("row_no").collect()
    whole = spark.createDataFrame([(texts["a"],), (texts["b"],), ((tmp_path / "c.txt").read_text(),)], "text string")
    want = parse_event_text(whole, now).collect()
    fields = ("source", "endpoint", "message", "severity")
    assert sorted(tuple(r[f] for f in fields) for r in got) == sorted(tuple(r[f] for f in fields) for r in want)
    named = [r.source for r in got if r.source.startswith("S")]
    assert named == [f"S{k}" for k in range(12)] * 2 and len({r.row_no for r in got}) == len(got) == 27


def test_no_dump(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n \n")
    assert read_event_text(spark, str(tmp_path)).count() == 0
    assert validate_file(spark, str(tmp_path)).errors.count() == 1


def test_captured_text_keeps_its_ids_when_taken_again(spark, tmp_path):
    now = F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")
    (tmp_path / "in").mkdir()
    table, marks = str(tmp_path / "logs"), str(tmp_path / "marks")
    seen = []

    def twice(batch, number):
        for _ in range(2):  # a batch that is taken again
            live.capture_sink(table, captured_at=now)(batch, number)
            seen.append(sorted((r.id, r.message) for r in spark.read.parquet(table).filter(F.col("batch") == number).collect()))

    rng = random.Random(8)
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.txt").write_text(dump(5, rng))
        live.start(live.read_capture(spark, str(tmp_path / "in")), twice, marks).awaitTermination()
    assert len(seen) == 4 and seen[0] == seen[1] and seen[2] == seen[3]
    stored = spark.read.parquet(table)
    assert stored.count() == 12 and stored.select("id").distinct().count() == 12
    assert {i >> 32 for i, _ in seen[2]} == {1} and "anomaly_score" in stored.columns


def test_trailing_counts_with_state_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), 1_700_000_000 + rng.randrange(0, 3000) * 1.0) for k in range(500)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 400))  # out of order by less than the delay
    rows.append((900, "a", 1_700_010_000.0))
    table = spark.createDataFrame([(i, s, t) for i, s, t in rows], "id long, source string, t double")
    table = table.withColumn("timestamp", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    path, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for part in (rows[:200], rows[200:350], rows[350:]):  # each run begins where the one before ended
        table.filter(F.col("id").isin([r[0] for r in part])).coalesce(1).write.mode("append").parquet(path)
        counts = live.trailing_state(live.read_logs(spark, path, table.schema))
        query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.id: r.n_5m for r in spark.read.parquet(out).collect()}
    want = {i: sum(s == s2 and (t - 300 <= t2 < t or t2 == t and j <= i) for j, s2, t2 in rows) for i, s, t in rows if i != 900}
    assert got == want
    late = table.filter("id < 20").withColumn("id", F.col("id") + 1000)
    late.write.mode("append").parquet(path)
    query = live.trailing_state(live.read_logs(spark, path, table.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: r.n_5m for r in spark.read.parquet(out).collect()} == want


def test_small_splits_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Every task writes a file, which later steps open one by one."""
    blocks = [f"Event[{k}]\n  Source: s{k}\n  Description: \n{'word ' * (k % 40)}end {k}\n" for k in range(400)]
    (tmp_path / "dump.txt").write_text("".join(blocks))
    files, write = [], ranges.staged
    monkeypatch.setattr(ranges, "staged", lambda df: files.append(write(df)) or files[-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = read_event_text(spark, str(tmp_path / "dump.txt")).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(files[0].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert [r.text.rstrip("\n") for r in got] == [b.rstrip("\n") for b in blocks]


def test_descriptions_without_text(spark):
    texts = ["Event[0]\n  Description:", "Event[0]\n  Description: \n ", "Event[0]\n Level: x", "Event[0]\nDescription: a \n\tb  Description: c"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = parse_event_text(rows, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).orderBy("k").collect()
    told = "Windows Event Log Entry"
    assert [r.message for r in got] == [told, "Windows Application Event 100 from Windows-Application", told, "a b Description: c"]


def test_columns_without_use_are_not_stored(spark, tmp_path, monkeypatch):
    """Validation reads a few columns of a wide file; the others are left in the file."""
    from logloom.sources import delimited

    wide = [f"extra_{k}" for k in range(50)]
    head = ",".join([*wide, "timestamp", "source", "event_type", "severity", "message"])
    row = ",".join(["x"] * 50 + ["2024-01-01 00:00:00", "api", "GET", "INFO"])
    (tmp_path / "a.csv").write_text(f"{head}\n" + "".join(f"{row},m{k}\n" for k in range(5)))
    stored, write = [], delimited.staged
    monkeypatch.setattr(delimited, "staged", lambda df: stored.append(df.columns) or write(df))
    got = validate_file(spark, str(tmp_path / "a.csv")).valid.orderBy("row_no").collect()
    assert [(r.row_no, r.message) for r in got] == [(k + 1, f"m{k}") for k in range(5)]
    assert not [c for c in stored[0] if c.startswith("extra")]
    assert "extra_7" in read_delimited(spark, str(tmp_path / "a.csv")).columns

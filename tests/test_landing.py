"""Reading delivered files: quoting, short and long records, splits, missing pieces."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from meterline.config import default_config, load_config
from meterline.functions import joins
from meterline.operators import filechecks as fc
from meterline.sources import landing
from meterline.streaming import feeds


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_records_and_profiles(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,name,note\n1, x ,"a,""b"""\n\n2,y\n   \n3,z,q,extra\n4,"",last\n')
    put(tmp_path, "b.csv", "note,id,name\nn1,9,nine\n")
    rows, profiles = landing.read_feed(spark, str(tmp_path))
    got = {
        (r.file_name, r.row_index): (r.id, r.name, r.note, r.n_fields)
        for r in landing.feed_columns(rows, ["id", "name", "note", "absent"]).collect()
    }
    assert got == {
        ("a.csv", 0): ("1", "x", 'a,"b"', 3), ("a.csv", 1): ("2", "y", "", 2), ("a.csv", 2): ("3", "z", "q", 4), ("a.csv", 3): ("4", "", "last", 3),
        ("b.csv", 0): ("9", "nine", "n1", 3),
    }
    assert {r.file_name: r.lines for r in profiles.collect()} == {"a.csv": 5, "b.csv": 2}
    assert [tuple(r) for r in landing.structural_errors(rows).collect()] == [("a.csv", "record 4 holds 4 fields, the header 3")]


def test_blank_extra_field_is_a_long_record(spark, tmp_path):
    put(tmp_path, "a.csv", 'a,b\n1,2,\n3,"x,y"\n')
    rows, _ = landing.read_feed(spark, str(tmp_path))
    assert [r.n_fields for r in rows.orderBy("row_index").collect()] == [3, 2]


def plain_csv(text):
    """Records and fields by a character scan: a quote toggles, line ends count outside quotes."""
    records, record, inside, at = [], "", False, 0
    while at < len(text):
        ch = text[at]
        if ch == '"':
            inside = not inside
        if ch in "\r\n" and not inside:
            at += ch == "\r" and text[at + 1 : at + 2] == "\n"
            records.append(record)
            record = ""
        else:
            record += ch
        at += 1
    records.append(record)
    out = []
    for record in records:
        if not record.strip():
            continue
        fields, field, inside, at = [], "", False, 0
        while at < len(record):
            ch = record[at]
            if ch == '"' and inside and record[at + 1 : at + 2] == '"':
                field += ch
                at += 1
            elif ch == '"':
                inside = not inside
            elif ch == "," and not inside:
                fields.append(field.strip())
                field = ""
            else:
                field += ch
            at += 1
        out.append([*fields, field.strip()])
    return out


def read_back(spark, folder):
    rows, profiles = landing.read_feed(spark, str(folder))
    got = {}
    for r in rows.collect():
        got.setdefault(r.file_name, {})[r.row_index] = (list(r.fields), r.n_fields)
    return got, {r.file_name: (list(r.header), r.lines) for r in profiles.collect()}


def check_files(spark, folder):
    got, profiles = read_back(spark, folder)
    for path in folder.iterdir():
        with open(path, encoding="utf-8", newline="") as f:
            wanted = plain_csv(f.read())
        if not wanted:
            assert path.name not in profiles
            continue
        assert profiles[path.name] == (wanted[0], len(wanted))
        assert got.get(path.name, {}) == {i: (fields, len(fields)) for i, fields in enumerate(wanted[1:])}


def put_bytes(folder, name, text):
    (folder / name).write_bytes(text.encode())


def test_quoted_newlines(spark, tmp_path):
    put_bytes(tmp_path, "a.csv", 'id,note\n1,"two\nlines"\n2,plain\n\n3,"a, b"\n4,"x\n\n ""y"" \n"\n')
    put_bytes(tmp_path, "crlf.csv", 'id,note\r\n1,"two\r\nlines"\r\n2,b\r\n')
    put_bytes(tmp_path, "cr.csv", 'id,note\r1,"two\rlines"\r2,b\r')
    put_bytes(tmp_path, "head.csv", '"id\nof it",note\n1,x\n')
    put_bytes(tmp_path, "open.csv", 'id,note\n1,x\n2,"never closed\n3,y\n')
    put_bytes(tmp_path, "odd.csv", 'id,note\n1,5" pipe\n2,6" pipe\n3,a"b,c"d\n')
    put_bytes(tmp_path, "blank.csv", "id,note\n" + "\n" * 150 + "1,x\n\n \t\n2,y")
    put_bytes(tmp_path, "empty.csv", "")
    check_files(spark, tmp_path)


def test_quoted_newlines_across_splits(spark, tmp_path):
    """Records that span lines, in files of many splits; some records are longer than a split."""
    rng = random.Random(3)
    for name, share in (("few.csv", 0.01), ("many.csv", 0.5), ("none.csv", 0.0)):
        rows = ["id,note,more"]
        for i in range(4_000):
            note = "\n".join(rng.choice(['a ""b""', "x,y", "", "plain words"]) for _ in range(rng.randint(2, 6))) if rng.random() < share else "one"
            rows.append(f'{i},"{note}",z' if share else f"{i},{note},z")
            if rng.random() < 0.01:
                rows.append("")
        if share:
            rows[2_000] = '1999,"' + "long line\n" * 5_000 + '",z'
        put_bytes(tmp_path, name, "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        check_files(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_without_quoted_newlines_are_not_shuffled(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,note\n1,"a, ""b"""\n\n2,c\n')
    rows, _ = landing.read_feed(spark, str(tmp_path))
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_row_numbers_across_splits(spark, tmp_path):
    n = 20_000
    put(tmp_path, "big.csv", "id,x\n" + "".join(f"{i},v\n" for i in range(n)))
    put(tmp_path, "small.csv", "id,x\n5,v\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, profiles = landing.read_feed(spark, str(tmp_path))
        big = landing.feed_columns(rows, ["id"]).filter("file_name = 'big.csv'")
        assert big.filter(~F.col("id").try_cast("long").eqNullSafe(F.col("row_index"))).count() == 0
        assert big.count() == n
        assert {r.file_name: r.lines for r in profiles.collect()} == {"big.csv": n + 1, "small.csv": 2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_listing_checksums_and_sidecars(spark, tmp_path):
    put(tmp_path, "a.csv", "x\n1\n")
    put(tmp_path, "a.csv.manifest.json", json.dumps({"expected_rows": 1, "checksum_sha256": "ab"}, indent=1))
    put(tmp_path, "b.csv", "x\n")
    put(tmp_path, "b.csv.manifest.json", "{not json")
    put(tmp_path, "c.txt", "no")
    put(tmp_path, "a file+100%.csv", "")
    put(tmp_path, "a file+é 50%.csv", "x\n")
    names = [r.file_name for r in landing.list_zone(spark, str(tmp_path)).collect()]
    assert sorted(names) == ["a file+100%.csv", "a file+é 50%.csv", "a.csv", "a.csv.manifest.json", "b.csv", "b.csv.manifest.json"]
    sums = {r.file_name: r.computed_checksum for r in landing.checksums(spark, str(tmp_path)).collect()}
    assert sums["a.csv"] == hashlib.sha256(b"x\n1\n").hexdigest()
    cards = {r.feed_file: (r.expected_rows, r.checksum_sha256) for r in landing.read_sidecars(spark, str(tmp_path)).collect()}
    assert cards == {"a.csv": (1.0, "ab"), "b.csv": (None, None)}


def test_missing_zone_is_empty(spark, tmp_path):
    gone = str(tmp_path / "nothing")
    assert landing.list_zone(spark, gone).count() == 0
    assert landing.read_sidecars(spark, gone).count() == 0


def test_deadline_is_strict_and_newest_file_wins(spark):
    config = default_config()
    days = spark.createDataFrame([("B-20260101-01", "2026-01-01")], "batch_id string, business_date string")
    files = spark.createDataFrame(
        [("energy_consumption_2026-01-01.csv", "2026-01-01 10:00:00"), ("energy_consumption_2026-01-01.csv", "2026-01-01 10:30:00"),
         ("site_master_2026-01-01.csv", "2026-01-01 08:15:01")],
        "file_name string, at string",
    ).select("file_name", F.col("at").cast("timestamp").alias("received_at"))
    matched = fc.match_files(fc.expected_feeds(days, config), files)
    got = {r.dataset: (r.status, r.actual_value) for r in fc.sla_checks(matched).collect()}
    assert got == {"energy_consumption": ("PASS", "on time"), "site_master": ("FAIL", "late arrival")}


def test_prior_handling_counts_as_arrival(spark):
    config = default_config()
    days = spark.createDataFrame([("B-20260101-02", "2026-01-01")], "batch_id string, business_date string")
    none = spark.createDataFrame([], "file_name string, received_at timestamp")
    log = spark.createDataFrame(
        [("energy_consumption", "B-20260101-01", "PROCESSED", "2026-01-01 06:30:00"), ("carbon_emissions", "B-20260101-01", "RECEIVED", "2026-01-01 06:40:00")],
        "dataset string, batch_id string, file_status string, at string",
    ).withColumn("expected_arrival_at", F.col("at").cast("timestamp")).withColumn("created_at", F.col("at").cast("timestamp"))
    rows = fc.arrival_checks(fc.match_files(fc.expected_feeds(days, config), none), log).collect()
    got = {r.dataset: r.actual_value for r in rows}
    assert got["energy_consumption"] == "handled before: PROCESSED by batch B-20260101-01"
    assert got["carbon_emissions"] == got["site_master"] == "not received"


def test_config_documents_overlay_defaults(tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"datasets": {"m": {"required_columns": ["a"], "mandatory_not_null": ["a"]}}, "checks": {"c": {"severity": "LOW"}}}))
    (tmp_path / "manifest.json").write_text(json.dumps({"datasets": {"m": {"sla_hours": 1}}}))
    (tmp_path / "settings.json").write_text(json.dumps({"reporting": {"rejected_record_threshold_pct": 9}, "incidents": {"severity_mapping": {"SLA_BREACH": "P4"}}}))
    config = load_config(*(str(tmp_path / f"{n}.json") for n in ("rules", "manifest", "settings")))
    assert config.manifest["m"].pattern == "m_{date}.csv" and config.manifest["m"].expected_arrival == "06:30"
    assert config.feeds["m"].primary_key == ["record_id"] and config.checks["c"].category == "OPERATIONS"
    assert config.settings.rejected_threshold_pct == 9 and config.settings.aggregate_tolerance == 0.01
    assert config.severity["SLA_BREACH"] == "P4" and config.severity["LOAD_FAILURE"] == "P1"


def test_long_quoted_field_and_quoted_header(spark, tmp_path):
    text = "x" * 50_000
    (tmp_path / "a.csv").write_text(f'"id","last, first",note\n1,"Doe, Jane","{text}"\n2,"a ""b"" c",n\n')
    rows, profiles = landing.read_feed(spark, str(tmp_path))
    found = {row.row_index: row for row in landing.feed_columns(rows, ["id", "last, first", "note"]).collect()}
    assert profiles.first().header == ["id", "last, first", "note"]
    assert found[0]["last, first"] == "Doe, Jane" and found[0].note == text and found[1]["last, first"] == 'a "b" c'
    assert all(row.n_fields == 3 for row in found.values())


def test_split_size_may_change_between_call_and_action(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},{i % 7}\n" for i in range(100_000)))
    rows, _ = landing.read_feed(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        numbers = rows.agg({"row_index": "max", "*": "count"}).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(numbers) == [99_999, 100_000]


def test_checksums_of_files_of_any_size(spark, tmp_path):
    """A sparse file of 3 GB, beyond what one value can hold, in little memory; short files as before."""
    (tmp_path / "short.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "middle.csv").write_bytes(b"x" * 100_000)
    (tmp_path / "none.csv").write_bytes(b"")
    size = 3 * 1024**3
    with open(tmp_path / "long.csv", "wb") as f:
        f.truncate(size)
    state, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 * 1024):
        state.update(piece)
    wanted = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("short.csv", "middle.csv", "none.csv")}
    got = {r.file_name: (r.computed_checksum, r.size_bytes) for r in landing.checksums(spark, str(tmp_path), whole=50_000).collect()}
    assert {n: c for n, (c, _) in got.items()} == {**wanted, "long.csv": state.hexdigest()}
    assert got["long.csv"][1] == size


def test_streamed_digests_hold_one_piece(tmp_path):
    with open(tmp_path / "long.csv", "wb") as f:
        f.truncate(400 << 20)
    import resource

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [f"file://{tmp_path}/long.csv"]})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(list(landing.streamed_digests(iter([batch])))) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_few_lines_give_the_same_rows(spark, tmp_path):
    put_bytes(tmp_path, "a.csv", 'id,note\n1,"two\nlines"\n2,plain\n\n3,"a, b"\n4,"x\n\n ""y"" \n"\n')
    put_bytes(tmp_path, "cr.csv", '﻿id,note\r1,"two\rlines"\r2,b\r')
    put_bytes(tmp_path, "crlf.csv", '"id\r\nof it",note\r\n1,"two\r\nlines"\r\n2,b\r\n')
    put_bytes(tmp_path, "open.csv", 'id,note\n1,x\n2,"never closed\n3,y\n')
    put_bytes(tmp_path, "blank.csv", "\n \nid,note\n" + "\n" * 150 + "1,x\n\n \t\n2,y,z\n")
    put_bytes(tmp_path, "head.csv", "id,note\n")
    put_bytes(tmp_path, "long.csv", "id,note\n" + "".join(f'{i},"{"a" * (i % 90)}{chr(10) * (i % 3)}"\n' for i in range(2_000)))
    (tmp_path / "more").mkdir()
    put_bytes(tmp_path / "more", "a.csv", "note,id\nz,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = landing.text_lines(spark.read, str(tmp_path))
        assert landing.are_few(lines)
        few, wanted = landing.index_few(lines), landing.index_records(lines)[0]
        assert few.columns == wanted.columns
        got = sorted(tuple(r) for r in few.collect())
        assert got == sorted(tuple(r) for r in wanted.collect()) and len(got) > 2_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_micro_batches_write_nothing_in_between(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for n in range(3):
        put(tmp_path / "in", f"f{n}.csv", 'record_id,site_id,reading_date,energy_kwh\nR1,S1,2026-01-01,1\nR1,S1,2026-01-01,2\n,S1,2026-01-01,3\n,"S\n1",2026-01-01,4\nR2,S1,x,5\n')

    def staged(out, files):
        rules = default_config().feeds["energy_consumption"]
        columns = ["record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e"]
        feeds.landing_stream(spark, str(tmp_path / "in"), [rules], F.lit(rules.name), str(tmp_path / out), str(tmp_path / f"{out}-state"), columns, files_per_batch=files).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / out)).collect()
        assert {r.batch_id for r in rows} == {f"M-{n:08d}" for n in range(-(-3 // files))}
        return sorted((r.source_file_name, r.row_index, r.record_id, r.site_id, r.validation_status, r.rejection_reason) for r in rows)

    monkeypatch.setattr(landing, "FEW_LINES", 0)
    wanted = staged("many", 3)
    assert len(wanted) == 15 and sum(r[-1] == "duplicate_record_id" for r in wanted) == 3
    monkeypatch.setattr(landing, "FEW_LINES", 100)

    def written(df):
        raise AssertionError("written in between")

    monkeypatch.setattr(landing, "cut_lineage", written)
    monkeypatch.setattr(joins, "cut_lineage", written)
    assert staged("few", 2) == wanted

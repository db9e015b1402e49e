"""Round trips with fixed numbers, error cases, and text against independent models."""

from __future__ import annotations

import math
import os
import random
import struct
from datetime import date, datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from colonnade import convert, schema, storage, types
from colonnade.functions import csvtext, values
from colonnade.operators import batch, stats
from colonnade.sources import csv_io, rowgroup_file, store
from colonnade.streaming import csv_stream

SCHEMA = "id,int32\nscore,int64\nname,string\n"
DATA = "1,100,Alice\n2,200,Bob\n3,300,Charlie\n4,400,Diana\n5,500,Eve\n"


def cell(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def write(path: Path, text: str) -> str:
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("kind", ["table.iyx", "table"])
def test_small_round_trip(spark, tmp_path, kind):
    s, d, out = write(tmp_path / "s.csv", SCHEMA), write(tmp_path / "d.csv", DATA), str(tmp_path / kind)
    assert convert.import_csv(spark, s, d, out, single=True) == 5
    rows = convert.open_table(spark, out)
    assert batch.numeric_product(rows).first()[0] == 998992007
    assert schema.same(rows.schema, schema.parse(SCHEMA))
    assert convert.export_csv(spark, out, str(tmp_path / "e.csv"), str(tmp_path / "t.csv"), single=True) == 5
    assert (tmp_path / "e.csv").read_text() == DATA and (tmp_path / "t.csv").read_text() == SCHEMA


def test_file_layout(spark, tmp_path):
    out = str(tmp_path / "one.iyx")
    convert.import_csv(spark, write(tmp_path / "s.csv", SCHEMA), write(tmp_path / "d.csv", DATA), out, single=True)
    raw = Path(out).read_bytes()
    assert len(raw) == 221 and raw[-4:] == b"IYX\x01"
    assert struct.unpack_from("<IIQQQ", raw) == (3, 1, 5, 64, 197)
    assert raw[64:74] == b"\x01\x02\x00\x00\x00id\x02\x05\x00"
    assert rowgroup_file.directory(out) == [(out, 0, 90, 107, 5)]


def test_many_groups(spark, tmp_path):
    rows = spark.range(1, 5001).selectExpr("id", "id * 2 AS value")
    assert batch.numeric_product(rows).first()[0] == 560069862
    out = str(tmp_path / "many.iyx")
    rowgroup_file.write(rows, out, single=True)
    assert Path(out).stat().st_size == 80157
    assert [x[2:] for x in rowgroup_file.directory(out)] == [(81, 32772, 2048), (32853, 32772, 2048), (65625, 14468, 904)]
    assert batch.numeric_product(rowgroup_file.read(spark, out)).first()[0] == 560069862
    assert sorted(r.id for r in rowgroup_file.read(spark, out, [2]).collect()) == list(range(4097, 5001))
    with pytest.raises(Exception, match="row group 3 of 3"):
        rowgroup_file.read(spark, out, [3]).collect()
    path = str(tmp_path / "parquet")
    store.write(rows.coalesce(1), path, store.GROUP_ROWS)
    assert [(r.group_no, r.row_offset, r.row_count) for r in store.directory(spark, path).orderBy("group_no").collect()] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert [r.id for r in store.read_groups(spark, path, [2], ["id"]).collect()] == list(range(4097, 5001))
    with pytest.raises(IndexError):
        store.read_groups(spark, path, [3])


def test_all_types_round_trip(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice('ab,"\r é漢\t') for _ in range(rng.randrange(9)))
    rows = [(rng.randrange(-(2**15), 2**15), rng.randrange(-(2**31), 2**31), rng.randrange(-(2**63), 2**63), rng.random() < 0.5, text(), date.fromordinal(rng.randrange(700_000, 750_000)), datetime(1969, 12, 31, 23, 59, rng.randrange(60))) for _ in range(3000)]
    kinds = schema.make(*((n, n) for n in ("int16", "int32", "int64", "bool", "string", "date", "timestamp")))
    df = spark.createDataFrame(rows, kinds)
    for back in (csv_io.roundtrip(df, "all"), rowgroup_file.roundtrip(df, "all"), store.roundtrip(df, "all")):
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_pushdown(spark, tmp_path):
    out = str(tmp_path / "p.iyx")
    rowgroup_file.write(spark.range(5000).selectExpr("id", "cast(id % 7 AS string) AS s"), out)
    rows = rowgroup_file.read(spark, out)
    for op in batch.COMPARE:
        assert batch.compare(rows, "id", op, 4000).count() == sum(getattr(i, batch.COMPARE[op])(4000) for i in range(5000))
    assert rows.where("s = '3' and id > 10 and s != '4'").count() == sum(i % 7 == 3 and i > 10 for i in range(5000))


@pytest.mark.parametrize(
    ("text", "said"),
    [("id", "found 1 fields"), ("a,b,c", "found 3 fields"), (",int32", "empty column name"), ("id,", "empty type"), ("id,INT32", "unknown type"), ("id,float", "unknown type"), ("a,int32\n\na,bool", "line 3: duplicate"), ("", "no columns"), (" \n\t\n", "no columns"), ('"a,int32', "unclosed")],
)
def test_bad_schema_files(text, said):
    with pytest.raises(ValueError, match=said):
        schema.parse(text)


def test_schemas(spark):
    s = schema.parse(' id , int32 \n\n"a,b",string\r\n')
    assert [(f.name, f.dataType.simpleString()) for f in s] == [("id", "int"), ("a,b", "string")]
    assert schema.parse(schema.render(s)) == s and schema.count(s) == 2
    assert schema.find(s, "a,b") == 1 and schema.find(s, "ID") is None and not schema.has(s, "ID")
    assert schema.at(s, 0).name == "id" and schema.valid(s) and not schema.valid(schema.make())
    with pytest.raises(IndexError):
        schema.at(s, 2)
    with pytest.raises(ValueError, match="duplicate"):
        schema.add(s, "id", "bool")
    assert types.name_of(9) == "unknown"
    with pytest.raises(TypeError, match="'x'.*double"):
        csv_io.to_lines(spark.range(1).selectExpr("cast(id as double) AS x"))


def machine(line: str) -> list[str] | None:
    """A line's fields, character by character."""
    fields, held, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            held, i = held + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields, held = [*fields, held], ""
        elif c != "\r" or quoted:
            held += c
        i += 1
    return None if quoted else [*fields, held]


def test_split_against_a_state_machine(spark):
    rng = random.Random(5)
    lines = ["", "a,,b", "a,", '"a""b,c"', 'ab"c,d"e', "a\rb", '"a\rb"', *("".join(rng.choice('ab,"\r é') for _ in range(rng.randrange(14))) for _ in range(4000)), '"' + "x," * 100_000 + '"']
    closed = [x for x in lines if machine(x) is not None]
    got = {r.value: r.f for r in spark.createDataFrame([(x,) for x in closed], "value string").select("value", csvtext.split(F.col("value")).alias("f")).collect()}
    assert all(got[x] == machine(x) == csvtext.split_text(x) for x in closed)
    for x in [x for x in lines if machine(x) is None][:3]:
        with pytest.raises(ValueError, match="unclosed"):
            csvtext.split_text(x)
        with pytest.raises(Exception, match="unclosed quote"):
            cell(spark, csvtext.split(F.lit(x)))


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("int16", {"5": 5, " -7 ": -7, "007": 7, "32767": 32767}, ["", "+5", "5x", "1.0", "32768", "--1"]),
        ("int32", {"2147483647": 2147483647}, ["2147483648", "1e3"]),
        ("int64", {"\t-9223372036854775808\r": -(2**63)}, ["9223372036854775808"]),
        ("int128", {"12345678901234567890123": 12345678901234567890123}, ["x", "1" * 39]),
        ("bool", {"true": True, " FALSE ": False}, ["1", "yes", ""]),
        ("date", {"2024-01-15": date(2024, 1, 15), " 1969-12-31 ": date(1969, 12, 31)}, ["", "15/01/2024", "2024-02-30", "2024-01-15abc", "2024-1-5"]),
        ("timestamp", {"2024-01-15 10:11:12": datetime(2024, 1, 15, 10, 11, 12), "1969-12-31 23:59:59": datetime(1969, 12, 31, 23, 59, 59)}, ["2024-01-15", "2024-01-15 25:00:00"]),
        ("string", {"": "", " a ": " a "}, []),
    ],
)
def test_parsing(spark, kind, good, bad):
    for text, value in good.items():
        assert cell(spark, values.parse(F.lit(text), kind)) == value
    for text in bad:
        with pytest.raises(Exception, match="not a value of"):
            cell(spark, values.parse(F.lit(text), kind))
    assert cell(spark, values.parse(F.lit(None).cast("string"), kind)) is None


def test_formatting(spark):
    assert cell(spark, values.days(F.lit("2024-01-15").cast("date"))) == 19737
    assert cell(spark, values.date_text(F.lit(19737))) == "2024-01-15" and cell(spark, values.date_text(F.lit(-1))) == "1969-12-31"
    at = F.lit("2024-01-15 10:11:12").cast("timestamp_ntz")
    assert cell(spark, values.seconds(at)) == 1705313472 and cell(spark, values.timestamp_text(F.lit(1705313472))) == "2024-01-15 10:11:12"
    assert cell(spark, values.to_text(at, "timestamp", raw_times=True)) == "1705313472"
    assert cell(spark, values.seconds(F.lit("1969-12-31 23:59:59.5").cast("timestamp_ntz"))) == -1


def test_csv_errors(spark, tmp_path):
    kinds = schema.make(("a", "int32"), ("b", "string"))
    path = write(tmp_path / "x.csv", "1,x\n\n2\n")
    for ask in (lambda d: d.select("a").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="expected 2 fields but found 1"):
            ask(csv_io.read(spark, path, kinds))
    assert csv_io.first_error(spark, path, kinds) == (3, "2")
    assert [tuple(r) for r in csv_io.read(spark, write(tmp_path / "y.csv", '1," a"\r\n\n2,'), kinds).collect()] == [(1, " a"), (2, "")]
    with pytest.raises(Exception, match="column a: not a value of int32"):
        csv_io.read(spark, write(tmp_path / "z.csv", "x,y\n"), kinds).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        csv_io.read(spark, str(tmp_path / "none.csv"), kinds).collect()
    with pytest.raises(Exception, match="holds NULL"):
        csv_io.to_lines(spark.sql("SELECT cast(null AS int) AS a")).collect()
    bad = write(tmp_path / "bad.csv", "x,y\n")
    with pytest.raises(Exception, match="int32"):
        convert.import_csv(spark, write(tmp_path / "s.csv", "a,int32\nb,string\n"), bad, str(tmp_path / "o.iyx"), single=True)
    assert not (tmp_path / "o.iyx").exists()


def test_row_group_file_errors(spark, tmp_path):
    out = str(tmp_path / "f.iyx")
    rowgroup_file.write(spark.range(10).selectExpr("id", "cast(id AS string) AS s"), out, single=True)
    raw = Path(out).read_bytes()
    for damaged in (raw[:50], raw[:-1] + b"\x02", raw[:24] + b"\xff" * 8 + raw[32:]):
        (tmp_path / "g.iyx").write_bytes(damaged)
        with pytest.raises(Exception, match="row-group file|magic|points outside|cut short"):
            rowgroup_file.read(spark, str(tmp_path / "g.iyx")).collect()
    layout = rowgroup_file.read_layout(pa.BufferReader(raw))
    with pytest.raises(IndexError):
        rowgroup_file.read_group(pa.BufferReader(raw), layout, 1)
    with pytest.raises(rowgroup_file.FormatError, match="cut short"):
        rowgroup_file.decode(memoryview(b"\x05\x00\x00\x00ab"), 0, 1, types.by_name("string"))
    writer = rowgroup_file.FileWriter(str(tmp_path / "h.iyx"), pafs.LocalFileSystem(), schema.make(("a", "int32")))
    with pytest.raises(ValueError, match="columns"):
        writer.add(pa.record_batch([pa.array([1])], names=["b"]))
    writer.end()
    with pytest.raises(RuntimeError):
        writer.end()
    with pytest.raises(Exception, match="NULL"):
        rowgroup_file.write(spark.sql("SELECT cast(null AS int) AS a"), str(tmp_path / "n.iyx"))
    assert not list((tmp_path / "n.iyx").glob("*.iyx"))
    with pytest.raises(Exception, match="double"):
        rowgroup_file.write(spark.sql("SELECT 1.5D AS a"), str(tmp_path / "d.iyx"))


def test_empty_tables(spark, tmp_path):
    none = batch.empty(spark, schema.make(("a", "int32"), ("s", "string")))
    for back in (csv_io.roundtrip(none, "e"), store.roundtrip(none, "e"), rowgroup_file.roundtrip(none, "e")):
        assert back.count() == 0 and schema.same(back.schema, none.schema)
    assert batch.numeric_product(none).first()[0] == 1
    row = stats.column_stats(none).where("column = 's'").first()
    assert (row.row_count, row.null_count, row.min_value, row.total_length, row.unique_count) == (0, 0, None, None, 0)


def test_tables(spark):
    df = batch.from_columns(spark, {"a": [1, 2], "b": ["x", "é"]}, schema.make(("a", "int32"), ("b", "string")))
    assert batch.append_row(df, [" 3", " y"]).collect()[2] == (3, " y")
    with pytest.raises(ValueError, match="expected 2 fields"):
        batch.append_row(df, ["1"])
    with pytest.raises(Exception, match="not a value of int32"):
        batch.append_row(df, ["z", ""]).collect()
    with pytest.raises(ValueError, match="different lengths"):
        batch.from_columns(spark, {"a": [1], "b": []})
    assert batch.column_named(df, "B") is None and batch.column_at(df, 1).columns == ["b"] and batch.clear(df).count() == 0
    with pytest.raises(IndexError):
        batch.column_at(df, 2)
    with pytest.raises(ValueError):
        batch.compare(df, "a", "like", 1)
    got = {r.column: r for r in stats.column_stats(df, exact=False).collect()}
    assert (got["b"].min_length, got["b"].max_length, got["b"].total_length, got["a"].max_value) == (1, 2, 3, "2")
    assert batch.product(__import__("numpy").array([-3, 5, 10**9 + 9])) == -30


def test_stream(spark, tmp_path):
    kinds, source = schema.make(("a", "int32"), ("b", "string")), tmp_path / "in"
    source.mkdir()
    for k in range(2):
        write(source / f"{k}.csv", f'{k},"x,{k}"\n')
        csv_stream.import_available(spark, str(source), kinds, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, store.read(spark, str(tmp_path / "out")).collect())) == [(0, "x,0"), (1, "x,1")]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        storage.read_text(spark, str(tmp_path / "no"))
    assert convert.main(["import"]) == 1


def test_without_the_text_operators(tmp_path):
    """The rest imports and lists its queries where the optional subpackage is missing."""
    import subprocess
    import sys

    code = "import sys\nsys.modules['colonnade.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'scan_orders' in e.queries() and not any(n.startswith('op') for n in e.queries())\nassert e.queries().keys() == e.oracle_sql().keys()"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_numeric_product_scans_in_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 8)
    plan = batch.numeric_product(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Coalesce" not in plan
    assert batch.numeric_product(rows.where("id > 0").limit(20)).first()[0] == math.factorial(20) % batch.PRIME


def test_small_groups_share_partitions(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 2).selectExpr("id", "cast(id as string) name")
    made = rowgroup_file.write(rows, str(tmp_path / "t"))
    assert (made.files, made.groups, made.rows) == (2, 10, 20_000)
    assert rowgroup_file.read(spark, str(tmp_path / "t")).rdd.getNumPartitions() == 2
    split = rowgroup_file.register(spark) or spark.read.format("iyx").option("partitionBytes", "60000").load(str(tmp_path / "t"))
    assert split.rdd.getNumPartitions() >= 5 and split.count() == 20_000
    some = rowgroup_file.read(spark, str(tmp_path / "t"), columns=["name"])
    assert some.columns == ["name"] and some.distinct().count() == 20_000


def test_failed_overwrite_keeps_the_old_file_names_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    rowgroup_file.write(spark.range(10), path)
    with pytest.raises(Exception, match="NULL|null"):
        rowgroup_file.write(spark.range(10).selectExpr("if(id = 5, null, id) id"), path)
    assert rowgroup_file.read(spark, path).count() == 10
    rowgroup_file.write(spark.range(7), path)
    assert rowgroup_file.read(spark, path).count() == 7 and not [x for x in os.listdir(path) if x.startswith(".") and not x.endswith(".crc")]


def test_files_of_other_stores_are_written_by_a_copy(tmp_path):
    import pyarrow.fs as pafs

    batch_ = pa.record_batch([pa.array(range(5000)), pa.array([f"é{i}" for i in range(5000)])], names=["a", "b"])
    both = []
    for fs in (pafs.LocalFileSystem(), pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())):
        path = str(tmp_path / "x.iyx") if isinstance(fs, pafs.LocalFileSystem) else "y.iyx"
        out = rowgroup_file.FileWriter(path, fs, schema.make(("a", "int64"), ("b", "string")))
        out.add(batch_)
        out.end()
        both.append((tmp_path / path).read_bytes())
    assert both[0] == both[1] and sorted(os.listdir(tmp_path)) == ["x.iyx", "y.iyx"]


def test_first_error_numbers_lines(spark, tmp_path):
    (tmp_path / "d.csv").write_text("".join(f"{i},a\n" for i in range(5000)) + "\nx,y,z\n1,\"b\n")
    assert csv_io.first_error(spark, str(tmp_path / "d.csv"), schema.make(("a", "int32"), ("b", "string"))) == (5002, "x,y,z")
    (tmp_path / "e.csv").write_text("1,a\n")
    assert csv_io.first_error(spark, str(tmp_path / "e.csv"), schema.make(("a", "int32"), ("b", "string"))) is None


def test_typed_statistics_skip(spark):
    found = stats.TypedStatistics.of(spark.createDataFrame([(3, None), (9, None)], "a int, b string"), "a")
    expected = {("eq", 3): True, ("eq", 2): False, ("ne", 5): True, ("lt", 3): False, ("le", 3): True, ("gt", 9): False, ("ge", 9): True, ("eq", None): False}
    assert {k: found.may_hold(*k) for k in expected} == expected
    assert not stats.TypedStatistics.of(spark.createDataFrame([(3, None)], "a int, b string"), "b").may_hold("eq", "x")


def test_statistics_read_one_column_each(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select("n_name", "n_regionkey")
    exact, sketch = ({r["column"]: r for r in stats.column_stats(df, e).collect()} for e in (True, False))
    assert exact == sketch and "Expand" not in stats.column_stats(df)._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from colonnade import storage

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: {}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(unset)

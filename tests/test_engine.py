import io
import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lading.functions import columns as C
from lading.plans.extract import planned, written
from lading.plans.queries import QUERIES, SQL
from lading.sources.datasource import register
from lading.sources.reader import Options, list_entries, read_archives, volume_sets
from lading.streaming.arrivals import arriving_entries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(name, spark, sf_dir, duck):
    df, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(shown, r)) for r in df.collect()), key=repr) == sorted((tuple(shown(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.fixture
def folder(tmp_path):
    for name, files in (("one.zip", {"a.txt": "A", "d/b.txt": "B"}), ("two.zip", {"top/../../up.txt": "U", "top/c.txt": "C", "top/C.txt": "c"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
    (tmp_path / "junk.bin").write_bytes(b"junk")
    return tmp_path


def test_readers_agree(spark, folder):
    register(spark)
    a = read_archives(spark, f"file://{folder}", Options(content=True))
    b = spark.read.format("lading").option("content", "true").load(str(folder))
    pick = lambda df: sorted((r[0].rsplit("/", 1)[-1], r[1] or "", bytes(r[2] or b""), r[3] or "") for r in df.select("archive", "name", "content", "archive_status").collect())
    assert pick(a) == pick(b)
    assert len(pick(a)) == 6


@pytest.mark.parametrize("policy", ["overwrite", "skip", "rename"])
def test_extraction(spark, folder, tmp_path_factory, policy):
    out = tmp_path_factory.mktemp("out")
    entries = read_archives(spark, f"file://{folder}/*.zip", Options(content=True))
    done = written(planned(entries, on_collision=policy), f"file://{out}").collect()
    assert len(done) == 5
    assert (out / "one/a.txt").read_text() == "A"
    assert (out / "two/__Parent__/up.txt").read_text() == "U" or not (out / "two/top").exists()
    assert not (out.parent / "up.txt").exists()


def test_volumes(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x", "volume " * 50)
    whole = data.getvalue()
    rows = spark.createDataFrame([("s.zip.002", bytearray(whole[100:])), ("s.zip.001", bytearray(whole[:100])), ("t.part2.rar", bytearray(b"2")), ("t.part1.rar", bytearray(b"1")), ("u.r00", bytearray(b"2")), ("u.rar", bytearray(b"1"))], "path string, content binary")
    sets = {r.path: (r.volumes, bytes(r.content)) for r in volume_sets(rows).collect()}
    assert sets == {"s.zip.001": (2, whole), "t.part1.rar": (2, b"12"), "u.rar": (2, b"12")}
    assert list_entries(volume_sets(rows).where("path like 's%'"), Options(test=True)).select("name", "status").collect() == [("x", "ok")]


def test_arrivals(spark, folder, tmp_path):
    stream = arriving_entries(spark, f"file://{folder}").where("name is not null")
    run = stream.select("name").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_column_functions(spark):
    rows = spark.createDataFrame([("a\tb", "x.tar.gz", "f.tgz", b"\x80\x01")], "c string, n string, g string, v binary")
    got = rows.select(C.carets(F.col("c")), C.without_extension(F.col("n")), C.gzip_content_name(F.col("g")), C.varint(F.col("v")), C.fork_path(F.lit("d/n"), F.lit(True), "hidden"), C.four_letters(F.lit(0x54455854))).first()
    assert tuple(got) == ("a^Ib", "x", "f.tar", 128, "d/._n", "TEXT")
    assert C.glob_to_regex("a[bc]*?.\\*") == r"(?s)^a[bc].*.\.\*$"


def test_errors_of_the_store_fail_the_task():
    from lading.sources.reader import rows_of
    from lading.sources.source import Source, StoreFailure

    class Broken(Source):
        def at(self, offset, n):
            if offset > 100:
                raise OSError("connection lost")
            return super().at(offset, n)

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 500)
    with pytest.raises(StoreFailure):
        list(rows_of(Broken(out.getvalue()), "a.zip", Options(test=True)))


def test_volumes_and_small_files_in_the_data_source(spark, tmp_path, monkeypatch):
    from lading.sources import datasource

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(30):
            z.writestr(f"f{i}.txt", f"text {i} " * 20)
    data = out.getvalue()
    for k in range(3):
        (tmp_path / f"set.zip.{k + 1:03d}").write_bytes(data[k * 1000 : (k + 1) * 1000] if k < 2 else data[2000:])
    for i in range(20):
        (tmp_path / f"one{i}.zip").write_bytes(data)
    register(spark)
    df = spark.read.format("lading").option("test", "true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    rows = df.groupBy("archive").count().collect()
    assert len(rows) == 21 and all(r["count"] == 30 for r in rows)
    assert df.where("status <> 'ok'").isEmpty()
    monkeypatch.setattr(datasource, "PARTITION_ARCHIVES", 7)
    assert len(datasource.grouped([(f"a{i}.zip", 10) for i in range(20)])) == 3
    assert datasource.grouped([("b.r00", 1), ("b.rar", 1), ("b.r01", 1), ("c.z01", 1), ("c.zip", 1)]) == [[["b.rar", "b.r00", "b.r01"], ["c.z01", "c.zip"]]]


def test_targets_are_unique_and_attempts_have_names_of_their_own(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("d/a.txt", "1"), ("d/a.txt", "2"), ("d/a-1.txt", "3"), ("d/a.txt", "4"), ("d/b.txt", "5")):
            info = zipfile.ZipInfo(name, (2020, 2, 29, 12, 34, 56))
            info.create_system, info.external_attr = 3, 0o100640 << 16
            z.writestr(info, text)
    files = spark.createDataFrame([("x.zip", bytearray(out.getvalue()))], "path string, content binary")
    entries = list_entries(files, Options(content=True, test=True))
    there = spark.createDataFrame([("d/b.txt",), ("d/b-1.txt",)], "path string")
    plan = planned(entries, existing=there)
    got = [r.target for r in sorted(plan.collect(), key=lambda r: r.idx)]
    assert got == ["d/a.txt", "d/a-2.txt", "d/a-1.txt", "d/a-3.txt", "d/b-2.txt"]
    assert written(plan, f"file://{tmp_path}").where("result <> 'file'").isEmpty()
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["a-1.txt", "a-2.txt", "a-3.txt", "a.txt", "b-2.txt"]
    assert (tmp_path / "d" / "a-3.txt").read_text() == "4"
    stat = (tmp_path / "d" / "a.txt").stat()
    assert stat.st_mode & 0o777 == 0o640 and stat.st_mtime == 1582979696


def test_chosen_entries_and_early_stop():
    from lading.sources.reader import rows_of
    from lading.sources.source import Source

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(9):
            z.writestr(f"{i}.txt", "x")
    rows = list(rows_of(Source(out.getvalue()), "a.zip", Options(keep=lambda r: r["idx"] % 2 == 0, until=lambda r: r["name"] == "5.txt")))
    assert [r["idx"] for r in rows] == [0, 2, 4] and rows[-1]["archive_status"] == "stopped"


def test_names_split_by_what_decodes():
    from lading.functions.names import split_raw

    assert split_raw("表示\\ソ.txt".encode("shift_jis"), "shift_jis") == ["表示", "ソ.txt"]
    assert split_raw(b"/a/b", "ascii") == ["/", "a", "b"]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_long_lines_are_the_same_in_any_time_zone(spark, sf_dir, duck, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sorted(map(tuple, QUERIES["long_lines"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == sorted(duck.sql(SQL["long_lines"]).fetchall())


def test_sizes_of_ten_megabytes_and_more(spark, tmp_path):
    path = tmp_path / "orders.parquet"
    con = duckdb.connect()
    con.sql(f"copy (select i as o_orderkey, (i * 7919 % 20)::bigint * [1, 9, 999, 10000, 123456, 1000000][1 + i % 6] as o_custkey from range(1000) r(i)) to '{path}'")
    con.sql(f"create view orders as select * from '{path}'")
    want = con.sql(SQL["sizes_and_modes"]).fetchall()
    got = QUERIES["sizes_and_modes"](spark, str(tmp_path)).select("o_orderkey", "size", "mode").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    sizes = spark.createDataFrame([(12_340_000,), (123_400_000,), (1_234_000_000,)], "n long")
    assert [r[0] for r in sizes.select(C.short_size(F.col("n"))).collect()] == ["12.3 MB", "123 MB", "1.23 GB"]


def test_forked_files_of_one_row_group_are_many_tasks(spark, sf_dir):
    assert spark.read.parquet(f"{sf_dir}/customer.parquet").rdd.getNumPartitions() == 1
    with_forks = QUERIES["forked_files"](spark, sf_dir)
    assert with_forks.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_entries_of_small_archives_share_batches(spark, monkeypatch):
    import pyarrow as pa

    made = []

    class Counted:
        @staticmethod
        def from_pylist(rows, schema):
            made.append(len(rows))
            return pa.RecordBatch.from_pylist(rows, schema)

    files = spark.createDataFrame([("a.Z", bytearray(b"\x1f\x9d\x8ca\0"))], "path string, content binary")
    kept = {}
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: kept.update(f=f))
    list_entries(files, Options(content=True))
    f = kept["f"]
    monkeypatch.setitem(f.__globals__, "pa", type("pa", (), {"RecordBatch": Counted}))
    batch = pa.RecordBatch.from_pylist([{"path": f"{i}.Z", "content": b"\x1f\x9d\x8ca\0"} for i in range(2500)])
    assert sum(b.num_rows for b in f(iter([batch, batch]))) == 5000
    assert made == [1000] * 5


def test_streams_of_one_row_group_are_many_tasks(spark, sf_dir):
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() == 1
    streams = QUERIES["Z_streams"](spark, sf_dir)
    assert streams.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_compress_streams_of_any_width_come_back():
    import random

    from lading.functions.kernels import unix_compress
    from lading.plans.pack import ONE

    chance = random.Random(3)
    for n in (0, 1, 2, 255, 256, 257, 600, 1300, 2600, 9000, 40000):
        for data in (chance.randbytes(n), b"ab" * n, bytes(chance.choices(b"abcd ", k=n))):
            assert unix_compress(ONE["Z"](data)) == data


def test_locked_archives_are_packed_once_for_both_passwords(spark, sf_dir):
    rows = QUERIES["password_entries"](spark, sf_dir)
    rows.collect()
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_trees_are_not_broadcast(spark, sf_dir):
    rows = QUERIES["tree_paths"](spark, sf_dir)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packing_has_more_tasks_for_more_bytes(spark, sf_dir, monkeypatch):
    from lading.plans import pack

    films = QUERIES["film_pictures"](spark, sf_dir)
    assert films.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(pack, "PART", 1 << 14)
    assert QUERIES["film_pictures"](spark, sf_dir).rdd.getNumPartitions() > 8

"""Shard files: stores by scheme, pushed filters, the Arrow writer, inventories."""

import os

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from shardwright.operators import selection as sel
from shardwright.sources import stores
from shardwright.sources import token_bin as tb

CHUNKS = "shard_stem string, start_pos long, tokens array<int>"
STORE = f"{__name__}:open_depot"


def open_depot(path):
    """A store of its own: ``depot://name/...`` lies under a folder that only this function knows."""
    assert path.startswith("depot://")
    return fs.SubTreeFileSystem(os.environ["SHARD_DEPOT"], fs.LocalFileSystem()), path.removeprefix("depot://")


@pytest.fixture
def depot(tmp_path, monkeypatch):
    monkeypatch.setenv("SHARD_DEPOT", str(tmp_path))
    return tmp_path


def shard_rows(n_shards=4, n_chunks=5, size=10):
    return [(f"s_{s:02d}", c * size, [s * 1000 + c * size + k for k in range(size if c < n_chunks - 1 else 3)])
            for s in range(n_shards) for c in range(n_chunks)]


@pytest.fixture
def folder(spark, tmp_path):
    tb.write_shards(spark.createDataFrame(shard_rows(), CHUNKS).repartition(3), f"file://{tmp_path}/bin")
    return f"file:{tmp_path}/bin"


def read(spark, folder, **options):
    return tb.read_shards(spark, folder + "/*.bin", chunkSize="10", chunksPerPartition="2", **options)


def parts(df):
    return df.rdd.getNumPartitions()


def test_round_trip_by_scheme(spark, folder):
    got = read(spark, folder).orderBy("shard_stem", "start_pos").select("shard_stem", "start_pos", "tokens")
    assert [(r[0], r[1], list(r[2])) for r in got.collect()] == shard_rows()
    plain = folder.removeprefix("file:")
    assert np.fromfile(plain + "/s_01.bin", "<u2")[512:].tolist() == [t for s, _, ts in shard_rows() for t in ts if s == "s_01"]
    one = tb.read_shards(spark, [f"{plain}/s_03.bin", f"{folder}/s_00.bin"], chunkSize="10")
    assert {r[0] for r in one.select("shard_stem").collect()} == {"s_00", "s_03"}


@pytest.mark.parametrize("condition, n_parts, n_rows", [
    ("true", 12, 20),
    ("shard_stem = 's_02'", 3, 5),
    ("shard_stem IN ('s_00', 's_03', 'none')", 6, 10),
    ("shard_stem LIKE 's_0%' AND shard_stem > 's_01'", 6, 10),
    ("shard_stem = 's_01' AND start_pos >= 20 AND start_pos < 40", 1, 2),
    ("chunk_id IN (0, 3)", 8, 8),
    ("chunk_id = 4 AND shard_stem >= 's_02'", 2, 2),
    ("shard_stem = 'none'", 1, 0),  # one empty task
    ("size(tokens) = 3 AND chunk_id > 2", 4, 4),
    ("shard_stem = NULL", 0, 0),
])
def test_filters_reach_the_planning(spark, folder, condition, n_parts, n_rows):
    df = read(spark, folder).where(condition)
    assert parts(df) == n_parts
    assert df.count() == n_rows
    rows = read(spark, folder).collect()
    again = spark.createDataFrame(rows, tb.CHUNK_SCHEMA).where(condition)
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))


def test_raw_positions_are_pushed_as_they_are(spark, folder):
    df = read(spark, folder, raw="true").where("start_pos = 512 + 20 AND shard_stem = 's_00'")
    assert parts(df) == 1 and [r["tokens"][0] for r in df.collect()] == [20]


def test_headers_are_pruned_by_stem(spark, folder):
    df = tb.header_inventory(spark, folder + "/*.bin").where("shard_stem > 's_01' AND n_tokens = 43")
    assert parts(df) == 2 and sorted(r["shard_stem"] for r in df.collect()) == ["s_02", "s_03"]


def test_total_and_short_files(spark, folder):
    total = tb.inventory_total(tb.header_inventory(spark, folder + "/*.bin", min_tokens=43)).first()
    assert tuple(total) == (4, 4 * 43, 43, 43)
    with pytest.raises(Exception, match="expected at least 44"):
        tb.header_inventory(spark, folder + "/*.bin", min_tokens=44).collect()
    with pytest.raises(Exception, match="expected at least 44"):
        read(spark, folder, minTokens="44").collect()


def test_another_store(spark, depot):
    rows, listed = shard_rows(2), stores.matching
    frame = spark.createDataFrame(rows, CHUNKS)
    assert listed("depot://bin/*.bin", STORE) == []
    writer = tb.TokenBinWriter({"path": "depot://bin", "fileSystem": STORE}, False)
    writer.commit([writer.write(iter(frame.toArrow().to_batches()))])
    assert [f.path for f in listed("depot://bin/*.bin", STORE)] == ["depot://bin/s_00.bin", "depot://bin/s_01.bin"]
    reader = tb.TokenBinReader({"path": "depot://bin/*.bin", "fileSystem": STORE, "chunkSize": "10"})
    got = [(r["shard_stem"], r["start_pos"], r["tokens"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == rows


def test_patterns(tmp_path):
    for name in ("a/x_1.bin", "a/x_2.bin", "a/.x_3.bin", "b/x_1.bin", "b/c/x_1.bin", "b/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    def found(pattern):
        return [f.path.removeprefix(f"{tmp_path}/") for f in stores.matching(f"{tmp_path}/{pattern}")]
    assert found("a/*.bin") == ["a/x_1.bin", "a/x_2.bin"]
    assert found("*/x_1.bin") == ["a/x_1.bin", "b/x_1.bin"]
    assert found("a/x_[2-9].bin") == ["a/x_2.bin"] and found("b/y.txt") == ["b/y.txt"] and found("no/*.bin") == [] == found("no.bin")


def test_damaged_files_are_refused(spark, folder):
    path = folder.removeprefix("file:") + "/s_01.bin"
    whole = open(path, "rb").read()
    for damaged, message in ((whole[:-2], "bytes, expected"), (b"\0" * 4 + whole[4:], "header starts"),
                             (whole[:4] + b"\x07\0\0\0" + whole[8:], "version 7")):
        with open(path, "wb") as f:
            f.write(damaged)
        with pytest.raises(Exception, match=message):
            read(spark, folder).collect()
        assert read(spark, folder).where("shard_stem = 's_02'").count() == 5  # the others are not touched


@pytest.mark.parametrize("bad", [[70_000], [-1], [None]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame(shard_rows(2) + [("s_09", 0, bad)], CHUNKS).coalesce(1)
    with pytest.raises(Exception, match="shard s_09 holds"):
        tb.write_shards(rows, str(tmp_path / "bin"))
    assert not [f for f in os.listdir(tmp_path / "bin") if "s_09" in f]


def test_shards_cross_batches(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("s_%02d", (F.col("id") / 1700).cast("int")).alias("shard_stem"),
                                    F.col("id").alias("start_pos"), F.array((F.col("id") % 60_000).cast("int")).alias("tokens"))
    tb.write_shards(rows, str(tmp_path / "bin"))
    got = tb.read_shards(spark, str(tmp_path / "bin/*.bin")).orderBy("shard_stem").collect()
    assert [t for r in got for t in r["tokens"]] == list(range(5000))


def test_long_files_are_joined_from_parts(spark, tmp_path):
    rows = [(f"f_{f}", 7 * k, [100 * f + k] * 7) for f in range(3) for k in range(23 + f)]
    frame = spark.createDataFrame(rows, CHUNKS).repartition(5)
    assert tb.write_long_shards(frame, str(tmp_path / "bin"), part_tokens=16) == [(f"f_{f}", 7 * (23 + f)) for f in range(3)]
    assert sorted(os.listdir(tmp_path / "bin")) == ["f_0.bin", "f_1.bin", "f_2.bin"]
    got = tb.read_shards(spark, str(tmp_path / "bin/*.bin")).orderBy("shard_stem").collect()
    assert [list(r["tokens"]) for r in got] == [[t for _, _, ts in rows[a:b] for t in ts] for a, b in ((0, 23), (23, 47), (47, 72))]
    assert tb.write_long_shards(frame.where("start_pos < 0"), str(tmp_path / "none")) == []


def test_files_are_streamed_from_rows_cut_in_place(spark, tmp_path):
    rows = [(f"f_{f}", 3 * k, 3, f, k) for f in range(3) for k in range(50)]
    frame = spark.createDataFrame(rows, "shard_stem string, start_pos long, n_tokens long, f int, k int").repartition(4)

    def cut(dealt):
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "packed" not in plan  # no ids are exchanged
        one = F.concat(*[F.expr(f"unhex(lpad(hex({c}), 2, '0') || '00')") for c in ("f", "k", "f")])
        return dealt.withColumn("packed", one)

    assert tb.write_long_shards(frame, str(tmp_path / "bin"), cut=cut) == [(f"f_{f}", 150) for f in range(3)]
    assert sorted(os.listdir(tmp_path / "bin")) == ["f_0.bin", "f_1.bin", "f_2.bin"]
    for f in range(3):
        assert np.fromfile(f"{tmp_path}/bin/f_{f}.bin", "<u2")[512:].tolist() == [x for k in range(50) for x in (f, k, f)]
    assert tb.write_long_shards(frame.where("k < 0"), str(tmp_path / "none"), cut=cut) == []
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a join that becomes a broadcast one as it runs
    try:
        assert tb.write_long_shards(frame, str(tmp_path / "late"), cut=cut) == [(f"f_{f}", 150) for f in range(3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="the next start at 3"):
        tb.write_long_shards(frame.where("k > 0"), str(tmp_path / "gap"), cut=cut)
    assert not os.listdir(tmp_path / "gap")


def test_sums_of_files_beyond_64_bits(spark):
    """Position-weighted sums of long files pass a long; their lowest 64 bits stay exact, smaller sums are as they are."""
    rows = [(stem, 2 ** 31 - 65_536 * (k + 1), [token] * 2_000) for stem, n, token in (("long", 90, 65_535), ("short", 2, 7)) for k in range(n)]
    got = {r["shard_stem"]: r[1:] for r in sel.file_sums(spark.createDataFrame(rows, CHUNKS)).collect()}
    for stem in ("long", "short"):
        own = [(start, tokens) for name, start, tokens in rows if name == stem]
        exact = sum(t * (start + i) for start, tokens in own for i, t in enumerate(tokens))
        assert (exact >= 2 ** 63) == (stem == "long")
        assert got[stem] == (2_000 * len(own), sum(sum(tokens) for _, tokens in own), (exact + 2 ** 63) % 2 ** 64 - 2 ** 63)

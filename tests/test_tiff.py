"""Stacks and arrays in files of every kind, read whole and in parts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.sources import arrays, tiff

KINDS = [
    dict(compression=c, predictor=p, tile=t, strip_rows=s, big=b, order=o)
    for c, p, (t, s), (b, o) in itertools.product(("none", "lzw", "deflate", "packbits"), (1, 2), (((16, 32), None), (None, 7), (None, None)), ((False, "<"), (True, "<"), (False, ">")))
]


def smooth(dtype, seed=0, shape=(3, 37, 53)):
    z, y, x = np.indices(shape)
    v = 100 + 3 * z + y // 5 + x // 3 + np.random.default_rng(seed).integers(0, 3, shape)
    return v.astype(dtype)


@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4", "f8"])
def test_pages_of_every_codec_come_back(tmp_path, dtype):
    for kind in KINDS:
        if kind["predictor"] == 2 and dtype[0] == "f":
            kind = kind | {"predictor": 3}
        stack = smooth(dtype)
        (tmp_path / "a.tif").write_bytes(tiff.encode(stack, **kind))
        with (tmp_path / "a.tif").open("rb") as f:
            found = tiff.pages(f)
            assert len(found) == 3 and all((p.read(f) == s).all() for p, s in zip(found, stack, strict=True)), kind


def test_codecs_on_odd_bytes():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"aa", b"ab" * 5000, bytes(range(256)) * 40, rng.integers(0, 256, 30_000, np.uint8).tobytes(), rng.integers(0, 3, 60_000, np.uint8).tobytes(), b"\0" * 70_000):
        assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw and tiff.unpack_bits(tiff.pack_bits(raw)) == raw


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    tiff.register(spark)
    stacks = {f"s{k}.tif": smooth("u2", k, (9, 20, 30)) for k in range(3)}
    for n, s in stacks.items():
        (tmp_path / n).write_bytes(tiff.encode(s, "deflate", 2, big=n == "s1.tif"))
    (tmp_path / "_hidden.tif").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_bytes(b"no image")
    df = spark.read.format("fluorite_tiff").option("partitionBytes", 20 * 30 * 2 * 4).load(f"file://{tmp_path}/*.tif")
    assert df.rdd.getNumPartitions() == 9  # 4, 4 and 1 pages of each file
    got = {}
    for r in df.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], np.zeros((9, 20, 30)))[r.z, r.y, r.x] = r.v
    assert got.keys() == stacks.keys() and all((got[n] == s).all() for n, s in stacks.items())
    assert df.select(F.min("path")).first()[0] == f"file://{tmp_path}/s0.tif"
    # The older reader's files are read too.
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.tif").write_bytes(arrays.tiff_bytes(stacks["s0.tif"].astype("f8")))
    assert spark.read.format("fluorite_tiff").load(f"file://{tmp_path}/old").agg(F.sum("v")).first()[0] == stacks["s0.tif"].sum()


def test_arrays_are_read_in_ranges_of_rows(spark, tmp_path):
    tiff.register(spark)
    rng = np.random.default_rng(2)
    made = {"a": rng.normal(size=(100, 4)), "b": np.asfortranarray(rng.normal(size=(50, 3))), "c": rng.integers(0, 9, 70).astype("u2"), "d": np.zeros((0, 3)), "e": rng.normal(size=(10, 2, 5)).astype("f4")}
    for n, a in made.items():
        np.save(tmp_path / f"{n}.npy", a)
    df = spark.read.format("fluorite_npy").option("partitionBytes", 25 * 4 * 8).load(f"file://{tmp_path}")
    assert df.where("path like '%a.npy'").select(F.spark_partition_id()).distinct().count() == 4
    rows = df.collect()
    for n, a in made.items():
        own = {(r.row, r.col): r.value for r in rows if r.path.endswith(f"/{n}.npy")}
        flat = a.reshape(len(a), int(np.prod(a.shape[1:])))
        assert own == {(i, j): float(v) for (i, j), v in np.ndenumerate(flat)}


def test_broken_files_say_so(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"II*\0" + b"\0" * 3)
    with pytest.raises(Exception), (tmp_path / "a.tif").open("rb") as f:
        tiff.pages(f)
    ring = bytearray(tiff.encode(smooth("u1", shape=(2, 4, 4))))
    with (tmp_path / "a.tif").open("wb") as f:
        f.write(ring)
    two = tiff.encode(smooth("u1", shape=(1, 4, 4)), "lzw")
    broken = two.replace(b"\x05\x00\x00\x00", b"\x63\x00\x00\x00", 1)  # an unknown compression
    (tmp_path / "b.tif").write_bytes(broken)
    with (tmp_path / "b.tif").open("rb") as f, pytest.raises(ValueError, match="compression"):
        tiff.pages(f)[0].read(f)
    with pytest.raises(ValueError, match="no TIFF"), (tmp_path / "c").open("w+b") as f:
        f.write(b"PK\x03\x04" + b"\0" * 20)
        f.seek(0)
        tiff.pages(f)


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 2}/{k}.bin", bytes([k] * k)) for k in range(9)], "path string, content binary").repartition(3)
    for _ in range(2):
        tiff.write_files(rows, f"file://{tmp_path}/out")
    assert {f"{p.parent.name}/{p.name}": p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"f{k % 2}/{k}.bin": bytes([k] * k) for k in range(9)}

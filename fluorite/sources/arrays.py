"""Array files: NPY and NPZ as rows and back, and uncompressed TIFF stacks.

Readers take Spark's binaryFile rows, so any file system that Spark reads will do; a file is one row and is parsed by one
task. Writers give a binary column, one file's bytes in a row.
"""

from __future__ import annotations

import ast
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.functions.ranking import numbered

ROWS = "path string, member string, row long, col long, value double"


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def npy_array(raw: bytes) -> np.ndarray:
    """Version 1 to 3 headers; object arrays are refused."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no NPY file")
    wide = raw[6] > 1
    (size,) = struct.unpack_from("<I" if wide else "<H", raw, 8)
    at = 12 if wide else 10
    head = ast.literal_eval(raw[at : at + size].decode("utf-8" if raw[6] > 2 else "latin-1"))
    dtype = np.dtype(head["descr"])
    if dtype.hasobject:
        raise ValueError("an object array can't be read")
    data = np.frombuffer(raw, dtype, int(np.prod(head["shape"])), at + size)
    return data.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


#: Values that a reader's task holds as rows at a time.
SLICE = 1 << 18


def _rows(path: str, member: str, array: np.ndarray):
    """The array's values as batches of rows, a slice of the array each."""
    flat = array.reshape(len(array), -1) if array.ndim else array.reshape(1, 1)
    each = max(1, SLICE // max(1, flat.shape[1]))
    for k in range(0, len(flat), each):
        own = flat[k : k + each]
        row, col = np.indices(own.shape)
        n = own.size
        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n), "member": pa.array([member] * n), "row": pa.array(row.ravel() + k, pa.int64()), "col": pa.array(col.ravel(), pa.int64()), "value": pa.array(own.ravel().astype(np.float64))})


def array_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Values of NPY or NPZ files (path, content) in long form: path, member, row, col, value."""

    def parse(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for name in sorted(z.namelist()):
                            yield from _rows(p, name.removesuffix(".npy"), npy_array(z.read(name)))
                else:
                    yield from _rows(p, "", npy_array(raw))

    return files.select(F.col(path).cast("string"), F.col(content)).mapInArrow(parse, ROWS)


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return array_rows(files)


def spots_npy(spots: DataFrame, by: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """NPY files of (n, 3) coordinates in order of spot_id for each value of ``by``: path, first_row, content.

    A value's spots are dealt to files of ``rows_per_file``, each made by a task of its own: ``<value>/<part>.npy``. first_row is
    how many of its spots lie in the files before.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("spot_id")
        zyx = np.stack([group[a].to_numpy() for a in "zyx"], 1).astype("<i8")
        part = group["part"][0].as_py()
        return pa.table({"path": pa.array([f"{group['by'][0].as_py()}/{part:06}.npy"]), "first_row": pa.array([part * rows_per_file], pa.int64()), "content": pa.array([npy_bytes(zyx)], pa.binary())})

    rows = numbered(spots.select(F.col(by).cast("string").alias("by"), "spot_id", "z", "y", "x"), ["spot_id"], "rn", ["by"])
    rows = rows.withColumn("part", F.floor(F.col("rn") / rows_per_file).cast("long")).drop("rn")
    return rows.groupBy("by", "part").applyInArrow(pack, "path string, first_row long, content binary")


def ragged_npz(df: DataFrame, by: str, member: str, order: str, value: str) -> DataFrame:
    """An NPZ file for each ``by`` with a one-dimensional array for each ``member``, as long as that has rows: path, content.

    A file is made by one task, so ``by`` names what fits there, such as an image.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("member", "ascending"), ("at", "ascending")])
        names, values = group["member"].to_numpy(zero_copy_only=False), group["value"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        out = io.BytesIO()
        np.savez(out, **dict(zip(names[cuts], np.split(values, cuts[1:]), strict=True)))
        return pa.table({"path": pa.array([group["by"][0].as_py()]), "content": pa.array([out.getvalue()], pa.binary())})

    rows = df.select(F.col(by).cast("string").alias("by"), F.col(member).cast("string").alias("member"), F.col(order).alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("by").applyInArrow(pack, "path string, content binary")


def readable(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` whose content parses as NPY: the others are missing to what picks by priority."""

    def keep(batches):
        for b in batches:
            ok = []
            for raw in b.column(content).to_pylist():
                try:
                    npy_array(raw or b"")
                    ok.append(True)
                except (ValueError, SyntaxError, KeyError, TypeError, struct.error):
                    ok.append(False)
            yield b.filter(pa.array(ok, pa.bool_()))

    return files.mapInArrow(keep, files.schema)


# ---- TIFF -----------------------------------------------------------------------------------------------------------

#: Tags of the TIFF format, and struct letters of its value types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, PER_PIXEL, STRIP_ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}


def tiff_bytes(stack: np.ndarray) -> bytes:
    """A (planes, rows, columns) stack as little-endian TIFF, a page with one strip for each plane."""
    stack = np.ascontiguousarray(stack, stack.dtype.newbyteorder("<"))
    planes, rows, cols = stack.shape
    kind = {v: k for k, v in KINDS.items()}[stack.dtype.kind]
    size = rows * cols * stack.dtype.itemsize
    out, at = [], 8
    directory = 2 + 10 * 12 + 4
    for k in range(planes):
        data_at = at + directory
        tags = [(WIDTH, cols), (HEIGHT, rows), (BITS, 8 * stack.dtype.itemsize), (COMPRESSION, 1), (PHOTOMETRIC, 1), (OFFSETS, data_at), (PER_PIXEL, 1), (STRIP_ROWS, rows), (COUNTS, size), (FORMAT, kind)]
        at = data_at + size
        entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        out.append(struct.pack("<H", len(tags)) + entries + struct.pack("<I", at if k + 1 < planes else 0) + stack[k].tobytes())
    return struct.pack("<2sHI", b"II", 42, 8) + b"".join(out)


def tiff_stack(raw: bytes) -> np.ndarray:
    """Pages of one size and type, uncompressed, one value for each pixel, as (planes, rows, columns)."""
    e = {b"II": "<", b"MM": ">"}[raw[:2]]
    (at,) = struct.unpack_from(e + "I", raw, 4)
    pages = []
    while at:
        (n,) = struct.unpack_from(e + "H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * k)
            if kind in TYPES:
                size = struct.calcsize(TYPES[kind]) * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", raw, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{e}{count}{TYPES[kind]}", raw, place)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(PER_PIXEL, (1,))[0] != 1:
            raise ValueError("only uncompressed pages with one value for each pixel can be read")
        dtype = np.dtype(f"{e}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
        data = b"".join(raw[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        pages.append(np.frombuffer(data, dtype, tags[WIDTH][0] * tags[HEIGHT][0]).reshape(tags[HEIGHT][0], tags[WIDTH][0]))
        (at,) = struct.unpack_from(e + "I", raw, at + 2 + 12 * n)
    return np.stack(pages)


def stack_tiff(img: DataFrame, by: str) -> DataFrame:
    """One TIFF of float64 pages for each value of ``by``, from voxel rows of a dense stack: path, content."""

    def pack(group: pa.Table) -> pa.Table:
        z, y, x = (group[a].to_numpy() for a in "zyx")
        stack = np.zeros((z.max() - z.min() + 1, y.max() + 1, x.max() + 1))
        stack[z - z.min(), y, x] = group["v"].to_numpy()
        return pa.table({"path": pa.array([str(group["by"][0].as_py())]), "content": pa.array([tiff_bytes(stack)], pa.binary())})

    return img.select(F.col(by).cast("string").alias("by"), "z", "y", "x", "v").groupBy("by").applyInArrow(pack, "path string, content binary")


def tiff_rows(files: DataFrame) -> DataFrame:
    """Voxels of TIFF files (path, content): path, z (page), y, x, v."""

    def parse(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                stack = tiff_stack(raw)
                z, y, x = (a.ravel() for a in np.indices(stack.shape))
                yield pa.RecordBatch.from_pydict({"path": pa.array([p] * stack.size), "z": pa.array(z, pa.int64()), "y": pa.array(y, pa.int64()), "x": pa.array(x, pa.int64()), "v": pa.array(stack.ravel().astype(np.float64))})

    return files.select("path", "content").mapInArrow(parse, "path string, z long, y long, x long, v double")

"""TIFF stacks read in ranges of pages, and array files in ranges of rows, by Spark's Python data sources.

Planning reads headers alone: of a TIFF the chain of page directories, of an array file its head. Each partition is a few pages
or rows of one file, and the task that reads it seeks to their bytes, so a file may be larger than any task. Paths are files,
folders or patterns of one folder, on any file system that pyarrow opens.

    register(spark)
    spark.read.format("fluorite_tiff").load("hdfs:///stacks/*.tif")   # path, z, y, x, v
    spark.read.format("fluorite_npy").load("hdfs:///spots")            # path, row, col, value
"""

from __future__ import annotations

import ast
import fnmatch
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Decoded bytes of a partition, at least one page or row.
PARTITION_BYTES = 32 << 20
#: Values that a task gives as rows at a time.
SLICE = 1 << 18

# Tags of the TIFF format, sizes and struct letters of its value types, and codes of compressions.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "strip_rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "format"}
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
OLD_DEFLATE = 32946


# ---- codecs -----------------------------------------------------------------------------------------------------------


def unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while n < 128 and at + n < len(raw) and raw[at + n] == raw[at]:
            n += 1
        if n > 1:
            out += bytes((257 - n, raw[at]))
        else:
            while n < 128 and at + n < len(raw) and (at + n + 1 >= len(raw) or raw[at + n] != raw[at + n + 1]):
                n += 1
            out += bytes((n - 1,)) + raw[at : at + n]
        at += n
    return bytes(out)


CLEAR, END, FIRST = 256, 257, 258


def lzw_decode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early, as the format has it."""
    table = [bytes((k,)) for k in range(256)] + [b"", b""]
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            del table[FIRST:]
            width, last = 9, b""
            continue
        if last:
            if code > len(table):
                raise ValueError("a broken LZW stream")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        else:
            entry = table[code]
        out.append(entry)
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw_encode(raw: bytes) -> bytes:
    table, free, width = {bytes((k,)): k for k in range(256)}, FIRST, 9
    held, bits, out, own = CLEAR, 9, bytearray(), b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    for k in raw:
        more = own + bytes((k,))
        if more in table:
            own = more
            continue
        put(table[own])
        table[more], free, own = free, free + 1, bytes((k,))
        if free in (512, 1024, 2048):
            width += 1
        elif free == 4094:
            put(CLEAR)
            table, free, width = {bytes((k,)): k for k in range(256)}, FIRST, 9
    if own:
        put(table[own])
        free += 1
        width += free in (512, 1024, 2048)
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _decode(raw: bytes, compression: int) -> bytes:
    if compression == COMPRESSIONS["none"]:
        return raw
    if compression == COMPRESSIONS["lzw"]:
        return lzw_decode(raw)
    if compression in (COMPRESSIONS["deflate"], OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == COMPRESSIONS["packbits"]:
        return unpack_bits(raw)
    raise ValueError(f"compression {compression} can't be read")


def _undo(block: bytes, dtype: np.dtype, rows: int, cols: int, predictor: int) -> np.ndarray:
    """Rows of a strip or tile: 1 as they are, 2 differences along a row, 3 differences of the bytes of floats, by significance."""
    size = dtype.itemsize
    if predictor == 3:
        own = np.frombuffer(block, np.uint8, rows * cols * size).reshape(rows, cols * size)
        own = np.cumsum(own, axis=1, dtype=np.uint8).reshape(rows, size, cols)
        return np.ascontiguousarray(own.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols)
    own = np.frombuffer(block, dtype, rows * cols).reshape(rows, cols)
    return np.cumsum(own, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else own


# ---- pages ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    """What a directory says of its page: where its strips or tiles are, and how to read them."""

    height: int
    width: int
    dtype: str
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def n_bytes(self) -> int:
        return self.height * self.width * np.dtype(self.dtype).itemsize

    def read(self, f) -> np.ndarray:
        rows, cols = self.block
        out, across = np.zeros((self.height, self.width), np.dtype(self.dtype).newbyteorder("=")), -(-self.width // cols)
        for k, (offset, count) in enumerate(zip(self.offsets, self.counts, strict=True)):
            y, x = k // across * rows, k % across * cols
            high = rows if cols < self.width or self.height - y >= rows or across > 1 else self.height - y
            f.seek(offset)
            raw = _decode(f.read(count), self.compression)
            high = min(high, len(raw) // (cols * np.dtype(self.dtype).itemsize))
            own = _undo(raw, np.dtype(self.dtype), high, cols, self.predictor)
            part = out[y : y + high, x : x + cols]
            part[:] = own[: part.shape[0], : part.shape[1]]
        return out


def pages(f) -> list[Page]:
    """The pages of an open file, in order, from its directories alone; 32- and 64-bit offsets."""
    head = f.read(16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF file")
    e = "<" if head[:2] == b"II" else ">"
    (version,) = struct.unpack_from(e + "H", head, 2)
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    (at,) = struct.unpack_from(e + ("Q" if big else "I"), head, 8 if big else 4)
    count, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    out, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("the chain of pages runs in a circle")
        seen.add(at)
        f.seek(at)
        size = struct.calcsize(count)
        (n,) = struct.unpack(e + count, f.read(size))
        raw = f.read(n * entry + struct.calcsize(place))
        tags = {}
        for k in range(n):
            tag, kind, values = struct.unpack_from(e + "HH" + place, raw, k * entry)
            if tag not in TAGS or kind not in TYPES:
                continue
            letters, spot = f"{e}{values}{TYPES[kind]}", k * entry + 4 + struct.calcsize(place)
            if struct.calcsize(letters) <= struct.calcsize(place):
                tags[TAGS[tag]] = struct.unpack_from(letters, raw, spot)
            else:
                f.seek(struct.unpack_from(e + place, raw, spot)[0])
                tags[TAGS[tag]] = struct.unpack(letters, f.read(struct.calcsize(letters)))
        one = {k: v[0] for k, v in tags.items() if v}
        if one.get("samples", 1) != 1:
            raise ValueError("only pages with one value for each pixel can be read")
        tiled = "tile_width" in one
        block = (one["tile_height"], one["tile_width"]) if tiled else (min(one.get("strip_rows", one["height"]), one["height"]), one["width"])
        dtype = np.dtype(f"{e}{KINDS[one.get('format', 1)]}{one['bits'] // 8}").str
        out.append(Page(one["height"], one["width"], dtype, one.get("compression", 1), one.get("predictor", 1), block, tags["tile_offsets" if tiled else "offsets"], tags["tile_counts" if tiled else "counts"]))
        (at,) = struct.unpack_from(e + place, raw, n * entry)
    return out


def encode(stack: np.ndarray, compression: str = "none", predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int | None = None, big: bool = False, order: str = "<") -> bytes:
    """A (planes, rows, columns) stack as TIFF, a page for each plane; ``big``: with 64-bit offsets."""
    stack = np.ascontiguousarray(stack, stack.dtype.newbyteorder(order))
    planes, height, width = stack.shape
    code, kind = COMPRESSIONS[compression], {v: k for k, v in KINDS.items()}[stack.dtype.kind]
    rows, cols = tile or (strip_rows or height, width)
    count, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    four, wide = (16, 8) if big else (4, 4)
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8)
    out = [head]
    at = len(head)
    for k in range(planes):
        blocks = []
        for y in range(0, height, rows):
            for x in range(0, width, cols):
                own = stack[k, y : y + rows, x : x + cols]
                if tile:
                    own = np.pad(own, ((0, rows - own.shape[0]), (0, cols - own.shape[1])))
                if predictor == 2:
                    own = np.concatenate([own[:, :1], own[:, 1:] - own[:, :-1]], 1).astype(stack.dtype)
                raw = np.ascontiguousarray(own)
                if predictor == 3:
                    size = stack.dtype.itemsize
                    split = raw.astype(stack.dtype.newbyteorder(">")).view(np.uint8).reshape(len(own), -1, size).transpose(0, 2, 1).reshape(len(own), -1)
                    raw = np.concatenate([split[:, :1], split[:, 1:] - split[:, :-1]], 1)
                raw = raw.tobytes()
                blocks.append(raw if code == 1 else lzw_encode(raw) if code == 5 else zlib.compress(raw) if code == 8 else pack_bits(raw))
        tags = {256: [width], 257: [height], 258: [8 * stack.dtype.itemsize], 259: [code], 262: [1], 277: [1], 317: [predictor], 339: [kind]}
        names = (324, 325) if tile else (273, 279)
        tags |= {322: [cols], 323: [rows]} if tile else {278: [rows]}
        size = struct.calcsize("<" + count) + entry * (len(tags) + 2) + wide
        lists = at + size
        data = lists + (2 * wide * len(blocks) if len(blocks) > 1 else 0)
        starts = np.cumsum([data, *map(len, blocks)]).tolist()
        tags |= {names[0]: starts[:-1], names[1]: list(map(len, blocks))}
        made, spill = [], b""
        for tag in sorted(tags):
            values = tags[tag]
            if len(values) == 1:
                made.append(struct.pack(f"{order}HH{place}{place}", tag, four, 1, values[0]))
            else:
                made.append(struct.pack(f"{order}HH{place}{place}", tag, four, len(values), lists + len(spill)))
                spill += struct.pack(f"{order}{len(values)}{place}", *values)
        at = starts[-1]
        out += [struct.pack(order + count, len(tags)), *made, struct.pack(order + place, at if k + 1 < planes else 0), spill, *blocks]
    return b"".join(out)


# ---- data sources -----------------------------------------------------------------------------------------------------


def files(path: str) -> list[tuple[fs.FileSystem, str, str]]:
    """(file system, path on it, path as it was given) of each file that ``path`` names; hidden files don't count."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    at = at.rstrip("/")
    root = path[: len(path.rstrip("/")) - len(at)]
    folder, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        found = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, name)]
    else:
        (info,) = system.get_file_info([at])
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [at] if info.type == fs.FileType.File else [i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    return [(system, p, root + p) for p in sorted(found) if not p.rsplit("/", 1)[1].startswith((".", "_"))]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    parts: tuple


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))


class TiffReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for system, at, path in files(self.path):
            with system.open_input_file(at) as f:
                every = pages(f)
            first = held = 0
            for k, p in enumerate(every):
                held += p.n_bytes
                if held >= self.size or k + 1 == len(every):
                    out.append(Range(path, first, tuple(every[first : k + 1])))
                    first, held = k + 1, 0
        return out

    def read(self, partition: Range):
        ((system, at, path),) = files(partition.path)
        with system.open_input_file(at) as f:
            for z, page in enumerate(partition.parts, partition.first):
                own = page.read(f)
                for y0 in range(0, len(own), each := max(1, SLICE // own.shape[1])):
                    part = own[y0 : y0 + each]
                    y, x = (a.ravel() for a in np.indices(part.shape))
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path] * part.size), "z": pa.array(np.full(part.size, z, np.int64)), "y": pa.array(y + y0), "x": pa.array(x), "v": pa.array(part.ravel().astype(np.float64))})


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fluorite_tiff"

    def schema(self) -> str:
        return "path string, z long, y long, x long, v double"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def npy_head(f) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """dtype, shape, whether columns come first, and where the values begin, of an open array file."""
    raw = f.read(12)
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no NPY file")
    wide = raw[6] > 1
    (size,) = struct.unpack_from("<I" if wide else "<H", raw, 8)
    f.seek(12 if wide else 10)
    head = ast.literal_eval(f.read(size).decode("utf-8" if raw[6] > 2 else "latin-1"))
    dtype = np.dtype(head["descr"])
    if dtype.hasobject:
        raise ValueError("an object array can't be read")
    return dtype, tuple(head["shape"]), head["fortran_order"], (12 if wide else 10) + size


class NpyReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for system, at, path in files(self.path):
            with system.open_input_file(at) as f:
                dtype, shape, columns_first, _ = npy_head(f)
            rows, row = (shape[0], int(np.prod(shape[1:])) * dtype.itemsize) if shape else (1, dtype.itemsize)
            # With columns first a row's values lie apart, so such a file of several columns is one partition.
            each = max(1, rows) if columns_first and len(shape) > 1 else max(1, self.size // max(1, row))
            out += [Range(path, k, (min(each, rows - k),)) for k in range(0, rows, each)]
        return out

    def read(self, partition: Range):
        ((system, at, path),) = files(partition.path)
        with system.open_input_file(at) as f:
            dtype, shape, columns_first, begin = npy_head(f)
            cols, n = int(np.prod(shape[1:])), partition.parts[0]
            if columns_first and len(shape) > 1:
                f.seek(begin)
                whole = np.frombuffer(f.read(), dtype, shape[0] * cols).reshape(shape, order="F").reshape(shape[0], cols)
            for k in range(partition.first, partition.first + n, each := max(1, SLICE // max(1, cols))):
                m = min(each, partition.first + n - k)
                if columns_first and len(shape) > 1:
                    own = whole[k : k + m]
                else:
                    f.seek(begin + k * cols * dtype.itemsize)
                    own = np.frombuffer(f.read(m * cols * dtype.itemsize), dtype, m * cols).reshape(m, cols)
                row, col = (a.ravel() for a in np.indices(own.shape))
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * own.size, pa.string()), "row": pa.array(row + k, pa.int64()), "col": pa.array(col, pa.int64()), "value": pa.array(own.ravel().astype(np.float64))})


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fluorite_npy"

    def schema(self) -> str:
        return "path string, row long, col long, value double"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (TiffSource, NpySource):
        spark.dataSource.register(source)


def write_files(rows: DataFrame, folder: str, name: str = "path", content: str = "content") -> None:
    """Each row's bytes as a file of ``folder``. A file appears whole under its name, so a task may be repeated."""

    def write(batches):
        for b in batches:
            system, at = fs.FileSystem.from_uri(folder)
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{at}/{n}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                part = f"{to.rpartition('/')[0]}/._{n.rpartition('/')[2]}.{id(batches):x}"
                with system.open_output_stream(part) as f:
                    f.write(raw)
                system.move(part, to)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows.select(F.col(name), F.col(content)).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def stack_files(img: DataFrame, by: str, codec: str) -> DataFrame:
    """One TIFF of float64 pages for each value of ``by``, from voxel rows of a dense stack: path, content.

    ``codec``: a column with the compression's name, the same for a whole stack; LZW and deflate get differences of bytes first.
    """

    def pack(group: pa.Table) -> pa.Table:
        z, y, x = (group[a].to_numpy() for a in "zyx")
        stack = np.zeros((z.max() - z.min() + 1, y.max() + 1, x.max() + 1))
        stack[z - z.min(), y, x] = group["v"].to_numpy()
        name = group["codec"][0].as_py()
        raw = encode(stack, name, 3 if name in ("lzw", "deflate") else 1, big=name == "packbits")
        return pa.table({"path": pa.array([f"{group['by'][0].as_py()}.tif"]), "content": pa.array([raw], pa.binary())})

    rows = img.select(F.col(by).cast("string").alias("by"), F.col(codec).alias("codec"), "z", "y", "x", "v")
    return rows.groupBy("by").applyInArrow(pack, "path string, content binary")

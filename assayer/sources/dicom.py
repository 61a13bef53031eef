"""A Spark data source of DICOM images: explicit-VR little-endian files, one partition a file; damaged files are rows with an error.

    spark.dataSource.register(DicomSource)
    spark.read.format("dicom").load("hdfs://.../scans")

Files whose names end in the option `suffixes` (.dcm,.dicom) under the path are read, on any file system that pyarrow opens.
Pixels are numbers by row, with the file's slope and intercept; of inverted images (MONOCHROME1) they are turned about.
A file that is cut off, compressed, of several samples or no DICOM at all gives its path and what is wrong.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, height int, width int, bits int, photometric string, modality string, px array<double>, error string"
_TYPES = {"path": pa.string(), "height": pa.int32(), "width": pa.int32(), "bits": pa.int32(), "photometric": pa.string(), "modality": pa.string(), "px": pa.list_(pa.float64()), "error": pa.string()}
# Fixed values of the format: the syntax that is read, representations with long lengths, and tags.
EXPLICIT_LITTLE_ENDIAN = "1.2.840.10008.1.2.1"
LONG = frozenset(b"OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
SYNTAX, MODALITY, SAMPLES, PHOTOMETRIC, ROWS, COLUMNS = (2, 0x10), (8, 0x60), (0x28, 2), (0x28, 4), (0x28, 0x10), (0x28, 0x11)
BITS, SIGNED, INTERCEPT, SLOPE, PIXELS = (0x28, 0x100), (0x28, 0x103), (0x28, 0x1052), (0x28, 0x1053), (0x7FE0, 0x10)
UNDEFINED = 0xFFFFFFFF


class Damaged(ValueError):
    pass


def _head(data: bytes, at: int) -> tuple[tuple[int, int], bytes, int, int]:
    """(tag, representation, length, where the value begins) of the element at an offset; items have no representation."""
    if at + 8 > len(data):
        raise Damaged("the file ends within an element")
    tag = struct.unpack_from("<HH", data, at)
    if tag[0] == 0xFFFE:
        return tag, b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
    kind = data[at + 4 : at + 6]
    if kind in LONG:
        if at + 12 > len(data):
            raise Damaged("the file ends within an element")
        return tag, kind, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, kind, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _after(data: bytes, at: int, end: tuple[int, int]) -> int:
    """Where elements of unknown length end: past the delimiter, whatever sequences lie in between."""
    open_ends = [end]
    while open_ends:
        tag, kind, length, at = _head(data, at)
        if tag == open_ends[-1]:
            open_ends.pop()
        elif length == UNDEFINED:
            open_ends.append(ITEM_END if tag == ITEM else SEQUENCE_END)
        elif tag != ITEM or open_ends[-1] != SEQUENCE_END or length:
            at += length
    return at


def elements(data: bytes) -> dict[tuple[int, int], bytes]:
    """The values of a file's elements outside sequences."""
    if data[128:132] != b"DICM":
        raise Damaged("no DICOM file")
    found, at = {}, 132
    while at < len(data):
        tag, kind, length, at = _head(data, at)
        if length == UNDEFINED:
            if tag == PIXELS:
                raise Damaged("compressed pixels")
            at = _after(data, at, SEQUENCE_END)
            continue
        if at + length > len(data):
            raise Damaged("the file ends within a value")
        if kind != b"SQ":
            found[tag] = data[at : at + length]
        at += length
        if tag[0] > 2 and SYNTAX in found and _text(found, SYNTAX) != EXPLICIT_LITTLE_ENDIAN:
            raise Damaged(f"transfer syntax {_text(found, SYNTAX)}")
    return found


def _text(found: dict, tag: tuple[int, int], other: str = "") -> str:
    return found[tag].decode("latin-1").strip(" \0") if tag in found else other


def _number(found: dict, tag: tuple[int, int], other: int | None = None) -> int:
    if tag not in found:
        if other is None:
            raise Damaged(f"no element {tag[0]:04x},{tag[1]:04x}")
        return other
    return struct.unpack_from("<H", found[tag])[0]


def image(data: bytes) -> dict:
    """height, width, bits, photometric, modality, px of a file's bytes."""
    found = elements(data)
    height, width, bits = (_number(found, t) for t in (ROWS, COLUMNS, BITS))
    if _number(found, SAMPLES, 1) != 1 or bits not in (8, 16):
        raise Damaged("more than one sample a pixel, or a size other than 8 or 16 bits")
    if len(found.get(PIXELS, b"")) < height * width * bits // 8:
        raise Damaged("pixels are missing")
    kind = f"<{'i' if _number(found, SIGNED, 0) else 'u'}{bits // 8}"
    px = np.frombuffer(found[PIXELS], kind, height * width).astype(float) * float(_text(found, SLOPE, "1")) + float(_text(found, INTERCEPT, "0"))
    photometric = _text(found, PHOTOMETRIC, "MONOCHROME2")
    if photometric == "MONOCHROME1" and len(px):
        px = px.max() + px.min() - px
    return {"height": height, "width": width, "bits": bits, "photometric": photometric, "modality": _text(found, MODALITY) or None, "px": px}


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class DicomReader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...]):
        self.path, self.suffixes = path, suffixes

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the path there, and what comes before a path in a URI."""
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path, ""
        files, inner = fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))
        return files, inner, self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""

    def partitions(self) -> list[File]:
        files, inner, _ = self._place()
        info = files.get_file_info(inner)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(inner, recursive=True))
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and (info.is_file or x.path.lower().endswith(self.suffixes))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # an empty folder
            return
        files, _, before = self._place()
        row = dict.fromkeys(_TYPES)
        row["path"] = before + partition.value
        try:
            with files.open_input_stream(partition.value) as stream:
                row |= image(stream.read())
        except (ValueError, OSError, struct.error) as e:
            row["error"] = str(e)
        yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in _TYPES.items()], list(_TYPES))


class DicomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DicomReader:
        return DicomReader(self.options["path"], tuple(x.strip().lower() for x in self.options.get("suffixes", ".dcm,.dicom").split(",")))

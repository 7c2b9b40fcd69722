"""Media columns: content-addressed payloads in tar shards, referenced by digest, offset and length.

A text's bytes, padded with 255 to rows of 576 samples, become an 8-bit greyscale PNG (lossless). Each task appends
its images to a tar shard of its own in the shared folder, equal images once a shard, and emits references. A digest's
address, for the whole table, is the first of its members (by shard and offset): all rows with equal texts refer to
that one, whichever tasks met them, and only that one is ever read. Metadata columns are filled from range reads of the
first bytes alone; features from the whole payload, read back by range, once for each digest.

A retried task writes a shard under a new name, so references never point into a half-written file; references are
stored before anything reads them, and every later step can be repeated from them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

ROW = 576
FILLER = 255
#: Of compression: 6 takes a sixth less room than 1.
LEVEL = 6
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 256 << 20
#: Fixed values of the PNG format: signature, and how many bytes hold it and the header chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
BLOCK = 512
#: Bytes of payloads that a task reads back, in stretches of a shard of so many.
READ_BYTES, STRETCH = 16 << 20, 2 << 20


def padded(data: bytes) -> bytes:
    """The data with filler up to a positive multiple of ROW."""
    return data + bytes([FILLER]) * (ROW - len(data) if not data else -len(data) % ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image, ROW samples wide, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter type 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> np.ndarray:
    """The samples, checked against the checksums of all chunks."""
    width, height, depth = png_header(media[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit lines are expected")
    return lines[:, 1:].reshape(-1)


def feature(samples: np.ndarray) -> str:
    """Mean and variance (in hundredths, integers), a 16-bin histogram in ten-thousandths, and the mean step."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    bins = np.bincount(samples >> 4, minlength=16) * 10_000 // n
    step = int(np.abs(np.diff(x)).sum()) * 100 // max(n - 1, 1)
    return f"m{total * 100 // n};v{(squares * n - total * total) * 100 // (n * n)};d{step};h" + ",".join(map(str, bins.tolist()))


class ShardWriter:
    """Appends members to tar files under ``root``; a member equal to an earlier one of the shard is stored once."""

    def __init__(self, root: str, most: int = SHARD_BYTES):
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.files.create_dir(self.root, recursive=True)
        self.most, self.out, self.at, self.known = most, None, 0, {}

    def add(self, digest: bytes, data: bytes) -> tuple[str, int]:
        """(shard, offset) of the member."""
        if digest in self.known:
            return self.name, self.known[digest]
        if self.out is None or self.at >= self.most:
            self.close()
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out, self.at, self.known = self.files.open_output_stream(f"{self.root}/{self.name}"), 0, {}
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.known[digest] = self.at + len(head)
        self.out.write(head + data + bytes(-len(data) % BLOCK))
        self.at += len(head) + len(data) + -len(data) % BLOCK
        return self.name, self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            self.out = None


def write(docs: DataFrame, root: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store each text's payload under ``root`` and return stored references.

    Columns: doc_id, n_bytes, digest (sha256 of the stored form, 32 bytes), shard, offset, length. A null text counts
    as empty; null ids and repeated rows each give a reference; an empty table gives none. Equal texts of one task refer
    to one member; :func:`addresses` chooses one for all.
    """
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, by_text = ShardWriter(root), {}
        try:
            for batch in base.slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), base.text_of(batch).to_pylist(), strict=True):
                    data = text.encode()
                    key = hashlib.sha256(data).digest()
                    if key in by_text and by_text[key][1] == getattr(shards, "name", None):
                        digest, shard, offset, length = by_text[key]
                    else:
                        media = to_png(padded(data))
                        digest, length = hashlib.sha256(media).digest(), len(media)
                        before = getattr(shards, "name", None)
                        shard, offset = shards.add(digest, media)
                        if shard != before:
                            by_text.clear()
                        by_text[key] = (digest, shard, offset, length)
                    rows.append((doc_id, len(data), digest, shard, offset, length))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    out = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
    return base.stored(picked.mapInArrow(run, out), "media-references")


def addresses(references: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one member for each digest, dealt out by stretches of a shard, in its order.

    The partitions are as many as the stored bytes need; a row is a few bytes here, but stands for a payload.
    """
    total = references.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    first = references.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return first.repartition(max(1, -(-total // READ_BYTES)), "shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")


class ShardReader:
    """Range reads from shards; keeps the last one open."""

    def __init__(self, root: str):
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.files.open_input_file(f"{self.root}/{shard}")
        data = self.file.read_at(n, offset)
        if len(data) != n:
            raise OSError(f"{shard} ends before {offset + n}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def probe(references: DataFrame, root: str) -> DataFrame:
    """References with ``width``, ``height`` and ``bit_depth``, each from a range read of the first bytes alone.

    A row for each row; a damaged or missing header is an error; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader(root)
        for batch in batches:
            found = [png_header(shards.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            extra = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "width", "height", "bit_depth"])
        shards.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in references.schema.fields)
    return references.mapInArrow(run, f"{schema}, width long, height long, bit_depth long")


def read_features(references: DataFrame, root: str) -> DataFrame:
    """References with digests and features of the payloads, all computed from the stored bytes.

    A row for each row, equal references equal values; a damaged payload is an error; an empty table gives an empty
    result.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def look(media: bytes) -> tuple:
        samples = from_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen, at = ShardReader(root), {}, None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != at:
                    seen, at = {}, shard
                if offset not in seen:
                    seen[offset] = look(shards.read(shard, offset, length))
                found.append(seen[offset])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))] if found else [*batch.columns, *(pa.array([], t) for t in kinds)], [*batch.schema.names, *names])
        shards.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in references.schema.fields)
    return references.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store every text as media and return what its stored bytes show.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, shard, offset,
    length, width, height, bit_depth. Equal texts have equal values, shard and offset included; null texts count as
    empty. Without ``root`` the shards are scratch in the shared folder.
    """
    root = root or base.scratch(docs.sparkSession, "media")
    references = write(docs, root, id_column, text_column)
    found = base.stored(read_features(probe(addresses(references), root), root), "media-features")
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "bit_depth")
    return references.select("doc_id", "n_bytes", "digest").join(found, "digest").select(F.col("doc_id").alias(id_column), *names)


def members(shard: bytes) -> dict[str, bytes]:
    """All members of a shard, as any tar reader finds them (for tests and exports of small shards)."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as t:
        return {m.name: t.extractfile(m).read() for m in t}

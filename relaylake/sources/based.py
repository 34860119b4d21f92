"""The compact binary event codec and a Spark data source over its files.

A data file is a sequence of events; an index file of fixed-width rows gives
where each begins. Both start with the same four bytes.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..protocol import quote
from ..schema import EVENT

MAGIC = bytes([0xBA, 0x53, 0xED, 0x01])
INDEX = struct.Struct("<QqqHxx32s32s")
#: Record sizes: this one, and that of files made before expiry was kept.
OLD_INDEX_SIZE = INDEX.size - 8
HEAD = struct.Struct("<32s32s64sqH")
DATA_FILE, INDEX_FILE = "data.n", "index.o"


_WHOLE = re.compile(r"[+-]?[0-9]+")


class CodecError(ValueError):
    pass


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place)."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise CodecError("buffer too small")
        if shift >= 64:
            raise CodecError("varint overflow")
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _field(text: str, compress: bool) -> bytes:
    raw = text.encode()
    flag = 0
    if compress and len(raw) >= 8 and len(raw) % 2 == 0 and all(c in b"0123456789abcdef" for c in raw):
        raw, flag = bytes.fromhex(text), 128
    return (bytes([flag | len(raw)]) if len(raw) < 127 else bytes([flag | 127]) + encode_varint(len(raw))) + raw


def _read_field(data: bytes, at: int) -> tuple[str, int]:
    if at >= len(data):
        raise CodecError("buffer too small")
    flag, size = data[at] & 128, data[at] & 127
    at += 1
    if size == 127:
        size, at = decode_varint(data, at)
    raw = data[at : at + size]
    if len(raw) < size:
        raise CodecError("buffer too small")
    return raw.hex() if flag else raw.decode(), at + size


def serialize(event: dict, compress: bool = True) -> bytes:
    """Bytes of an event; with ``compress`` fields of lower-case hex take half the room."""
    if any(len(t) > 255 for t in event["tags"]):
        raise CodecError("too many tags")
    tags = encode_varint(len(event["tags"])) + b"".join(bytes([len(t)]) + b"".join(_field(f, compress) for f in t) for t in event["tags"])
    head = HEAD.pack(*(bytes.fromhex(event[k]) for k in ("id", "pubkey", "sig")), event["created_at"], event["kind"])
    return head + encode_varint(len(tags)) + tags + _field(event["content"], compress)


def deserialize(data: bytes) -> dict:
    if len(data) < HEAD.size:
        raise CodecError("buffer too small")
    ids, created_at, kind = HEAD.unpack_from(data)[:3], *HEAD.unpack_from(data)[3:]
    size, at = decode_varint(data, HEAD.size)
    end = at + size
    count, at = decode_varint(data, at)
    tags = []
    for _ in range(count):
        n, at = data[at], at + 1
        tag = []
        for _ in range(n):
            value, at = _read_field(data, at)
            tag.append(value)
        tags.append(tag)
    if at != end:
        raise CodecError("invalid tag section")
    content, _ = _read_field(data, at)
    return dict(zip(("id", "pubkey", "sig"), (x.hex() for x in ids), strict=True)) | {"created_at": created_at, "kind": kind, "tags": tags, "content": content}


def expiry_of(tags: list[list[str]]) -> int:
    """The time of the first expiration tag that holds a whole number, or 0."""
    for t in tags:
        if len(t) > 1 and t[0] == "expiration" and _WHOLE.fullmatch(t[1]) and -(2**63) <= int(t[1]) < 2**63:
            return int(t[1])
    return 0


def index_record(event: dict, offset: int) -> bytes:
    """Offset, time, expiry (0 for none), kind, id and author of an event, in 92 bytes."""
    return INDEX.pack(offset, event["created_at"], expiry_of(event["tags"]), event["kind"], bytes.fromhex(event["id"]), bytes.fromhex(event["pubkey"]))


def frame_of(data: bytes, sub_id: str) -> str:
    """The ["EVENT", sub_id, event] message of a stored event, straight from its bytes."""
    e = deserialize(data)
    tags = ",".join("[" + ",".join(map(quote, t)) + "]" for t in e["tags"])
    return f'["EVENT",{quote(sub_id)},{{"id":"{e["id"]}","pubkey":"{e["pubkey"]}","created_at":{e["created_at"]},"kind":{e["kind"]},"tags":[{tags}],"content":{quote(e["content"])},"sig":"{e["sig"]}"}}]'


def created_at_of(data: bytes) -> int:
    return struct.unpack_from("<q", data, 128)[0]


class _Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BinaryReader(DataSourceReader):
    """Reads runs of index rows; an event ends where the next one begins."""

    rows_per_task = 50_000

    def __init__(self, path: str):
        self.path = path
        with open(f"{path}/{INDEX_FILE}", "rb") as f:
            if f.read(4) != MAGIC:
                raise CodecError("index file without header")
        with open(f"{path}/{DATA_FILE}", "rb") as f:
            if f.read(4) != MAGIC:
                raise CodecError("data file without header")
        size = os.path.getsize(f"{path}/{INDEX_FILE}") - 4
        if size % INDEX.size:
            raise CodecError("index file of an older layout" if size % OLD_INDEX_SIZE == 0 else "index file with a broken record")
        self.count = size // INDEX.size

    def partitions(self) -> list[InputPartition]:
        return [_Span(a, min(self.count, a + self.rows_per_task)) for a in range(0, self.count, self.rows_per_task)] or [_Span(0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open(f"{self.path}/{INDEX_FILE}", "rb") as index, open(f"{self.path}/{DATA_FILE}", "rb") as data:
            index.seek(4 + partition.first * INDEX.size)
            starts = [INDEX.unpack(index.read(INDEX.size))[0] for _ in range(partition.first, min(self.count, partition.last + 1))]
            if partition.last == self.count:
                starts.append(os.path.getsize(f"{self.path}/{DATA_FILE}"))
            for seq, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True), partition.first):
                data.seek(a)
                e = deserialize(data.read(b - a))
                yield seq, e["id"], e["pubkey"], e["sig"], e["created_at"], e["kind"], e["tags"], e["content"]


class BinaryWriter(DataSourceWriter):
    """Writes one part per task and joins the parts, in order of ``seq``, on commit."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = f"{self.path}/.part-{TaskContext.get().taskAttemptId()}"
        rows = sorted(iterator, key=lambda r: r["seq"])
        with open(part, "wb") as f:
            for r in rows:
                blob = serialize({k: r[k] for k in ("id", "pubkey", "sig", "created_at", "kind", "tags", "content")}, compress=False)
                f.write(struct.pack("<qI", r["seq"], len(blob)) + blob)
        return _Part(part)

    def commit(self, messages: list) -> None:
        import heapq

        def records(path: str) -> Iterator[tuple[int, bytes]]:
            with open(path, "rb") as f:
                while head := f.read(12):
                    seq, size = struct.unpack("<qI", head)
                    yield seq, f.read(size)

        with open(f"{self.path}/{DATA_FILE}", "wb") as data, open(f"{self.path}/{INDEX_FILE}", "wb") as index:
            data.write(MAGIC)
            index.write(MAGIC)
            for _, blob in heapq.merge(*[records(m.path) for m in messages if m], key=lambda r: r[0]):
                event = deserialize(blob)
                index.write(index_record(event, data.tell()))
                data.write(blob)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class _Part(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class BinaryEvents(DataSource):
    """``spark.read.format("relay_binary").load(path)``, for a path that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "relay_binary"

    def schema(self) -> StructType:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinaryReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BinaryWriter(self.options["path"])

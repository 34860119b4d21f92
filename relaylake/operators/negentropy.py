"""Set reconciliation: fingerprints, differences and the range-based protocol (version 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROTOCOL, SKIP, FINGERPRINT, ID_LIST = 0x61, 0, 1, 2
INFINITY = 2**64 - 1
BUCKETS = 16


def varint(n: int) -> bytes:
    """Base 128, most significant digit first."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def fingerprint_of(total: int, count: int) -> bytes:
    return hashlib.sha256((total % 2**256).to_bytes(32, "little") + varint(count)).digest()[:16]


def fingerprint(items: DataFrame) -> str:
    """Fingerprint of a set of ids, as hex: the sum of ids as little-endian numbers, their count, hashed.

    The sum is one aggregate of eight 32-bit limbs; carries are settled on the driver.
    """
    limb = lambda k: F.conv(F.concat(*[F.substr("id", F.lit(8 * k + 2 * b + 1), F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("decimal(38,0)")
    row = items.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(limb(k)), F.lit(0)).alias(f"l{k}") for k in range(8)]).first()
    return fingerprint_of(sum(int(row[f"l{k}"]) << (32 * k) for k in range(8)), row.n).hex()


def difference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(side, created_at, id): "have" is ours only, "need" is theirs only."""
    both = ours.select(F.lit("have").alias("side"), "created_at", "id").unionAll(theirs.select(F.lit("need"), "created_at", "id"))
    # Each row moves once, by id; a side that is alone under its id has what the other lacks.
    w = Window.partitionBy("id")
    return both.select("*", (F.min("side").over(w) == F.max("side").over(w)).alias("alone")).where("alone or id is null").drop("alone")


class Session:
    """One side of a reconciliation over a snapshot of (created_at, id), sorted.

    ``initiate`` makes the first message; ``reconcile`` answers one. The initiator
    learns have and need ids and is done when its answer is None.
    """

    def __init__(self, items: Iterable[tuple[int, str]], initiator: bool = False):
        self.items = sorted((t, bytes.fromhex(i)) for t, i in items)
        self.initiator = initiator
        self.have: set[str] = set()
        self.need: set[str] = set()

    def initiate(self) -> bytes:
        out = _Writer()
        self._split(0, len(self.items), (INFINITY, b""), out)
        return bytes([PROTOCOL]) + out.done()

    def reconcile(self, message: bytes) -> bytes | None:
        if not message or message[0] != PROTOCOL:
            if message and 0x60 <= message[0] <= 0x6F and not self.initiator:
                return bytes([PROTOCOL])
            raise ValueError("unsupported negentropy protocol version")
        read, out = _Reader(message[1:]), _Writer()
        low = at = 0
        while read.more():
            bound = read.bound()
            mode = read.varint()
            high = self._lower_bound(bound, at)
            mine = self.items[at:high]
            if mode == SKIP:
                out.skip(bound)
            elif mode == FINGERPRINT:
                theirs = read.take(16)
                if theirs == self._fingerprint(mine):
                    out.skip(bound)
                else:
                    self._split(at, high, bound, out)
            elif mode == ID_LIST:
                theirs = {read.take(32) for _ in range(read.varint())}
                own = {i for _, i in mine}
                if self.initiator:
                    self.have |= {i.hex() for i in own - theirs}
                    self.need |= {i.hex() for i in theirs - own}
                    out.skip(bound)
                else:
                    out.ids(bound, [i for _, i in mine])
            else:
                raise ValueError("unexpected negentropy mode")
            low, at = high, high
        body = out.done()
        del low
        if self.initiator and not body:
            return None
        return bytes([PROTOCOL]) + body

    def _fingerprint(self, part: list[tuple[int, bytes]]) -> bytes:
        return fingerprint_of(sum(int.from_bytes(i, "little") for _, i in part), len(part))

    def _lower_bound(self, bound: tuple[int, bytes], start: int) -> int:
        low, high = start, len(self.items)
        while low < high:
            mid = (low + high) // 2
            if self.items[mid] < bound:
                low = mid + 1
            else:
                high = mid
        return low

    def _split(self, a: int, b: int, bound: tuple[int, bytes], out: _Writer) -> None:
        if b - a < 2 * BUCKETS:
            out.ids(bound, [i for _, i in self.items[a:b]])
            return
        each, extra = divmod(b - a, BUCKETS)
        at = a
        for k in range(BUCKETS):
            end = at + each + (k < extra)
            edge = bound if end == b else _between(self.items[end - 1], self.items[end])
            out.fingerprint(edge, self._fingerprint(self.items[at:end]))
            at = end


def _between(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    """The shortest bound above ``a`` and not above ``b``."""
    if a[0] != b[0]:
        return b[0], b""
    same = next(k for k in range(32) if a[1][k] != b[1][k])
    return b[0], b[1][: same + 1]


class Sessions:
    """The reconciliations of one connection, by subscription name; each works on the snapshot of its opening.

    Answers are (payload, "") or (None, reason); an error ends the session.
    """

    def __init__(self, max_records: int = 500_000, most: int = 20):
        self.max_records, self.most, self.open_ = max_records, most, {}

    def open(self, sub_id: str, items: DataFrame, payload: bytes) -> tuple[bytes | None, str]:
        """Start over (created_at, id) rows, in place of an earlier session of that name."""
        self.open_.pop(sub_id, None)
        if len(self.open_) >= self.most:
            return None, "too many subscriptions"
        rows = items.select("created_at", "id").limit(self.max_records + 1).collect()
        if len(rows) > self.max_records:
            return None, "too many records for negentropy session"
        self.open_[sub_id] = Session([(r.created_at, r.id) for r in rows])
        return self.message(sub_id, payload)

    def message(self, sub_id: str, payload: bytes) -> tuple[bytes | None, str]:
        session = self.open_.get(sub_id)
        if session is None:
            return None, "session not found"
        try:
            return session.reconcile(payload), ""
        except ValueError as e:
            self.close(sub_id)
            return None, str(e)

    def close(self, sub_id: str) -> None:
        self.open_.pop(sub_id, None)


class _Writer:
    def __init__(self) -> None:
        self.body, self.last, self.pending = b"", 0, None

    def _bound(self, bound: tuple[int, bytes]) -> bytes:
        t, prefix = bound
        if t == INFINITY:
            code, self.last = 0, INFINITY
        else:
            code, self.last = t - self.last + 1, t
        return varint(code) + varint(len(prefix)) + prefix

    def skip(self, bound: tuple[int, bytes]) -> None:
        self.pending = bound

    def _flush(self) -> None:
        if self.pending is not None:
            self.body += self._bound(self.pending) + varint(SKIP)
            self.pending = None

    def fingerprint(self, bound: tuple[int, bytes], value: bytes) -> None:
        self._flush()
        self.body += self._bound(bound) + varint(FINGERPRINT) + value

    def ids(self, bound: tuple[int, bytes], ids: list[bytes]) -> None:
        self._flush()
        self.body += self._bound(bound) + varint(ID_LIST) + varint(len(ids)) + b"".join(ids)

    def done(self) -> bytes:
        return self.body


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.last = data, 0, 0

    def more(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("negentropy message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        n = 0
        while True:
            byte = self.take(1)[0]
            n = n << 7 | byte & 127
            if byte < 128:
                return n

    def bound(self) -> tuple[int, bytes]:
        code = self.varint()
        if code == 0 or self.last == INFINITY:
            self.last = INFINITY
        else:
            self.last += code - 1
        return self.last, self.take(self.varint())

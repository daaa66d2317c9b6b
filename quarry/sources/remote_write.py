"""Remote write requests (protobuf under raw snappy, versions 1 and 2) to samples, and samples to requests.

The wire format is read by field numbers; fields that are not samples or labels are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: an int, 8 or 4 bytes, or the bytes of a string or message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends after its message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def _sample(data: bytes) -> tuple[int, float]:
    value, ts = 0.0, 0
    for n, v in fields(data):
        if n == 1:
            (value,) = struct.unpack("<d", v)
        elif n == 2:
            ts = v - (1 << 64) if v >> 63 else v
    return ts, value


def series(request: bytes) -> Iterator[tuple[dict[str, str], list[tuple[int, float]]]]:
    """(labels, samples) of each time series of an uncompressed request; version 2 has a table of symbols."""
    top = list(fields(request))
    symbols = [v.decode() for n, v in top if n == 4]
    for number, body in top:
        if number not in (1, 5):
            continue
        labels, refs, samples = {}, [], []
        for n, v in fields(body):
            if n == 2:
                samples.append(_sample(v))
            elif n == 1 and number == 1:
                pair = dict(fields(v))
                labels[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
            elif n == 1:
                at = 0
                while at < len(v):
                    ref, at = _varint(v, at)
                    refs.append(ref)
        yield labels or {symbols[a]: symbols[b] for a, b in zip(refs[::2], refs[1::2], strict=True)}, samples


def decompress(body: bytes) -> bytes:
    size, _ = _varint(body, 0)
    return pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True) if size else b""


def read(requests: DataFrame) -> DataFrame:
    """Samples (labels, ts_ms, value) of requests (body BINARY)."""
    ship(requests.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            rows = [(list(labels.items()), ts, v) for body in batch.column(0).to_pylist() if body for labels, samples in series(decompress(body)) for ts, v in samples]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.float64()), strict=True)], ["labels", "ts_ms", "value"])

    return requests.select("body").mapInArrow(decode, "labels map<string,string>, ts_ms long, value double")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(number: int, value: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(value)) + value


def encode(rows: list[tuple[dict[str, str], list[tuple[int, float]]]], version: int = 1) -> bytes:
    """A compressed request of (labels, samples)."""
    symbols: dict[str, int] = {"": 0}
    out = []
    for labels, samples in rows:
        points = b"".join(_bytes(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _number(ts & (1 << 64) - 1)) for ts, v in samples)
        if version == 1:
            names = b"".join(_bytes(1, _bytes(1, k.encode()) + _bytes(2, v.encode())) for k, v in sorted(labels.items()))
            out.append(_bytes(1, names + points))
        else:
            refs = b"".join(_number(symbols.setdefault(x, len(symbols))) for pair in sorted(labels.items()) for x in pair)
            out.append(_bytes(5, _bytes(1, refs) + points))
    table = b"".join(_bytes(4, s.encode()) for s in symbols) if version == 2 else b""
    return pa.compress(table + b"".join(out), codec="snappy", asbytes=True)


def write(samples: DataFrame, version: int = 1, together: int = 1000) -> DataFrame:
    """Requests (body BINARY) of up to ``together`` samples (labels, ts_ms, value) each, as a sender would make them."""
    ship(samples.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, together):
                some = batch.slice(k, together)
                rows: dict[tuple, list[tuple[int, float]]] = {}
                for labels, ts, v in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    rows.setdefault(tuple(sorted(labels)), []).append((ts, v))
                yield pa.RecordBatch.from_arrays([pa.array([encode([(dict(x), y) for x, y in rows.items()], version)], pa.binary())], ["body"])

    return samples.select("labels", "ts_ms", "value").mapInArrow(pack, "body binary")

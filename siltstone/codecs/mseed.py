"""Seismic records (version 2): header fields and integer, float and text samples, without Steim decoding of unknown layouts."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta, timezone

import numpy as np

from .images import Unsupported

TYPES = {0: ("a", "S1"), 1: ("i", "i2"), 3: ("i", "i4"), 4: ("f", "f4"), 5: ("d", "f8")}
RECORD = 256


def _start(data: bytes, at: int, order: str) -> datetime:
    year, day, hour, minute, second, _, fract = struct.unpack_from(order + "HHBBBBH", data, at + 20)
    return datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, microseconds=fract * 100)


def _steim(body: bytes, n: int, version: int, order: str) -> np.ndarray:
    """Differences of Steim 1 or 2 frames, summed up to samples."""
    words = np.frombuffer(body, np.dtype(order + "u4")).astype(np.int64).reshape(-1, 16)
    first = int(np.int32(words[0, 1] & 0xFFFFFFFF if words[0, 1] < 1 << 31 else words[0, 1] - (1 << 32)))
    signed = lambda v, bits: v - (1 << bits) if v >> bits - 1 else v
    diffs: list[int] = []
    for frame in words.tolist():
        for i in range(1, 16):
            code, w = frame[0] >> 30 - 2 * i & 3, frame[i]
            if code == 0:
                continue
            if code == 1:
                diffs += [signed(w >> s & 255, 8) for s in (24, 16, 8, 0)]
            elif version == 1:
                diffs += [signed(w >> s & 0xFFFF, 16) for s in (16, 0)] if code == 2 else [signed(w, 32)]
            else:
                count, bits = {(2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}[code, w >> 30]
                diffs += [signed(w >> bits * (count - 1 - k) & (1 << bits) - 1, bits) for k in range(count)]
    out = np.cumsum(np.array(diffs[:n], np.int64))
    return (out - out[0] + first).astype(np.int32) if n else out.astype(np.int32)


def records(data: bytes) -> list[dict]:
    """The records of a file in order: sid, start, rate, kind, samples."""
    out, at = [], 0
    while at + 48 <= len(data):
        if data[at + 6 : at + 7] not in (b"D", b"R", b"Q", b"M"):
            raise Unsupported("not a version 2 record")
        order = ">" if 1900 <= struct.unpack_from(">H", data, at + 20)[0] <= 2100 else "<"
        station, location, channel, network = (data[at + a : at + b].decode("ascii").strip() for a, b in ((8, 13), (13, 15), (15, 18), (18, 20)))
        n, factor, times = struct.unpack_from(order + "Hhh", data, at + 30)
        start, block = struct.unpack_from(order + "HH", data, at + 44)
        encoding, size = None, 512
        while block:
            kind, after = struct.unpack_from(order + "HH", data, at + block)
            if kind == 1000:
                encoding, word, power = data[at + block + 4], data[at + block + 5], data[at + block + 6]
                size = 1 << power
                body_order = ">" if word else "<"
            block = after
        if encoding is None:
            raise Unsupported("record without blockette 1000")
        rate = float(factor if factor > 0 else -1 / factor if factor else 0) * float(times if times > 0 else -1 / times if times else 0)
        body = data[at + start : at + size]
        if encoding in (10, 11):
            kind, samples = "i", _steim(body[: len(body) // 64 * 64], n, encoding - 9, body_order)
        elif encoding in TYPES:
            kind, dtype = TYPES[encoding]
            samples = np.frombuffer(body, np.dtype(body_order + dtype) if kind != "a" else np.dtype(dtype), n)
        else:
            raise Unsupported(f"encoding {encoding}")
        out.append({"sid": f"{network}_{station}_{location}_{channel}", "codes": (station, location, channel, network), "start": _start(data, at, order), "rate": rate, "factor": factor, "times": times, "kind": kind, "samples": samples})
        at += size
    if not out:
        raise Unsupported("no records")
    return out


def segments(data: bytes) -> list[dict]:
    """Records joined where one begins a sample after the one before ends, within half a sample; by sid, then time."""
    out: list[dict] = []
    for r in sorted(records(data), key=lambda r: (r["sid"], r["start"])):
        last = out[-1] if out else None
        step = 1 / r["rate"] if r["rate"] else 0.0
        if last and (last["sid"], last["kind"], last["rate"]) == (r["sid"], r["kind"], r["rate"]) and abs((r["start"] - last["start"]).total_seconds() - len(last["samples"]) * step) <= step / 2:
            last["samples"] = np.concatenate([last["samples"], r["samples"]])
        else:
            out.append(dict(r))
    return out


def _frames(samples: np.ndarray, room: int) -> tuple[bytes, int]:
    """Steim 2 frames for as many samples as ``room`` frames hold; their bytes and number."""
    values = samples.astype(np.int64)
    diffs = np.diff(values, prepend=values[0]).tolist()
    options = ((7, 4, 3, 2), (6, 5, 3, 1), (5, 6, 3, 0), (4, 8, 1, None), (3, 10, 2, 3), (2, 15, 2, 2), (1, 30, 2, 1))
    out, at = [], 0
    for f in range(room):
        frame = [0] * 16
        for i in range(3 if f == 0 else 1, 16):
            if at >= len(diffs):
                break
            for count, bits, code, mark in options:
                part = diffs[at : at + count]
                if len(part) == count and all(-(1 << bits - 1) <= d < 1 << bits - 1 for d in part):
                    break
            else:
                raise Unsupported("difference beyond 30 bits")
            word = 0 if mark is None else mark
            for d in part:
                word = word << bits | d & (1 << bits) - 1
            frame[i], frame[0] = word, frame[0] | code << 30 - 2 * i
            at += count
        out.append(frame)
        if at >= len(diffs):
            break
    out[0][1], out[0][2] = int(values[0]) & 0xFFFFFFFF, int(values[at - 1]) & 0xFFFFFFFF
    return b"".join(struct.pack(">16I", *f) for f in out), at


def repacked(data: bytes, keep_metadata: bool = True) -> bytes:
    """Integers in Steim 2, other samples in their own type, in records of one size."""
    out = []
    for seg in segments(data):
        samples, done, number = seg["samples"], 0, 1
        while done < len(samples):
            if seg["kind"] == "i":
                body, n = _frames(samples[done:], (RECORD - 64) // 64)
                encoding = 11
            else:
                encoding, dtype = {"f": (4, ">f4"), "d": (5, ">f8"), "a": (0, "S1")}[seg["kind"]]
                n = min(len(samples) - done, (RECORD - 64) // np.dtype(dtype).itemsize)
                body = samples[done : done + n].astype(dtype).tobytes()
            at = seg["start"] + timedelta(seconds=done / seg["rate"] if seg["rate"] else 0)
            station, location, channel, network = seg["codes"]
            head = b"%06dD %-5s%-2s%-3s%-2s" % (number % 1_000_000, station.encode(), location.encode(), channel.encode(), network.encode())
            head += struct.pack(">HHBBBBHHhhBBBBiHH", at.year, at.timetuple().tm_yday, at.hour, at.minute, at.second, 0, at.microsecond // 100, n, seg["factor"], seg["times"], 0, 0, 0, 1, 0, 64, 48)
            head += struct.pack(">HHBBBB", 1000, 0, encoding, 1, RECORD.bit_length() - 1, 0)
            out.append((head.ljust(64, b"\0") + body).ljust(RECORD, b"\0"))
            done, number = done + n, number + 1
    return b"".join(out)


def canonical(data: bytes) -> bytes:
    return b"".join(f"{s['sid']} {s['start'].isoformat()} {s['rate']} {s['kind']} {len(s['samples'])} ".encode() + s["samples"].astype({"i": ">i4", "f": ">f4", "d": ">f8", "a": "S1"}[s["kind"]]).tobytes() for s in segments(data))

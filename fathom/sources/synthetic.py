"""Writers of small recordings and logs with known truth, for tests and demonstrations."""

from __future__ import annotations

import math
import struct

from fathom.functions.geo import FEET_TO_METRES, MERCATOR_RADIUS


def sonar_file(pings: list[dict], magic: int = 3) -> bytes:
    """An SL3 file of pings with time_ms, lon, lat, depth_m, channel, samples, max_range_m."""
    out = [struct.pack("<H6x", magic)]
    for n, p in enumerate(pings):
        samples = bytes(p.get("samples", b"\x10" * 32))
        channel = p.get("channel", 0)
        header = bytearray(168 if channel <= 5 else 128)
        struct.pack_into("<H2xH", header, 8, len(header) + len(samples), channel)
        struct.pack_into("<I", header, 16, n)
        struct.pack_into("<ff", header, 20, 0.0, p.get("max_range_m", 10.0) / FEET_TO_METRES)
        struct.pack_into("<H", header, 44, len(samples))
        struct.pack_into("<f", header, 48, p["depth_m"] / FEET_TO_METRES)
        x = math.radians(p["lon"]) * MERCATOR_RADIUS
        y = math.log(math.tan(math.pi / 4 + math.radians(p["lat"]) / 2)) * MERCATOR_RADIUS
        struct.pack_into("<ii", header, 92, round(x), round(y))
        struct.pack_into("<I", header, 124, p["time_ms"])
        out += [bytes(header), samples]
    return b"".join(out)


def log_file(fixes: list[dict], junk: bytes = b"") -> bytes:
    """A log of GPS fixes with t (GPS seconds), lon, lat, and optionally status, instance, alt, speed."""

    def format_packet(code: int, length: int, name: str, kinds: str, fields: str) -> bytes:
        return b"\xa3\x95\x80" + struct.pack("<BB4s16s64s", code, length, name.encode(), kinds.encode(), fields.encode())

    fields, kinds = "TimeUS,I,Status,GMS,GWk,NSats,HDop,Lat,Lng,Alt,Spd", "QBBIHBcLLef"
    layout = struct.Struct("<QBBIHBhiiif")
    out = [format_packet(128, 89, "FMT", "BBnNZ", "Type,Length,Name,Format,Columns"), format_packet(130, layout.size + 3, "GPS", kinds, fields)]
    for f in fixes:
        week, rest = divmod(f["t"], 604_800)
        body = layout.pack(int(f["t"] * 1e6) % (1 << 60), f.get("instance", 0), f.get("status", 3), round(rest * 1000), int(week), 12, 90, round(f["lat"] * 1e7), round(f["lon"] * 1e7), round(f.get("alt", 5.0) * 100), f.get("speed", 1.0))
        out += [junk, b"\xa3\x95\x82", body]
    return b"".join(out)

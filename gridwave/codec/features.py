"""What a main header declares, for any stream of the standard: more than the decoder takes."""

from __future__ import annotations

import struct

PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")


def read_features(data: bytes) -> dict:
    """Features of SIZ and COD; ValueError if one is missing, cut off or out of range."""
    if data[:4] != b"\xff\x4f\xff\x51":
        raise ValueError("no SOC and SIZ")
    out: dict = {}
    at = 2
    try:
        while True:
            marker, size = struct.unpack_from(">HH", data, at)
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise ValueError("segment cut off")
            if marker == 0xFF51:
                x1, y1, _, _, tile_w, tile_h, tile_x, tile_y, n = struct.unpack_from(">8IH", body, 2)
                parts = [struct.unpack_from(">BBB", body, 36 + 3 * i) for i in range(n)]
                if not (n and tile_w and tile_h) or x1 <= tile_x or y1 <= tile_y:
                    raise ValueError("SIZ geometry")
                out |= {
                    "width": x1, "height": y1, "components": n, "subsampling": [[dx, dy] for _, dx, dy in parts], "precision": [(d & 127) + 1 for d, _, _ in parts], "signed": [d > 127 for d, _, _ in parts],
                    "tiles": [-(-(x1 - tile_x) // tile_w), -(-(y1 - tile_y) // tile_h)],
                }
            elif marker == 0xFF52:
                progression, layers, mct, levels, xcb, ycb, _, transform = struct.unpack_from(">BHBBBBBB", body, 1)
                if progression >= len(PROGRESSIONS):
                    raise ValueError("progression")
                out |= {"progression": PROGRESSIONS[progression], "layers": layers, "mct": mct, "resolutions": levels + 1, "code_block": [xcb + 2, ycb + 2], "reversible": transform == 1}
            elif marker in (0xFF90, 0xFF93, 0xFFD9):
                break
            at += 2 + size
            if "progression" in out and "width" in out:
                break
    except struct.error:
        pass
    if "width" not in out or "progression" not in out:
        raise ValueError("main header cut off")
    return out

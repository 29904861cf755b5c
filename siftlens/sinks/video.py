"""Video frames as an FLV file."""

import struct


def flv(frames: list[bytes], codec: int, rate: float) -> bytes:
    """A header and a video tag for each frame; the first is a key frame. rate: frames a second."""
    out = [b"FLV\x01\x01" + struct.pack(">I", 9) + struct.pack(">I", 0)]
    for n, data in enumerate(frames):
        body = bytes([(1 if n == 0 else 2) << 4 | codec]) + data
        at = int(n / rate * 1000)
        head = b"\x09" + len(body).to_bytes(3, "big") + (at & 0xFFFFFF).to_bytes(3, "big") + bytes([at >> 24 & 255]) + b"\0\0\0"
        out += [head, body, struct.pack(">I", len(head) + len(body))]
    return b"".join(out)

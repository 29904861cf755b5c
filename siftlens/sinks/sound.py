"""Sound data as WAV files."""

import struct


def wav(data: bytes, rate: int, channels: int, bits: int = 16) -> bytes:
    """PCM samples with a RIFF header."""
    align = channels * bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * align, align, bits)
    body = b"WAVE" + head + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body

"""sha256 and md5 that one task begins and another goes on with, for use inside tasks."""

from __future__ import annotations

import ctypes
import hashlib

STATE_BYTES = 256  # holds the state of either digest, 112 and 92 bytes
NAMES = {"sha256": ("SHA256", 32), "md5": ("MD5", 16)}


class RunningDigest:
    """Digest of bytes given piece by piece; ``state`` is plain bytes from which a later one goes on.

    hashlib does not hand out its state, so the functions come from the OpenSSL library it is linked with.
    """

    def __init__(self, algorithm: str, state: bytes = b""):
        import _hashlib

        name, self._size = NAMES[algorithm]
        library = ctypes.CDLL(_hashlib.__file__)
        self._update, self._final = getattr(library, f"{name}_Update"), getattr(library, f"{name}_Final")
        self._update.argtypes = ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t
        self._final.argtypes = ctypes.c_char_p, ctypes.c_void_p
        self._state = ctypes.create_string_buffer(state, STATE_BYTES)
        if not state:
            start = getattr(library, f"{name}_Init")
            start.argtypes = (ctypes.c_void_p,)
            start(self._state)

    def update(self, data: bytes) -> None:
        self._update(self._state, data, len(data))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out, state = ctypes.create_string_buffer(self._size), ctypes.create_string_buffer(self._state.raw, STATE_BYTES)
        self._final(out, state)
        return out.raw.hex()


class WholeDigest:
    """The same without a state, for a Python without that library: all pieces must meet in one task."""

    def __init__(self, algorithm: str, state: bytes = b""):
        if state:
            raise ValueError("this Python cannot go on with a digest of another task")
        self._digest = hashlib.new(algorithm, usedforsecurity=False)
        self.update, self.hexdigest = self._digest.update, self._digest.hexdigest

    def state(self) -> bytes:
        return b""


def resumable(algorithm: str) -> bool:
    """Whether half-done digests can be handed on here: one handed on in the middle must equal hashlib's."""
    data = bytes(range(256)) * 3
    try:
        first = RunningDigest(algorithm)
        first.update(data[:333])
        second = RunningDigest(algorithm, first.state())
    except (ImportError, OSError, AttributeError):
        return False
    second.update(data[333:])
    return second.hexdigest() == hashlib.new(algorithm, data, usedforsecurity=False).hexdigest()

"""SHA-256 taken part by part.

A digest is one chain over its bytes, so the parts of a file follow one another; but the state between
two parts is a small value, which one task can hand to the next.  ``hashlib`` keeps it to itself,
OpenSSL's ``SHA256_CTX`` (openssl/sha.h) is plain memory.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from functools import cache

_BLOCK = 1 << 20


class _Context(ctypes.Structure):
    _fields_ = [("h", ctypes.c_uint32 * 8), ("nl", ctypes.c_uint32), ("nh", ctypes.c_uint32),
                ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _openssl():
    """The OpenSSL that ``hashlib`` itself uses."""
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    context = ctypes.POINTER(_Context)
    lib.SHA256_Init.argtypes = [context]
    lib.SHA256_Update.argtypes = [context, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, context]
    return lib


def start() -> bytes:
    """The state before the first byte."""
    context = _Context()
    _openssl().SHA256_Init(context)
    return bytes(context)


def add(state: bytes, data: bytes) -> bytes:
    """The state after ``data``."""
    context = _Context.from_buffer_copy(state)
    _openssl().SHA256_Update(context, data, len(data))
    return bytes(context)


def finish(state: bytes) -> str:
    """The digest in hex."""
    context, digest = _Context.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(digest, context)
    return digest.raw.hex()


@cache
def available() -> bool:
    """Whether this Python's OpenSSL gives the state out (some builds have none, or hide it)."""
    try:
        return finish(add(add(start(), b"a" * 70), b"bc")) == hashlib.sha256(b"a" * 70 + b"bc").hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def add_range(state: bytes, path: str, modified: int, first: int, size: int) -> bytes:
    """The state after ``size`` bytes of a file from ``first`` on, of which one block is held at a time."""
    with open(path, "rb") as file:
        file.seek(first)
        while size and (data := file.read(min(size, _BLOCK))):
            state = add(state, data)
            size -= len(data)
        if size or os.fstat(file.fileno()).st_mtime_ns // 1_000_000 != modified:
            raise OSError(f"{path} was changed while it was hashed")
    return state

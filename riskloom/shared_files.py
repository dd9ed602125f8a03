"""Arrays in files of the shared folder, mapped into memory by tasks.

A file is a line of JSON (name, dtype, length, offset of each array) and the
arrays behind it.  Local and mounted folders are mapped; other stores are read
through Arrow's file systems."""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a new file and return its path; a repeated task writes another."""
    store, where = place(folder)
    store.create_dir(where, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.bin"
    with store.open_output_stream(place(name)[1]) as out:
        out.write(line)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 64))
    return name


def joined(folder: str, names: list[str]) -> str:
    """The arrays of several files behind each other in one new file; copied a
    file at a time."""
    parts = [open_arrays(n) for n in names]
    store, where = place(folder)
    head, at = {}, 0
    for k in parts[0]:
        size, kind = sum(len(p[k]) for p in parts), parts[0][k].dtype
        head[k] = [kind.str, size, at]
        at += -(-size * kind.itemsize // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.bin"
    with store.open_output_stream(place(name)[1]) as out:
        out.write(line)
        for k, (kind, size, _) in head.items():
            for p in parts:
                out.write(p[k].tobytes())
            out.write(bytes(-size * np.dtype(kind).itemsize % 64))
    return name


def open_arrays(name: str) -> dict[str, np.ndarray]:
    store, where = place(name)
    if isinstance(store, fs.LocalFileSystem):
        with open(where, "rb") as f:
            raw = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    else:
        with store.open_input_file(where) as f:
            raw = memoryview(pa.py_buffer(f.read_buffer()))
    end = bytes(raw[:1 << 16]).index(b"\n") + 1
    return {k: np.frombuffer(raw, np.dtype(t), n, end + at) for k, (t, n, at) in json.loads(bytes(raw[:end])).items()}

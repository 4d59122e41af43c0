"""Arrays as files of the shared folder, written by tasks and mapped into memory by others."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs


def save(folder: str, name: str, arrays: dict[str, np.ndarray | list[np.ndarray]]) -> None:
    """Each array, or list of pieces of one, as a file of its own; a repeated task writes the same again."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    for key, a in arrays.items():
        # under a name of its own first, so that no reader sees half a file
        own = f"{path}/.{name}.{key}.{os.getpid()}-{os.urandom(4).hex()}"
        with store.open_output_stream(own) as out, pa.PythonFile(out, "w") as f:
            if isinstance(a, list):
                kind = np.result_type(*a)
                np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (sum(map(len, a)),)})
                for piece in a:
                    f.write(piece.astype(kind, copy=False).tobytes())
            else:
                np.lib.format.write_array(f, np.ascontiguousarray(a))
        store.move(own, f"{path}/{name}.{key}.npy")


def load(folder: str, name: str, keys: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped; from a folder that isn't a mounted one they are copied to this worker's own first."""
    store, path = fs.FileSystem.from_uri(folder)
    if not isinstance(store, fs.LocalFileSystem):
        own = _own_folder(folder)
        for k in keys:
            if not os.path.exists(f"{own}/{name}.{k}.npy"):  # under another name until it is whole
                fs.copy_files(f"{path}/{name}.{k}.npy", f"{own}/{name}.{k}.part", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                os.replace(f"{own}/{name}.{k}.part", f"{own}/{name}.{k}.npy")
        path = own
    return {k: np.load(f"{path}/{name}.{k}.npy", mmap_mode="r") for k in keys}


def exists(folder: str, name: str, key: str) -> bool:
    store, path = fs.FileSystem.from_uri(folder)
    return store.get_file_info(f"{path}/{name}.{key}.npy").type == fs.FileType.File


@lru_cache(maxsize=4)
def _own_folder(folder: str) -> str:
    made = tempfile.mkdtemp(prefix="arrays-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # with the worker
    return made


class SortedShards:
    """64-bit hashes in sorted shards by their first bits; a shard without a file is empty. Only shards that are asked for are opened, OPEN of them at a time."""

    OPEN = 256

    def __init__(self, folder: str, bits: int, value: str):
        self.folder, self.bits, self.value = folder, bits, value
        self.shard = lru_cache(maxsize=self.OPEN)(self._shard)

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not exists(self.folder, f"shard-{k}", self.value):
            return None
        got = load(self.folder, f"shard-{k}", ("hash", self.value))
        return got["hash"], got[self.value]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 for those that aren't there."""
        order = np.argsort(hashes)
        asked = hashes[order]
        got = np.full(len(hashes), -1, np.int64)
        top = asked >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(asked), np.uint64)
        edges = np.r_[np.flatnonzero(np.r_[True, top[1:] != top[:-1]]), len(top)] if len(top) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            pair = self.shard(int(top[a]))
            if pair is None:
                continue
            known, value = pair
            at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
            got[a:b] = np.where(known[at] == asked[a:b], value[at].astype(np.int64), -1)
        out = np.empty(len(hashes), np.int64)
        out[order] = got
        return out


@lru_cache(maxsize=4)
def sorted_shards(folder: str, bits: int, value: str) -> SortedShards:
    return SortedShards(folder, bits, value)

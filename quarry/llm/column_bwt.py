"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Every round inserts one symbol of every string, from the last column to the first: the order of the
suffixes that start there follows from the next column's order by one stable sort on the inserted
symbols, and the common prefix of two neighbours is one more than the smallest common prefix between
them in the next column's order (none if their symbols differ). Order and common prefixes live in
sequential files: a round reads the last one's, removes them and writes its own; the transform grows by
one column. No file is written twice, as file systems flush a file that is cut to nothing and written again
when it is closed, which held each round up by the disk.

The strings are aligned: only suffixes that start in one column are ever compared, so the transform is
kept column by column, a file each, and a round costs the number of strings, not the size of the transform
so far. A column of the transform is what the next round inserts: the symbols before its suffixes, in order.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: Common prefixes are counted up to this.
MOST = 255


class Files:
    """Arrays as sequential files of a folder of the shared storage (a URI or a local path), each written
    once; the folder goes when the block ends."""

    def __init__(self, folder: str):
        self.place, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.folder += f"/{uuid.uuid4().hex}"

    def __enter__(self) -> Files:
        self.place.create_dir(self.folder, recursive=True)
        return self

    def __exit__(self, *error) -> None:
        self.place.delete_dir(self.folder)

    def write(self, name: str, values: np.ndarray) -> None:
        with self.place.open_output_stream(f"{self.folder}/{name}", compression=None) as f:
            f.write(np.ascontiguousarray(values).data)

    def read(self, name: str, kind: type) -> np.ndarray:
        with self.place.open_input_stream(f"{self.folder}/{name}", compression=None) as f:
            return np.frombuffer(f.read(), kind)

    def take(self, name: str, kind: type) -> np.ndarray:
        """Read a file and remove it."""
        values = self.read(name, kind)
        self.place.delete_file(f"{self.folder}/{name}")
        return values


def columns(strings: np.ndarray, files: Files) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, common) from the last column to the first.

    strings is a uint8 matrix, a string a row. order lists the rows by their suffix from the column on,
    equal ones by row; common[i] is the length that suffix i shares with the one before it in order,
    up to MOST. File `bwt-<column>` holds the symbols of the column in the order of the suffixes after it.
    """
    n, width = strings.shape
    files.write(f"order-{width}", np.arange(n, dtype=np.int32))
    files.write(f"common-{width}", np.zeros(n, np.uint8))  # empty suffixes share nothing
    files.write(f"bwt-{width - 1}", strings[:, width - 1])
    for column in range(width - 1, -1, -1):
        order, common, symbol = files.take(f"order-{column + 1}", np.int32), files.take(f"common-{column + 1}", np.uint8), files.read(f"bwt-{column}", np.uint8)
        place = np.argsort(symbol, kind="stable")
        order, symbol = order[place], symbol[place]
        # the least from behind a place up to the place that follows in the new order; of use where symbols are equal
        least = np.minimum.reduceat(np.append(common, np.uint8(0)), place + 1)[:-1]
        new = np.zeros(n, np.uint8)
        new[1:] = np.where(symbol[1:] == symbol[:-1], np.minimum(least, MOST - 1) + 1, 0)
        if column:
            files.write(f"order-{column}", order)
            files.write(f"common-{column}", new)
            files.write(f"bwt-{column - 1}", strings[:, column - 1][order])
        yield column, order, new

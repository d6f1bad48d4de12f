"""Files by path or URI, as tasks and the driver open them for Python data sources."""

from __future__ import annotations

import fnmatch

from ..session import carried


def store_of(path: str):
    """(file system, path within it) of a local path or of a URI that Arrow knows: file, hdfs, s3 and others."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of the files below a folder whose path from there fits the pattern, sorted; hidden ones are left out."""
    from pyarrow import fs

    store, base = store_of(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    below = [(f.path, f.path[len(base.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
    return sorted((p, size) for p, short, size in below if fnmatch.fnmatch(short, pattern) and not any(x[0] in "._" for x in short.split("/")))


carried(__name__)

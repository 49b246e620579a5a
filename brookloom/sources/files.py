"""Files of a shared file system, seen from tasks and from the driver."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, or of a URI that pyarrow knows, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(pattern: str) -> list[fs.FileInfo]:
    """Files at a path: itself, those of a folder, or those whose names a last part with wildcards fits; in order."""
    system, path = file_system(pattern)
    if not any(c in path.rsplit("/", 1)[-1] for c in "*?["):
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        found = system.get_file_info(fs.FileSelector(path))
    else:
        folder, name = path.rsplit("/", 1)
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatchcase(i.base_name, name)]
    return sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)

"""Files that tasks write themselves, on any file system Arrow knows: a local or shared path, file:, s3:, gs:, hdfs:."""

from __future__ import annotations

import uuid

from pyarrow import fs as afs


def filesystem(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path


def put(files: afs.FileSystem, path: str, data: bytes) -> None:
    """A file that is seen whole or not at all."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{uuid.uuid4().hex}.draft"  # readers skip names with an underscore
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, path)


def names(files: afs.FileSystem, folder: str) -> list[str]:
    return [i.path for i in files.get_file_info(afs.FileSelector(folder, allow_not_found=True)) if i.is_file]

"""Opening and listing of files for the binary sources, on local disks and in stores that Arrow can reach."""

from __future__ import annotations

import glob
import os
import uuid
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow.fs as fs


def local(path: str) -> str | None:
    """The local name of a path, or None for a path in another store."""
    u = urlparse(path)
    return path if not u.scheme or len(u.scheme) == 1 else u.path if u.scheme == "file" else None


def open_input(path: str) -> BinaryIO:
    """A seekable file."""
    if (name := local(path)) is not None:
        return open(name, "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def write_file(path: str, content: bytes) -> None:
    """Writes a file under another name and renames it, so that a task that runs twice leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    if (name := local(path)) is not None:
        with open(local(part), "wb") as f:
            f.write(content)
        os.replace(local(part), name)
        return
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_output_stream(inner + part.removeprefix(path)) as f:
        f.write(content)
    store.move(inner + part.removeprefix(path), inner)


def make_folder(path: str) -> str:
    if (name := local(path)) is not None:
        os.makedirs(name, exist_ok=True)
    else:
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner, recursive=True)
    return path


def size(path: str) -> int:
    if (name := local(path)) is not None:
        return os.path.getsize(name)
    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).size


def list_files(path: str, suffix: str = "") -> list[str]:
    """A file, the files of a folder, or the matches of a pattern, sorted; only names that end with the suffix."""
    if (name := local(path)) is not None:
        if os.path.isdir(name):
            found = [os.path.join(name, x) for x in os.listdir(name)]
        elif os.path.exists(name):
            return [name]
        else:
            found = glob.glob(name)
        return sorted(x for x in found if os.path.isfile(x) and x.lower().endswith(suffix))
    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name.lower().endswith(suffix))


def stem(path: str) -> str:
    return os.path.basename(urlparse(path).path if local(path) is None else path)

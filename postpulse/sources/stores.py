"""Byte ranges of files, wherever they are: web servers or any file system that Arrow opens."""

from __future__ import annotations

import posixpath
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs

from postpulse.sources import crawl

WEB = ("http://", "https://")


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def below(address: str, *names: str) -> str:
    return posixpath.join(address, *names)


def size(address: str) -> int:
    """Bytes at an address; 0 if there is nothing."""
    if address.startswith(WEB):
        return crawl.size_of(address)
    files, path = _opened(address)
    return files.get_file_info(path).size or 0


def read(address: str, start: int, end: int) -> bytes:
    """Bytes ``start`` to ``end`` (exclusive); raises if there is nothing at the address."""
    if address.startswith(WEB):
        found = crawl.fetch_range(address, start, end - 1)
        if found is None:
            raise FileNotFoundError(address)
        return found
    files, path = _opened(address)
    with files.open_input_file(path) as source:
        return source.read_at(end - start, start)


def whole(address: str) -> bytes | None:
    """All bytes at an address, or None if there is nothing."""
    if address.startswith(WEB):
        return crawl.fetch_range(address)
    files, path = _opened(address)
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path, compression=None) as source:
        return source.read()


def created(address: str) -> BinaryIO | pa.NativeFile:
    files, path = _opened(address)
    files.create_dir(posixpath.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)


def write(address: str, content: bytes) -> None:
    with created(address) as out:
        out.write(content)


def remove(address: str) -> None:
    """Delete a file; one that is not there is fine."""
    files, path = _opened(address)
    if files.get_file_info(path).type == fs.FileType.File:
        files.delete_file(path)

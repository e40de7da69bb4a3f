"""Files read piece by piece inside tasks, for files that do not fit into a task's memory.

A task opens the file itself, through Arrow's file systems, and never holds more than a piece and what its
reader carries over. Paths are those that Spark's file sources show: local or mounted folders and the schemes that
Arrow knows (``s3``, ``gs``, ``abfs``, ``hdfs``; the last needs the Hadoop client library on the executors).
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs

PIECE_BYTES = 1 << 20
_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]+):(//[^/]*)?(.*)$", re.DOTALL)
# Hadoop's names of a scheme that Arrow knows under another one.
_ALIASES = {"s3a": "s3", "s3n": "s3"}


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path as Spark writes it (``file:/a/b``, ``s3a://bucket/key``, ``/a/b``)."""
    named = _SCHEME.match(path)
    if named is None:
        return pafs.LocalFileSystem(), path
    scheme, host, place = named.groups()
    if scheme == "file":
        return pafs.LocalFileSystem(), place
    scheme = _ALIASES.get(scheme, scheme)
    if scheme == "hdfs":
        return pafs.FileSystem.from_uri(f"hdfs:{host or '//default'}/")[0], place
    # The host is resolved as a URI, the rest is taken as it stands: Spark does not escape its paths.
    system, root = pafs.FileSystem.from_uri(f"{scheme}:{host or '//'}")
    return system, root.rstrip("/") + place


def file_bytes(path: str) -> int:
    """Size of a file."""
    system, place = locate(path)
    return system.get_file_info(place).size


def read_pieces(path: str, piece: int = PIECE_BYTES) -> Iterator[str]:
    """The UTF-8 text of a file in order, ``piece`` bytes at a time; bad bytes give U+FFFD.

    A character that is cut by the end of a piece comes with the next one.
    """
    system, place = locate(path)
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    with system.open_input_stream(place, compression=None, buffer_size=0) as stream:
        while data := stream.read(piece):
            if text := decoder.decode(data):
                yield text
    if rest := decoder.decode(b"", final=True):
        yield rest


_OUTSIDE = re.compile(r'["{}\[\],:]')
_INSIDE = re.compile(r'(?:[^"\\]++|\\.)*+', re.DOTALL)


def _json_marks(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Cuts JSON text behind each bracket, comma and colon outside strings: ``(text, mark or "")``."""
    quoted, carried = False, ""
    for piece in pieces:
        text, carried, at = carried + piece, "", 0
        while at < len(text):
            if quoted:
                end = _INSIDE.match(text, at).end()
                if end < len(text) and text[end] == "\\":
                    # An escape whose second character comes with the next piece.
                    carried = text[end:]
                    yield text[at:end], ""
                    break
                quoted = end == len(text)
                end += not quoted
                yield text[at:end], ""
            else:
                found = _OUTSIDE.search(text, at)
                end = found.end() if found else len(text)
                mark = found.group() if found else ""
                quoted = mark == '"'
                yield text[at:end], "" if quoted else mark
            at = end
    if quoted or carried:
        raise ValueError("JSON text ends inside a string")


class _Walk:
    """Position in a JSON text: the open brackets, and the number of the outer object's member being read."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.member: int | None = None
        self.label: list[str] = []
        self._labelled = False
        self._ended = False

    def step(self, text: str, mark: str) -> None:
        if not self.open:
            outside = text[:-1] if mark else text
            if outside.strip("\ufeff \t\r\n") or (mark and (self._ended or mark not in "{[")):
                raise ValueError("not one JSON object or array")
        if mark in ("{", "["):
            self.open.append(mark)
        elif mark in ("}", "]"):
            if self.open.pop() + mark not in ("{}", "[]"):
                raise ValueError("JSON brackets do not match")
            self._ended = not self.open
        if self.open == ["{"]:
            self._member(text, mark)

    def _member(self, text: str, mark: str) -> None:
        """Between the members of the outer object: what stands before the first colon is the key."""
        if mark in ("{", ","):
            self.member = 0 if self.member is None else self.member + 1
            self.label, self._labelled = [], False
        elif not self._labelled:
            self.label.append(text[:-1] if mark else text)
            self._labelled = mark == ":"

    def finish(self) -> None:
        if not self._ended:
            raise ValueError("JSON text ends early")


def json_arrays(pieces: Iterable[str]) -> list[tuple[int | None, str | None]]:
    """Where a JSON text keeps arrays, in order: ``(None, None)`` for the text itself, else number and key of the
    members of the outer object that are arrays. Reads to the end; a text whose brackets or strings do not close is
    refused."""
    walk, found = _Walk(), []
    for text, mark in _json_marks(pieces):
        walk.step(text, mark)
        if mark != "[":
            continue
        if walk.open == ["["]:
            found.append((None, None))
        elif walk.open == ["{", "["]:
            found.append((walk.member, json.loads("".join(walk.label))))
    walk.finish()
    return found


def json_elements(pieces: Iterable[str], member: int | None) -> Iterator[str]:
    """Texts of the elements of one of the ``json_arrays``, one at a time."""
    walk, element = _Walk(), []
    outer = ["["] if member is None else ["{", "["]
    for text, mark in _json_marks(pieces):
        level = len(walk.open)
        inside = walk.open[: len(outer)] == outer and walk.member == member
        walk.step(text, mark)
        if not inside:
            continue
        ends = level == len(outer) and mark in (",", "]")
        element.append(text[:-1] if ends else text)
        if ends:
            whole = "".join(element)
            element = []
            if mark == "," or whole.strip():
                yield whole

"""Decompress one file of the archive: all of its text in steps that end with a line, or none."""

from __future__ import annotations

import bz2
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa

# Text of a file that a task holds before it knows that the file is whole; a file with
# more is first read to its end and then read again.
HELD_BYTES = 128 * 1024 * 1024
STEP_BYTES = 1024 * 1024
BLOCK_BYTES = 16 * 1024 * 1024

#: What a reader gives: text in steps that end with a line, every line with a line feed, the number of its first line,
#: or why a file has none.
STEPS = "file string, block bigint, first bigint, text string, reason string"

Opener = Callable[[], BinaryIO]


def _steps(opened: Opener) -> Iterator[bytes]:
    with opened() as raw, bz2.BZ2File(raw) as stream:
        while step := stream.read(STEP_BYTES):
            yield step


def _fault(steps: Iterator[bytes]) -> str | None:
    """Why the rest of a file cannot be read; None if it can."""
    try:
        for _ in steps:
            pass
    except EOFError:
        return "cut off"
    except (OSError, ValueError):
        return "damaged"
    return None


def _intact(opened: Opener) -> tuple[Iterator[bytes], str | None]:
    """A file's text in steps, none if the file is broken, and what is wrong with it."""
    held, size, steps = [], 0, _steps(opened)

    def some() -> Iterator[bytes]:
        nonlocal size
        for step in steps:
            held.append(step)
            size += len(step)
            if size > HELD_BYTES:
                return
            yield step

    fault = _fault(some())
    if fault is None and size > HELD_BYTES:
        held.clear()
        fault = _fault(steps)
        return (iter(()), fault) if fault else (_steps(opened), None)
    return (iter(()), fault) if fault else (iter(held), None)


def _whole_lines(steps: Iterator[bytes]) -> Iterator[bytes]:
    """The same text in steps that end with a line; lines end with a line feed, a carriage return, or both."""
    rest = b""
    for step in steps:
        rest += step
        cut = max(rest.rfind(b"\n"), rest.rfind(b"\r", 0, len(rest) - 1)) + 1  # a last return may go with a feed
        if cut:
            yield rest[:cut]
            rest = rest[cut:]
    if rest:
        yield rest


def unpacked(name: str, opened: Opener) -> Iterator[pa.RecordBatch]:
    """One file as rows of ``STEPS``: its text, or one row with the reason why it has none."""
    with opened() as raw:
        if not raw.read(1):
            yield _batch(name, 0, 0, None, "empty")
            return
    steps, fault = _intact(opened)
    if fault:
        yield _batch(name, 0, 0, None, fault)
    read = line = 0
    for text in _whole_lines(steps):
        block, read = read // BLOCK_BYTES, read + len(text)
        if b"\r" in text:
            text = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        yield _batch(name, block, line, text.decode("utf-8", "replace"), None)
        line += text.count(b"\n")


def _batch(file: str, block: int, first: int, text: str | None, reason: str | None) -> pa.RecordBatch:
    columns = [pa.array([v], k) for v, k in ((file, pa.string()), (block, pa.int64()), (first, pa.int64()), (text, pa.string()), (reason, pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "first", "text", "reason"])

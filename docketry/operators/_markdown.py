"""Cutting one Markdown text into sections and chunks, line by line: the small sequential helper behind ``chunking``."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

TARGET, LARGEST, LONGEST_PARENT, OVERLAP = 650, 900, 3500, 0.12
# '.' of the source dialect stops at any line end, so a line that ends in a carriage return is no heading
HEADING = re.compile(r"(#{1,6})\s+([^\n\r  ]*)\Z")
ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]+|\s*[^.!?\n]+\Z")
IMAGE = re.compile(r"<!--\s*image\s*-->")


class Piece(NamedTuple):
    kind: str  # heading, paragraph, table, code, list
    text: str
    level: int | None
    path: tuple[str, ...]


class Sizes(NamedTuple):
    target: int = TARGET
    largest: int = LARGEST
    parent: int = LONGEST_PARENT
    overlap: float = OVERLAP


def tokens(text: str) -> int:
    return math.ceil(len(text) / 3.5)


def cleaned(markdown: str) -> str:
    return re.sub("\n{3,}", "\n\n", IMAGE.sub("", markdown))


def line_kinds(lines: Iterable[str]) -> Iterator[tuple[tuple[str, int], str]]:
    """What each line is by itself, and a number: neighbouring lines alike in both are one block.

    Fences are numbered in pairs, so a fenced block holds its two fences and all between; a heading is a block of its own.
    """
    fences = headings = 0
    for line in lines:
        bare = line.strip()
        if bare.startswith("```"):
            kind, fences = ("code", fences // 2), fences + 1
        elif fences % 2:
            kind = ("code", fences // 2)
        elif HEADING.match(line):
            kind, headings = ("heading", headings), headings + 1
        else:
            kind = ("table" if bare.startswith("|") else "text" if bare else "blank", 0)
        yield kind, line


def pieces(markdown: str | Iterable[str]) -> Iterator[Piece]:
    """Blocks of a text, or of its lines, in order, each with the headings above it. Nothing is held but one block."""
    above: list[tuple[int, str]] = []
    for (kind, _), rows in groupby(line_kinds(markdown.split("\n") if isinstance(markdown, str) else markdown), key=lambda x: x[0]):
        lines = [line for _, line in rows]
        text, level = "\n".join(lines).strip(), None
        if kind == "heading":
            found = HEADING.match(lines[0])
            level, text = len(found[1]), found[2].strip()
            # a heading closes those of its own rank and below
            above = [*(h for h in above if h[0] < level), (level, text)]
        elif kind == "text":
            kind = "list" if ITEM.match(lines[0]) else "paragraph"
        if kind != "blank" and (text or level):
            yield Piece(kind, text, level, tuple(t for _, t in above))


def split_long(text: str, sizes: Sizes = Sizes()) -> list[str]:
    """Runs of whole sentences of about the target size; each run begins with the last sentences of the one before."""
    return list(_runs(text, sizes))


def _runs(text: str, sizes: Sizes) -> Iterator[str]:
    run: list[tuple[str, int]] = []
    for sentence in chain((m[0] for m in SENTENCE.finditer(text)), [] if SENTENCE.search(text) else [text]):
        size = tokens(sentence)
        if run and sum(n for _, n in run) + size > sizes.target:
            if whole := "".join(s for s, _ in run).strip():
                yield whole
            back, carried = len(run), 0
            while back and carried < sizes.target * sizes.overlap:
                back -= 1
                carried += run[back][1]
            run = run[back:]
        run.append((sentence, size))
    if whole := "".join(s for s, _ in run).strip():
        yield whole


def packed(blocks: Iterable[Piece], sizes: Sizes = Sizes()) -> Iterator[str]:
    """Bodies of the child chunks of a section: blocks packed to the target size; tables whole, longer blocks cut."""
    body: list[str] = []
    size = 0
    for block in blocks:
        more = tokens(block.text)
        table = block.kind == "table"
        if not table and more > sizes.largest:
            if body:
                yield "\n\n".join(body)
            yield from _runs(block.text, sizes)
            body, size = [], 0
            continue
        if body and size + more > (sizes.largest if table else sizes.target):
            yield "\n\n".join(body)
            body, size = [], 0
        body.append(block.text)
        size += more
        if table and size >= sizes.target:
            yield "\n\n".join(body)
            body, size = [], 0
    if body:
        yield "\n\n".join(body)


def chunk_id(doc_id: str, kind: str, ordinal: int) -> str:
    return hashlib.sha256(f"{doc_id}:{kind}:{ordinal}".encode()).hexdigest()


def chunks(doc_id: str, filename: str, markdown: str | Iterable[str], sizes: Sizes = Sizes()) -> Iterator[dict]:
    """Parent and child chunks of a document, a text or the lines of a cleaned one: one parent a section (first two headings), after its children.

    Of a section only what its parent shows is held, so a document of any length needs the memory of its longest block.
    """
    blocks = (b for b in pieces(cleaned(markdown) if isinstance(markdown, str) else markdown) if b.kind != "heading")
    n_parents = n_children = 0
    for path, group in groupby(blocks, lambda b: b.path[:2]):
        label = " > ".join(path) or None
        crumb = f"[Dosya: {filename} > {label}]" if label else f"[Dosya: {filename}]"
        parent = chunk_id(doc_id, "parent", n_parents)
        common = {"doc_id": doc_id, "section": label, "metadata": None}
        head: list[str] = []
        length = held = 0

        def passing(group=group, head=head) -> Iterator[Piece]:
            nonlocal length, held
            for b in group:
                length += len(b.text) + (2 if length else 0)
                # held counts a separator after each block; the one after the last is shown too where it falls within the parent
                if held < sizes.parent * 4 + 2:
                    head.append(b.text)
                    held += len(b.text) + 2
                yield b

        for child in packed(passing(), sizes):
            text = f"{crumb}\n{child}"
            yield common | {"id": chunk_id(doc_id, "child", n_children), "kind": "child", "ordinal": n_children, "text": text, "parent_id": parent, "token_count": tokens(text), "probe": child}
            n_children += 1
        body = "\n\n".join(head)
        body = body[: sizes.parent * 4] if math.ceil(length / 3.5) > sizes.parent else body
        yield common | {"id": parent, "kind": "parent", "ordinal": n_parents, "text": f"{crumb}\n{body}", "parent_id": None, "token_count": tokens(body), "probe": head[0]}
        n_parents += 1

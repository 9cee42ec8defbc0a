"""Splitting of texts at spaces into pieces whose tokens do not depend on their neighbours.

The patterns of these tokenizers match a word with at most one leading space, or
drop white space.  A text may therefore be cut before any single space or line
feed that stands between two non-space characters: no match spans the place and
none looks past it.  Each distinct piece is tokenised once per worker and kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RARE_ASCII = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_MARKS = ".,;:!?|#$%&*+=()[]{}<>/-"


def _plain(text: str) -> bool:
    """Whether space and line feed are all the white space there is."""
    if text.isascii():
        raw = text.encode()
        return len(raw.translate(None, _RARE_ASCII)) == len(raw)
    return not _RARE.search(text)


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece as it stands, then the later ones.

    A later piece keeps a leading line feed and loses a leading space.
    """
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or "\n" in parts or not _plain(text):  # white space beside white space
        first, *rest = _CUT.split(text)
        return first, [p[1:] if p[0] == " " else p for p in rest]
    return parts[0], parts[1:]


def literal(piece: str) -> str:
    """The characters that a later piece stands for."""
    return piece if piece[0] == "\n" else " " + piece


class PieceCache:
    """Values of pieces, kept in two generations of at most ``cap`` entries each.

    ``encode_many`` gets distinct pieces and returns their values, which are
    concatenated with ``+``.  Pieces over ``longest`` characters are not
    remembered, which bounds memory.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[Any]], cap: int = 200_000, longest: int = 48):
        self.encode_many, self.cap, self.longest = encode_many, cap, longest
        self.now: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def _fill(self, pieces: set[str]) -> None:
        """A run of marks after letters is a word of its own: both parts are looked up."""
        known, old = self.now, self.old
        ends: dict[str, tuple[str, str]] = {}
        todo = set()
        for p in pieces:
            if old and (value := old.get(p)) is not None:
                known[p] = value
            elif p[-1:] in _MARKS and (base := p.rstrip(_MARKS)).isalpha():
                ends[p] = base, "\n" + p[len(base) :]  # a line feed stays alone, so the run begins anew after it
                todo.update(ends[p])
            else:
                todo.add(p)
        new = list(todo.difference(known))
        known.update(zip(new, self.encode_many(new), strict=True))
        if ends:
            (feed,) = self.encode_many(["\n"])
            for p, (base, run) in ends.items():
                known[p] = known[base] + (known[run][len(feed) :] if isinstance(feed, bytes) else known[run] - feed)

    def each(self, docs: list[list[str]], join: Callable[[Iterable[Any]], Any]) -> list[Any]:
        """``join`` of the values of every document's pieces."""
        new = set().union(*docs).difference(self.now)
        if new:
            self._fill(new)
        known = self.now
        get = known.__getitem__
        out = [join(map(get, parts)) for parts in docs]
        for p in [p for p in new if len(p) > self.longest]:
            del known[p]
        if len(known) > self.cap:
            self.old, self.now = known, {}
        return out

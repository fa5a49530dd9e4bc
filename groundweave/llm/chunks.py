"""A table of distinct chunks: each chunk that no token crosses is encoded once, texts are put together from the entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class ChunkTable:
    """Encodings of distinct chunks as little-endian unsigned 32-bit ids.

    It is a cache within a worker, never an input limit: when it is full it starts anew, and chunks longer than
    ``longest`` are encoded each time.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 200_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.ids: dict[str, bytes] = {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its chunks in order."""
        new = list(set().union(*texts).difference(self.ids)) if texts else []
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            new = list(set().union(*texts))
        ids = dict(zip(new, self.encode(new), strict=True)) if new else {}
        table = self.ids
        table.update(ids)
        out = [b"".join([table[c] for c in chunks]) for chunks in texts]
        for c in new:
            if len(c) > self.longest:
                del table[c]
        return out


    def texts(self, texts: list[str], split: Callable[[str], list[str]], cut: Callable[[str, int], int], size: int = 1 << 20) -> list[bytes]:
        """The ids of each text; split gives a text's chunks, and long texts go through in parts of about size characters."""
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        chunks: list[list[str]] = []
        room = size
        for i, t in enumerate(texts):
            if len(t) > size:
                out[i] = b"".join(self.join([split(s)])[0] for s in slices(t, cut, size))
                continue
            if len(t) > room:
                for k, x in zip(held, self.join(chunks), strict=True):
                    out[k] = x
                held, chunks, room = [], [], size
            held.append(i)
            chunks.append(split(t))
            room -= len(t)
        for k, x in zip(held, self.join(chunks), strict=True):
            out[k] = x
        return out


def slices(text: str, cut: Callable[[str, int], int], size: int = 1 << 20) -> Iterator[str]:
    """text in parts of about size characters; cut(text, at) gives the first chunk boundary from at on, or the end."""
    at = 0
    while len(text) - at > size:
        end = cut(text, at + size)
        yield text[at:end]
        at = end
    yield text[at:]

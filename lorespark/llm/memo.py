"""Encoding by remembered words, inside a task.

A tokenizer that never forms a token across the start of a spaced word gives the same ids for
a text as for its words one after the other. Words repeat, so each is encoded once by the library
and looked up afterwards. Texts with other white space next to a space go to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable

Encode = Callable[[list[str]], list[bytes]]


class WordMemo:
    """Maps texts to the bytes of their ids.

    ``texts`` encodes whole texts, ``spaced`` words as they are after a space. About ``words``
    words are remembered, none longer than ``longest``: once half of them are known, those that do not
    come again before the next half go. ``prefix``: the library puts a space before
    a text, so that a text beginning with one has two.
    """

    def __init__(self, texts: Encode, spaced: Encode, prefix: bool = False, words: int = 1_000_000,
                 longest: int = 48):
        self.texts, self.spaced, self.prefix = texts, spaced, prefix
        self.words, self.longest = words, longest
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def forget(self) -> None:
        self.known.clear()
        self.older.clear()

    def _learn(self, new: set[str]) -> None:
        plain = [p for p in new if p and len(p) <= self.longest and p.strip() == p]
        self.known.update(zip(plain, self.spaced(plain), strict=True))
        if len(plain) < len(new):
            self.known.update(dict.fromkeys(new.difference(plain)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.words // 2:
            self.known, self.older = {}, self.known
        cut = [t.split(" ") for t in texts]
        heads = [parts.pop(0) for parts in cut]
        new: set[str] = set()
        for parts in cut:
            new.update(parts)
        new.difference_update(self.known.keys())
        if self.older:
            again = new & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self._learn(new)
        get, out, odd = self.known.__getitem__, [], []
        for at, parts in enumerate(cut):
            try:
                if heads[at][-1:].isspace() or self.prefix and parts and not heads[at]:
                    raise TypeError
                out.append(b"".join(map(get, parts)))
            except TypeError:  # a word that was not encoded by itself
                out.append(None)
                odd.append(at)
        head_ids = self.texts(heads)
        whole = dict(zip(odd, self.texts([texts[i] for i in odd]), strict=True)) if odd else {}
        return [whole[i] if tail is None else head + tail
                for i, (head, tail) in enumerate(zip(head_ids, out, strict=True))]

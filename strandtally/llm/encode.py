"""Token ids of whole texts, by the tokenizers library, with a bounded memory of segments.

Both tokenizers that are used here never join characters across a single space or line feed that
stands between two other characters, so a text's ids are those of its segments, one after another.
Segments repeat: the distinct ones of many texts are found by Arrow, each worker remembers the ids
of up to ``MEMORY`` of them, and texts are put together by numpy.

A text that holds one of the tokenizer's added tokens, in whatever case, is encoded as a whole.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY = 800_000
#: Characters of text whose segments are looked up together.
CHARS = 8 << 20
#: Letters that all Unicode versions agree on.
_LAST_LETTER = "ɏ"
#: Marks that end a word of letters; the boundary between the letters and a run of these is certain.
_STOPS = ",.!?;:*$%#"
_ASCII = frozenset(range(128))


class Encoder:
    """``spaced``: the tokenizer keeps the space before a word in the word's ids, as byte-level BPE does."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}  #: ids of words as ``plain`` cuts them
        self.start: dict[str, bytes] = {}  #: ids of all other segments
        # stands between words that are encoded together, and is a token by itself there
        self.mark = "\n" if spaced else "|"
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self.feed = self._ids("\n")
        # letters as the tokenizer's model spells them
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, range(128, ord(_LAST_LETTER) + 1)) if c.isalpha() and len(c.lower()) == 1 and c.lower() <= _LAST_LETTER]
        self.spelling = {ord(c): spell(c if spaced else c.lower())[0][0] for c in letters}
        self.space = spell(" ")[0][0] if spaced else ""

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> str | None:
        """The text in words with one space between them; None if it cannot be cut so.

        A word that begins a line has a line feed before it if the tokenizer has use for that.
        """
        if any(a in text.lower() for a in self.added):
            return None
        if not self.spaced:
            # white space separates and leaves no ids; case is folded by the tokenizer
            return (text.lower() if text.isascii() else text).replace("\n", " ")
        text = "\n" + text
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n" or not text.replace("\n", "").isprintable():
            return None
        return text.replace("\n", " \n")[1:]

    def segments(self, text: str) -> list[str]:
        """Parts of any text that can be encoded one by one; each has the space before it."""
        if any(a in text.lower() for a in self.added):
            return [text]
        out: list[str] = []
        for i, part in enumerate(text.split(" ")):
            piece = " " + part if i else part
            if out and (not part or part[0].isspace() or out[-1][-1:].isspace()):
                out[-1] += piece
            else:
                out.append(piece)
        return out

    def _word(self, letters: str, before: str) -> bytes | None:
        """Ids of a word of letters alone, from the model itself; None for letters beyond those that are spelt here."""
        if not letters.isascii():
            if not self.spelling.keys() >= set(map(ord, letters)) - _ASCII:
                return None
            letters = (letters if self.spaced else letters.lower()).translate(self.spelling)
        elif not self.spaced:
            letters = letters.lower()
        return array.array("I", [t.id for t in self.model.tokenize(before + letters)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Add the ids of words as ``plain`` cuts them."""
        known, rest = self.words, []
        for s in words:
            line = self.spaced and s[:1] == "\n"
            own = s[1:] if line else s
            head = own if own.isalpha() else own.rstrip(_STOPS)
            ids = self._word(head, "" if line else self.space) if head.isalpha() else None
            if ids is None:
                rest.append(s)
                continue
            tail = own[len(head) :]
            if tail:
                if tail not in self.start:
                    self.start[tail] = self._ids(tail)
                ids += self.start[tail]
            known[s] = self.feed + ids if line else ids
        if self.spaced:
            lines = [s[1:] for s in rest if s[:1] == "\n"]
            known.update(("\n" + s, self.feed + ids) for s, ids in self._together(lines, ""))
        known.update(self._together([s for s in rest if s[:1] != "\n"] if self.spaced else rest, " " if self.spaced else ""))

    def _together(self, words: list[str], before: str) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, each with ``before`` in front; as many as can be are encoded at once."""
        mark, glue = self.mark, self.mark if self.spaced else f" {self.mark} "
        # no white space but a space in front, so that the mark stays a token by itself
        fits = lambda s: s and s.isprintable() and mark not in s and s.rfind(" ") < 1 and s != " " and not any(a in s.lower() for a in self.added)
        single, plain = [], []
        for s in words:
            (plain if fits(s) else single).append(s)
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = np.array(self.tokenizer.encode(before + (glue + before).join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                yield from zip(part, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)], strict=True)
            else:
                single += part
        for s in single:
            yield s, self._ids(before + s)

    def _forget(self) -> None:
        for known in (self.words, self.start):
            if len(known) > MEMORY:
                # the words that came first are the frequent ones
                early = list(itertools.islice(known.items(), MEMORY // 2))
                known.clear()
                known.update(early)

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that ``plain`` has made, one after another, and where each ends."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = list(map(self.words.get, names))
        if new := [i for i, ids in enumerate(own) if ids is None]:
            self._learn([names[i] for i in new])
            for i in new:
                own[i] = self.words[names[i]]
        pool, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        begins, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(begins[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[words.offsets.to_numpy()[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, its ids as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= CHARS):
                chars += len(texts[to])
                to += 1
            out += self._part(texts[at:to])
            at = to
        return out

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        self._forget()
        cut = [self.plain(t) if t else None for t in texts]
        ids, ends = self._plain_ids([c for c in cut if c is not None])
        skip, begin, at, out = int(self.spaced) * len(self.feed) // 4, 0, 0, []
        for text, c in zip(texts, cut, strict=True):
            if c is not None:
                end = int(ends[at])
                # the first line has no line feed before it
                out.append(ids[begin + skip : end])
                begin, at = end, at + 1
            elif not text:
                out.append(np.zeros(0, "<u4"))
            else:
                parts = self.segments(text)
                if len(parts) > 1:
                    self.start.update(self._together([s for s in set(parts) if s not in self.start], ""))
                    out.append(np.frombuffer(b"".join([self.start[s] for s in parts]), "<u4"))
                else:
                    out.append(np.frombuffer(self._ids(text), "<u4"))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder; its memory lasts from task to task."""
    return Encoder(path, spaced)

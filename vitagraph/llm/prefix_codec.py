"""Byte-level BPE by dynamic programming over prefixes, with appends and local re-encoding.

Merging lowest ranks first gives every byte string one encoding, and each prefix of the
string has one too.  What decides all of them is the last token of each prefix: a token
that ends at byte ``i`` is that prefix's last one if it fits behind the last token of the
prefix before it, that is, if merging would not have crossed their border (``_fits``).
Exactly one token does.  So a table of last tokens (``Prefixes``) is filled from left to
right, the tokens that end at each byte coming from an Aho-Corasick automaton, and

* the encoding of any prefix is read off by walking back from its end;
* appending bytes extends the table and changes no entry of it;
* after an edit, entries are worked out anew from its place on, until as many in a row as
  the longest token has bytes equal the old ones: all later ones depend on these and on
  unchanged bytes alone, so they are kept.

A text is first split into pieces by a pattern, and each piece is encoded by itself; one
that is a token as a whole is that token.  ``Document`` keeps the pieces of a text and
splits anew only around an edit.

Edge cases: a null text is encoded as an empty one, which has no ids; equal rows give equal
results; a very long text is split and hashed in steps, and a long piece takes four bytes of
table for each of its own; text that looks like a special token is ordinary text; only
``doc_id`` and ``text`` are read, so further columns never clash, and a null ``doc_id`` stays
null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Pieces in each of the two generations of a worker's cache, and the longest piece kept there.
CACHE, CACHE_CHARS = 300_000, 40
#: Byte strings up to this long have their table in a list.
SHORT = 1_000
#: Remembered answers on neighbouring tokens.
ASKED = 500_000
#: Texts of more characters are split into pieces by steps of this many.
LONG, STEP = 1_000_000, 100_000


class Vocabulary:
    """Tokens by rank, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.size = [len(t) for t in self.bytes]
        self.longest = max(self.size)
        self.left = list(range(len(self.bytes)))
        self.right = list(range(len(self.bytes)))
        self.pair: dict[tuple[int, int], int] = {}
        self.asked: dict[int, bool] = {}
        reached = [False] * len(self.bytes)
        self.ends = ahocorasick.Automaton()
        for rank, token in enumerate(self.bytes):
            if len(token) == 1:
                reached[rank] = True
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at], rank), ranks.get(token[at:], rank)
                if a < rank and b < rank and reached[a] and reached[b] and self._undo(a, b):
                    # the one split from which merging arrives at this token
                    self.left[rank], self.right[rank], self.pair[a, b], reached[rank] = a, b, rank, True
                    break
            if reached[rank]:
                self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()

    def _undo(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side.

        Their merges are undone, last first; no token across the border may have been due
        before the merge that is undone next.
        """
        pair, left, right = self.pair, self.left, self.right
        before = len(self.bytes)
        while True:
            across = pair.get((a, b))
            if across is not None and across < before:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # the left one's last merge came later than the right one's, or it is all that is left to undo
            if not whole_a and (whole_b or a > b):
                before, a = a, right[a]
            else:  # a merge of equal rank on the left came first
                before, b = b + 1, left[b]

    def fits(self, a: int, b: int) -> bool:
        """``_undo``, remembered."""
        key = a << 32 | b
        known = self.asked.get(key)
        if known is None:
            if len(self.asked) >= ASKED:
                self.asked.clear()
            known = self.asked[key] = self._undo(a, b)
        return known


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        # a list is quicker, and small enough for a word
        self.last: list[int] | array = [] if len(data) <= SHORT else array("I")
        self.append(data)

    def _fill(self, data: bytes, start: int, old: list[int] | array | None = None, resume: int = 0) -> int:
        """Work out the entries from byte ``start`` on; ``self.last`` holds those before.

        Ends early, with the rest taken over, once they go on as in ``old``, whose entries stand
        for the bytes from ``resume`` on.  Returns how many were worked out.
        """
        v, last = self.vocabulary, self.last
        size, asked, fits, longest, put = v.size, v.asked.get, v.fits, v.longest, self.last.append
        # a token that ends behind ``start`` begins less than the longest one before it
        skip = max(0, start - longest + 1)
        due, chosen, same = start, -1, 0
        for end, token in v.ends.iter(data[skip:].decode("latin-1") if skip else data.decode("latin-1")):
            end += skip
            if end > due:
                put(chosen)
                if old is not None and due >= resume:
                    same = same + 1 if old[due - resume] == chosen else 0
                    if same == longest:
                        last.extend(old[due + 1 - resume :])
                        return due + 1 - start
                due, chosen = end, -1
            elif chosen >= 0 or end < due:
                continue
            begin = end - size[token]
            if begin >= 0:
                known = asked(last[begin] << 32 | token)
                if not (fits(last[begin], token) if known is None else known):
                    continue
            chosen = token
        if due < len(data):
            put(chosen)
        return len(data) - start

    def append(self, more: bytes) -> None:
        """Extend the string; no entry changes."""
        start, self.data = len(self.data), self.data + more
        self._fill(self.data, start)

    def edit(self, begin: int, end: int, put: bytes) -> int:
        """Replace bytes ``begin`` to ``end``; returns how many entries were worked out."""
        if isinstance(self.last, list):
            self.last = array("I", self.last)
        old, self.data = self.last[end:], self.data[:begin] + put + self.data[end:]
        del self.last[begin:]
        return self._fill(self.data, begin, old, begin + len(put))

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the first ``upto`` bytes."""
        at, size, out = len(self.last) if upto is None else upto, self.vocabulary.size, []
        while at > 0:
            token = self.last[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]


class Encoder(dict):
    """Piece to its ids as decimals joined by spaces, remembered: the younger generation is this
    dictionary, the older one is kept until the younger is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.older: dict[str, str] = {}
        self.token = {str(rank): token for token, rank in ranks.items()}

    def piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()

    def __missing__(self, piece: str) -> str:
        made = self.older.get(piece)
        if made is None:
            made = " ".join(map(str, self.piece(piece)))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists of bounded length."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(found, STEP)):
            yield part

    def decimals(self, text: str) -> Iterator[str]:
        """Ids of a text, step by step, as decimals joined by spaces."""
        for part in self.pieces(text):
            if part:
                yield " ".join(map(self.__getitem__, part))

    def encode(self, text: str) -> list[int]:
        return [int(i) for step in self.decimals(text) for i in step.split(" ")]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.vocabulary.bytes[i] for i in ids)


class Document:
    """An encoded text that can be appended to and edited without encoding all of it again.

    The pattern must not look behind, so that where a piece starts decides the pieces from there on,
    and where a piece ends must not depend on more than the ``AHEAD`` pieces after it.
    """

    #: White space looks for the end of its run: its last character may be a piece of its own.
    AHEAD = 2

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.text = text
        self.pieces = [p for part in encoder.pieces(text) for p in part]

    def edit(self, begin: int, end: int, put: str) -> int:
        """Replace characters ``begin`` to ``end``; returns how many pieces were found anew."""
        if sum(map(len, self.pieces)) != len(self.text):
            raise ValueError("the pattern leaves parts of the text out")
        new = self.text[:begin] + put + self.text[end:]
        first = start = 0
        starts = array("Q")
        for p in self.pieces:
            starts.append(start)
            start += len(p)
        while first < len(starts) and starts[first] + len(self.pieces[first]) < begin:
            first += 1
        first = max(0, first - self.AHEAD)
        shift = len(put) - (end - begin)
        old = {s + shift: k for k, s in enumerate(starts) if s >= end and s >= starts[first] + 1}
        fresh: list[str] = []
        rest: list[str] = []
        for m in self.encoder.pattern.finditer(new, starts[first] if len(starts) else 0):
            if m.start() in old:  # from here on the old pieces stand
                rest = self.pieces[old[m.start()] :]
                break
            fresh.append(m[0])
        self.pieces[first:] = fresh + rest
        self.text = new
        return len(fresh)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [int(i) for p in self.pieces for i in self.encoder[p].split(" ")]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_file: str, pattern: str | None = None) -> Encoder:
    """One encoder for each Python worker, which Spark keeps across tasks."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (ranks_file, pattern) not in _encoders:
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[ranks_file, pattern] = Encoder(ranks, pattern)
    return _encoders[ranks_file, pattern]


def _mapped(docs: DataFrame, schema: str, ranks_file: str | None, pattern: str | None, one: Callable[[Encoder, str], tuple]) -> DataFrame:
    """``doc_id`` and what ``one`` makes of each text; no shuffle."""
    where = ranks_file or ranks_path()

    def make():
        own = encoder(where, pattern)

        def step(columns: list[list]) -> list[list]:
            made = [one(own, text or "") for text in columns[1]]
            return [columns[0], *map(list, zip(*made, strict=True))]

        return step

    return arrow_map(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], f"doc_id bigint, {schema}", make)


def encode_documents(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded binary."""

    def one(own: Encoder, text: str) -> tuple:
        ids = own.encode(text)
        return ids, own.decode(ids)

    return _mapped(docs, "ids array<int>, decoded binary", ranks_file, pattern, one)


def digest_documents(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Number of ids, and digests of the ids and of the bytes that they decode to."""

    def one(own: Encoder, text: str) -> tuple:
        n, ids, decoded, token = 0, hashlib.sha256(), hashlib.sha256(), own.token.__getitem__
        for step in own.decimals(text):
            each = step.split(" ")
            ids.update(f"{' ' * (n > 0)}{step}".encode())
            decoded.update(b"".join(map(token, each)))
            n += len(each)
        return n, ids.hexdigest(), decoded.hexdigest()

    return _mapped(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ranks_file, pattern, one)

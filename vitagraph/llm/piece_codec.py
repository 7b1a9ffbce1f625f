"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library merges, of all neighbouring symbols that form a piece, the best-scored pair
first, leftmost on ties.  The encoder here finds the same tokens from left to right
without simulating the merges:

* an Aho-Corasick automaton over the reachable pieces gives the longest piece at every
  position; shorter ones follow a precomputed chain of prefixes;
* a token may follow another only if merging the two would not have crossed their
  border, which is decided by undoing their merges step by step (``_compatible``);
* positions from which no way leads to the start are marked in a bitfield and never
  entered again, so the search is linear in practice.

A text is cut where no piece has the two neighbouring characters side by side (as a rule
between a character and the space mark that follows it): no merge can cross there.  The
tokens of such a chunk depend on nothing else, and short chunks recur, so each task keeps
them in a bounded cache.  Characters outside the vocabulary become their UTF-8 bytes'
pieces, or the unknown id where the model has no such pieces.

Edge cases: a null text is encoded as an empty one; equal rows give equal results; a very
long text without a space is one chunk, searched in linear time and not cached; only
``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MARK = "▁"
#: Chunks in each of the two generations of a worker's cache, and the longest chunk kept there.
CACHE = 300_000
CACHE_CHARS = 40
#: Remembered answers on neighbouring tokens.
ASKED = 300_000


class PieceEncoder:
    """Encoder for one model file of the BPE kind without user-defined pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        pieces = {i: model.id_to_piece(i) for i in range(size) if not special[i]}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(i == model.unk_id() for i in self.bytes):
            self.bytes = None
        self.unk, self.eos = model.unk_id(), model.eos_id()
        # rank: the order in which merges are made; single characters come first
        order = sorted(pieces, key=lambda i: (len(pieces[i]) > 1, -model.get_score(i), i))
        self.rank_to_id = order
        rank = {pieces[i]: r for r, i in enumerate(order)}
        self.text = [pieces[i] for i in order]
        self.left: list[int] = []
        self.right: list[int] = []
        self.pair: dict[tuple[int, int], int] = {}
        reachable = ahocorasick.Automaton()
        ok: list[bool] = []
        for r, piece in enumerate(self.text):
            self.left.append(r)
            self.right.append(r)
            ok.append(len(piece) == 1)
            if len(piece) > 1:
                for cut in range(1, len(piece)):
                    a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
                    if a is not None and b is not None and a < r and b < r and ok[a] and ok[b] and self._compatible(a, b):
                        # the one way in which the merges arrive at this piece
                        self.left[r], self.right[r], self.pair[a, b], ok[r] = a, b, r, True
                        break
            if ok[r]:
                reachable.add_word(piece, r)
        reachable.make_automaton()
        self.automaton = reachable
        # the next shorter reachable piece that starts a piece, or -1
        self.shorter = []
        for piece in self.text:
            cut = next((c for c in range(len(piece) - 1, 0, -1) if (p := rank.get(piece[:c])) is not None and ok[p]), 0)
            self.shorter.append(rank[piece[:cut]] if cut else -1)
        self.size = [len(p) for p in self.text]
        joined = {p[i : i + 2] for p in self.text for i in range(len(p) - 1)}
        alone = "" if any("\n" in x for x in joined) else "\n"
        if any(x[0] != MARK and x[1] == MARK for x in joined):
            self.chunks = re.compile(r"[\s\S]+").findall
        else:
            self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|{alone}" * bool(alone)).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.asked: dict[int, bool] = {}
        self.decimal = list(map(str, range(size)))
        letters = "".join(re.escape(p) for p in self.text if len(p) == 1)
        self.unknown = re.compile(f"([^{letters}]+)").split

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: undo their merges, last first,
        and see that no piece across the border would have been merged before."""
        pair, left, right = self.pair, self.left, self.right
        limit = 1 << 60  # merges of this rank or later come after the step that was undone
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:  # of equal ranks the left one was merged first, so b is undone first
                limit = a
                inner = right[a]
                if inner == a:
                    limit = b + 1
                    if left[b] == b:
                        return True
                    b = left[b]
                else:
                    a = inner
            else:
                limit = b + 1
                inner = left[b]
                if inner == b:
                    limit = a
                    if right[a] == a:
                        return True
                    a = right[a]
                else:
                    b = inner

    def _fits(self, a: int, b: int) -> bool:
        """``_compatible``, remembered for neighbours that were asked about before."""
        key = a << 20 | b
        known = self.asked.get(key)
        if known is None:
            if len(self.asked) >= ASKED:
                self.asked.clear()
            known = self.asked[key] = self._compatible(a, b)
        return known

    def _backtrack(self, span: str) -> list[int]:
        """Tokens (ranks) of a span whose characters are all in the vocabulary."""
        size, shorter, fits, n = self.size, self.shorter, self._fits, len(span)
        longest = [-1] * n
        for end, r in self.automaton.iter(span):  # longer pieces of one end come first, so later starts stay longest
            at = end - size[r] + 1
            if longest[at] < 0 or size[longest[at]] < size[r]:
                longest[at] = r
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            nxt = pos + size[token]
            if not failed[nxt >> 3] >> (nxt & 7) & 1 and (not tokens or fits(tokens[-1], token)):
                tokens.append(token)
                pos = nxt
                token = longest[pos] if pos < n else -1
                continue
            token = shorter[token]
            while token < 0:
                # nothing fits here: mark the place and take the last token back
                failed[pos >> 3] |= 1 << (pos & 7)
                token = tokens.pop()
                pos -= size[token]
                token = shorter[token]
        return tokens

    def _known(self, span: str) -> list[int]:
        """As ``_backtrack``; the longest matches from left to right often fit as they are."""
        tokens = [r for _, r in self.automaton.iter_long(span)]
        fits = self._fits
        last = tokens[0]
        for r in tokens[1:]:
            if not fits(last, r):
                return self._backtrack(span)
            last = r
        return tokens

    def encode_chunk(self, chunk: str) -> list[int]:
        to_id = self.rank_to_id
        ids: list[int] = []
        for at, span in enumerate(self.unknown(chunk)):  # odd ones are runs of characters outside the vocabulary
            if not span:
                continue
            if at % 2 == 0:
                ids += [to_id[r] for r in self._known(span)]
            elif self.bytes is None:
                ids.append(self.unk)
            else:
                ids += [self.bytes[b] for b in span.encode()]
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that the younger cache doesn't hold, four bytes each."""
        made = self.older.get(chunk)
        if made is None:
            made = array("I", self.encode_chunk(chunk)).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[chunk] = made
        return made

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        ids = array("I")
        chunk = self.chunk
        for at in range(0, len(chunks := self.chunks(self.model.normalize(text))), 100_000):
            get = self.cache.get
            ids.frombytes(b"".join([get(c) or chunk(c) for c in chunks[at : at + 100_000]]))
        ids.append(self.eos)
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """One encoder for each Python worker, which Spark keeps across tasks."""
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Ids and decoded text of each document: doc_id, ids array<int>, decoded."""
    where = model_file or model_path()

    def make():
        own = encoder(where)

        def step(columns: list[list]) -> list[list]:
            ids = [own.encode(t or "") for t in columns[1]]
            return [columns[0], ids, [own.decode(i) for i in ids]]

        return step

    return arrow_map(
        docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], "doc_id bigint, ids array<int>, decoded string", make
    )


def digest_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of each document; no shuffle."""
    where = model_file or model_path()

    def make():
        own = encoder(where)
        sha = hashlib.sha256

        def step(columns: list[list]) -> list[list]:
            out: list[list] = [columns[0], [], [], []]
            for text in columns[1]:
                ids = own.encode(text or "")
                out[1].append(len(ids))
                out[2].append(sha(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                out[3].append(sha(own.decode(ids).encode()).hexdigest())
            return out

        return step

    return arrow_map(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], SCHEMA, make)

"""Byte-level encoding: equal to the library; prefixes, appends and edits equal to encoding anew."""

import hashlib
import random

import pytest
from helpers import AWKWARD, docs, nullified


@pytest.fixture(scope="module")
def own():
    from vitagraph.llm.prefix_codec import encoder, ranks_path

    return encoder(ranks_path())


@pytest.fixture(scope="module")
def library(own):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def strings(rng, alphabet, n, longest):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["ab ", "abc\n  '", "aeinrst", "é😀ü漢 \n1", "s't\tre", "<|endoftext|> "])
def test_equal_to_the_library(own, library, alphabet):
    for text in strings(random.Random(1), alphabet, 600, 60):
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_any_bytes_have_one_encoding_by_merging(own):
    """Against merging itself, on byte strings that no text has."""
    rng, ranks = random.Random(2), own.vocabulary.ranks
    from vitagraph.llm.prefix_codec import Prefixes

    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            due = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not due:
                return [ranks[p] for p in parts]
            at = min(due)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    for alphabet in (b"ab", b"theanir", bytes(range(256)), b" \n"):
        for _ in range(150):
            data = bytes(rng.choice(alphabet) for _ in range(rng.randrange(80)))
            table = Prefixes(own.vocabulary, data)
            assert table.ids() == merged(data)
            k = rng.randrange(len(data) + 1)
            assert table.ids(k) == merged(data[:k])


def test_appends_change_no_entry(own):
    from vitagraph.llm.prefix_codec import Prefixes

    rng = random.Random(3)
    table, data = Prefixes(own.vocabulary), b""
    for _ in range(300):
        before = list(table.last)
        more = bytes(rng.choice(b"thean ir") for _ in range(rng.randrange(9)))
        table.append(more)
        data += more
        assert list(table.last)[: len(before)] == before
    assert list(table.last) == list(Prefixes(own.vocabulary, data).last)


@pytest.mark.parametrize("size", [0, 30, 3_000])
def test_edits_work_out_few_entries(own, size):
    from vitagraph.llm.prefix_codec import Prefixes

    rng = random.Random(4)
    for alphabet in (b"ab", b"theanir", bytes(range(256))):
        data = bytes(rng.choice(alphabet) for _ in range(size))
        table = Prefixes(own.vocabulary, data)
        for _ in range(40):
            a = rng.randrange(len(data) + 1)
            b, put = min(len(data), a + rng.randrange(4)), bytes(rng.choice(alphabet) for _ in range(rng.randrange(4)))
            data = data[:a] + put + data[b:]
            worked = table.edit(a, b, put)
            assert table.data == data and list(table.last) == list(Prefixes(own.vocabulary, data).last)
            assert worked <= len(put) + 8 * own.vocabulary.longest


@pytest.mark.parametrize("alphabet", ["ab ", "abc\n  '", "é😀ü漢 \n1", "s't \n"])
def test_edited_documents(own, library, alphabet):
    from vitagraph.llm.prefix_codec import Document

    rng = random.Random(5)
    for text in strings(rng, alphabet, 200, 40):
        doc = Document(own, text)
        for _ in range(4):
            a = rng.randrange(len(doc.text) + 1)
            doc.edit(a, min(len(doc.text), a + rng.randrange(4)), "".join(rng.choice(alphabet) for _ in range(rng.randrange(4))))
        doc.append(" more")
        assert doc.ids() == library.encode_ordinary(doc.text)
    long = Document(own, "many words and more of them " * 2_000)
    assert long.edit(28_000, 28_003, "xyz") < 10
    assert long.ids() == library.encode_ordinary(long.text)


def test_long_texts_go_in_steps(own, library, monkeypatch):
    from vitagraph.llm import prefix_codec

    text = "words, 123 and  spaces\n\n " * 400
    monkeypatch.setattr(prefix_codec, "LONG", 100)
    monkeypatch.setattr(prefix_codec, "STEP", 7)
    assert len(list(own.pieces(text))) > 50
    assert own.encode(text) == library.encode_ordinary(text)
    assert len(own.encode("a" * 300_000)) == len(library.encode_ordinary("a" * 300_000))


def test_small_caches_change_nothing(own, library, monkeypatch):
    from vitagraph.llm import prefix_codec

    monkeypatch.setattr(prefix_codec, "CACHE", 5)
    monkeypatch.setattr(prefix_codec, "ASKED", 5)
    fresh = prefix_codec.Encoder(own.vocabulary.ranks, own.pattern.pattern)
    for text in strings(random.Random(6), "the an in er", 60, 200):
        assert fresh.encode(text) == library.encode_ordinary(text)


def test_documents(spark, library):
    from vitagraph.llm.prefix_codec import digest_documents, encode_documents

    texts = [*AWKWARD, "same text", "same text", "it's 100% fine\n\n  ok 漢字😀"]
    df = nullified(docs(spark, texts))
    got = sorted((tuple(r) for r in digest_documents(df).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (None, None)]:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert got == sorted(want, key=str)
    for r in encode_documents(df).collect():
        text = None if r["doc_id"] is None else texts[r["doc_id"]]
        assert bytes(r["decoded"]).decode() == (text or "") and r["ids"] == library.encode_ordinary(text or "")
    assert digest_documents(df.limit(0)).count() == 0

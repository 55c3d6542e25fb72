"""The word vectoriser and the tokenisation automaton against plain Python and the public tokenizers library."""

import hashlib
import random
import re

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import cases
from panelkit.llm import bpe, packing
from panelkit.llm import textvec as V

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_and_hashes():
    texts = [t for t in cases.texts()] + ["a b a b a b a b", None, "tail"]
    got, by_hash = [], {}
    for _, words in V.chunks(pa.chunked_array([pa.array(texts[:7]), pa.array(texts[7:])])):
        h = words.hashes().tolist()
        spans = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)]
        got += [spans[a:b] for a, b in zip(words.first, words.first[1:])]
        for w, x in zip(spans, h):
            assert by_hash.setdefault(x, w) == w
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(by_hash) == len(set(by_hash.values()))


def test_hash_does_not_depend_on_the_batch():
    one = {}
    for texts in (["a bb ccc", "bb ccc a bb ccc"], ["zz", "bb ccc a bb ccc", "a bb ccc"]):
        for _, words in V.chunks(pa.array(texts)):
            h, doc = V.ngram_hash(words, words.hashes(), 2)
            for i, t in enumerate(texts):
                assert one.setdefault(t, h[doc == i].tolist()) == h[doc == i].tolist()


@pytest.fixture(scope="module")
def pair():
    return bpe.automaton(PATH), Tokenizer.from_file(PATH)


def test_encodes_and_decodes_as_the_library(pair):
    automaton, library = pair
    rng = random.Random(2)
    texts = [t or "" for t in cases.texts()] + ["  a  b\n\n c\t\td ", "it's I'LL we've", "-" * 500 + "=" * 300, "aaaaa" * 50, " " * 300, "a\x85b c　d"]
    texts += ["".join(rng.choice("aaabehtion rsé '.,1290\n\t ßx") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = automaton.encode(text)
        assert got == want.ids, text
        assert automaton.decode(got) == library.decode(want.ids, skip_special_tokens=False) == text


def test_every_token_is_its_own_encoding(pair):
    automaton, library = pair
    texts = [library.decode([i]) for i in range(0, 50_256, 7)]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert automaton.encode(t) == want.ids


def test_automaton_arcs_follow_the_merges():
    """On a tiny merge list every string's encoding equals repeated merging of the best pair."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "b"), ("aa", "aa"), ("ab", "ab"), ("aab", "b")]
    vocab = {t: i for i, t in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
    automaton = bpe.Automaton(vocab, merges, {})

    def merged(word):
        parts = list(word)
        for x, y in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    for n in range(1, 11):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert automaton.encode_word(word.encode()) == merged(word), word


def test_spark_digests_and_round_trip(spark, pair):
    _, library = pair
    docs = cases.documents(spark)
    want = sorted((str(r[0]), len(ids := library.encode(r[1] or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in cases.rows())
    got = bpe.digests(docs, PATH).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(map(str, (r["text"] for r in back.collect()))) == sorted(r[1] or "" for r in cases.rows())
    assert bpe.digests(cases.empty(spark), PATH).count() == 0


def test_packing_uses_the_same_ids(pair):
    _, library = pair
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), (("<|endoftext|>", 50256),))
    for t in cases.texts():
        assert enc.encode_to_numpy(t or "", allowed_special="all").tolist() == library.encode(t or "", add_special_tokens=False).ids

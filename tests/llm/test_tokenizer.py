"""Token ids against the public library, and defined results for odd texts."""

import base64
import os
import random

import numpy as np
import pytest

from quadloom.llm import tokenizer as T
from quadloom.llm.spans import Spelled, span_hashes

PATH = T.vocabulary_path("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocabulary, texts):
    flat, counts = vocabulary.ids(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


TEXTS = [
    "", " ", "  ", "\n", "a", "it's we're I'll 'd 'x '' ''s 's's don't  's\n't", "a  b", "a \n b", "tab\t\tx", "x   ", "<|endoftext|>", "漢字とかな、漢字", "1234567", "²½ x¹", "a b", "a 　b",
    "🔧🔧 é́", "\ud83d".encode("utf-8", "replace").decode(), "ab" * 2000, "a" * 5000, " " * 3000 + "x", "漢" * 3000, "'", "''", "x'", "x'r", "x're", "'ll'll", "!'s", "\r\n\r\nx",
]


def test_equals_library(vocabulary, library):
    assert ids(vocabulary, TEXTS) == [library.encode_ordinary(t) for t in TEXTS]
    assert vocabulary.counts(TEXTS).tolist() == [len(library.encode_ordinary(t)) for t in TEXTS]


def test_random_texts_equal_library(vocabulary, library):
    random.seed(1)
    texts = ["".join(random.choice("abcst'  \n\tréё漢の12½.,;-_— ") for _ in range(random.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(chr(random.choice([random.randint(32, 0x2FF), random.randint(0x370, 0x30FF), random.randint(0x1F000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    assert ids(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_matrix_and_heap_agree(vocabulary):
    random.seed(2)
    for n in (2, 7, 60, 700):
        word = "".join(random.choice("abcdeé漢") for _ in range(n))
        assert vocabulary._merge_long(word.encode()).tolist() == list(vocabulary.encode_pieces([word])[word])


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    texts = [f"word{i} other{i}" for i in range(50)]
    forgetful = T.Vocabulary(vocabulary.whole)
    want = ids(forgetful, texts)
    again = [ids(vocabulary, [t])[0] for t in texts]
    assert again == want == [ids(forgetful, [t])[0] for t in texts]


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_pieces_of_one_hash_keep_their_own_ids(vocabulary, library, n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    cp = np.frombuffer((word + other).encode("utf-32-le"), dtype=np.uint32)
    hashes = span_hashes(cp, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] == hashes[1] and word != other
    want = [library.encode_ordinary(t) for t in (word, other)]
    assert want[0] != want[1]
    for texts in ([word, other, word], [other, word, other], [word + " x " + other, "y", other]):
        fresh = T.Vocabulary(vocabulary.whole)
        for _ in range(2):
            assert ids(fresh, texts) == [library.encode_ordinary(t) for t in texts]
        assert [ids(fresh, [t])[0] for t in (other, word)] == [want[1], want[0]]


def test_spelled_spans(monkeypatch):
    from quadloom.llm import spans

    random.seed(3)
    # Hashes of three values only: the code points alone decide.
    monkeypatch.setattr(spans, "span_hashes", lambda cp, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    table, numbers = Spelled(60), {}
    for _ in range(60):
        words = ["".join(random.choice("ab漢") for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 12))]
        gap = random.choice(["", "-"])
        text = gap.join(words)
        ends = np.cumsum([len(w) + len(gap) for w in words]) - len(gap)
        starts = ends - np.array([len(w) for w in words])
        got, new, forgotten = table.numbers(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), starts, ends)
        if forgotten:
            numbers.clear()
        for i in new:
            assert words[i] not in numbers
            numbers[words[i]] = len(numbers)
        assert got.tolist() == [numbers[w] for w in words]


def test_pair_table(vocabulary):
    left = np.array([vocabulary.whole[b"t"], vocabulary.whole[b"t"], -1], dtype=np.int32)
    right = np.array([vocabulary.whole[b"h"], vocabulary.whole[b"\x00"], 5], dtype=np.int32)
    assert vocabulary.pairs.rank(left, right).tolist() == [vocabulary.whole[b"th"], T._NONE, T._NONE]


def test_frames(spark, library):
    data = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "hello world", "x"), (4, "漢字 " * 3000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.token_ids(df).collect()), key=repr)
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in data), key=repr)
    counts = sorted((tuple(r) for r in T.token_counts(df).collect()), key=repr)
    assert counts == sorted(((i, len(library.encode_ordinary(t or ""))) for i, t, _ in data), key=repr)
    assert T.token_ids(df.limit(0)).collect() == []

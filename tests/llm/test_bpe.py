import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veilgrid.llm.bpe import codec, digest_documents, encode_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = codec(PATH, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_the_library(both):
    own, library = both
    rnd = random.Random(1)
    texts = ["", " ", "\n\n", "a" * 5000, "ab" * 3000, "don't  stop\t\n 12", "é漢字😀́"]
    texts += ["".join(rnd.choice("abcdeéß 漢字😀\n\t  12thingtion") for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_rows_and_nulls(spark, both):
    _, library = both
    docs = spark.createDataFrame([(1, "hello thing", "x"), (1, "hello thing", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    got = sorted(map(tuple, digest_documents(docs, PATH, public_tokenizers.PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = np.array(library.encode_ordinary("hello thing"), "<u4").tobytes()
    one = (1, len(ids) // 4, sha(ids), sha(b"hello thing"))
    assert got == sorted([one, one, (2, 0, sha(b""), sha(b"")), (3, 0, sha(b""), sha(b""))])
    assert [bytes(r.decoded) for r in encode_documents(docs, PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [b"hello thing", b"hello thing", b"", b""]
    assert digest_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_large_ids_beside_a_null_one(spark):
    docs = spark.createDataFrame([(9007199254740993, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in digest_documents(docs, PATH, public_tokenizers.PATTERN).collect()} == {9007199254740993, None}

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
NASTY = [None, "", " ", "  ", "\n", "a  b", "a \n b", "a\n \nb", "x   ", "x \n", "\n x", "it's we'll I'D", "ééé ßß 日本語 ж", "a" * 500,
         "<|endoftext|> <s> [INST]", "tab\tand\u00a0nbsp \u3000wide", "  lead", "tail  ", "a b" * 300, "🙂🙂 ok\r\n\r\n", "0 12 345 !!! ??"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces(reference):
    enc = bpe.BacktrackingEncoder(bpe.parse_ranks(bpe.read_ranks(VOCAB)))
    rnd = random.Random(3)
    for _ in range(4000):
        piece = "".join(rnd.choice(["a", "aa", "the", "tion", "é", "zz", "!!", "  ", "0", "ж", "日", "\n", "ing"]) for _ in range(rnd.randint(1, 10))).encode()
        assert enc.encode(piece) == reference._core_bpe.encode_single_piece(piece)


def test_documents_with_clashing_columns(spark, reference):
    rnd = random.Random(5)
    texts = NASTY + ["".join(rnd.choice(" \n\tab1é!") for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    rows = [(i, t, "old", "x") for i, t in enumerate(texts)] + [(0, "same id", "old", "x")] * 2 + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded string")
    out = bpe.decode_documents(bpe.encode_documents(docs, VOCAB, P.PATTERN), VOCAB).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.token_ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = bpe.decode_documents(bpe.encode_documents(docs, VOCAB, P.PATTERN), VOCAB)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "token_ids", "decoded"]

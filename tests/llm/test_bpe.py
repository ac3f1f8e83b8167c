"""Encoding against the tokenizers library, decoding as an exact round trip."""

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lemmaforge.llm.bpe import Encoder, Vocabulary, decode_ids, encode_texts, token_report
from lemmaforge.llm.words import sha256_hex

import numpy as np

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = Encoder(Vocabulary(PATH), most=50)
HARD = [
    "", " ", "  a", "a  ", "a b ", "\n", "a \n b", "\ta\t", "it's we'll I'D 'tis", "ünï 漢字 ½ Ⅷ ² _x_", "\x1c a\x1fb", " x   y  z",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endof", "é \U0001f600\U0001f468‍\U0001f469", "x" * 5000, "12345 6.7", "a\r\n\r\n b", "\x00\x85 q",
]


def same(text):
    assert np.frombuffer(OURS.encode(text), np.int32).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n'asté9.\t\x1c漢", max_size=60))
def test_any_text(text):
    same(text)


def test_report(spark):
    rng = random.Random(1)
    texts = [*HARD, *("".join(rng.choices("the and ing ou\n .,é9", k=k)) for k in (10, 200, 3000))]
    for t in texts:
        same(t)
    rows = [*enumerate(texts), (98, None), (None, "a b"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "'y' as decoded")
    want = []
    for i, t in rows:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        text = THEIRS.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha256_hex(",".join(map(str, ids))), sha256_hex(text)))
    assert sorted(map(tuple, token_report(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert token_report(df.limit(0), PATH).count() == 0


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([([50256, 99999, -1, 64],), (None,), ([200],)], "ids array<int>")
    got = [r.decoded for r in decode_ids(df, PATH).collect()]
    assert got == ["<|endoftext|>" + THEIRS.decode([64]), "", THEIRS.decode([200])]
    assert encode_texts(spark.createDataFrame([(1, "a")], "k int, t string"), PATH, "k", "t").columns == ["k", "ids"]

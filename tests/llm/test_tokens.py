import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row
from tokenizers import Tokenizer

from veilframe.llm.byte_bpe import ByteBpe, encode
from veilframe.llm.token_counts import Counter, count_tokens

ODD = ["", " ", "a", "\n\n  x", "ab" * 2000, "a" * 3001, "<|endoftext|>x<|startoftext|> y", "ΑΣ Σ ΟΔΟΣ", "İI ıſK", "é Å ﬁ", "日本語テキスト👍🏽",
       "\x1c\x1d\x85\xa0 　 z", "it's IT'S we'll", "1234 ½ ٣", "\x00\x01", "<|endoftext", "x" * 700 + " " * 900 + "!" * 600,
       "thethethethethe" * 100, "ß" * 400, "​﻿ ᠎", "aͅΣ", "Ǆ ǅ ẞ"]


def texts():
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(32, 127), 10, 9, 0xE9, 0xDF, 0x3A3, 0x130, 0x301, 0x4E00, 0x1F600, 0xA0, 0x2003, 0x1C, 0x85]]
    return ODD + ["".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(400)] + ["".join(rng.choices("abtheinr ", k=2000)) for _ in range(10)]


def test_encoding_is_the_librarys_and_decodes():
    path = P.path("byte_bpe_50k.tiktoken")
    lines = open(path, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = ByteBpe(lines, P.PATTERN)
    for text, ids in zip(texts(), model.encode(texts())):
        assert ids.tolist() == library.encode_ordinary(text), text[:50]
        assert model.decode(ids) == text.encode()


def test_counts_are_the_librarys():
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    model = Counter(open(path, encoding="utf-8").read())
    expected = [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    got = model.count(texts())
    assert [(t[:30], a) for t, a, b in zip(texts(), got, expected) if a != b] == []


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (1, "two words"), (1, "two words")]])
def test_tables(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="x", n_bytes="y") for i, t in rows] or [],
                                 "doc_id long, text string, ids string, n_bytes string")
    coded = encode(docs).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in coded) == sorted((str(i), t or "") for i, t in rows)
    counted = count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted) == sorted((str(i), len(t or ""), 2 if t else 0) for i, t in rows)
    for r in coded:
        assert len(hashlib.sha256(r.ids).hexdigest()) == 64 and len(np.frombuffer(r.ids, "<u4")) == (2 if r.decoded else 0)

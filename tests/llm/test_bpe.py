import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    coder, rng = bpe.coder(bpe.read_spec(PATH)), random.Random(5)
    letters = [chr(c) for r in ((0, 0x250), (0x300, 0x340), (0x1670, 0x1690), (0x2000, 0x2070), (0x3000, 0x3010)) for c in range(*r)]
    letters += [chr(c) for c in (0x1F600, 0x1F468, 0x4E00, 0xAC00, 0x180E, 0x85, 0xFEFF, 0x660)]
    for _ in range(4000):
        text = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice("abc the'sll  \n\t123") for _ in range(rng.choice([0, 1, 4, 25])))
        if rng.random() < 0.05:
            text += "<|endoftext|>" + text
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_long_word(library):
    word = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    assert bpe.coder(bpe.read_spec(PATH)).encode(word) == library.encode(word, add_special_tokens=False).ids


def test_known_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    coder = bpe.Coder(bpe.read_spec(PATH))
    text = " ".join(f"word{i}" for i in range(100))
    assert coder.decode(coder.encode(text)) == text and len(coder.known) <= 10


def test_columns(spark, odd_documents, no_documents, library):
    coded, name = bpe.with_codes(odd_documents, PATH)
    assert coded.columns == [*odd_documents.columns, name]
    rows = coded.select("text", F.col(name).ids.alias("found"), F.col(name).decoded.alias("decoded"),
                        bpe.ids_digest(F.col(name).ids).alias("digest")).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = r["text"] or ""
        assert r["found"] == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    assert bpe.with_codes(no_documents, PATH)[0].count() == 0
    ids = odd_documents.select("text", bpe.encoder(spark, PATH)("text").alias("i"))
    for r in ids.select("text", bpe.decoder(spark, PATH)("i").alias("back")).collect():
        assert r["back"] == (r["text"] or "")

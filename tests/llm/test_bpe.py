"""The transducer against the library, letter by letter and text by text."""

import json
import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer as Library

from loomrow.llm import bpe
from loomrow.llm.bpe import Encoder, Tokenizer, default_tokenizer, encoded, op9_bpe
from loomrow.llm.common import beyond_latin, latin_pattern


@pytest.fixture(scope="module")
def library():
    found = Library.from_file(default_tokenizer())
    found.no_padding()
    found.no_truncation()
    return found


@pytest.fixture(scope="module")
def own():
    return Tokenizer(open(default_tokenizer(), encoding="utf-8").read())


def fuzzed():
    rng = random.Random(1)
    letters = "abcdefghthein 'sXYZ09.,!?éüßñσΣİ́\u0085\x1c\x1f　\xa0\n\t字😀<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice("thein") for _ in range(rng.randrange(60, 700))) for _ in range(150)]
    return texts + ["", "a" * 5000, "<|endoftext|>a <|startoftext|>", "<|endoftext", "é" * 400, "th" * 300 + "!" * 300]


def test_ids_and_text_are_the_library_s(library, own):
    for text in fuzzed():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_letters_and_digits_of_any_unicode_version(library, own):
    """Every code point once: classes that differ between versions of Unicode cut words like the library does."""
    points = [c for c in range(0x80, 0x32000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 500):
        text = "a" + "a".join(map(chr, points[start : start + 500])) + "1"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(points[start])


def test_rules_come_from_the_file(library):
    described = json.loads(open(default_tokenizer(), encoding="utf-8").read())
    for token, text in zip(described["added_tokens"], ("[BEGIN]", "@end@")):
        token["content"] = text
    described["normalizer"] = {"type": "NFC"}
    content = json.dumps(described)
    theirs, ours = Library.from_str(content), Tokenizer(content)
    theirs.no_padding()
    for text in ("a[BEGIN]b @end@", "<|endoftext|>", "lower case only, café"):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_tokens_leave_early_and_memory_stays_constant(own):
    merges, rng = own.merges, random.Random(2)
    symbols = [rng.choice("thein") for _ in range(3000)]
    machine, out, ahead = Encoder(merges), [], merges.lookahead()
    for count, symbol in enumerate(symbols, 1):
        out += machine.push(symbol)
        waiting = count - sum(map(len, out))
        assert waiting <= ahead + merges.longest + machine.EVERY
        assert len(machine.nodes) <= merges.longest and len(machine.tail) <= merges.longest
    assert waiting < 200
    assert out + machine.finish() == merges.merged(symbols)


def test_text_comes_back_by_whole_characters(own):
    pieces = list(own.text(own.encode("Héllo 字😀 <|endoftext|>x")))
    assert "".join(pieces) == "héllo 字 😀 <|endoftext|>x "


def test_nulls_repeats_clashes_long_and_empty(spark, library):
    long = "word " * 100_000
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3), (3, long, 4)], "doc_id long, text string, tokens int")
    got = sorted((r.doc_id or 0, len(r.tokens)) for r in encoded(df, default_tokenizer()).collect())
    assert got == [(0, 0), (1, 0), (2, 2), (2, 2), (3, 100_000)]
    assert encoded(df, default_tokenizer()).columns == ["doc_id", "text", "tokens"]
    assert encoded(df.limit(0), default_tokenizer(), digests=True).count() == 0


def test_query(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op9_bpe(spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(decoded.encode()).hexdigest()


def test_words_of_any_length_go_through_the_transducer(monkeypatch):
    tokenizer, pushed, push = Tokenizer(open(default_tokenizer(), encoding="utf-8").read()), [], bpe.Encoder.push
    monkeypatch.setattr(bpe.Encoder, "push", lambda self, symbol: pushed.append(symbol) or push(self, symbol))
    for word in ("a", "word", "x" * 64, "y" * 65):
        pushed.clear()
        ids = tokenizer.word_ids(word)
        assert pushed == [*word[:-1], word[-1] + tokenizer.merges.mark]
        assert [tokenizer.pieces[i] for i in ids] == tokenizer.merges.merged(list(pushed))


def test_latin_texts_take_a_plainer_pattern(own):
    """Words of ASCII and Latin letters are the same by the plainer pattern, at every character and its neighbours."""
    chars = [chr(c) for c in (*range(0x80), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
    rng = random.Random(4)
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(3000)] + ["it's they'll I'd we've 'S x''t", " \x1c\x1f\t a\x0b\n "]
    assert own.plain and not any(map(beyond_latin, texts)) and all(map(beyond_latin, "\x85\xa0\xd7ɐ一"))
    for text in texts:
        assert own.plain(text) == own.found(text)


def test_patterns_that_cannot_be_written_out():
    assert all(latin_pattern(p) is None for p in (r"\p{Lu}+", r"(?i:a)", r"\d", r"[\S]"))
    assert latin_pattern(r"\S+(?!\S)").findall("a b") == ["a", "b"]

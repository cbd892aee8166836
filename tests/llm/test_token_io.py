"""Coded ids decode to what was coded, and files of ids hold what the library says."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomrow.llm import token_coder, token_io
from loomrow.llm.token_io import Encoder, op7_token_io, packed, read_tokens, unpacked_block, write_tokens

PATH = public_tokenizers.path(token_io.TOKENIZER)


@pytest.mark.parametrize(("count", "vocabulary"), [(0, 7), (1, 7), (130, 2), (5000, 50257), (200_000, 300), (3, 1)])
def test_coder_round_trip(count, vocabulary):
    ids = np.random.default_rng(count).integers(0, vocabulary, count)
    assert (token_coder.decode(token_coder.encode(ids, vocabulary)) == ids).all()


def test_coder_learns_and_refuses_damage():
    ids = np.tile(np.arange(40), 4000)
    block = token_coder.encode(ids, 50257)
    assert len(block) < len(ids) / 4 and (token_coder.decode(block) == ids).all()
    middle = len(block) // 2
    changed = block[:middle] + bytes([block[middle] ^ 8]) + block[middle + 1 :]
    for damaged in (block[:-2], block[:10], b"x" + block[1:], changed):
        with pytest.raises(ValueError):
            token_coder.decode(damaged)


@pytest.mark.parametrize("copies", [1.0, 0.34])
def test_rare_ids_among_copies_have_code_space(copies):
    rng = np.random.default_rng(11)
    text, lanes, count = rng.integers(0, 20_000, 300), 4096, 1 << 21
    ids = np.tile(text, count // len(text) + 1)[:count]
    documents = np.repeat(rng.random(count // 300 + 1) < copies, 300)[:count]
    ids[~documents] = np.minimum(rng.zipf(1.3, count), 20_000)[~documents]
    late = rng.random(count) < 0.01 * (np.arange(count) % (count // lanes) > 100)
    ids[late] = rng.integers(20_000, 50_257, late.sum())
    block = token_coder.encode(ids, 50_257)
    assert (token_coder.decode(block) == ids).all()


def test_every_id_has_code_space_at_the_surest():
    model = token_coder.Model(50_257, 2)
    model.right[:], model.tried[:] = 1 << 30, (1 << 30) + 1
    model.sure_one[0] = model.sure_two[0] = token_coder.CONFIDENCES - 1
    model.frequency[7] = 1 << 25
    model.predict()
    starts, sizes = zip(*(model.interval(np.full(2, i)) for i in range(1, 50_257)))
    assert np.min(sizes) > 0
    for start, size, i in zip(starts, sizes, range(1, 50_257)):
        assert (model.found(start) == i).all() and (model.found(start + size - 1) == i).all()


def test_blocks_of_the_first_version_are_read():
    block = bytes.fromhex("544944420190010000000000000500000001000000bae6d247090000001931412185e25d02dc750000000000000000")
    assert block[4] == 1 and (token_coder.decode(block) == np.arange(400) % 5).all()


def test_blocks_hold_whole_documents():
    keys, ids = [None, -5, 2**40], [np.array([1, 0]), np.array([0]), np.array([], dtype=int)]
    found = unpacked_block(packed(keys, ids, 10))
    assert found[0] == keys and [i.tolist() for i in found[1]] == [i.tolist() for i in ids]
    with pytest.raises(ValueError):
        unpacked_block(b"TIDF" + b"\0" * 30)


def test_words_encode_as_in_their_text():
    library, own = Tokenizer.from_file(PATH), Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    letters = "abcdeé'st  \n\t 　\x1c\x85ÄÖ0159.,!字😀<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|>a <|endoftext|>", "a  b   \n\n c", "it's I'LL we'll", None, ""]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_in_key_order(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6) - 500_000, "w%d " % i * rng.randrange(30)) for i in range(300)]
    rows += [(None, "x"), (None, None), (3, "same"), (3, "same"), (4, ""), (5, "long " * 60_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(7)
    write_tokens(df, str(tmp_path / "t"), PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, len(r.tokens)) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    assert [(k, s, n, c) for s, k, n, c, _ in got] == expected(rows) and all(n == m for _, _, n, _, m in got)
    write_tokens(df.limit(0), str(tmp_path / "e"), PATH)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op7_token_io(spark, data).collect())
    assert got == expected(rows)


def test_latin_texts_are_parted_by_a_plainer_pattern():
    rng = random.Random(5)
    chars = [chr(c) for c in (*range(0x80), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
    texts = ["".join(rng.choices(chars + [" "] * 200, k=rng.randint(1, 60))) for _ in range(3000)] + ["it's  they'll 12a \n\n b  "]
    for text in texts:
        assert token_io.PLAIN_WORDS.findall(text) == token_io.WORDS.findall(text)
    library = Tokenizer.from_file(PATH)
    found = Encoder(open(PATH, encoding="utf-8").read()).encode(texts)
    assert all(list(f) == library.encode(t, add_special_tokens=False).ids for f, t in zip(found, texts))


def test_words_are_remembered_as_few_bytes(monkeypatch):
    monkeypatch.setattr(token_io, "BATCH_WORDS", 3)
    path = public_tokenizers.path(token_io.TOKENIZER)
    with open(path, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    texts = ["plain words, and others that are plain words: 1234 tails", None, ""]
    whole = Tokenizer.from_file(path)
    assert [i.tolist() for i in encoder.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(isinstance(ids, bytes) and len(ids) % 4 == 0 for ids in encoder.known.values())


def test_new_latin_words_are_asked_of_the_model_alone():
    with open(PATH, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    library, asked = encoder.tokenizer, []

    class Watched:
        def __getattr__(self, name):
            asked.append(name)
            return getattr(library, name)

    encoder.tokenizer = Watched()
    texts = ["it's naïve: 12  \n\n Ärger\x1c\x7f don't ", "a" * 5000, " ", None, ""]
    assert [i.tolist() for i in encoder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not asked
    assert [i.tolist() for i in encoder.encode(["字 a"])] == [library.encode("字 a", add_special_tokens=False).ids] and asked


def test_ids_that_a_context_names_are_not_searched_for(monkeypatch):
    ids, searched = np.tile(np.arange(40), 4000), []
    block = token_coder.encode(ids, 50_257)
    search = np.searchsorted
    monkeypatch.setattr(token_coder.np, "searchsorted", lambda a, v, **k: searched.append(np.size(v)) or search(a, v, **k))
    assert (token_coder.decode(block) == ids).all()
    assert sum(searched) < len(ids) / 4

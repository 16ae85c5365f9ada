"""Token files: exact round trips, random access, damage."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from tidemark.llm import pieces, tokenfiles as tf
from tidemark.session import scratch_path

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = ["", None, "Hello world", "a  b\n\n c's 12 é漢字 \U0001f600", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endoftext |> \n<|endoftext|>\n", "x" * 5000, "word " * 20000, "Hello world", "\x00\x7f ­", "\x1c\x1d \x85\xa0　x\x0b", "été  ª²½ x\x85y"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_files_give_back_what_the_library_encodes(spark):
    rows = [(i * 7 % 13 - 3, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(4)
    manifest = tf.write(df, scratch_path(spark, "t"), PATH, PATTERN)
    want, start, lib = [], 0, library()
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.checksums(spark, manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert {r.doc_id: len(r.ids) // 4 for r in tf.read(spark, manifest).collect()} == {r[0]: r[2] for r in want}


def test_random_access_seek_table_and_damage(tmp_path):
    path = str(tmp_path / "a.zst")
    docs = [(5, np.arange(10, dtype="<u4").tobytes()), (None, b""), (9, np.arange(70000, dtype="<u4").tobytes())]
    assert tf.write_file(path, iter(docs)) == (3, 70010)
    f = tf.TokenFile(path)
    assert f.keys == [5, None, 9] and [f.read(i).tobytes() for i in (2, 0, 1)] == [docs[2][1], docs[0][1], b""]
    assert list(tf.take(path, [9])) == [9]
    whole = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(whole) == b"".join(d for _, d in docs)
    broken = bytearray(whole)
    broken[12] ^= 255
    open(path, "wb").write(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.TokenFile(path).read(0)
    assert len(tf.TokenFile(path).read(2)) == 70000
    with pytest.raises(ValueError):
        open(path, "wb").write(whole[:-1])
        tf.TokenFile(path)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest = tf.write(df, scratch_path(spark, "t"), PATH, PATTERN)
    assert tf.checksums(spark, manifest).count() == 0 and manifest.count() == 0


def test_memory_is_bounded_and_keeps_common_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "PIECES", 50)
    asked = []

    def encode(new):
        asked.extend(new)
        return [p.encode() for p in new]

    memory = pieces.Remembering(PATTERN, encode, ["<end>"])
    for i in range(60):
        text = f"the<end> {'x' * i} {'y' * i}"
        assert b"".join(memory.encode([text, text])) == 2 * text.encode()
    assert len(memory.known) + len(memory.old) < 120 and asked.count("the") == asked.count("<end>") == 1


def test_pieces_are_looked_up_once_and_new_ones_once_more():
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    memory = pieces.Remembering(PATTERN, lambda new: [p.encode() for p in new])
    memory.known = Counting()
    texts = ["a b c d e f g h", "a b c d e f g new", "a b c d e f g h"]
    assert b"".join(memory.encode(texts[:1])) == texts[0].encode()
    Counting.asked = 0
    assert list(memory.encode(texts)) == [t.encode() for t in texts]
    assert Counting.asked == 3 * 8 + 1


def test_words_of_many_scripts_cut_as_the_library_cuts_them():
    lib, rng = library(), np.random.default_rng(2)
    letters = [chr(i) for i in range(0x250, 0x30000) if chr(i).isalpha()]
    words = [" " + "".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(1500)] + [" the", " a", " é", " x" * 1, " \U0003134a"] + [f" w{'o' * i}rd" for i in range(600)]
    got = tf.encoder(PATH, PATTERN).encode_pieces(words)
    assert [np.frombuffer(raw, "<u4").tolist() for raw in got] == [lib.encode(word, add_special_tokens=False).ids for word in words]

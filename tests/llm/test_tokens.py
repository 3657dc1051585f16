"""Tokenizer operators against the library that their files belong to."""

import array
import hashlib
import random
import zlib

import pytest
from tokenizers import Tokenizer

from pixelloom.llm import packing, transducer, vocabulary, wordbpe

BYTE, WORD = vocabulary.public_path("byte_bpe_50k.json"), vocabulary.public_path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "'l", "r", "e", "the", "ing", "Tion", "1", "23", "é", "é", "ß", "Σ", "ΑΣ", "İ", "中文", "😀", " ", " ", "#", "$$", "...", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\r\n", "LL", "'T", "²", "Ⅷ", "_", "​", "ﬁ", "ǅ"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(1500)] + ["x" * 3000, "ab" * 900, " " * 1500, "'" * 700, "the" * 800, ""]


def test_transducer_counts(strings):
    library = Tokenizer.from_file(BYTE)
    machine = transducer.transducer(BYTE)
    found = transducer.count_texts(machine, [s.encode() for s in strings]).tolist()
    assert found == [len(library.encode(s, add_special_tokens=False).ids) for s in strings]


def test_transducer_begins_anew(monkeypatch, strings):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    monkeypatch.setattr(transducer, "BLOCK_BYTES", 500)
    machine = transducer.Transducer(BYTE)
    library = Tokenizer.from_file(BYTE)
    assert transducer.count_texts(machine, [s.encode() for s in strings[:200]]).tolist() == [len(library.encode(s, add_special_tokens=False).ids) for s in strings[:200]]


def test_transducer_on_long_texts():
    """Blocks that a text crosses, periodic texts whose paths do not meet, and rounds that don't follow the length."""
    library, machine = Tokenizer.from_file(BYTE), transducer.transducer(BYTE)
    rng = random.Random(1)
    count = lambda t: transducer.count_texts(machine, [t.encode()])[0]
    for text in ("a" * 300_000, "abc" * 100_000, " \n" * 100_000, "=-" * 90_000 + "x", "".join(rng.choices("etaoinshr", k=200_000)), "".join(rng.choices("中文字é", k=60_000))):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert machine.rounds <= transducer.MAX_ROUNDS // 2 and machine.steps <= 14
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(2000)]
    line = " ".join(rng.choices(words, k=180_000)) + "\n"
    once = len(library.encode(line, add_special_tokens=False).ids)
    whole = line * (50_000_000 // len(line) + 1)
    assert len(whole) >= 50_000_000
    assert count(whole) == once * (len(whole) // len(line)) and machine.rounds <= 4


def test_transducer_follows_maps_that_stay_open(monkeypatch, strings):
    monkeypatch.setattr(transducer, "MAX_ROUNDS", 1)
    monkeypatch.setattr(transducer, "CHUNK", 7)
    machine, library = transducer.Transducer(BYTE), Tokenizer.from_file(BYTE)
    texts = [*strings[:300], "a" * 3000, "abcab" * 500]
    assert transducer.count_texts(machine, [s.encode() for s in texts]).tolist() == [len(library.encode(s, add_special_tokens=False).ids) for s in texts]


def test_word_bpe_round_trip(strings):
    library, codec = Tokenizer.from_file(WORD), wordbpe.codec(WORD)
    for s in strings:
        ids = library.encode(s, add_special_tokens=False).ids
        assert codec.encode(s) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert codec.digest(s) == (len(ids), " ".join(map(str, ids)), codec.decode(ids))


def test_scanning_and_queue_agree():
    codec, rng = wordbpe.codec(WORD), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("theraonisgé", k=rng.randint(1, 120)))
        assert codec.merge(codec.parts(word)) == codec.merge_long(codec.parts(word))


def test_digests(spark):
    docs = spark.createDataFrame([(1, "Hello  World's 12"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in wordbpe.digests(docs, WORD).collect()}
    ids = Tokenizer.from_file(WORD).encode("Hello  World's 12", add_special_tokens=False).ids
    assert found[1]["n_tokens"] == len(ids)
    assert found[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert found[2]["n_tokens"] == 0 and found[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_packing(spark, strings, prose_of, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    monkeypatch.setattr(packing, "PART_ROWS", 2)
    rng = random.Random(4)
    texts = [prose_of(rng, rng.choice([1, 30, 300, 1500, 5000])) for _ in range(80)] + strings[:100] + ["same text"] * 60
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    ids = {i: library.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
    covered = sorted((r["doc_id"], r["start"], r["length"]) for r in rows)
    for i in ids:
        at = 0
        for _, start, length in (c for c in covered if c[0] == i):
            assert start == at
            at += length
        assert at == len(ids[i])
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = padded = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
        total, padded = total + end, padded + (0 if end & (end - 1) == 0 else packing.LENGTH - end)
    assert padded < 0.1 * total


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r\n", "\u3000", "\x85", " \n"])
def test_packing_takes_long_white_space(space):
    library, encode = Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    run = space * (20_000 // len(space))
    for text in (run, f"one{run}two three", f"one two{run}", f"a b{run}c<|endoftext|>"):
        assert encode(text) == packing.le(library.encode(text, add_special_tokens=False).ids)
    text = f"one{space * (2_000_000 // len(space))}two three"
    assert library.decode(array.array("I", encode(text)).tolist(), skip_special_tokens=False) == text


def test_encoder_against_the_library(strings):
    library, encode = Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    for s in strings:
        assert encode(s) == packing.le(library.encode(s, add_special_tokens=False).ids)


def test_scanning_and_queue_around_the_limit():
    codec, rng, library = wordbpe.codec(WORD), random.Random(3), Tokenizer.from_file(WORD)
    for n in range(wordbpe.SHORT - 2, wordbpe.SHORT + 4):
        for letters in ("theraonis", "a", "ab"):
            word = "".join(rng.choices(letters, k=n))
            assert codec.merge(codec.parts(word)) == codec.merge_long(codec.parts(word)) == list(codec.word(word)) == library.encode(word, add_special_tokens=False).ids


def test_shortest_pack_first():
    packs = packing.shortest_pack_first({900: 3, 1000: 4, 100: 30, 2048: 2})
    assert sum(n for n, _ in packs) * 2048 >= sum(n * s for s, n in {900: 3, 1000: 4, 100: 30, 2048: 2}.items())
    assert all(sum(lengths) <= 2048 for _, lengths in packs)
    counted: dict = {}
    for n, lengths in packs:
        for size in lengths:
            counted[size] = counted.get(size, 0) + n
    assert counted == {900: 3, 1000: 4, 100: 30, 2048: 2}

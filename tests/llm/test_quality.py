import os
import random

import zstandard

from pixelloom.llm import quality


def plain(text: str) -> tuple:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    duplicates = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), failed


def test_counts_against_plain_ones():
    rng = random.Random(1)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    for _ in range(300):
        text = "".join(rng.choices(["a", "b ", "c\n", "é", "\x0b", "# ", " ", "\n", "a b c d e "], k=rng.randint(0, 60)))
        assert quality.measure(text, compress)[:6] == plain(text)


def test_bands(prose_of):
    rng = random.Random(2)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    for words in (60, 200, 900, 4000):
        assert quality.verdict(prose_of(rng, words, 5000).encode(), compress)[2]
    assert not quality.verdict(b"again and again " * 400, compress)[2]
    assert not quality.verdict(os.urandom(5000), compress)[2]
    half = prose_of(rng, 700, 5000).encode() + b"over and over it goes " * 1200  # most of its chunks repeat
    assert not quality.verdict(half, compress)[2]
    assert quality.verdict(b"", compress)[2]


def said_again(rng, words: list[str], times: int, size: int) -> str:
    """Words each said some times in a row, up to a size: five words in a row seldom come twice."""
    out = ""
    while len(out) < size:
        out += " ".join([rng.choice(words)] * times) + " "
    return out[:size]


def test_bands_reject_what_the_base_passes(prose_of):
    rng = random.Random(3)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    words = sorted(set(prose_of(rng, 9000, 8000).replace(".", " ").lower().split()))
    for size in (300, 450, 900, 2000, 5000, 20_000):
        for times in (3, 4):
            row = quality.measure(said_again(rng, words, times, size), compress)
            assert not row[5] and not row[6], (size, times, row)
        noise = " ".join("".join(rng.choices([chr(c) for c in range(33, 127)], k=7)) for _ in range(size // 8))
        row = quality.measure(noise, compress)
        assert not row[5] and not row[6], (size, row)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=6000))
    assert quality.measure(letters, compress)[5:7] == (False, False)
    mixed = prose_of(rng, 1800, 5000) + said_again(rng, words, 3, 6000)  # a third of its chunks
    assert quality.measure(mixed, compress)[5:7] == (False, False)


def test_short_texts_have_bands(prose_of):
    rng = random.Random(4)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    words = sorted(set(prose_of(rng, 9000, 8000).replace(".", " ").lower().split()))
    for size in (170, 210, 250):
        row = quality.measure(said_again(rng, words, 3, size), compress)
        assert not row[5] and not row[6], (size, row)
    for size in (100, 130, 170, 210, 255):
        assert quality.verdict(prose_of(rng, 80, 8000).encode()[:size], compress)[2]
    assert quality.out_of_band(204, 0.299) and quality.out_of_band(120, 0.5) and quality.out_of_band(99, 0.299) and not quality.out_of_band(40, 1.2)


def test_texts_of_every_length_are_judged(prose_of):
    """Texts under 100 bytes that say words again go, passages of prose stay; a short last chunk joins the one before."""
    rng = random.Random(5)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    words = [w for w in sorted(set(prose_of(rng, 9000, 8000).replace(".", " ").lower().split())) if len(w) > 3]
    for size in (64, 75, 85, 95):
        row = quality.measure(said_again(rng, words, 5, size), compress)
        assert not row[6], (size, row)
    for size in (40, 55, 65, 75, 85, 95):
        for _ in range(50):
            assert quality.verdict(prose_of(rng, 80, 8000).encode()[:size], compress)[2]
    prose = prose_of(rng, 3000, 5000).encode()[:8192]
    for tail in (1, 100, 255, 256, 300):
        ratio, bad, good = quality.verdict(prose + b"x" * tail, compress)
        assert good and bad == (tail / (8192 + tail) if tail >= 256 else 0.0), (tail, bad)


def test_verdicts_against_plain_ones(spark, prose_of):
    """The query's ratio, share of bad chunk bytes and verdict against the rules written out."""
    rng = random.Random(6)
    texts = [prose_of(rng, n, 3000) for n in (12, 40, 300, 900, 2500)] + ["again and over " * n for n in (5, 300)] + ["".join(rng.choices("abcdef ghij#", k=9000)), "", None]
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress

    def band(data: bytes) -> bool:
        ratio = len(compress(data)) / len(data)
        low, high = [limits for least, *limits in quality.BANDS if len(data) >= least][-1]
        return low <= ratio <= high

    for r in quality.compression_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        data = (texts[r["doc_id"]] or "").encode()
        chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
        if chunks and len(chunks[-1]) < 256:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        bad = sum(len(c) for c in chunks if not band(c)) / max(1, len(data))
        assert r["zstd_ratio"] == (len(compress(data)) / len(data) if data else 0.0) and r["bad_chunk_share"] == bad
        assert (r["base_failed"], r["kept"]) == (plain(texts[r["doc_id"]] or "")[5], not plain(texts[r["doc_id"]] or "")[5] and band(data) and bad <= 0.25)

import numpy as np
import pytest
from cases import words

from edgelight.llm import hashing, repeats


@pytest.mark.parametrize("text", ["", "  ", "a", " Ab  cd\tEF\n\x0b\x0c\r é x ", "x" * 700_000 + " y", "w " * 200_000])
def test_word_hashes_tell_words_apart(text):
    plain = words(text)
    got = hashing.word_hashes(text.encode(), fold=False)
    assert len(got) == len(plain)
    by = {}
    for h, w in zip(got.tolist(), plain, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert (hashing.word_hashes(text.upper().encode(), True) == hashing.word_hashes(text.lower().encode(), True)).all() or not text.isascii()


@pytest.mark.parametrize("words_,width,gram", [(False, 50, 16), (True, 35, 8)])
def test_equal_windows_have_equal_anchors(words_, width, gram):
    kind = repeats.Kind(words_, width, gram, True)
    rng = np.random.default_rng(0)
    shared = b" ".join(b"w%d" % x for x in rng.integers(0, 50, 80))
    texts = [b"left one " + shared + b" q", b"r " + shared + b" and more of it", b"", b"short"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = {}
    for piece in repeats.pieces(data, offsets, kind):
        start, document, at, h = repeats.anchors(piece, kind)
        for s, a, x in zip(start.tolist(), at.tolist(), h.tolist(), strict=True):
            window = tuple(piece.units[s : s + width].tolist())
            assert seen.setdefault(window, (a - s, x)) == (a - s, x) and 0 <= a - s <= width - gram
    assert repeats.unpack40(repeats.pack40(h)).tolist() == h.tolist()


def test_long_documents_come_in_pieces(monkeypatch):
    kind = repeats.Kind(False, 50, 16, True)
    data = np.frombuffer(np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8).tobytes(), np.uint8)
    whole = [repeats.anchors(p, kind)[3].tolist() for p in repeats.pieces(data, np.array([0, 5000]), kind)]
    monkeypatch.setattr(repeats, "BLOCK", 700)
    parts = [repeats.anchors(p, kind)[3].tolist() for p in repeats.pieces(data, np.array([0, 5000]), kind)]
    assert len(whole) == 1 and len(parts) == 8 and sum(parts, []) == whole[0]

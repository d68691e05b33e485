"""Byte spans, their hashes and word shingles against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import text


def thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


def test__spans__thue_morse_and_complement__differ():
    raw = thue_morse(2048)
    buf = np.frombuffer(raw + raw.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    for n in (8, 64, 256, 1024, 2048):
        a, b = text.spans(buf, np.array([0, 2048]), np.array([n, 2048 + n]))
        assert a != b
    hashed = text.windows(buf, 128)
    plain = [bytes(buf[i : i + 128]) for i in range(len(hashed))]
    assert len(set(hashed.tolist())) == len(set(plain))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700), st.data())
def test__spans__equal_hashes__only_equal_bytes(raw, data):
    buf = np.frombuffer(raw, np.uint8)
    cuts = data.draw(st.lists(st.tuples(st.integers(0, len(raw)), st.integers(0, len(raw))), min_size=1, max_size=30))
    starts, ends = np.array([min(c) for c in cuts]), np.array([max(c) for c in cuts])
    got = text.spans(buf, starts, ends)
    plain = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    assert all((x == y) == (p == q) for x, p in zip(got, plain, strict=True) for y, q in zip(got, plain, strict=True))
    for width in (1, 3, 8, 13, 32):
        rolled = text.windows(buf, width)
        pieces = [raw[i : i + width] for i in range(len(raw) - width + 1)]
        assert len(rolled) == len(pieces) and len(set(rolled.tolist())) == len(set(pieces))


def test__words__odd_texts__as_split():
    texts = ["", None, " a  b\tc\n", "é x\x0b\x0cy", "one", "   ", "x" * 600 + " y"]
    for first, last, buf, bounds in text.chunks(pa.array(texts)):
        starts, ends, at = text.words(buf, bounds)
        for i in range(first, last):
            got = [bytes(buf[starts[k] : ends[k]]).decode() for k in range(at[i - first], at[i - first + 1])]
            assert got == [w for w in (texts[i] or "").encode().decode().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]

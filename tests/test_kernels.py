import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lading.functions import kernels as K


def test_known_answers():
    assert K.crc16(b"123456789") == 0xBB3D
    assert K.crc16_ccitt(b"123456789") == 0x31C3
    assert K.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    aes = K.Aes(bytes(range(16)))
    assert aes.encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert K.Aes(bytes(range(32))).encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"


@given(st.binary(min_size=16, max_size=16), st.sampled_from([16, 24, 32]))
def test_aes_back(block, size):
    aes = K.Aes(bytes(range(size)))
    assert aes.decrypt(aes.encrypt(block)) == block


@given(st.binary(max_size=300))
def test_crc_table_is_the_library_s(data):
    table, crc = K.crc_table(0xEDB88320), 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    assert crc ^ 0xFFFFFFFF == zlib.crc32(data)


def test_run_lengths():
    assert K.rle90(b"ab\x90\x04\x90\x00") == b"abbbb\x90"
    with pytest.raises(K.Damaged):
        K.rle90(b"a\x90")


def test_squeeze():
    # one inner node: a zero bit is 'a', a one bit ends
    assert K.squeeze(b"\x01\x00" + (-ord("a") - 1).to_bytes(2, "little", signed=True) + (-257).to_bytes(2, "little", signed=True) + bytes([0b0100])) == b"aa"


def _compressed(data: bytes, most: int = 12) -> bytes:
    """A plain LZW encoder in compress's layout, for the round trip."""
    table, width, used, bits, out = {bytes([i]): i for i in range(256)}, 9, 0, [], b""
    nxt, word = 257, b""

    def put(code):
        nonlocal used
        bits.extend(code >> i & 1 for i in range(width))
        used += 1

    for b in data:
        if (more := word + bytes([b])) in table:
            word = more
            continue
        put(table[word])
        if nxt < 1 << most:
            table[more] = nxt
            nxt += 1
            if nxt > (1 << width) and width < most:
                bits.extend([0] * (-used % 8 * width))
                width, used = width + 1, 0
        word = bytes([b])
    if word:
        put(table[word])
    bits.extend([0] * (-len(bits) % 8))
    out = bytes(sum(bits[i + k] << k for k in range(8)) for i in range(0, len(bits), 8))
    return b"\x1f\x9d" + bytes([0x80 | most]) + out


@given(st.binary(max_size=3000))
def test_unix_compress(data):
    assert K.unix_compress(_compressed(data)) == data


def _lzw(data: bytes, most: int = 13) -> bytes:
    table, width, bits, word, nxt = {bytes([i]): i for i in range(256)}, 9, [], b"", 258

    def put(code):
        bits.extend(code >> i & 1 for i in range(width))

    known = 258
    for k, b in enumerate(data):
        if (more := word + bytes([b])) in table:
            word = more
            continue
        put(table[word])
        if nxt < 1 << most:
            table[more] = nxt
            nxt += 1
        known = nxt - 1
        if known >= 1 << width and width < most:
            width += 1
        word = bytes([b])
    if word:
        put(table[word])
        if nxt >= 1 << width and nxt < (1 << most) + 1 and width < most:
            width += 1
    put(257)
    bits.extend([0] * 16)
    return bytes(sum(bits[i + k] << k for k in range(8)) for i in range(0, len(bits) - 7, 8))


@given(st.binary(max_size=200), st.integers(0, 9))
def test_zoo_lzw(data, times):
    data = data * times
    assert K.lzw(_lzw(data)) == data


@given(st.binary(max_size=60), st.integers(1, 4))
def test_deflate64_reads_what_deflate_has_in_common(data, times):
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert K.inflate64(d.compress(data * times) + d.flush()) == data * times


def test_deflate64_stored_and_fixed():
    for strategy, level in ((zlib.Z_DEFAULT_STRATEGY, 0), (zlib.Z_FIXED, 6)):
        d = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
        assert K.inflate64(d.compress(b"some text, some more text" * 4) + d.flush()) == b"some text, some more text" * 4


def test_lz5():
    assert K.larc_lz5(bytes([0b111]) + b"abc", 3) == b"abc"
    # the ring's run of 'A' (13 times from 65 * 13), then what was just written
    place = 65 * 13
    assert K.larc_lz5(bytes([0b00, place & 255, (place >> 4 & 0xF0) | 2, (4096 - 18) & 255, ((4096 - 18) >> 4 & 0xF0) | 0]), 8) == b"AAAAAAAA"

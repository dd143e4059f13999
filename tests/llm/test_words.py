import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftwave.llm import arrays, cuckoo, lines, tokens

ODD = ["", " ", "a", "  a  b ", "é è x", "word　 next", "\n\n x \n", "don't 12 345", "日本 語", "a\tb\x0bc", "x\x00y", "😀 😀", None, "TAB\tEnd\n", "a" * 5000]


def texts(seed: int) -> list:
    r = random.Random(seed)
    made = ["".join(r.choice("abAB é\n\t .,1") for _ in range(r.randint(0, 60))) for _ in range(60)]
    return ODD + made


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_words_are_those_of_the_pattern(limit):
    given = texts(1)
    found = []
    for _, _, data, offsets in arrays.pieces(pa.array(given), limit):
        words = arrays.Words(data, offsets, arrays.space_words())
        found += [[data[a:b].tobytes().decode() for a, b in zip(words.start[words.row == r], words.end[words.row == r])] for r in range(len(offsets) - 1)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in given]


def test_equal_spans_hash_alike_wherever_they_stand():
    values = arrays.mix(np.array([5, 1, 2, 3, 9, 1, 2, 3, 1, 2], np.uint64))
    p = arrays.prefix_sums(values)
    h = arrays.span_hash(p, np.array([1, 5, 8, 1]), np.array([4, 8, 10, 3]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_lines_and_keys():
    given = texts(2)
    data, offsets = arrays.text_buffer(pa.array(given))
    found = lines.Lines(data, offsets)
    want = [(r, line) for r, t in enumerate(given) for line in (t or "").split("\n")]
    assert [(r, data[a:b].tobytes().decode()) for r, a, b in zip(found.row, found.start, found.end)] == want
    strip = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s)
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    line, digest = found.keys(data, 4)
    assert [(int(i), d) for i, d in zip(line, digest)] == [(i, hashlib.md5(lower(strip(x)).encode()).digest()) for i, (_, x) in enumerate(want) if len(strip(x)) >= 4]


def test_cuckoo_filter_grows_and_shrinks():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2), dtype=np.uint64)
    filter_ = cuckoo.filled(keys[:4000])
    assert filter_.contains(keys[:4000]).all() and filter_.contains(keys[4000:]).mean() < 0.01
    again = cuckoo.Cuckoo(slots=filter_.to_bytes())
    again.delete(keys[:1000])
    assert again.contains(keys[1000:4000]).all() and again.contains(keys[:1000]).mean() < 0.01
    with pytest.raises(cuckoo.CuckooFull):
        cuckoo.Cuckoo(4).insert(keys)


def test_pieces_give_the_tokenizers_own_ids():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    given = [t or "" for t in texts(3)] + ["<|endoftext|> a<|endoftext|>", "\x1c \x1d a", "a   b", "c \u0085 d"]
    data, offsets = arrays.text_buffer(pa.array(given))
    ids, size, row, _, _ = tokens.encoder(path).encode(data, offsets)
    per_row = np.split(ids, np.cumsum(np.bincount(row, weights=size, minlength=len(given)).astype(int))[:-1])
    assert [x.tolist() for x in per_row] == [plain.encode(t, add_special_tokens=False).ids for t in given]

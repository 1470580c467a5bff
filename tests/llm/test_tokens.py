import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from fixtures import documents, prose, table
from tokenizers import Tokenizer

from facetline.llm import bpe, packing
from facetline.llm.tokens import ByteTokens, WordTokens

BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a ", "a\n b", "a \nb", "don't we'll 'tis", "ab  cd", "x\u00a0y z", "\x1f a", "tab\tx", "ﬁ İ ΑΣ ς e\u0301", "🙂🙂 漢字", "12 345", "a" * 5000, "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def test_byte_ids_are_those_of_the_ranks(plain):
    t = ByteTokens(BYTES, P.PATTERN)
    for text in ODD + [x or "" for _, x in documents()]:
        ids = np.frombuffer(t.encode(text), "<u4")
        assert ids.tolist() == plain.encode_ordinary(text)
        assert t.decode(ids) == text.encode()
        at = t.offsets(ids)
        assert len(at) == len(ids) and (np.diff(at) >= 0).all() and (not len(at) or at[0] == 0)


def test_word_ids_are_those_of_the_library(whole):
    t = WordTokens(WORDS)
    for text in ODD + [x or "" for _, x in documents()]:
        assert np.frombuffer(t.text(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, plain):
    df = bpe.encode(table(spark).withColumnRenamed("token", "ids"), BYTES, P.PATTERN, offsets="at")
    assert df.columns.count("ids") == 1
    got = bpe.digests(bpe.decode(df, BYTES, P.PATTERN)).collect()
    want = []
    for i, t in documents():
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode(table(spark, []), BYTES, P.PATTERN).count() == 0


def check_plan(counts, size):
    bins = packing.plan(counts, size)
    made = defaultdict(int)
    for content, copies in bins:
        assert copies > 0 and sum(k * n for k, n in content) <= size
        for k, n in content:
            made[k] += n * copies
    assert dict(made) == {k: n for k, n in counts.items() if n}
    return sum(c for _, c in bins)


def test_plan_covers_and_fits():
    assert check_plan({}, 10) == 0
    assert check_plan({10: 5}, 10) == 5
    # two pieces in the place of a bin's smallest: 6 + 1 becomes 6 + 2 + 2
    assert check_plan({6: 1, 3: 1, 2: 2}, 10) <= 2
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 9, 40))}
        n = check_plan(counts, 100)
        least = max(-(-sum(k * c for k, c in counts.items()) // 100), sum(c for k, c in counts.items() if k > 50))
        assert n <= least * 1.1 + 2


def test_pack(spark, whole):
    rows = documents() + [(60 + i, prose(60 + i, 30 + 7 * i)) for i in range(40)]
    got = packing.pack(table(spark, rows), WORDS, size=256, keep_ids=True).collect()
    own = defaultdict(list)
    for i, t in rows:
        own[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    seqs, total = defaultdict(list), 0
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length and r.start == 256 * r.piece
        assert any(r.ids == x[r.start : r.start + r.length] and (r.start + r.length == len(x) or r.length == 256) for x in own[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(x) for v in own.values() for x in v)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= -(-total // 256) + 3
    assert packing.pack(table(spark, []), WORDS).count() == 0

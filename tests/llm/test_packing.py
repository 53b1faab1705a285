import zlib

import numpy as np
import pytest

from loomtext.llm.packing import ChunkEncoder, best_fit, cut, fit_counts, fit_patterns, pack, patterns_of, plan
from tests.llm.helpers import awkward, docs


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_ids_equal_the_published_tokenizer(tokenizer):
    ids = ChunkEncoder().ids
    for t in ["", "a", " a", "a ", "a  b", "a\n b", "Hello, world! 12'345 don't", "tabs\tand\r\nlines \n", "éß漢字 🙂 x" * 20, "x" * 5000, "a b" * 3, *map(str, awkward(3000)[1:])]:
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_a_text_is_encoded_in_one_call():
    encode = ChunkEncoder()
    calls, whole = [], encode.encode
    encode.encode = lambda t: calls.append(t) or whole(t)
    text = " ".join(f"word{i}" for i in range(500))
    assert encode.ids(text).tolist() == whole(text) and calls == [text]


def test_cut():
    assert cut(1) == [(0, 1)] and cut(2048) == [(0, 2048)]
    assert cut(2049) == [(0, 1), (1, 2048)] and cut(4096) == [(0, 2048), (2048, 2048)]


def test_fit_recovers_known_counts():
    lengths = np.zeros(101, dtype=np.int64)
    lengths[[30, 70]] = 500
    patterns = patterns_of(np.flatnonzero(lengths), 100)
    assert [30, 70, 0] in patterns.tolist()
    counts = fit_counts(patterns, lengths.astype(float))
    assert 450 <= counts[patterns.tolist().index([30, 70, 0])] <= 500


@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_most_pieces(seed):
    """The least squares and not the residual's best fit place the pieces, at no more sequences."""
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.clip(rng.gamma(2.0, 350.0, 6000).astype(int), 1, 2047), minlength=2049)
    steps, rest = fit_patterns(histogram)
    assert all(sum(p) == 2048 and n > 0 for p, n in steps)
    assert sum(len(p) * n for p, n in steps) + rest.sum() == histogram.sum()
    assert rest.sum() <= 0.1 * histogram.sum()
    assert sum(n for _, n in plan(histogram)) <= sum(n for _, n in best_fit(histogram, 2048))


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.minimum(rng.geometric(0.01 * (seed + 1), 5000), 256), minlength=257)
    for steps in (plan(histogram, 256), best_fit(histogram, 256)):
        held = np.zeros(257, dtype=np.int64)
        for pattern, count in steps:
            assert sum(pattern) <= 256
            for p in pattern:
                held[p] += count
        assert (held == histogram).all()
    bound = -(-int((histogram * np.arange(257)).sum()) // 256)
    assert sum(n for _, n in plan(histogram, 256)) <= 1.02 * bound + 2


def test_pack_round_trip(spark, tokenizer):
    texts = awkward(4000) + [f"text {i} " * (i % 90) for i in range(200)]
    rows = pack(docs(spark, texts)).collect()
    ids = {i + 1: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen, sequences = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length <= 2048 and zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, want in ids.items():
        parts = sorted(seen[i])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(want)
        assert len(parts) == max(1, -(-len(want) // 2048))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(docs(spark, texts).where("false")).count() == 0

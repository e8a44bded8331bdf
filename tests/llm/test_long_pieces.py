"""BPE of long pieces: the same ids as tiktoken's, at a cost that follows the bytes."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rasterloom.llm import bpe


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_pieces(codec):
    own, public = codec
    draw = random.Random(3)
    texts = ["a" * n for n in (129, 130, 5001)] + ["ab" * 3000, "aab" * 2000, "the" * 2000, "thethx" * 700]
    for letters in ("ab", "aeinst", "the", "0123456789abcdef", "的一是不了人我在", "éèàù", "abcdefghijklmnopqrstuvwxyz"):
        texts += ["".join(draw.choice(letters) for _ in range(draw.randint(60, 1500))) for _ in range(40)]
    ids, counts = own.encode(texts)
    want = [public.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    # alone and together: rows don't see each other
    for t, w in zip(texts[::17], want[::17]):
        own._forget()
        assert own.encode([t])[0].tolist() == w


def test_cost_follows_the_bytes(codec):
    own, _ = codec
    draw = random.Random(5)
    for draw_one in (lambda: draw.choice("abcdefghijklmnopqrstuvwxyz"), lambda: chr(draw.randint(0x4E00, 0x9FA5))):
        took = []
        for n in (20_000, 160_000):
            text = "".join(draw_one() for _ in range(n))
            own._forget()
            began = time.process_time()
            ids, _ = own.encode([text])
            took.append(time.process_time() - began)
            assert bytes(own.decode(ids)) == text.encode()
        assert took[1] < 5 and took[1] < 12 * took[0]


def test_a_small_vocabulary():
    """Merges that lead below the rank they came from, by a plain version."""
    draw = random.Random(8)
    for _ in range(40):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 256 + 12:
            new = draw.choice(tokens[97:100] + tokens[256:]) + draw.choice(tokens[97:100] + tokens[256:])
            if new not in tokens:
                tokens.append(new)
        later = tokens[256:]
        draw.shuffle(later)  # a longer token may have the lesser rank
        ranks = {t: k for k, t in enumerate(tokens[:256] + later)}
        own = bpe.Codec(ranks, r"(?s).+")
        rows = ["".join(draw.choice("abc") for _ in range(draw.randint(130, 260))) for _ in range(5)]
        want = []
        for text in rows:
            parts = [bytes([b]) for b in text.encode()]
            while True:
                found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            want.append([ranks[p] for p in parts])
        got = own._long([own.byte_ids[np.frombuffer(t.encode(), np.uint8)] for t in rows])
        assert [g.tolist() for g in got] == want

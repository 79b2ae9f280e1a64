"""The lattice's pieces by tails, and merging, against the library."""

import random

import public_tokenizers
import sentencepiece

from tallyframe.llm import pieces


def test_tails_are_remembered_and_forgotten_without_change():
    """A boundary's pieces come from its tail, so that a new word costs few steps; a full memory starts again."""
    model = pieces.read_model(public_tokenizers.path(pieces.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé日 ▁z0") for _ in range(rng.randrange(90))) for _ in range(400)]
    whole, small = pieces.Encoder(*model), pieces.Encoder(*model)
    small.tail_limit, small.pairs, small.limit = 5, 7, 3
    for word in words:
        wanted = library.encode(word)
        assert whole.encode(word).tolist() == wanted
        assert small.encode(word).tolist() == wanted
    assert 0 < len(small.tails) <= 5 < len(whole.tails)


def test_segments_share_their_first_characters_and_frequent_ones_stay():
    model = pieces.read_model(public_tokenizers.path(pieces.MODEL))
    plain, small = pieces.Encoder(*model), pieces.Encoder(*model)
    small.head_limit, small.limit = 2, 8
    walked = []
    walk = small.walk
    small.walk = lambda text, *held: walked.append((text, len(held[0]))) or walk(text, *held)
    text = "".join(f"commonword number{i} " for i in range(60))
    assert small.encode(text).tolist() == plain.encode(text).tolist()
    for segment in pieces.SEGMENT.findall(pieces.SPACE_SIGN + text.replace(" ", pieces.SPACE_SIGN)):
        assert plain.whole(segment) == plain.stream(segment)
    assert sum("commonword" in t for t, _ in walked) == 1  # forgotten again and again before
    assert any(len(t) > pieces.HEAD and n == pieces.HEAD + 1 for t, n in walked)

"""Pairs of tokens told by undoing merges, against plain merging; both steps in one Python worker."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from defectlake.llm import bpe


def _apart_as_merged(transducer: bpe.Transducer, pairs: list[tuple[int, int]]) -> bool:
    of = transducer.bytes_of
    return all(transducer._may_follow(a, b) == (transducer._merged(of[a] + of[b]) == [a, b]) for a, b in pairs)


def test_pairs_as_merging_tells_them():
    draw, ordered = random.Random(3), 0
    for _ in range(200):
        tokens = [bytes((x,)) for x in b"abc"]
        while len(tokens) < 14:  # joined from earlier ones, as training does
            new = draw.choice(tokens) + draw.choice(tokens)
            tokens += [new] if new not in tokens else []
        transducer = bpe.Transducer({token: i for i, token in enumerate(tokens)})
        own = [i for i, token in enumerate(tokens) if transducer._merged(token) == [i]]
        ordered += transducer.ordered
        assert _apart_as_merged(transducer, [(a, b) for a in own for b in own])
    assert ordered > 50
    draw.shuffle(tokens)
    shuffled = bpe.Transducer({token: i for i, token in enumerate(tokens)})
    own = [i for i, token in enumerate(tokens) if shuffled._merged(token) == [i]]
    assert _apart_as_merged(shuffled, [(a, b) for a in own for b in own])


def test_one_worker_gives_what_two_steps_give(spark, odd_documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    once = bpe.round_trip(odd_documents, path, public_tokenizers.PATTERN)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    twice = bpe.decode(bpe.encode(odd_documents, path, public_tokenizers.PATTERN), path)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    assert once.count() == twice.count() and once.where(F.col("ids").isNull()).isEmpty()


def test_states_carry_the_places_from_which_tokens_go_on(monkeypatch):
    """A run that leaves the kept states goes on from the state's places, as merging does."""
    draw = random.Random(8)
    tokens = [bytes((x,)) for x in b"abc"]
    while len(tokens) < 30:
        new = draw.choice(tokens) + draw.choice(tokens)
        tokens += [new] if new not in tokens else []
    ranks, plain = {token: i for i, token in enumerate(tokens)}, []
    pieces = [bytes(draw.choices(b"abc", k=draw.randint(1, 40))) for _ in range(300)]
    for states in (20_000, 5):
        monkeypatch.setattr(bpe, "MAX_STATES", states)
        transducer = bpe.Transducer(ranks)
        own = [x for x in tokens if transducer._merged(x) == [ranks[x]]]
        assert [transducer.encode(x) for x in pieces] == [[ranks[x]] if x in ranks else transducer._merged(x) for x in pieces]
        for state in transducer.states.values():
            n = len(state.pending)
            assert [lo for lo, _ in state.live] == [lo for lo in range(n) if any(len(x) > n - lo and x.startswith(state.pending[lo:]) for x in own)]
    assert len(transducer.states) < 200

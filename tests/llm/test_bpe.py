import itertools
import pickle

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecloom.llm import bpe_automaton, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe_automaton.WordCoder(vocabulary.read(PATH))


def plain_merges(word, merges):
    """Byte-pair encoding by its definition."""
    parts = [*word[:-1], word[-1] + bpe_automaton.END]
    rank = {m: k for k, m in enumerate(merges)}
    while True:
        best = min((rank.get(p, len(rank)) for p in zip(parts, parts[1:])), default=len(rank))
        if best == len(rank):
            return parts
        a, b = merges[best]
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


MERGES = [
    [("a", "b")],
    [("a", "a")],
    [("a", "a"), ("aa", "a")],
    [("a", "a"), ("aa", "aa"), ("b", "aa")],
    [("b", "c"), ("a", "b"), ("a", "bc"), ("ab", "a")],
    [("a", "b</w>"), ("b", "a"), ("c", "ba"), ("ba", "c"), ("c", "c")],
    [("a", "b"), ("b", "a"), ("ab", "ab"), ("ba", "ba"), ("abab", "c</w>")],
]


@pytest.mark.parametrize("merges", MERGES)
def test_gadgets_give_the_merges(merges):
    tokens = [*"abc", *(x + bpe_automaton.END for x in "abc")]
    tokens += [a + b for a, b in merges if a + b not in tokens]
    vocab = {t: i for i, t in enumerate(tokens)}
    a = pickle.loads(pickle.dumps(bpe_automaton.Automaton(vocab, merges)))
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    want = [[vocab[t] for t in plain_merges(w, merges)] for w in words]
    coded = [w.encode() for w in words]
    assert a.encode_many(coded) == want
    assert [a.encode(w) for w in coded] == want


def test_states_and_arcs():
    """(a, b): the state behind a loses its b-arc, which ab bears on from wherever a starts."""
    a, b, ab = 0, 1, 2
    s = bpe_automaton.States(3, [a, b], [(a, b, ab)])
    assert s.target == [1, 0, 0] and (s.parent, s.lacks) == ([-1, 0], [-1, b])
    assert [[s.has(q, x) for x in (a, b, ab)] for q in (0, 1)] == [[True, True, True], [True, False, True]]
    double = bpe_automaton.States(2, [0], [(0, 0, 1)])  # aa leads to where one more a may stand, a does not
    assert double.target == [1, 0] and [double.has(1, x) for x in (0, 1)] == [False, False]
    late = bpe_automaton.States(6, [0, 1, 2], [(0, 1, 3), (2, 0, 4), (0, 1, 5)])  # the third merge finds no arc
    assert late.target[5] == -1
    with pytest.raises(ValueError, match="two merges"):
        bpe_automaton.States(5, [0, 1, 2], [(0, 1, 3), (2, 2, 3)])


def test_table_holds_the_states(coder):
    """The ranges of the table against the gadgets themselves, over random pairs of labels."""
    import numpy as np

    a = coder.automaton
    model = __import__("json").loads(vocabulary.read(PATH))["model"]
    v, made = model["vocab"], {x + y for x, y in model["merges"]}
    base = [i for t, i in v.items() if t not in made and len(t.removesuffix(bpe_automaton.END)) == 1]
    s = bpe_automaton.States(len(a.label), base, [(v[x], v[y], v[x + y]) for x, y in model["merges"]])
    rng = np.random.default_rng(5)
    first = np.flatnonzero(a.state >= 0)
    then = np.array([i for i in range(len(a.label)) if s.target[i] >= 0])
    x, y = rng.choice(first, 20_000), rng.choice(then, 20_000)
    assert a.arcs(x, y).tolist() == [s.has(s.target[i], j) for i, j in zip(x, y)] == a.arcs(x, y).tolist()
    assert (a.low[1:] >= a.high[:-1]).all() and (a.low < a.high).all()


def test_code_points_match_the_library(coder):
    """Alone and between letters, all of the first plane and the letters and digits that younger Unicode tables added."""
    tok = Tokenizer.from_file(PATH)
    points = [c for c in [*range(0x11000), *range(0x11380, 0x11400), *range(0x16D40, 0x16EC0), 0x1C89, 0x208F, 0xA7CB, 0x2EBF0, 0x323B0] if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 2000):
        text = " ".join(f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}'s" for c in points[k : k + 2000])
        assert coder.encode(text)[0] == " ".join(map(str, tok.encode(text, add_special_tokens=False).ids)), k


@pytest.mark.parametrize("text", ["don't 'S we'll !!'s ''s 5's it'stall 'rex 've' 'l 'v '", "a" * 3000, "!" * 5000, " " * 100_000, "ΑΣ Σ ſ K İ", "x\x1cy\x1fz", "a<|startoftext|>b<|endoftext|><|endoftext|>", "12 3½ ⅷ²"])
def test_odd_texts_match_the_library(coder, text):
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))


def test_small_caches_change_nothing(coder, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MOST_CACHED", 3)
    own = bpe_automaton.WordCoder(vocabulary.read(PATH), coder.automaton)
    for text in ("one two three four five", "five six one two", "", "one"):
        assert own.encode(text) == coder.encode(text)

"""Byte-pair encoding and decoding with a tokenisation automaton.

Compilation. The automaton reads tokens. It starts with one state that has an arc for every base symbol back
to itself; then each merge (a, b) -> ab, in order of rank, applies its gadget. All a-arcs lead to one state q
(so do the arcs of any label). If q has a b-arc, the gadget makes a copy of q without it, leads all a-arcs to
the copy, and adds an ab-arc, to where the b-arcs lead, to every state that has an a-arc (if a = b, an aa-arc
leads to q itself, since pairs of equal tokens are taken from the left). A merge whose b-arc is gone never
applies. A state is made by one gadget, so it is known by the state it copies, the label it lacks and the time
of the gadget; that is ``States``.

Tables. Labels are numbered depth-first along their left parts, younger ones first, so what a gadget takes
from its copy, the label b and all labels that later grow from it, is one range of numbers. A state's missing
arcs are therefore a few disjoint ranges, and all of them make one sorted table: a transition is one binary
search, for any number of (state, label) pairs at once. The labels' spellings make a byte trie. Both tables
are compiled once on the driver and broadcast (about 15 MB for 49k tokens, whatever the corpus).

Encoding. A text is normalised and split into words with arrays; the distinct words of a slice that are not
remembered walk the trie together, and of the labels that end at a place the one whose arc from the state at
its start exists is taken: there is one, since every prefix of a word has one path. Decoding emits the arc
labels, joined by a space, as the library does for a vocabulary without a decoder.

Edge cases: null counts as empty; an empty text has no token and digests of the empty text; special tokens
written in a text are those tokens; code points that Python's Unicode tables lack are normalised and classed
as the library does; repeated rows are encoded alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecloom.llm import vocabulary
from vecloom.llm.textkit import slices, strings
from vecloom.runtime import ship, table

END = "</w>"
#: White space of the word-level vocabulary's split.
SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
MOST_CACHED = 150_000
#: Longer words walk the tables one by one.
WIDE = 48
BITS = 17
SEEN_BITS = 20


class States:
    """The automaton as its gadgets make it: each label's target, and each state's origin."""

    def __init__(self, labels: int, base: list[int], merges: list[tuple[int, int, int]]):
        """merges: (a, b, ab) in order of rank."""
        self.target = [-1] * labels
        self.left = [-1] * labels
        self.born = [-1] * labels
        self.parent, self.lacks, self.made = [-1], [-1], [-1]
        for label in base:
            self.target[label] = 0
        for time, (a, b, ab) in enumerate(merges):
            q = self.target[a]
            if q < 0 or not self.has(q, b):
                continue
            if self.target[ab] >= 0:
                raise ValueError("two merges make one token")
            self.target[ab], self.left[ab], self.born[ab] = self.target[b], a, time
            self.parent.append(q)
            self.lacks.append(b)
            self.made.append(time)
            self.target[a] = len(self.parent) - 1

    def has(self, state: int, label: int) -> bool:
        """Does the state have an arc of this label?"""
        if self.target[label] < 0:
            return False
        while state:
            while self.born[label] >= self.made[state]:  # younger than the state: it stands where its left part does
                label = self.left[label]
            if label == self.lacks[state]:
                return False
            state = self.parent[state]
        return True

    def numbers(self) -> tuple[np.ndarray, list[list[int]]]:
        """Depth-first numbers along left parts, younger children first, and the children of each label in that order."""
        children: list[list[int]] = [[] for _ in self.left]
        for label in sorted(range(len(self.left)), key=lambda x: -self.born[x]):
            if self.left[label] >= 0:
                children[self.left[label]].append(label)
        number = np.full(len(self.left), -1, np.int64)
        todo = [x for x in range(len(self.left)) if self.left[x] < 0][::-1]
        at = 0
        while todo:
            label = todo.pop()
            number[label] = at
            at += 1
            todo += children[label][::-1]
        return number, children


class Automaton:
    """Transition tables of the compiled automaton and the byte trie of its labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for t, i in vocab.items():
            self.label[i] = t
        made = {a + b for a, b in merges}
        base = [i for t, i in vocab.items() if t not in made and len(t.removesuffix(END)) == 1]
        states = States(size, base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.number, children = states.numbers()
        below = np.ones(size, np.int64)
        for x in sorted(range(size), key=lambda x: -self.number[x]):
            if states.left[x] >= 0:
                below[states.left[x]] += below[x]
        # what each state lacks: one range of numbers for its own gadget, and those of the states it copies
        goes_on = [i for i, t in enumerate(self.label) if states.target[i] >= 0 and not t.endswith(END)]
        live = sorted({states.target[i] for i in goes_on})
        self.state = np.full(size, -1, np.int64)
        place = {q: k for k, q in enumerate(live)}
        for i in goes_on:
            self.state[i] = place[states.target[i]]
        ranges: list[tuple[int, int] | None] = [None]
        for b, time in zip(states.lacks[1:], states.made[1:]):
            end = int(self.number[b]) + 1
            for c in children[b]:
                if states.born[c] < time:
                    break
                end += int(below[c])
            ranges.append((int(self.number[b]), end))
        low, high = [], []
        for k, q in enumerate(live):
            own = []
            while q:
                own.append(ranges[q])
                q = states.parent[q]
            last = -1
            for a, z in sorted(own):
                if a >= last:
                    low.append(k << BITS | a)
                    high.append(k << BITS | z)
                    last = z
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self._trie(states)

    def _trie(self, states: States) -> None:
        byte = {c: b for b, c in vocabulary.byte_letters().items()}
        nodes: list[dict[int, int]] = [{}]
        mid, end = [-1], [-1]
        for i, t in enumerate(self.label):
            if states.target[i] < 0:
                continue
            at = 0
            for c in t.removesuffix(END):
                step = nodes[at]
                b = byte[c]
                if b not in step:
                    step[b] = len(nodes)
                    nodes.append({})
                    mid.append(-1)
                    end.append(-1)
                at = step[b]
            (end if t.endswith(END) else mid)[at] = i
        self.mid, self.end = np.array(mid, np.int32), np.array(end, np.int32)
        # nodes that go on come first, so that a row of the table is a node
        order = sorted(range(len(nodes)), key=lambda k: not nodes[k])
        new = np.empty(len(nodes), np.int32)
        new[order] = np.arange(len(nodes), dtype=np.int32)
        self.inner = sum(map(bool, nodes))
        self.root = int(new[0])
        self.mid, self.end = np.array(mid, np.int32)[order], np.array(end, np.int32)[order]
        steps = [(r, b, new[c]) for r, k in enumerate(order[: self.inner]) for b, c in nodes[k].items()]
        self.steps = np.array(steps, np.int32).reshape(-1, 3)
        self._spread()

    def _spread(self) -> None:
        """The trie's steps as a matrix, and an empty memory of arcs."""
        self.next = np.full((max(1, self.inner), 256), -1, np.int32)
        self.next[self.steps[:, 0], self.steps[:, 1]] = self.steps[:, 2]
        self.seen = np.full(1 << SEEN_BITS, -1, np.int64)
        self.said = np.zeros(1 << SEEN_BITS, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("next", "seen", "said")}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        self._spread()

    def arcs(self, label: np.ndarray, then: np.ndarray) -> np.ndarray:
        """For each pair: does the state behind ``label`` have an arc ``then``? Recent answers are looked up first."""
        pair = label.astype(np.int64) << BITS | then
        slot = (pair * np.int64(0x9E3779B97F4A7C1)) >> 20 & (1 << SEEN_BITS) - 1
        ok = self.said[slot]
        ask = np.flatnonzero(self.seen[slot] != pair)
        if len(ask):
            key = self.state[label[ask]] << BITS | self.number[then[ask]]
            at = np.searchsorted(self.low, key, side="right") - 1
            ok[ask] = ~((at >= 0) & (key < self.high[at]))
            self.seen[slot[ask]], self.said[slot[ask]] = pair[ask], ok[ask]
        return ok

    def arc(self, label: int, then: int) -> bool:
        key = int(self.state[label]) << BITS | int(self.number[then])
        at = bisect_right(self.low, key) - 1
        return at < 0 or key >= self.high[at]

    def encode(self, word: bytes) -> list[int]:
        """The path that spells one word; its last symbol ends the word."""
        n = len(word)
        state, since = [-1] * (n + 1), [0] * (n + 1)
        pending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j in range(n):
            if j:
                for i, token in pending[j]:
                    if i == 0 or (state[i] >= 0 and self.arc(state[i], token)):
                        state[j], since[j] = token, i
                        break
            pending[j] = []
            node = self.root
            for i in range(j, n):
                node = int(self.next[node, word[i]]) if node < self.inner else -1
                if node < 0:
                    break
                token = int(self.mid[node] if i + 1 < n else self.end[node])
                if token >= 0:
                    pending[i + 1].append((j, token))
        for i, token in pending[n]:
            if i == 0 or (state[i] >= 0 and self.arc(state[i], token)):
                state[n], since[n] = token, i
                break
        out, i = [], n
        while i:
            if state[i] < 0:
                raise ValueError("the vocabulary cannot spell this word")
            out.append(state[i])
            i = since[i]
        return out[::-1]

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """The paths of many words, all of them stepping through the tables together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list[list[int]] = [[]] * len(words)
        for k in np.flatnonzero(size > WIDE):
            out[k] = self.encode(words[k])
        order = np.flatnonzero(size <= WIDE)
        order = order[np.argsort(size[order], kind="stable")].tolist()
        for at in range(0, len(order), 1 << 13):
            part = order[at : at + (1 << 13)]
            for k, path in zip(part, self._together([words[k] for k in part], size[part])):
                out[k] = path
        return out

    def _together(self, words: list[bytes], size: np.ndarray) -> list[list[int]]:
        """Places are those of the words' letters one after another; what ends at a place is kept there."""
        letters = np.frombuffer(b"".join(words), np.uint8)
        stop = np.repeat(np.cumsum(size), size).astype(np.int32)
        first = np.repeat(np.cumsum(size) - size, size).astype(np.int32)
        start = np.arange(len(letters), dtype=np.int32)
        node = self.next[self.root, letters]
        step, found = 0, []
        while len(start):
            at = start + step
            ends = stop[start] == at + 1
            token = np.where(ends, self.end[node], self.mid[node])
            token[node < 0] = -1
            hit = token >= 0
            found.append((at[hit], start[hit], token[hit]))
            on = (node >= 0) & (node < self.inner) & ~ends
            start, node, step = start[on], node[on], step + 1
            node = self.next[node, letters[start + step]]
        at, start, token = (np.concatenate(x) for x in zip(*found))
        depth = (at - first[at]).astype(np.int16)
        turn = np.argsort(depth, kind="stable")
        at, start, token = at[turn], start[turn], token[turn]
        cuts = np.searchsorted(depth[turn], np.arange(int(depth.max(initial=0)) + 2))
        last, since = np.full(len(letters), -1, np.int32), np.zeros(len(letters), np.int32)
        for a, z in zip(cuts, cuts[1:]):
            i, j, t = at[a:z], start[a:z], token[a:z]
            ok = j == first[j]
            ask = np.flatnonzero(~ok)
            before = last[j[ask] - 1]
            ask, before = ask[before >= 0], before[before >= 0]
            ok[ask] = self.arcs(before, t[ask])
            last[i[ok]], since[i[ok]] = t[ok], j[ok]
        place = np.cumsum(size) - 1
        path = np.full((len(words), int(size.max(initial=1))), -1, np.int32)
        rows, step = np.flatnonzero(size), 0
        while len(rows):
            p = place[rows]
            path[rows, step] = last[p]
            if (last[p] < 0).any():
                raise ValueError("the vocabulary cannot spell this word")
            place[rows] = since[p] - 1
            rows, step = rows[since[p] > first[p]], step + 1
        return [p[:z][::-1] for p, z in zip(path.tolist(), (path >= 0).sum(1).tolist())]


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Blank, letter, number, other or (not in Python's tables) unknown, of each code point."""
    if not _CLASSES:
        kind = np.full(0x110000, OTHER, np.uint8)
        for c, name in enumerate(map(unicodedata.category, map(chr, range(0x110000)))):
            if name != "Co":
                kind[c] = LETTER if name[0] == "L" else NUMBER if name[0] == "N" else UNKNOWN if name == "Cn" else OTHER
        kind[SPACE] = BLANK
        _CLASSES.append(kind)
    return _CLASSES[0]


class WordCoder:
    """Encodes and decodes whole texts with the word-level vocabulary."""

    def __init__(self, data: bytes, automaton: Automaton | None = None):
        spec = json.loads(data)
        model = spec["model"]
        self.automaton = automaton or Automaton(model["vocab"], [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.data, self.library = data, None
        self.cache: dict[bytes, tuple[str, str]] = {}
        self.older: dict[bytes, tuple[str, str]] = {}
        self.decimal = list(map(str, range(len(self.automaton.label))))
        self.kind = classes().copy()

    def ask(self, code: int) -> int:
        """The library's class of a code point that Python's tables lack."""
        c = chr(code)
        pieces = [where for _, where in self.own().pre_tokenizer.pre_tokenize_str(f"a{c}{c}b")]
        return {1: LETTER, 2: BLANK, 3: OTHER, 4: NUMBER}[len(pieces)]

    def own(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.data.decode())
        return self.library

    def normal(self, text: str) -> str:
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            new = np.unique(codes[classes()[codes] == UNKNOWN])
            if len(new):
                out = self.own().normalizer.normalize_str(text)
                for c in map(ord, set(out)):
                    if self.kind[c] == UNKNOWN:
                        self.kind[c] = self.ask(c)
                return out
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words of normalised texts in order, and where each text's words begin (and the last ones end)."""
        joined = "\n".join([*texts, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        start = kind != BLANK
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # 's 't 'm 'd 're 've 'll, where an apostrophe begins a run of other characters
        quote = np.flatnonzero(start & (cp == 39))
        if len(quote):
            padded = np.append(cp, np.zeros(3, np.uint32))
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            length = np.where(one, 2, np.where(two, 3, 0))
            quote, length = quote[length > 0], length[length > 0]
            start[quote + 1] = False
            after = quote + length
            after = after[kind[after] == LETTER]
            start[after] = True
        keep = kind != BLANK
        kept = cp[keep]
        width = 1 + (kept >= 0x80).astype(np.int32) + (kept >= 0x800) + (kept >= 0x10000)
        begin = np.concatenate([np.zeros(1, np.int32), np.cumsum(width, dtype=np.int32)])
        first = start[keep]
        offsets = np.append(begin[:-1][first], begin[-1]).astype(np.int32)
        data = kept.tobytes().decode("utf-32-le").encode()
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(start)])
        return words, np.concatenate([np.zeros(1, np.int64), upto[ends]]) if texts else np.zeros(1, np.int64)

    def words(self, names: list[bytes]) -> list[tuple[str, str]]:
        """Ids and labels of distinct words; those of recent slices are remembered."""
        both = list(map(self.cache.get, names))
        new = [k for k, x in enumerate(both) if x is None]
        if len(self.cache) + len(new) > MOST_CACHED:
            self.older, self.cache = self.cache, {}
        unknown = []
        for k in new:
            x = self.older.get(names[k])
            if x is None:
                unknown.append(k)
            else:
                both[k] = self.cache[names[k]] = x
        label, number = self.automaton.label.__getitem__, self.decimal.__getitem__
        for k, ids in zip(unknown, self.automaton.encode_many([names[k] for k in unknown])):
            both[k] = self.cache[names[k]] = (" ".join(map(number, ids)), " ".join(map(label, ids)))
        return both

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """Decimal ids, and labels, each joined by one space, of each text."""
        parts, of = [], []
        for k, t in enumerate(texts):
            marked = self.splits is not None and any(s in t for s in self.special)
            for p in self.splits.split(t) if marked else (t,):
                parts.append(p)
                of.append(k)
        plain = [p not in self.special for p in parts]
        words, at = self.split([self.normal(p) if ok else "" for p, ok in zip(parts, plain)])
        coded = words.dictionary_encode()
        _, offsets, raw = coded.dictionary.buffers()
        raw = raw.to_pybytes() if raw else b""
        cuts = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist()
        both = self.words([raw[a:z] for a, z in zip(cuts, cuts[1:])])
        which = coded.indices.to_numpy()
        ids = np.array([b[0] for b in both], object)[which].tolist() if both else []
        labels = np.array([b[1] for b in both], object)[which].tolist() if both else []
        at = at.tolist()
        if len(parts) == len(texts) and all(plain):
            return [(" ".join(ids[a:z]), " ".join(labels[a:z])) for a, z in zip(at, at[1:])]
        out: list[tuple[list[str], list[str]]] = [([], []) for _ in texts]
        for k, p, ok, a, z in zip(of, parts, plain, at, at[1:]):
            out[k][0].extend(ids[a:z] if ok else [str(self.special[p])])
            out[k][1].extend(labels[a:z] if ok else [p])
        return [(" ".join(a), " ".join(b)) for a, b in out]

    def encode(self, text: str) -> tuple[str, str]:
        return self.encode_all([text])[0]


_CODERS: dict[int, WordCoder] = {}


def coder(shared) -> WordCoder:
    """One coder for each worker process, from the broadcast (vocabulary, tables)."""
    if shared.id not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.id] = WordCoder(*shared.value)
    return _CODERS[shared.id]


class Shared:
    """A broadcast with a name that workers can remember it by."""

    def __init__(self, spark, data: bytes):
        self.id = hashlib.sha256(data).hexdigest()
        self.held = spark.sparkContext.broadcast((data, WordCoder(data).automaton))

    @property
    def value(self):
        return self.held.value


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>) and decoded text of every row; with full=False digests in their place."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, vocabulary.read(path or vocabulary.default_path(vocabulary.WORD_LEVEL)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids", "decoded"] if full else ["ids_sha256", "decoded_sha256"]

    def run(batches):
        words = coder(shared)
        for b in batches:
            for part in slices(b, 1, 1 << 20):
                got = words.encode_all(strings(part.column(1)))
                n = pa.array([x.count(" ") + 1 if x else 0 for x, _ in got], pa.int64())
                if full:
                    cols = [pa.array([list(map(int, x.split())) for x, _ in got], pa.list_(pa.int32())), pa.array([y for _, y in got], pa.string())]
                else:
                    cols = [pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in got], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), n, *cols], names=[id_col, "n_tokens", *names])

    types = ("ids array<int>, decoded string") if full else "ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {types}")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), full=False)

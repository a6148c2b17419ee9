"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The token automaton accepts exactly the token sequences that the merges produce. It starts as one state
with a loop for each base symbol; each merge (u, v) -> t, in order of rank, adds a gadget: the state
behind u is copied without its arc v, all arcs u lead to the copy, and wherever u then v could be
read an arc t now leads where v led. Since arcs of one label all lead to one state, a state is its
parent and the one arc that the copy lacks, and "may t follow w" is read off both derivations.

Words are read symbol by symbol by the deterministic automaton over symbols that runs all paths of the
token automaton at once. After each symbol exactly one token ends there whose arc leaves the state of the
token before it. A state is the longest suffix read that a token may still grow from, and the token automaton's states at
the places from which it could start; a transition is one look into a table of states by symbols. An entry
is filled when its transition is first taken (all of them would be too many), and the table starts anew
beyond STATES states. All distinct words of a slice take their steps together, as arrays. The tokens of a word
are the last tokens met, from its end back to its start; nothing is tried twice. Decoding emits the label
of each arc.

Normalisation and pre-splitting are those of the vocabulary file. Runs of ASCII and of the letters from U+00C0
to U+00FF are split as arrays, if the file turns out to split a sample so; other runs go through the tokenizers
library or, where that is enough, a pattern.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.cluster import small_batches
from veritide.llm.words import BASES, LOWER, Words, mix, slices, sums, trim

STATES, LONG, SLICE = 131_072, 200, 250_000
#: Runs of these code points need no library: composed already, lower-cased one by one, all letters beyond ASCII.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
RUN = re.compile(rb"[^ \t-\r]+")
PRESPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_symbols() -> dict[int, int]:
    """Symbols of the 256 bytes in byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(rest)}


SYMBOLS = byte_symbols()
NAMES = [chr(SYMBOLS[b]) for b in range(256)]
BYTES = {s: b for b, s in SYMBOLS.items()}
KIND = np.zeros(256, dtype=np.int8)  # 1 letters, 2 digits, 3 other ASCII, 0 what needs a closer look
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[39] = 0  # an apostrophe may open a contraction


class Automaton:
    """The tokenization automaton of a BPE vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.label = {i: t for t, i in vocab.items()}
        self.split: dict[int, tuple[int, int, int]] = {}  # token: its merge's rank and two parts
        self.state: dict[int, int] = {}  # token: the state behind its arcs
        self.parent, self.lacks, self.since = [-1], [-1], [-1]  # of each state
        for rank, (left, right) in enumerate(merges):
            u, v, t = vocab[left], vocab[right], vocab[left + right]
            if t in self.split:
                raise ValueError(f"two merges make {left + right!r}; the gadget needs one")
            self._gadget(rank, u, v, t)
        self.gaps: dict[int, dict[int, int]] = {}
        self._grow()
        self._clear()

    def _gadget(self, rank: int, u: int, v: int, t: int) -> None:
        behind_v = self.state.get(v, 0)
        self.parent.append(self.state.get(u, 0))
        self.lacks.append(v)
        self.since.append(rank)
        self.state[u] = len(self.parent) - 1
        self.state[t] = behind_v
        self.split[t] = (rank, u, v)

    def _missing(self, state: int) -> dict[int, int]:
        """The arcs that a state of the token automaton lacks, with the rank from which on it does."""
        out = self.gaps.get(state)
        if out is None:
            out, at = {}, state
            while at > 0:
                out[self.lacks[at]] = min(self.since[at], out.get(self.lacks[at], self.since[at]))
                at = self.parent[at]
            if len(self.gaps) >= 4096:
                self.gaps.clear()
            self.gaps[state] = out
        return out

    def follows(self, state: int, t: int) -> bool:
        """Does an arc t leave the state? It does if its first part's arc did when the gadget of t was added, and was not removed since."""
        missing, until, part = self._missing(state), 1 << 60, t
        while True:
            if missing.get(part, 1 << 61) <= until:
                return False
            if part not in self.split:
                return True
            until, part, _ = self.split[part]

    def _grow(self) -> None:
        """The trie of all tokens' symbols: for each node its children, the node of its longest proper suffix, its depth, and the tokens that end there, longest first."""
        self.child: list[dict[str, int]] = [{}]
        self.depth, ends = [0], {}
        for label, t in self.vocab.items():
            at = 0
            for s in self.symbols(label):
                if s not in self.child[at]:
                    self.child[at][s] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[at] + 1)
                at = self.child[at][s]
            if at:
                ends[at] = t
        self.suffix_node = [0] * len(self.child)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.child)
        level = [0]
        while level:
            below = []
            for at in level:
                for s, to in self.child[at].items():
                    if at:
                        self.suffix_node[to] = self._next(self.suffix_node[at], s)
                    own = ((ends[to], self.depth[to]),) if to in ends else ()
                    self.ends[to] = own + self.ends[self.suffix_node[to]]
                    below.append(to)
            level = below

    def symbols(self, word: str) -> list[str]:
        """Base symbols of a token or, with the word end appended, of a word."""
        suffix = self.suffix
        return list(word) if not word.endswith(suffix) or word == suffix else [*word[: -len(suffix) - 1], word[-len(suffix) - 1 :]]

    def _next(self, node: int, s: str) -> int:
        while s not in self.child[node]:
            if not node:
                return 0
            node = self.suffix_node[node]
        return self.child[node][s]

    def _clear(self) -> None:
        #: transitions by state and column (-1: not filled in yet), and the column of each symbol: bytes, then bytes at a word's end
        self.moves = np.full((1024, 64), -1, dtype=np.int32)
        self.column = np.full(512, -1, dtype=np.int64)
        self.columns = 0
        #: by state: the token that ends there, that token's length, and what tells states apart
        self.token, self.length = np.full(1024, -1, dtype=np.int32), np.zeros(1024, dtype=np.int32)
        self.what: list[tuple[int, int, tuple[int, ...]]] = [(0, -1, (-1,))]
        self.states = {self.what[0]: 0}

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        """The columns of symbols; new symbols get one."""
        for c in np.flatnonzero(np.bincount(codes, minlength=512) * (self.column < 0)).tolist():
            if self.columns == self.moves.shape[1]:
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)], axis=1)
            self.column[c] = self.columns
            self.columns += 1
        return self.column[codes]

    def _move(self, state: int, code: int) -> int:
        """Fills in one transition."""
        s = NAMES[code & 255] + (self.suffix if code > 255 else "")
        node, _, behind = self.what[state]
        node = self._next(node, s)
        for t, k in self.ends[node]:
            if k <= len(behind) and (behind[k - 1] < 0 or self.follows(behind[k - 1], t)):
                break
        else:
            raise ValueError(f"no path by {s!r}")
        what = (node, t, (self.state.get(t, 0), *behind[: self.depth[node]]))
        to = self.states.get(what)
        if to is None:
            to = self.states[what] = len(self.what)
            self.what.append(what)
            if to == len(self.token):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
                self.token, self.length = np.concatenate([self.token, self.token]), np.concatenate([self.length, self.length])
            self.token[to], self.length[to] = t, k
        self.moves[state, self.column[code]] = to
        return to

    def _walk(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The state after each symbol of the words codes[start : start + size], which follow one another."""
        columns, path = self._columns(codes), np.zeros(len(codes), dtype=np.int32)
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG) :]
        at, state = start[order], np.zeros(len(order), dtype=np.int32)
        going = np.searchsorted(-size[order], -np.arange(1, LONG + 1), side="right")
        for i in range(LONG):
            n = int(going[i])
            if not n:
                break
            at, state = at[:n], state[:n]
            to = self.moves[state, columns[at + i]]
            new = np.flatnonzero(to < 0)
            if len(new):
                pair = state[new].astype(np.int64) << 9 | codes[at[new] + i]
                found, place = np.unique(pair, return_inverse=True)
                to[new] = np.array([self._move(x >> 9, x & 511) for x in found.tolist()], dtype=np.int32)[place]
            path[at + i] = state = to
        for w in np.flatnonzero(size > LONG).tolist():  # a few long ones, each for itself
            state = 0
            for p in range(int(start[w]), int(start[w] + size[w])):
                to = int(self.moves[state, columns[p]])
                path[p] = state = to if to >= 0 else self._move(state, int(codes[p]))
        return path

    def encode(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each word, all tokens in order) of words of symbols, one after another; none is empty."""
        if len(self.what) > STATES:
            self._clear()
        start = np.cumsum(size) - size
        path = self._walk(codes, start, size)
        word, at, found = np.arange(len(size)), start + size - 1, []
        while len(word):
            state = path[at]
            found.append((word, self.token[state]))
            at = at - self.length[state]
            on = at >= start[word]
            word, at = word[on], at[on]
        n = np.bincount(np.concatenate([w for w, _ in found]), minlength=len(size)) if found else np.zeros(0, np.int64)
        last, out = np.cumsum(n) - 1, np.zeros(int(n.sum()), dtype=np.int32)
        for k, (w, t) in enumerate(found):
            out[last[w] - k] = t
        return n, out


class Codec:
    """Encodes and decodes texts as the library does with the same file, special tokens recognised."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with a word end and no decoder is needed")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normalize, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        sample = "Don't ÀÉß_x1,23 IT'LL a-b É_é%%12x __ÿ"
        self.usual = False
        by_library = [self.words_of_run(r) for r in sample.split()]
        self.usual = True
        self.usual = by_library == [self.words_of_run(r) for r in sample.split()]
        self.rare = sorted(self.special, key=len, reverse=True)
        size = max(self.labels) + 1
        self.shown = [texts_of([f"{i} " for i in range(size)]), texts_of([self.labels.get(i, "") + " " for i in range(size)])]

    def words_of_run(self, run: str) -> list[str]:
        """Pre-split words of a run without ASCII blanks, in byte symbols."""
        if not self.usual or not PLAIN.fullmatch(run):
            return [w for w, _ in self.presplit(self.normalize(run))]
        words = PRESPLIT.findall(run.lower())
        return words if run.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(SYMBOLS) for w in words]

    def tokens(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each run, all tokens in order) of runs without ASCII blanks within data, UTF-8 bytes."""
        place = spans(start, size)
        codes, kind = LOWER[data[place]].astype(np.int64), KIND[data[place]]
        run = np.repeat(np.arange(len(size)), size)
        lead = np.flatnonzero(codes[:-1] == 0xC3) if self.usual else place[:0]
        lead = lead[(run[lead] == run[lead + 1]) & (codes[lead + 1] != 0x97) & (codes[lead + 1] != 0xB7)]  # all but the signs of times and division are letters
        codes[lead + 1] += np.where(codes[lead + 1] < 0x9F, 0x20, 0)
        kind[lead] = kind[lead + 1] = 1
        plain = np.bincount(run, weights=kind == 0, minlength=len(size)) == 0 if self.usual else np.zeros(len(size), dtype=bool)
        ends = np.cumsum(size)
        odd: list[tuple[int, bytes]] = []
        for i in np.flatnonzero(~plain).tolist():
            raw = data[start[i] : start[i] + size[i]].tobytes().decode()
            odd += [(i, w.translate(BYTES).encode("latin-1")) for w in self.words_of_run(raw)]
        keep = plain[run]
        codes, kind, run = codes[keep], kind[keep], run[keep]
        opens = np.ones(len(run), dtype=bool)
        opens[1:] = (run[1:] != run[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first = np.flatnonzero(opens)
        owner, length = run[first], np.diff(first, append=len(run))
        if odd:
            owner = np.concatenate([owner, [i for i, _ in odd]])
            codes = np.concatenate([codes, np.frombuffer(b"".join(w for _, w in odd), dtype=np.uint8)])
            length = np.concatenate([length, [len(w) for _, w in odd]])
            by = np.argsort(owner, kind="stable")
            codes = codes[spans((np.cumsum(length) - length)[by], length[by])]
            owner, length = owner[by], length[by]
        codes[np.cumsum(length) - 1] += 256
        n, out = self.automaton.encode(codes, length)
        return np.bincount(owner, weights=n, minlength=len(ends)).astype(np.int64), out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of tokens, ids joined by one space, decoded text in UTF-8) of each text; null is empty."""
        words = Words(texts)
        start, size, row, text = words.start, words.end - words.start, words.row, words.data
        found = [self.splits(words, i) for i in self.with_specials(words)]
        special = np.full(len(start), -1)
        if found:
            start, size, row, special = self.cut_out(found, start, size, row)
        n, tokens = self.of_runs(text, start, size, words, special)
        per_row = np.bincount(row, weights=n, minlength=words.rows).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(per_row)])
        made = []
        for pool, offset, length in self.shown:
            own = length[tokens]
            made.append((memoryview(pool[spans(offset[tokens], own)]), np.concatenate([[0], np.cumsum(own)])[edge].tolist()))
        (ids, id_at), (decoded, at) = made
        for i, k in enumerate(per_row.tolist()):
            yield k, ids[id_at[i] : max(id_at[i], id_at[i + 1] - 1)], decoded[at[i] : max(at[i], at[i + 1] - 1)]

    def of_runs(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, words: Words, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tokens() of all runs, by way of the distinct ones; special has the id of a run that is a special token."""
        h = words.hashes() if len(words.start) == len(start) else mix(sums(text.astype(np.uint64) + np.uint64(1), BASES[0], start, start + size))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        stands = first[which]
        if not np.array_equal(size, size[stands]) or not np.array_equal(text[spans(start, size)], text[spans(start[stands], size)]):
            first = which = np.arange(len(start))  # two runs of one hash: each is encoded for itself
        n, found = self.tokens(text, start[first], size[first])
        begin = np.cumsum(n) - n
        marked = special >= 0
        if not marked.any():
            return n[which], found[spans(begin[which], n[which])]
        n, begin, found = np.append(n, 1)[which], begin[which], np.concatenate([found, special[marked].astype(found.dtype)])
        n[marked], begin[marked] = 1, len(found) - marked.sum() + np.arange(marked.sum())
        return n, found[spans(begin, n)]

    def with_specials(self, words: Words) -> list[int]:
        """Rows that hold a special token."""
        raw = words.data.tobytes()
        if not any(s.encode() in raw for s in self.rare):
            return []
        own = [raw[a:b] for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
        return [i for i, x in enumerate(own) if any(s.encode() in x for s in self.rare)]

    def splits(self, words: Words, i: int) -> list[tuple[int, int, int, int]]:
        """(row, start, size, special id or -1) of the runs of a row: the text between special tokens is split for itself."""
        base, text = int(words.offsets[i]), bytes(words.data[words.offsets[i] : words.offsets[i + 1]])
        any_special, out, at = re.compile(b"|".join(re.escape(s.encode()) for s in self.rare)), [], 0
        for m in [*any_special.finditer(text), None]:
            end = m.start() if m else len(text)
            out += [(i, base + at + r.start(), len(r.group()), -1) for r in RUN.finditer(text[at:end])]
            if m:
                out.append((i, base + m.start(), len(m.group()), self.special[m.group().decode()]))
                at = m.end()
        return out

    @staticmethod
    def cut_out(found: list[list[tuple[int, int, int, int]]], start: np.ndarray, size: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs with those of some rows replaced, in order: start, size, row, special id."""
        rows, starts, sizes, ids = (np.array(x, dtype=np.int64) for x in zip(*(x for f in found for x in f), strict=True))
        stay = ~np.isin(row, rows)
        start, size, row = np.concatenate([start[stay], starts]), np.concatenate([size[stay], sizes]), np.concatenate([row[stay], rows])
        by = np.argsort(start, kind="stable")
        return start[by], size[by], row[by], np.concatenate([np.full(stay.sum(), -1), ids])[by]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space as by a library tokenizer without decoder."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that start so and are so long, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def texts_of(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values' bytes one after another, and where each starts and how long it is."""
    raw = [v.encode() for v in values]
    length = np.array([len(v) for v in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(length) - length, length


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One compiled automaton per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row: ids in decimal joined by one space. Null text is empty and has no tokens."""
    return _mapped(docs, path, id_col, text_col, False)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, digests taken where the tokens are made."""
    return _mapped(docs, path, id_col, text_col, True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    show = (lambda x: hashlib.sha256(x).hexdigest()) if digest else (lambda x: bytes(x).decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = [(n, show(ids), show(decoded)) for n, ids, decoded in coder.encode(part.column(1))]
                n, ids, decoded = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names)
        trim()

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {names[2]} string, {names[3]} string")

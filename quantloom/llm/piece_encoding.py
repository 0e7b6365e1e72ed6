"""SentencePiece encoding with a merge-type prefix table, and decoding.

A BPE encoding is told by its neighbours: a row of tokens is the encoding of its text if every
two adjacent tokens are the encoding of the two put together, and a text has one such row.  So each
prefix of a text has one last token.  ``PieceTable.encode`` keeps it for every prefix:
an automaton over the vocabulary yields the tokens that end at a position, and the one that
agrees with the last token of the prefix before it is stored.  The ids are then read backwards from the
end.  The work is linear in the text, however long it runs without a blank.

Two tokens agree if no merge crosses the seam between them: the symbols that touch the seam grow in
the order of the merges, and at each moment the pair across it must come after what consumes its sides
(``PieceTable.agree``).  Pieces whose merges share a score (runs of blanks) are merged literally instead.

The model file travels to the tasks by value.  A worker keeps its table, the answers to pairs and
the ids of short words, all of bounded size.  There is no shuffle: a lost task encodes its rows again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_batches

BLANK = "▁"
WORD_CHARS = 48  # longer words are encoded each time
WORDS, PAIRS = 1 << 19, 1 << 20  # what a worker keeps
MANY = 1 << 15  # words whose tables are filled side by side
_GROUPS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceTable:
    """The vocabulary of a BPE model with byte fallback, and the encoding of normalised text by it."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.get_piece_size())
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_ids = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        if len(self.byte_ids) < 256 or any(lib.is_unused(i) for i in every):
            raise ValueError("the model needs byte fallback and no unused pieces")
        self.rank = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        ids = {lib.id_to_piece(i): i for i in plain}
        self.splits: dict[str, tuple[str, str]] = {}
        for piece in sorted(ids, key=len):
            if len(piece) > 1 and self._merged(piece, piece) == [piece]:
                self.splits[piece] = self._last
        letters = {c for p in self.rank for c in p}
        #: what can stand in an encoding: letters, and pieces that their own merges reach
        self.tokens = sorted(letters | self.splits.keys())
        self.sizes = [len(t) for t in self.tokens]
        self.ids = [(ids[t],) if t in ids else tuple(self._bytes(t)) for t in self.tokens]
        self.ends = [self._spine(t, 1) for t in self.tokens]
        self.starts = [self._spine(t, 0) for t in self.tokens]
        self.strict = [self._rising(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        #: no piece goes on after a blank that follows another letter, so words are encoded one by one
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.rank)
        self._pairs: dict[int, bool] = {}
        self.names = [str(k) for k in every]
        self.size_of = np.array(self.sizes, np.int64)
        self.id_of = np.array([x[0] if len(x) == 1 else -1 for x in self.ids], np.int64)
        self.byte_of = np.array([*(self.byte_ids[k] for k in range(128)), -1], np.int64)
        self.nodes = _Nodes(self.tokens)
        #: a letter of no token, to put between texts
        self.apart = next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in letters)
        self._asked, self._fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.words: dict[str, tuple[bytes, str]] = {}

    def _own(self, part: str) -> str:
        """The text that one of ``groups`` stands for."""
        if not self.by_word:
            return part
        return part[1:] if part[:1] == BLANK else BLANK + part

    def _bytes(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in letter.encode()]

    def _merged(self, text: str, upto: str | None = None) -> list[str]:
        """Literal merging: the least rank first, then the leftmost; ``_last`` is the last pair."""
        symbols = list(text)
        while len(symbols) > 1:
            best = min((self.rank.get(symbols[k] + symbols[k + 1], math.inf), k) for k in range(len(symbols) - 1))
            if best[0] == math.inf:
                break
            k = best[1]
            self._last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols at one end of a token from its letter up to itself, each with the rank at which it is consumed."""
        found, upper = [(token, math.inf)], token
        while upper in self.splits:
            found.append((self.splits[upper][side], self.rank[upper]))
            upper = self.splits[upper][side]
        return found[::-1]

    def _rising(self, token: str) -> bool:
        """Whether every merge in a token comes strictly after those that it needs."""
        if token not in self.splits:
            return True
        return all(self._rising(x) and (x not in self.splits or self.rank[x] < self.rank[token]) for x in self.splits[token])

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens (by number) are the encoding of their texts put together."""
        key = left << 24 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._uncrossed(left, right)
        return known

    def _uncrossed(self, left: int, right: int) -> bool:
        if not (self.strict[left] and self.strict[right]):
            a, b = self.tokens[left], self.tokens[right]
            return self._merged(a + b) == [a, b]
        ends, starts, rank = iter(self.ends[left]), iter(self.starts[right]), self.rank
        (u, u_gone), (v, v_gone) = next(ends), next(starts)
        while True:
            across = rank.get(u + v)
            # of equal ranks the leftmost merges: the left side's own before the one across, that before the right side's
            if across is not None and across < u_gone and across <= v_gone:
                return False
            if u_gone <= v_gone:
                if u_gone == math.inf:
                    return True
                u, u_gone = next(ends)
            else:
                v, v_gone = next(starts)

    def prefixes(self, text: str) -> list[int]:
        """For each length of a prefix the number of its last token; -1 for none, and after a letter that no piece has."""
        last = [-1] * (len(text) + 1)
        sizes, pairs, agree = self.sizes, self._pairs, self.agree
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - sizes[token]]
                if before < 0:
                    last[end] = token
                else:
                    known = pairs.get(before << 24 | token)
                    if known or known is None and agree(before, token):
                        last[end] = token
        return last

    def encode_whole(self, text: str) -> tuple[bytes, str]:
        """Packed and decimal ids of normalised text, from its prefix table backwards."""
        last, at, found = self.prefixes(text), len(text), []
        while at:
            token = last[at]
            found.append(self._bytes(text[at - 1]) if token < 0 else self.ids[token])
            at -= 1 if token < 0 else self.sizes[token]
        ids = list(chain.from_iterable(reversed(found)))
        return np.array(ids, np.int32).tobytes(), ",".join([self.names[k] for k in ids])

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Packed and decimal ids of many short texts, their prefix tables filled side by side, one length of prefix after another."""
        texts_by_size = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in texts_by_size], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] + np.arange(len(sizes))
        letters = np.frombuffer(self.apart.join([texts[k] for k in texts_by_size]).encode("utf-32-le"), np.uint32).astype(np.int64)
        last = np.full(len(letters) + 1, -1, np.int64)
        state = np.zeros(len(sizes), np.int64)
        for length in range(1, int(sizes.max(initial=0)) + 1):
            going = int(np.searchsorted(-sizes, -length, "right"))
            ends = starts[:going] + length
            state[:going] = self.nodes.step(state[:going], letters[ends - 1])
            node = self.nodes.match[state[:going]]
            todo = np.flatnonzero(node >= 0)
            while len(todo):
                token = self.nodes.token[node[todo]]
                before = last[ends[todo] - self.size_of[token]]
                fits = before < 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self.agree_many(before[ask], token[ask])
                last[ends[todo[fits]]] = token[fits]
                todo = todo[~fits]
                node[todo] = self.nodes.shorter[node[todo]]
                todo = todo[node[todo] >= 0]
        owner, at = np.arange(len(texts)), starts + sizes
        owners, ids, odd = [owner[:0]], [owner[:0]], []
        while True:
            going = at > starts[owner]
            owner, at = owner[going], at[going]
            if not len(owner):
                break
            token = last[at]
            found = np.where(token >= 0, self.id_of[token], self.byte_of[np.minimum(letters[at - 1], 128)])
            odd += owner[found < 0].tolist()  # letters of several byte tokens
            owner, at, token, found = (x[found >= 0] for x in (owner, at, token, found))
            owners.append(owner)
            ids.append(found)
            at = at - np.where(token >= 0, self.size_of[token], 1)
        owners, ids = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])
        ids = ids[np.argsort(owners, kind="stable")]
        packed, names = ids.astype(np.int32).tobytes(), [self.names[k] for k in ids.tolist()]
        cut = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(texts))))).tolist()
        out: list[tuple[bytes, str]] = [(b"", "")] * len(texts)
        for k, i, j in zip(texts_by_size, cut, cut[1:], strict=False):
            out[k] = (packed[4 * i : 4 * j], ",".join(names[i:j]))
        for k in odd:
            out[texts_by_size[k]] = self.encode_whole(texts[texts_by_size[k]])
        return out

    def agree_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``agree`` for arrays, by a table with a place for each pair's hash that keeps the latest."""
        keys = left << 24 | right
        place = ((keys * -7046029254386353131) >> 20) & (PAIRS - 1)
        fits = self._fits[place]
        new = np.flatnonzero(self._asked[place] != keys)
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            told = np.array([self._uncrossed(k >> 24, k & 0xFFFFFF) for k in pairs.tolist()], bool)
            fits[new] = told[back]
            self._asked[place[new]], self._fits[place[new]] = keys[new], fits[new]
        return fits

    def learn(self, parts: Iterable[str]) -> None:
        """Encode the short ones of the parts that aren't known, all at once."""
        new = [p for p in parts if len(p) <= WORD_CHARS and p not in self.words]
        for lo in range(0, len(new), MANY):
            some = new[lo : lo + MANY]
            self.words.update(zip(some, self.encode_many([self._own(p) for p in some]), strict=True))

    def groups(self, text: str | None) -> list[str]:
        """The parts of a text, normalised as the model says, that are encoded one by one; a word stands without its blank."""
        text = self.library.normalize(text or "")
        if not text:
            return []
        if not self.by_word:
            return [text]
        if text[0] == BLANK and text[-1] != BLANK and BLANK * 2 not in text:
            return text[1:].split(BLANK)
        return [g[1:] if g[0] == BLANK and g[1:2] != BLANK and g != BLANK else BLANK + g for g in _GROUPS.findall(text)]

    def parts(self, texts: list[str | None]) -> Iterator[list[tuple[bytes, str]]]:
        """For each text the packed ids and the decimal ids of its groups."""
        grouped = [self.groups(t) for t in texts]
        wanted = set(chain.from_iterable(grouped))
        if len(self.words) + len(wanted) > WORDS:
            self.words = {w: self.words[w] for w in wanted if w in self.words}
        self.learn(wanted)
        known = self.words.__getitem__
        for group in grouped:
            try:
                yield list(map(known, group))
            except KeyError:  # a long part
                yield [self.words[p] if p in self.words else self.encode_whole(self._own(p)) for p in group]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, as the library's encode without begin and end."""
        return _unpack(b"".join([p[0] for p in next(self.parts([text]))]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class _Nodes:
    """The automaton as arrays, to step many texts at once; node 0 is its root.

    ``match`` is the node of the longest token that ends at a node, ``shorter`` the next one after it, -1 for none.
    Moves lie in a hash table with linear probing.
    """

    def __init__(self, tokens: list[str]):
        moves: dict[tuple[int, str], int] = {}
        token_at = {}
        for k, t in enumerate(tokens):
            at = 0
            for letter in t:
                at = moves.setdefault((at, letter), len(moves) + 1)
            token_at[at] = k
        count = len(moves) + 1
        self.fail, self.token = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        self.match, self.shorter = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        self.token[list(token_at)] = list(token_at.values())
        below: dict[int, list[tuple[str, int]]] = {}
        for (a, letter), b in moves.items():
            below.setdefault(a, []).append((letter, b))
        level = below.get(0, [])
        fail = [0] * count
        while level:
            for _, n in level:
                self.fail[n] = fail[n]
                self.shorter[n] = self.match[fail[n]]
                self.match[n] = n if self.token[n] >= 0 else self.shorter[n]
            deeper = []
            for _, n in level:
                for letter, child in below.get(n, ()):
                    at = fail[n]
                    while at and (at, letter) not in moves:
                        at = fail[at]
                    fail[child] = moves.get((at, letter), 0)
                    deeper.append((letter, child))
            level = deeper
        self.bits = max(10, int(len(moves) * 4).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([a << 21 | ord(letter) for a, letter in moves], np.int64)
        for key, place, b in zip(keys.tolist(), self._place(keys).tolist(), moves.values(), strict=True):
            while self.keys[place] >= 0:
                place = (place + 1) & ((1 << self.bits) - 1)
            self.keys[place], self.to[place] = key, b

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * -7046029254386353131 >> 24) & ((1 << self.bits) - 1)

    def _move(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, -1 for none."""
        key, out = node << 21 | letter, np.full(len(node), -1, np.int64)
        place, todo = self._place(key), np.arange(len(node))
        while len(todo):
            there = self.keys[place[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.to[place[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        node, out, todo = node.copy(), np.zeros(len(node), np.int64), np.arange(len(node))
        while len(todo):
            to = self._move(node[todo], letter[todo])
            out[todo] = np.maximum(to, 0)
            todo = todo[(to < 0) & (node[todo] > 0)]
            node[todo] = self.fail[node[todo]]
        return out


def _unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, np.int32).tolist()


@lru_cache(maxsize=2)
def table_of(model: bytes) -> PieceTable:
    return PieceTable(model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default that of the installed public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text.  Null and empty texts have none; rows that repeat an id each have theirs."""
    model = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for b in batches:
            ids = [_unpack(b"".join([p[0] for p in parts])) for parts in table.parts(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the library's text of each row of ``encode``; null ids give the empty text."""
    model = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for b in batches:
            texts = [table.decode(ids.as_py() or []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    arrow_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded text) of each row."""
    model = model_bytes(path)
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for b in batches:
            rows = []
            for doc, parts in zip(b.column(0).to_pylist(), table.parts(b.column(1).to_pylist()), strict=True):
                ids = _unpack(b"".join([p[0] for p in parts]))
                said = ",".join([p[1] for p in parts])
                rows.append((doc, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(table.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for _, k in kinds], [n for n, _ in kinds])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

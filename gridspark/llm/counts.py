"""Token counts of every prefix of a text, by dynamic programming over BPE."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, TO_LOWER, flat, slices
from .packing import _byte_of_char
from .words import stretches

END = "</w>"
#: Characters that compose with nothing before them: Latin, Greek, Cyrillic, kana, CJK, Hangul syllables.
PLAIN = regex.compile(r"[\x00-\u02ff\u0370-\u0482\u3041-\u3096\u30a1-\u30fa\u3400-\u9fff\uac00-\ud7a3]*")
#: Where pieces are matched by this, those of ASCII words can be told from bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4
#: The kind of each byte: 0 parts words, signs are ASCII without those that contractions and special strings begin with, other bytes make a word be matched as a whole.
KIND = np.array([0 if c in b" \n" else OTHER if c >= 127 or c < 33 or c in b"'<" else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN for c in range(256)], np.uint8)
#: Longer pieces (in bytes) are tabled one by one, and so are fewer: side by side they would not pay.
WIDE, MANY = 64, 64


class Trie:
    """The bytes of a vocabulary's tokens as a table of nodes, for many pieces at a time; node 1 is the root, 0 means that no token goes on so.

    Tokens are numbered; `open` and `shut` give those that end in a node without and with the end of the word, 0 if none does.
    What has been asked about a pair of tokens is kept in a table of fixed size, in which a later pair can take the place of an earlier one."""

    def __init__(self, vocab: frozenset[str], bits: int = 21) -> None:
        self.tokens = ["", *sorted(vocab)]
        byte_of = _byte_of_char()
        bodies = [t.removesuffix(END) for t in self.tokens]
        spelled = [bytes(map(byte_of.__getitem__, t)) if byte_of.keys() >= set(t) else b"" for t in bodies]
        starts = {b[:k] for b in spelled for k in range(len(b) + 1)}
        inner = {b[:-1] for b in starts if b}
        self.inner = len(inner)
        node = {b: k for k, b in enumerate(sorted(starts, key=lambda b: (b not in inner, len(b))), 1)}  # those that go on first, as only they have rows
        self.next = np.zeros((self.inner + 1, 256), np.int32)
        for b, k in node.items():
            if b:
                self.next[node[b[:-1]], b[-1]] = k
        self.open, self.shut = np.zeros(len(node) + 1, np.int32), np.zeros(len(node) + 1, np.int32)
        for k, (t, b) in enumerate(zip(self.tokens, spelled)):
            if b:
                (self.shut if t.endswith(END) else self.open)[node[b]] = k
        self.bits = np.uint64(64 - bits)
        self.pairs = np.full(1 << bits, -1, np.int64)

    def stay(self, a: np.ndarray, b: np.ndarray, ask: Callable[[str, str], bool]) -> np.ndarray:
        """Which pairs (a, b) stay apart; any may stand after nothing."""
        key = a.astype(np.int64) * len(self.tokens) + b
        slot = (key.view(np.uint64) * BASE) >> self.bits
        have = self.pairs[slot]
        new = np.flatnonzero(have >> 1 != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            said = [not x // len(self.tokens) or ask(self.tokens[x // len(self.tokens)], self.tokens[x % len(self.tokens)]) for x in asked.tolist()]
            have[new] = (asked * 2 + np.array(said, np.int64))[back]
            self.pairs[slot[new]] = have[new]
        return have & 1 == 1

    def totals(self, pieces: list[bytes], ask: Callable[[str, str], bool]) -> np.ndarray:
        """Of pieces from longest to shortest, none empty: the count of each as a word that ends there.

        Fills the tables of last tokens and of counts of all pieces at once, one prefix length a step. What is under way
        at a step are the beginnings of tokens: of which piece, from which place, at which node."""
        n, size = len(pieces), np.array([len(x) for x in pieces])
        width = int(size[0])
        letters = np.zeros((n, width), np.uint8)
        letters[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        letters = np.ascontiguousarray(letters.T)
        last, count = np.zeros((width, n), np.int32), np.zeros((width, n), np.int32)
        out = np.zeros(n, np.int64)
        piece = place = node = np.empty(0, np.int32)
        longer = n
        for j in range(width):
            here, longer = longer, int(np.searchsorted(-size, -(j + 1)))  # pieces that have byte j, and that go on after it
            on = np.flatnonzero((piece < here) & (node <= self.inner))
            piece = np.append(piece[on], np.arange(here, dtype=np.int32))
            place = np.append(place[on], np.full(here, j, np.int32))
            node = self.next[np.append(node[on], np.ones(here, np.int32)), letters[j, piece]]
            on = np.flatnonzero(node)
            piece, place, node = piece[on], place[on], node[on]
            ends = piece >= longer
            token = np.where(ends, self.shut[node], self.open[node])
            at = np.flatnonzero(token)
            at = at[self.stay(last[place[at], piece[at]], token[at], ask)]
            own, total = piece[at], count[place[at], piece[at]] + 1
            done = ends[at]
            out[own[done]] = total[done]
            if j + 1 < width:
                go = ~done
                last[j + 1, own[go]], count[j + 1, own[go]] = token[at[go]], total[go]
        return out


class PrefixCounter:
    """A word-level BPE vocabulary (a tokenizers file with an end-of-word suffix): NFC, lower case, white space dropped.

    Whether a sequence of tokens is what the merges give can be told from neighbours alone: each two must stay
    apart when merged by themselves. So the encoding of a prefix is that of a shorter prefix and one more token,
    and there is one such token only; a table over the prefixes holds it and the count. Counts of a word's
    prefixes are kept for words seen before; white space parts words for good."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = frozenset(spec["model"]["vocab"])
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.special = [x["content"] for x in spec["added_tokens"]]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.kind = KIND if pattern == PATTERN else np.where(KIND, OTHER, KIND)
        self.char = {b: c for c, b in _byte_of_char().items()}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, np.ndarray] = {}
        self.totals: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        self.most = most
        self.trie: Trie | None = None

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied in the order of their ranks; for pairs of tokens only, so short."""
        rank = self.rank
        while len(symbols) > 1:
            ranks = [rank.get(pair, 1 << 60) for pair in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def stay(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > self.most:
                self.apart.clear()
            if (a, b) in self.rank:  # once there, they would merge
                found = False
            else:
                body = b.removesuffix(END)
                symbols = [*a, *body]
                if body != b:
                    symbols[-1] += END
                found = self.merged(symbols) == [a, b]
            self.apart[a, b] = found
        return found

    def token_table(self, piece: str, every: bool) -> tuple[list[int], list[int]]:
        """Of a piece (a stand-in character a byte): the counts of each prefix as an open word, and as a word that ends there (of the whole only, unless `every`)."""
        last, count, closed = [""], [0], [0]
        vocab, apart, stay, n = self.vocab, self.apart, self.stay, len(piece)
        for j in range(1, n + 1):
            low = j - self.longest if j > self.longest else 0
            if j < n or every:
                for i in range(low, j):
                    token = piece[i:j]
                    if token in vocab and (not i or (apart[last[i], token] if (last[i], token) in apart else stay(last[i], token))):
                        last.append(token)
                        count.append(count[i] + 1)
                        break
            if j == n or every:
                for i in range(low, j):
                    token = piece[i:j] + END
                    if token in vocab and (not i or (apart[last[i], token] if (last[i], token) in apart else stay(last[i], token))):
                        closed.append(count[i] + 1)
                        break
        return count, closed

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word))

    def parted(self, word: str) -> tuple[int, list[str]]:
        """How many special strings, and the pieces, of a stretch without white space at which words part."""
        found, rest = 0, [word]
        if self.split and "<" in word and (parts := self.split.split(word)):
            found, rest = len(parts) // 2, parts[::2]
        return found, [m for part in rest for m in self.pieces.findall(self.normal(part))]

    def total(self, word: str) -> int:
        """Tokens of such a stretch."""
        return self.of_words([word.encode()])[0]

    def close(self, pieces: list[bytes], block: int = 1 << 13) -> None:
        """Puts the counts of pieces into `closed`; where many have up to WIDE bytes, those go through the tables together."""
        if len(self.closed) + len(pieces) > self.most:
            self.closed = {}
        side = sorted((m for m in pieces if len(m) <= WIDE), key=len, reverse=True)
        if len(side) < MANY:
            side = []
        elif self.trie is None:
            self.trie = Trie(self.vocab)
        for k in range(0, len(side), block):
            some = side[k : k + block]
            self.closed.update(zip(some, self.trie.totals(some, self.stay).tolist()))
        for m in pieces:
            if not side or len(m) > WIDE:
                self.closed[m] = self.token_table("".join(map(self.char.__getitem__, m)), False)[1][-1]

    def of_pieces(self, pieces: list[bytes]) -> list[int]:
        """Counts of pieces, each of them once; long ones are not kept."""
        found = list(map(self.closed.get, pieces))
        new = [k for k, n in enumerate(found) if n is None]
        self.close([pieces[k] for k in new])
        for k in new:
            found[k] = self.closed[pieces[k]] if len(pieces[k]) <= WIDE else self.closed.pop(pieces[k])
        return found

    def of_words(self, words: list[bytes]) -> list[int]:
        """Totals of stretches without white space at which words part, each of them once; long ones are not kept."""
        found = list(map(self.totals.get, words))
        new = [k for k, n in enumerate(found) if n is None]
        if len(self.totals) + len(new) > self.most:
            self.totals = {}
        parted = [self.parted(words[k].decode()) for k in new]
        pieces = list({m for _, own in parted for m in own})
        closed = dict(zip(pieces, self.of_pieces([m.encode() for m in pieces]))).__getitem__
        for k, (special, own) in zip(new, parted):
            found[k] = special + sum(map(closed, own))
            if len(words[k]) <= WIDE:
                self.totals[words[k]] = found[k]
        return found

    def count(self, col: pa.Array, most: int = 4 << 20) -> np.ndarray:
        """Tokens of each text of a column; null counts as empty. Works through about `most` bytes at a time.

        Words of ASCII letters, digits and signs are cut into pieces as bytes; words with anything else are looked up as they
        are, and those not met before are normalised and matched one by one."""
        data, offsets = flat(col)
        out = np.zeros(len(col), np.int64)
        for lo, hi in stretches(data, offsets, most, self.kind > 0):
            first, after = np.searchsorted(offsets, [lo, hi], "right")
            edges = np.clip(offsets[first - 1 : after + 1], lo, hi) - lo  # of the texts in this stretch
            begins = edges[edges < hi - lo]
            part = data[lo:hi]
            kind = self.kind[part]
            inside, word = kind > 0, kind > 0
            word[1:] &= ~inside[:-1]
            word[begins] = inside[begins]
            at = np.flatnonzero(word)
            if not len(at):
                continue
            piece = word.copy()
            piece[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
            other = np.zeros(hi - lo, bool)
            other[at[0] :] = np.repeat(np.maximum.reduceat(kind, at) == OTHER, np.diff(at, append=hi - lo))
            for letters, own, start, counts in ((TO_LOWER[part], inside & ~other, piece & ~other, self.of_pieces), (part, inside & other, word & other, self.of_words)):
                ends = np.append((np.cumsum(own, dtype=np.int32) - 1)[start], np.count_nonzero(own)).astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters[own])]).dictionary_encode()
                each = np.array(counts(found.dictionary.to_pylist()), np.int64)[found.indices.to_numpy()]
                out[first - 1 : first + len(edges) - 2] += np.diff(np.append(0, np.cumsum(each))[np.searchsorted(np.flatnonzero(start), edges)])
        return out

    def prefixes(self, word: str) -> np.ndarray:
        """Counts of the 1, 2, ... first characters of such a stretch.

        Inside a run of letters or signs the table of the piece has them all at once; where a special string, a
        contraction or a composing character can change what came before, the prefix is counted by itself."""
        found = self.words.get(word)
        if found is None:
            out = np.zeros(len(word), np.int32)
            low = self.normal(word)
            plain = len(low) == len(word) and "'" not in low and "<|" not in low and (low.isascii() or PLAIN.fullmatch(low) is not None)
            if plain:
                base = 0
                for m in self.pieces.finditer(low):
                    closed = self.token_table("".join(map(self.char.__getitem__, m[0].encode())), True)[1]
                    at = np.cumsum([len(c.encode()) for c in m[0]])
                    out[m.start() : m.end()] = base + np.asarray(closed)[at]
                    base = int(out[m.end() - 1])
                    out[m.end() :] = base  # other white space follows, or the next piece
            else:
                out[:] = [self.total(word[: k + 1]) for k in range(len(word))]
            if len(self.words) >= self.most // 4:
                self.words.clear()
            found = out
            if len(word) < 64:
                self.words[word] = found
        return found

    def table(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[: i]."""
        out = np.zeros(len(text) + 1, np.int32)
        at = base = 0
        for w in text.replace("\n", " ").split(" "):
            if w:
                out[at + 1 : at + 1 + len(w)] = base + self.prefixes(w)
                base = int(out[at + len(w)])
            at += len(w) + 1
            if at <= len(text):
                out[at] = base
        return out


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs. Words are closed at their end only, and each distinct one is counted once; prefix_counts() gives every prefix.

    Null and empty texts have no bytes and no tokens. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n_bytes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, pa.array(c.count(b.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, counts array<int>): counts[i] is the number of tokens of the first i characters, as the library gives it for that prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, 1 << 20):
            tables = [c.table(t.as_py() or "") for t in b.column("text")]
            ends = np.r_[0, np.cumsum([len(t) for t in tables])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))], ["doc_id", "text", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, counts array<int>")


def tokens_before(characters: Column | str) -> Column:
    """How many tokens the first `characters` characters of a row of prefix_counts() have; past its end, those of the whole text."""
    return F.get("counts", F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size("counts") - 1))


def fitting(budget: int) -> Column:
    """The longest prefix of a row of prefix_counts() of at most `budget` tokens; a count can fall as a word grows."""
    n = F.array_max(F.transform("counts", lambda x, i: F.when(x <= budget, i)))
    return F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.coalesce(n, F.lit(0)))

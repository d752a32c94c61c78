"""Token counts by rank-synchronous merging of ragged numpy arrays.

A tokenizer file of the word-end kind (lower case, white space dropped, byte-level
symbols, ``</w>`` on a word's last symbol) is read as plain tables. The distinct
pre-tokens of a batch lie end to end in one array of symbol ids. In each round every
word looks up the ranks of its adjacent pairs, takes its lowest, and merges all
places of that pair at once, left to right; words without a pair left are done, and
their symbols are counted. A merge only ever makes pairs of a higher rank, so this gives
what merging one place at a time gives. Words of more than ``LONG`` symbols, which stay alive
for many rounds, keep the places of every rank instead: a round reads and ranks anew only
the places it merges and their neighbours, so the work grows with the word's length.

Words are separated by white space before anything else happens to a text, and
normalization never reaches across white space, so each distinct white-space-free chunk is
counted once per worker. Chunks with characters that Python's Unicode tables don't know are
cut into words by the library's own normalizer and pre-tokenizer, as its tables are newer.

Cases: null and empty texts have no tokens; the strings of special tokens inside a text
count one each and split the text, as the library has it by default; symbols that the
file lacks are dropped; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

LIMIT = 2048
REMEMBER = 600_000
LONG = 512
NONE = np.int64(1) << 40

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next free one from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else spare))
        spare += b not in keep
    return out


SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)

#: The characters that the library's patterns take as white space.
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def kind(c: str) -> int:
    if c in WHITE:
        return SPACE
    category = unicodedata.category(c)
    return {"L": LETTER, "N": DIGIT}.get(category[0], UNKNOWN if category == "Cn" else OTHER)


def fold(text: str) -> str:
    """Composed and lower case; the final form of sigma is not chosen, as each character is lowered alone."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


class PairTable:
    """Ranks of symbol pairs by two hash tables; the second holds what shares a place in the first."""

    def __init__(self, key: np.ndarray):
        self.tables, rank = [], np.arange(len(key))
        for shift, factor in ((44, 0x9E3779B97F4A7C15), (44, 0xC2B2AE3D27D4EB4F), (44, 0xD6E8FEB86659FD93), (44, 0xA0761D6478BD642F)):
            if not len(key):
                break
            at = self._place(key, factor, shift)
            keys, ranks = np.full(1 << 64 - shift, -1, "i8"), np.full(1 << 64 - shift, NONE, "i8")
            keys[at], ranks[at] = key, rank
            lost = keys[at] != key
            self.tables.append((factor, shift, keys, ranks))
            key, rank = key[lost], rank[lost]
        assert not len(key)

    @staticmethod
    def _place(key: np.ndarray, factor: int, shift: int) -> np.ndarray:
        return (key.astype("u8") * np.uint64(factor) >> np.uint64(shift)).astype("i8")

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), NONE, "i8")
        for factor, shift, keys, ranks in self.tables:
            at = self._place(key, factor, shift)
            hit = keys[at] == key
            out[hit] = ranks[at[hit]]
        return out


class WordMerger:
    """The merge table of a tokenizer file, and the number of symbols that words end with."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in data["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        symbols = byte_symbols()
        self.path, self.library, self.byte_of = path, None, {s: b for b, s in enumerate(symbols)}
        self.inner = np.array([vocab.get(s, -1) for s in symbols], "i8")
        self.last = np.array([vocab.get(s + end, -1) for s in symbols], "i8")
        pairs = [(a, b) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"] for a, b in [x if not isinstance(x, str) else x.split(" ")]]
        self.find = PairTable(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], "i8"))
        self.made = np.array([vocab[a + b] for a, b in pairs], "i8")  # by rank
        self.kinds = np.array([kind(chr(c)) if not 0xD800 <= c < 0xE000 else OTHER for c in range(1 << 16)], "u1")

    def count(self, raw: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """How many symbols each of ``words`` words is merged into; ``raw``: their bytes, ``owner``: whose, in order."""
        out = np.zeros(words, "i8")
        symbol = np.where(np.append(owner[1:] != owner[:-1], True), self.last[raw], self.inner[raw]) if len(raw) else raw
        known = symbol >= 0
        symbol, owner = symbol[known], owner[known]
        size = np.bincount(owner, minlength=words) if len(owner) else out
        if size.max(initial=0) > LONG:
            long = size[owner] > LONG
            out += self.count_long(symbol[long], owner[long], words)
            symbol, owner = symbol[~long], owner[~long]
        while len(symbol):
            pair = symbol[:-1] << 20 | symbol[1:]
            rank = np.where(owner[:-1] == owner[1:], self.find(pair), NONE)
            rank = np.append(rank, NONE)  # the last symbol of all has no right neighbour
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(owner)))
            live = lowest < NONE
            out[owner[first[~live]]] += length[~live]
            if not live.any():
                break
            keep = np.repeat(live, length)
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            hit = np.flatnonzero(rank == np.repeat(lowest[live], length[live]))
            run = np.append(True, np.diff(hit) > 1)  # overlapping places, as in a a a, merge every other one
            since = hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            hit = hit[since % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            gone = np.ones(len(symbol), bool)
            gone[hit + 1] = False
            symbol, owner = symbol[gone], owner[gone]
        return out

    def count_long(self, symbol: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """As count, over symbols: each round takes the lowest rank of all, at all its places."""
        n = len(symbol)
        symbol, alive = symbol.copy(), np.ones(n + 1, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1, which are one place: none
        last = np.append(owner[1:] != owner[:-1], True)
        after[last] = n
        before[np.append(True, last[:-1])] = n
        rank = np.full(n + 1, NONE)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def rank_anew(at: np.ndarray) -> None:
            paired = after[at] < n
            rank[at[~paired]] = NONE
            at = at[paired]
            found = self.find(symbol[at] << 20 | symbol[after[at]])
            rank[at] = found
            hit = found < NONE
            at, found = at[hit], found[hit]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found
            for r, part in zip(found[first].tolist(), np.split(at, first[1:])):
                if r not in places:
                    places[r] = []
                    heappush(queue, r)
                places[r].append(part)

        rank_anew(np.arange(n))
        while queue:
            r = heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.append(True, after[at[:-1]] != at[1:])  # overlapping places merge every other one
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            gone = after[at]
            symbol[at], alive[gone], rank[gone] = self.made[r], False, NONE
            after[at] = after[gone]
            linked = after[at] < n
            before[after[at[linked]]] = at[linked]
            left = before[at]
            rank_anew(np.unique(np.append(at, left[left < n])))
        return np.bincount(owner[alive[:n]], minlength=words)

    def pre_tokens(self, text: str) -> list[bytes]:
        """The words of any text, by the file's own pattern."""
        folded = fold(text)
        if folded.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(folded)):
            return [w.encode() for w in self.words.findall(folded)]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in pieces]

    def count_words(self, words: list[bytes]) -> np.ndarray:
        return self.count(np.frombuffer(b"".join(words), "u1"), np.repeat(np.arange(len(words)), [len(w) for w in words]), len(words))

    def count_chunks(self, chunks: list[bytes]) -> list[int]:
        """Tokens of each chunk (without ASCII white space), special strings included."""
        odd = [i for i, c in enumerate(chunks) if b"'" in c or b"<|" in c]
        skip = set(odd)
        totals = np.zeros(len(chunks), "i8")
        plain = np.array([i for i in range(len(chunks)) if i not in skip], "i8")
        if len(plain):
            totals[plain], unknown = self._count_plain([chunks[i] for i in plain] if odd else chunks)
            odd += plain[unknown].tolist()
            totals[plain[unknown]] = 0
        words, of = [], []
        for i in odd:
            parts = self.split_special.split(chunks[i].decode("utf-8", "replace"))
            totals[i] += len(parts) - 1
            for part in parts:
                found = self.pre_tokens(part)
                words += found
                of += [i] * len(found)
        if words:
            np.add.at(totals, of, self.count_words(words))
        return totals.tolist()

    def _count_plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As count_chunks, all in arrays: without apostrophes, words are runs of letters, of symbols, and single digits; and the chunks that hold unknown characters."""
        text = fold(b"\n".join(chunks).decode("utf-8", "replace"))
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[np.minimum(code, 0xFFFF)]
        for at in np.flatnonzero(code > 0xFFFF):
            kinds[at] = kind(chr(code[at]))
        inside = kinds != SPACE
        begins = inside & ((kinds == DIGIT) | np.append(True, kinds[1:] != kinds[:-1]))
        word = np.cumsum(begins) - 1
        raw = np.frombuffer(text.encode(), "u1")
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        used = inside[char]
        n = self.count(raw[used], word[char[used]], int(begins.sum()))
        chunk = np.cumsum(code == 10)
        unknown = np.unique(chunk[kinds == UNKNOWN])
        return np.bincount(chunk[begins], n, len(chunks)).astype("i8"), unknown


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known = None, {}
        for batch in batches:
            merger = merger or WordMerger(tokenizer)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in utf8(part.column(1))]
                split = [t.split() for t in texts]
                if len(known) > REMEMBER:
                    known.clear()
                fresh = list(set().union(*split).difference(known)) if split else []
                for b in range(0, len(fresh), 20_000):
                    block = fresh[b : b + 20_000]
                    known.update(zip(block, merger.count_chunks(block)))
                n = np.array([sum(map(known.__getitem__, s)) for s in split], "i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, COUNTS)

"""BPE encoding and decoding with a public vocabulary; merges come from a segment tree over pair ranks.

Each word is a row of symbols; leaf ``i`` of its tree holds the rank of the pair that starts at
symbol ``i`` (or "none").  The root is the lowest rank, walking down to the left on ties yields its
leftmost place; a merge changes three leaves, each renewed in logarithmically many steps.  Short
words run as many trees side by side in numpy, long ones one by one.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankframe.llm.common import add_by_text

NONE = np.int32(2**31 - 1)
SHORT = 64
#: Distinct chunks whose ids a task remembers: those of two generations, the older one going when the newer has half.
REMEMBERED = 250_000

# Fixed values of the vocabulary file's normaliser and splitter (white space as its regular expressions see it).
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: Python's str.split() also splits here, the vocabulary's splitter does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [at[b] for b in range(256)]


# Code points that the installed regular expressions know as letters or numbers but the
# vocabulary's splitter does not (first-last), and lower-case forms newer than Python's own.
NEWER = ("558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d "
         "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f "
         "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
         "1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
         "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f")
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
_LOWERED_APART = [chr(c) for c in LOWER]
#: Neither the code points of NEWER nor those of LOWER are below these.
_FIRST_NEWER, _FIRST_LOWERED_APART = 0x558, min(LOWER)


def highest(text: str) -> int:
    """The highest code point of a text, -1 if it is empty."""
    return int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max(initial=0)) if text else -1


def newer_characters() -> str:
    """NEWER as the inside of a character class."""
    return "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (r.split("-") for r in NEWER.split()))


class WordBpe:
    """Encoder and decoder of one vocabulary file (JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, end = dict(spec["model"]["vocab"]), spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int64)
        pairs = [(vocab[a] << 20 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])]
        self.table = {k: (r, v) for k, r, v in reversed(pairs)}
        keys = sorted(self.table)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([self.table[k][0] for k in keys], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in spec["model"]["merges"]], np.int64)
        self.newer = regex.compile(f"[{newer_characters()}]")
        known = PIECES.replace(r"\p{L}+", rf"(?:(?![{newer_characters()}])\p{{L}})+").replace(r"|\p{N}|", rf"|(?![{newer_characters()}])\p{{N}}|")
        known = known[:known.rindex("[^")] + f"(?:[{newer_characters()}]|" + known[known.rindex("[^"):-1] + ")+"
        self.splitters = {end: (regex.compile(PIECES + end).findall, regex.compile(known + end).findall) for end in ("", "|\n")}
        self.find_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.forget_pieces()

    def find_pieces(self, text: str, end: str = "") -> list[str]:
        quick, exact = self.splitters[end]
        return quick(text) if text.isascii() or highest(text) < _FIRST_NEWER or not self.newer.search(text) else exact(text)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where there is no merge (or a symbol is below 0)."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def encode_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most SHORT bytes, side by side."""
        n = np.array([len(w) for w in words])
        width = 1 << int(max(n.max() - 1, 1)).bit_length()
        grid = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        cols = np.arange(width)
        grid[cols[None, :] < n[:, None]] = flat
        sym = np.where(cols[None, :] < n[:, None], self.inner[grid], -1)
        rows = np.arange(len(words))
        sym[rows, n - 1] = self.last[grid[rows, n - 1]]
        nxt = np.where(cols[None, :] + 1 < n[:, None], cols[None, :] + 1, -1)
        prv = np.broadcast_to(cols[None, :] - 1, sym.shape).copy()
        tree = np.full((len(words), 2 * width), NONE, np.int32)
        tree[:, width:2 * width - 1] = self.rank(sym[:, :-1], sym[:, 1:])
        at = width
        while at > 1:
            tree[:, at // 2:at] = np.minimum(tree[:, at:2 * at:2], tree[:, at + 1:2 * at:2])
            at //= 2
        depth = width.bit_length() - 1

        def renew(r, leaf, value):
            at = leaf + width
            tree[r, at] = value
            for _ in range(depth):
                at >>= 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        live = rows[tree[:, 1] != NONE]
        while len(live):
            at = np.ones(len(live), np.int64)
            for _ in range(depth):
                at *= 2
                at += tree[live, at] > tree[live, at + 1]
            i = at - width
            j = nxt[live, i]
            after, before = nxt[live, j], prv[live, i]
            new = self.merged[tree[live, 1]]
            sym[live, i], sym[live, j], nxt[live, i] = new, -1, after
            has = after >= 0
            prv[live[has], after[has]] = i[has]
            renew(live, j, NONE)
            renew(live, i, np.where(has, self.rank(new, sym[live, after]), NONE))
            has = before >= 0
            r = live[has]
            renew(r, before[has], self.rank(sym[r, before[has]], new[has]))
            live = live[tree[live, 1] != NONE]
        keep = sym >= 0
        ids, ends = sym[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        n, get, none = len(word), self.table.get, int(NONE)
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        width = 1 << max(n - 1, 1).bit_length()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(sym[i] << 20 | sym[i + 1], (none, 0))[0]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]

        def renew(leaf, value):
            at = width + leaf
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b

        while tree[1] != none:
            at = 1
            while at < width:
                at *= 2
                at += tree[at] > tree[at + 1]
            i = at - width
            j = nxt[i]
            new = int(self.merged[tree[1]])
            after, before = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = new, -1, after
            renew(j, none)
            if after >= 0:
                prv[after] = i
                renew(i, get(new << 20 | sym[after], (none, 0))[0])
            else:
                renew(i, none)
            if before >= 0:
                renew(before, get(sym[before] << 20 | new, (none, 0))[0])
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, those of like length together."""
        out, by = {}, {}
        for w in words:
            if len(w) > SHORT:
                out[w] = self.encode_long(w)
            else:
                by.setdefault(max(len(w) - 1, 1).bit_length(), []).append(w)
        for same in by.values():
            for at in range(0, len(same), 4_000):
                part = same[at:at + 4_000]
                out.update(zip(part, self.encode_short(part)))
        return out

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """White-space-separated parts of a text without special tokens, normalised."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii() and any(c in text for c in _LOWERED_APART):
            text = text.translate(LOWER)
        text = text.lower()
        if not text.isascii() or ODD_SPACE.search(text):
            return regex.findall(f"[^{SPACE}]+", text)
        return text.split()

    def forget(self) -> None:
        self.memory, self.older = {}, {}

    def learn(self, new: list[str]) -> None:
        """Remember ids (little-endian unsigned 32 bits) of chunks."""
        pieces = self.find_pieces("\n".join([*new, ""]), "|\n")
        distinct = list(set(pieces) - {"\n"})
        raw = [p.encode() for p in distinct]
        ids = dict(zip(distinct, map(self.encode_words(raw).__getitem__, raw)))
        chunk, own, pack, memory = iter(new), [], struct.pack, self.memory
        for p in pieces:
            if p == "\n":
                memory[next(chunk)] = pack(f"<{len(own)}I", *own)
                own = []
            else:
                own += ids[p]

    def split(self, text: str) -> list[str]:
        """Chunks of a text; a special token is a chunk of its own, marked by a leading blank."""
        if not self.find_special or not self.find_special.search(text):
            return self.chunks(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += self.chunks(text[at:m.start()])
            out.append(" " + m.group())
            at = m.end()
        return out + self.chunks(text[at:])

    def forget_pieces(self) -> None:
        """Empties the memory of pieces: number by piece (0: the line feed), and by number where its ids begin, how many they are, and the ids."""
        self.pieces, self.piece_at, self.piece_size, self.piece_ids = {"\n": 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn_pieces(self, pieces: list[str]) -> None:
        distinct = [p for p in set(pieces) if p not in self.pieces]
        raw = [p.encode() for p in distinct]
        found = list(map(self.encode_words(raw).__getitem__, raw))
        size = np.array([len(own) for own in found], np.int64)
        self.pieces.update(zip(distinct, range(len(self.pieces), len(self.pieces) + len(distinct))))
        self.piece_at = np.concatenate([self.piece_at, len(self.piece_ids) + np.cumsum(size) - size])
        self.piece_size = np.concatenate([self.piece_size, size])
        self.piece_ids = np.concatenate([self.piece_ids, np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))])

    def ids_of_words(self, lines: str) -> list[list[int]]:
        """Ids of each line of a text whose lines, each ended by a line feed, are words."""
        ids, size = self.flat_ids_of_words(lines)
        ids, ends = ids.tolist(), np.cumsum(size).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def flat_ids_of_words(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of :meth:`ids_of_words` in a row, and how many each line has."""
        if self.find_special and self.find_special.search(lines):
            packed = [self.encode_texts([w])[0][0] for w in lines.split("\n")[:-1]]
            return np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.array([len(b) // 4 for b in packed], np.int64)
        if not unicodedata.is_normalized("NFC", lines):
            lines = unicodedata.normalize("NFC", lines)
        if not lines.isascii() and highest(lines) >= _FIRST_LOWERED_APART and any(c in lines for c in _LOWERED_APART):
            lines = lines.translate(LOWER)
        pieces = self.find_pieces(lines.lower(), "|\n")
        if len(self.pieces) > REMEMBERED:
            self.forget_pieces()
        self.learn_pieces(pieces)
        no = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        size = self.piece_size[no]
        ends = np.cumsum(size)
        ids = self.piece_ids[np.repeat(self.piece_at[no] - (ends - size), size) + np.arange(int(size.sum()))]
        return ids, np.diff(ends[no == 0], prepend=0)

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(packed ids, decoded text) of each text."""
        parts = [self.split(t) for t in texts]
        every = set().union(*parts)
        new = [c for c in every if c not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED // 2:
            self.memory, self.older, new = {}, self.memory, list(every)
        known = [c for c in new if c in self.older]
        self.memory.update(zip(known, map(self.older.get, known)))
        if known:
            new = [c for c in new if c not in self.older]
        marked = [c for c in new if c[0] == " "]
        if new:
            self.learn([c for c in new if c[0] != " "])
            for c in marked:
                self.memory[c] = struct.pack("<I", self.special[c[1:]])
        get, names, out = self.memory.__getitem__, self.names.__getitem__, []
        for p in parts:
            packed = b"".join(map(get, p))
            out.append((packed, " ".join(map(names, np.frombuffer(packed, "<u4").tolist()))))
        return out


@lru_cache(maxsize=2)
def _coder(source: str) -> WordBpe:
    return WordBpe(source)


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """``docs`` with two more columns: the text's ids (binary, little-endian unsigned 32 bits) and their decoded text.

    A null text counts as empty and has no ids; special tokens written in a text get their own ids;
    repeated rows stay; an empty table gives no rows.  A column of ``docs`` named like a new one is
    replaced.  The vocabulary file is read by the driver and broadcast (a fixed file of a few MB).
    """
    with open(vocab_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        coder = _coder(source.value)

        def coded(texts: pa.Array) -> list[pa.Array]:
            pairs = coder.encode_texts([t or "" for t in texts.to_pylist()])
            return [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())]
        coded.end = coder.forget  # the worker goes on to other work
        return coded

    return add_by_text(docs, text_col, {ids_col: "binary", decoded_col: "string"}, start, keep_text=keep_text)

"""Operator 4: SentencePiece encoding with seeded merge-dropout, and exact decoding.

The vocabulary of a public BPE model (pieces, scores, byte fallback) is read
from its file; nothing is trained. A text is encoded as the model does it: a space
becomes U+2581, one is put in front, and the best-scored merge of neighbouring
symbols is applied until none is left. Dropout skips a candidate merge when the
keyed hash of (seed, text, place of the word in the text, merged piece, position) falls below
``dropout``, so a seed always gives the same segmentation and another seed gives another
one, and every occurrence of a word draws its own merges. Only merges that come up draw, so a word
has a small tree of decisions: a node is the segmentation under some skipped merges with the merges
made on the way, a child skips one more of them. For a single text the nodes met are remembered; an occurrence walks them by
its own draws. In a table most words are rare and trees do not pay: there only the segmentations without skipped merges are
remembered, and all occurrences that skip a merge are merged together as arrays, a merge of every word at a time.

Decoding joins the pieces' bytes. It is lossless for every text: symbols without a
piece, and a literal U+2581, are spelt in bytes. ``dropout=0`` gives the model's own ids.

Edge cases: null and empty texts have no ids and decode to the empty text; runs of
spaces, controls and characters beyond the vocabulary are kept; repeated rows are encoded
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import python_ready, texts

SEED, DROPOUT = 20240229, 0.1
SPACE = "▁"
INFINITE = float("inf")
NONE = (INFINITE, -1)
#: Marks of characters in place of a piece: in no piece at all; only in longer ones, or a literal U+2581.
ALONE, ODD = -10, -2
#: Characters of the longest words that are merged together with others and remembered.
LONG = 200
#: Bytes of the texts that are encoded together.
TEXT_BYTES = 1_000_000


class Node:
    """A word's segmentation when the merges ``skipped`` are skipped: its ids and the draws of the merges made, in order.

    ``children[i]``: the node where merge i is skipped as well; its first i merges are the same.
    """

    __slots__ = ("ids", "draws", "raw", "n", "skipped", "children")

    def __init__(self, ids: bytes | None, draws: tuple[int, ...], skipped: frozenset[int]):
        self.ids, self.draws, self.n, self.skipped = ids, draws, len(draws), skipped
        self.raw = np.array(draws, np.uint32).tobytes()
        self.children: dict[int, Node] = {}


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges of ``n`` from ``starts``."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Segments:
    """ids and draws of many words in flat arrays: word i has ``n_ids[i]`` ids from ``ids_at[i]``; draws alike."""

    def __init__(self, words: int):
        self.ids_at, self.n_ids, self.draws_at, self.n_draws = np.zeros((4, words), np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.ends = [0, 0]

    def put(self, rows: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, draws: np.ndarray, n_draws: np.ndarray) -> None:
        """The words ``rows``, in this order."""
        self.ids_at[rows], self.n_ids[rows] = self.ends[0] + np.cumsum(n_ids) - n_ids, n_ids
        self.draws_at[rows], self.n_draws[rows] = self.ends[1] + np.cumsum(n_draws) - n_draws, n_draws
        self.parts.append((ids, draws))
        self.ends = [self.ends[0] + len(ids), self.ends[1] + len(draws)]

    def closed(self) -> Segments:
        self.ids, self.draws = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (zip(*self.parts) if self.parts else ((), ())))
        self.parts = []
        return self

    def followed(self, more: Segments) -> Segments:
        """These words and then those of ``more``."""
        out = Segments(0)
        out.ids, out.draws = np.concatenate([self.ids, more.ids]), np.concatenate([self.draws, more.draws])
        out.ids_at, out.n_ids = np.append(self.ids_at, more.ids_at + len(self.ids)), np.append(self.n_ids, more.n_ids)
        out.draws_at, out.n_draws = np.append(self.draws_at, more.draws_at + len(self.draws)), np.append(self.n_draws, more.n_draws)
        return out


class Pieces:
    """One model's pieces with remembered decision trees of words."""

    LIMIT = 300_000
    #: Places of words that are merged at a time.
    CELLS = 400_000

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.id, self.rank, self.bytes, self.byte_id = {}, {}, [b""] * n, [0] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p], self.rank[p] = i, (-sp.get_score(i), i)
                self.bytes[i] = p.replace(SPACE, " ").encode()
        self.seed, self.threshold = seed, int(dropout * (1 << 32))
        self._tables()
        #: word -> its place in ``own``, for encode_all.
        self.number: dict[str, int] = {}
        self.own = Segments(1).closed()  # place 0: words that are not remembered
        self.unremembered = Node(None, (), frozenset())
        #: word -> root of its tree; size counts nodes.
        self.known: dict[str, Node] = {}
        self.size = 0

    @staticmethod
    def draw(rank: tuple[float, int], at: int) -> int:
        """What the merge into the piece of ``rank`` at symbol ``at`` adds to an occurrence's key."""
        return (rank[1] * 0x9E3779B1 + at * 0x85EBCA77) & 0xFFFFFFFF

    def skips(self, key: int, draw: int) -> bool:
        x = (key + draw) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        return x ^ (x >> 13) < self.threshold

    def node(self, word: str, skipped: frozenset[int]) -> Node:
        """Merge the best candidate, the leftmost of equals, until none is left; those in ``skipped`` are not made."""
        sym, get, at, start, draws = self.symbols(word), self.rank.get, 0, [], []
        for s in sym:
            start.append(at)
            at += len(s)
        wait = [get(a + b, NONE) for a, b in zip(sym, sym[1:])]
        cost = [w[0] for w in wait]
        while cost:
            best = min(cost)
            if best == INFINITE:
                break
            i = cost.index(best)
            d = self.draw(wait[i], start[i])
            if d in skipped:
                cost[i] = INFINITE
                continue
            draws.append(d)
            sym[i] += sym.pop(i + 1)
            start.pop(i + 1), wait.pop(i), cost.pop(i)
            for k in (i - 1, i):
                if 0 <= k < len(wait):
                    wait[k] = get(sym[k] + sym[k + 1], NONE)
                    cost[k] = wait[k][0]
        return Node(self.ids_of(sym), tuple(draws), skipped)

    def merged(self, symbols: list[str], key: int) -> list[str]:
        """The same under ``key`` with an agenda, for words of many symbols."""
        start = list(itertools.accumulate(map(len, symbols), initial=0))
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, str]] = []
        sym: list[str | None] = list(symbols)

        def push(i: int, j: int) -> None:
            p = sym[i] + sym[j]
            s = self.rank.get(p)
            if s is not None and not self.skips(key, self.draw(s, start[i])):
                heapq.heappush(agenda, (s[0], i, j, p))

        for i in range(len(symbols) - 1):
            push(i, i + 1)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j], after[i] = p, None, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in sym if s is not None]

    @staticmethod
    def symbols(word: str) -> list[str]:
        body = word.lstrip(" ")
        # A literal U+2581 is no space: as a symbol it has no piece.
        return [SPACE] * (len(word) - len(body)) + [c if c != SPACE else "\0" + c for c in body]

    def ids_of(self, sym: list[str]) -> bytes:
        """ids of symbols as little-endian uint32."""
        ids: list[int] = []
        for s in sym:
            i = self.id.get(s)
            ids += [i] if i is not None else [self.byte_id[b] for b in s.lstrip("\0").encode("utf-8", "surrogatepass") or b"\0"]
        return np.array(ids, "<u4").tobytes()

    def drawn(self, word: str, key: int) -> bytes:
        """ids of one word under ``key``; ``word`` starts with its spaces as plain spaces."""
        return self.ids_of(self.merged(self.symbols(word), key))

    def root(self, word: str) -> Node:
        """The word's segmentation without skipped merges, remembered unless the word has many symbols."""
        if len(word) > 48:
            return self.unremembered
        if self.size >= self.LIMIT:
            self.known.clear()
            self.size = 0
        self.size += 1
        n = self.known[word] = self.node(word, frozenset())
        return n

    def walked(self, word: str, node: Node, first: int, key: int) -> bytes:
        """ids of an occurrence whose draws skip merge ``first`` of ``node``."""
        threshold = self.threshold
        while True:
            child = node.children.get(first)
            if child is None:
                child = self.node(word, node.skipped | {node.draws[first]})
                if self.size < self.LIMIT:
                    node.children[first] = child
                    self.size += 1
            node = child
            for first in range(first, node.n):
                x = (key + node.draws[first]) & 0xFFFFFFFF
                x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                if x ^ (x >> 13) < threshold:
                    break
            else:
                return node.ids

    def together(self, words: list[str], keys: np.ndarray | None = None) -> Segments:
        """Segments of many words, each under its key or without skipped merges; draws only without keys.

        All words make their next merge at once. A place holds a piece and its neighbour pair's merge; a merge leaves the
        left one of its two places. Very long words and those with a literal U+2581 go one by one.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        char, starts = self.of_char[code], np.cumsum(size) - size
        # A symbol without a piece stands for itself, below ALONE: it is in no merge.
        lone = np.flatnonzero(char == ALONE)
        char[lone] = ALONE - code[lone].astype(np.int32)
        odd = np.logical_or.reduceat(char == ODD, starts) | (size > LONG)
        parts, order = [], np.flatnonzero(~odd)
        order = order[np.argsort(size[order], kind="stable")]
        at = 0
        while at < len(order):
            rows = order[at:at + max(1, min(self.CELLS // 8, len(order) - at))]
            rows = rows[:max(1, self.CELLS // int(size[rows[-1]]))]
            at += len(rows)
            parts.append((rows, *self._merged_together(char, starts[rows], size[rows], None if keys is None else keys[rows])))
        for i in np.flatnonzero(odd).tolist():
            n = self.node(words[i], frozenset()) if keys is None else None
            ids = np.frombuffer(n.ids if n else self.drawn(words[i], int(keys[i])), "<u4")
            draws = np.array(n.draws if n else (), np.uint32)
            parts.append((np.array([i]), ids, np.array([len(ids)]), draws, np.array([len(draws)])))
        out = Segments(len(words))
        for rows, *part in parts:
            out.put(rows, *part)
        return out.closed()

    def _merged_together(self, char: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray | None):
        """(ids, their number for each word, draws of the merges made, their number) of words of about one length."""
        n, width = len(size), int(size.max())
        place = np.arange(width + 1, dtype=np.int32)
        sym = np.where(place < size[:, None], char[np.minimum(starts[:, None] + place, len(char) - 1)], -1)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        merge, cost = self._offers(sym[:, :-1], sym[:, 1:])
        made_by, made = [], []
        r = np.arange(n)
        while len(r):
            offered = cost[r]
            i = offered.argmin(axis=1)  # the leftmost of equals
            live = offered[np.arange(len(r)), i] < self.no_offer
            r, i = r[live], i[live]
            m = merge[r, i]
            d = m.astype(np.uint32) * np.uint32(0x9E3779B1) + i.astype(np.uint32) * np.uint32(0x85EBCA77)  # as in draw()
            if keys is None:
                made_by.append(r)
                made.append(d)
                x, k = r, i
            else:  # as in skips()
                h = keys[r] + d
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                skip = (h ^ (h >> np.uint32(13))) < np.uint64(self.threshold)
                cost[r[skip], i[skip]] = self.no_offer
                x, k, m = r[~skip], i[~skip], m[~skip]
            gone = after[x, k]
            then, prior = after[x, gone], before[x, k]
            after[x, k], before[x, then] = then, k
            sym[x, k], sym[x, gone], cost[x, gone] = m, -1, self.no_offer
            left = prior >= 0
            x2, k2 = np.concatenate([x, x[left]]), np.concatenate([k, prior[left]])
            merge[x2, k2], cost[x2, k2] = self._offers(sym[x2, k2], np.concatenate([sym[x, then], m[left]]))
        there = sym != -1
        counts, ids = there.sum(axis=1), sym[there]
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # spelt in bytes
            spelt = [self.ids_of([chr(ALONE - c)]) for c in ids[lone].tolist()]
            more = np.array([len(x) // 4 - 1 for x in spelt])
            each = np.ones(len(ids), np.int64)
            each[lone] += more
            counts = counts + np.bincount(np.repeat(np.arange(n), counts)[lone], more, n).astype(np.int64)
            bytes_at = np.repeat(np.isin(np.arange(len(ids)), lone), each)
            ids = np.repeat(ids, each)
            ids[bytes_at] = np.frombuffer(b"".join(spelt), "<u4")
        row = np.concatenate(made_by) if made_by else np.zeros(0, np.int64)
        draws = np.concatenate(made)[np.argsort(row, kind="stable")] if made else np.zeros(0, np.uint32)
        return ids.astype(np.uint32), counts, draws, np.bincount(row, minlength=n)

    def _offers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its place among all scores) that neighbours a, b merge into; -1 stands for no symbol."""
        key = a.astype(np.int64) * len(self.bytes) + b
        slot = self._slot(key)
        found = self.slot_pair[slot]
        off = np.flatnonzero((found != key) & (found >= 0))  # taken by another pair: the next places
        while len(off):
            at = (slot.flat[off] + 1) & (len(self.slot_pair) - 1)
            slot.flat[off] = at
            found.flat[off] = there = self.slot_pair[at]
            off = off[(there != key.flat[off]) & (there >= 0)]
        hit = (found == key) & (a >= 0) & (b >= 0)
        return self.slot_piece[slot], np.where(hit, self.slot_cost[slot], self.no_offer)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).view(np.int64)

    def _tables(self) -> None:
        """Pieces of characters, and the pairs of pieces that merge, as arrays."""
        self.of_char = np.full(0x110000, ALONE, np.int32)
        # A character that is in pieces but is none itself may still merge: such words go one by one.
        self.of_char[[ord(c) for c in {c for p in self.rank for c in p}]] = ODD
        for c, i in self.id.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # In a word plain spaces stand for U+2581; a literal one is spelt in bytes.
        self.of_char[ord(" ")], self.of_char[ord(SPACE)] = self.of_char[ord(SPACE)], ODD
        place = {s: n for n, s in enumerate(sorted({r[0] for r in self.rank.values()}))}
        found = [(self.id[p[:k]] * len(self.bytes) + self.id[p[k:]], i, place[cost])
                 for p, (cost, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        pairs, piece, cost = (np.array(x, np.int64) for x in zip(*(found or [(0, -1, len(place))])))
        # Each pair lies in the first free slot from its hash's; at least three of four slots are free.
        bits = (4 * len(pairs) - 1).bit_length()
        self.slot_shift = np.uint64(64 - bits)
        self.slot_pair = np.full(1 << bits, -1, np.int64)
        self.slot_piece, self.slot_cost = np.zeros((2, 1 << bits), np.int32)
        left, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = self.slot_pair[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            mine = left[free][first]
            self.slot_pair[at], self.slot_piece[at], self.slot_cost[at] = pairs[mine], piece[mine], cost[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + 1 - (self.slot_pair[slot[left]] < 0)) & ((1 << bits) - 1)
        self.no_offer = np.int32(len(place))

    @staticmethod
    def words(text: str) -> list[str]:
        """Words with the spaces before them; one space more in front."""
        words = text.split(" ")
        if "" in words:  # runs of spaces belong to the word after them
            joined, spaces = [], 1
            for w in words[:-1]:
                if w:
                    joined.append(" " * spaces + w)
                    spaces = 1
                else:
                    spaces += 1
            return [*joined, " " * spaces + words[-1]]
        return [" " + w for w in words]

    def keys(self, text: str, n: int) -> np.ndarray:
        """Keys of the n words of ``text``."""
        base = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed & 0xFFFFFFFF)
        x = (np.arange(n, dtype=np.uint64) + np.uint64(base)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)).astype(np.uint32)

    def skipping(self, nodes: list[Node], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words whose draws skip a merge of their node, the first such merge)."""
        # As in skips(), for the merges of all words at once when none is skipped.
        size = np.fromiter([n.n for n in nodes], np.int64, len(nodes))
        x = np.repeat(keys, size) + np.frombuffer(b"".join([n.raw for n in nodes]), np.uint32)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        hits = np.flatnonzero((x ^ (x >> np.uint32(13))) < np.uint64(self.threshold))
        end = np.cumsum(size)
        at = np.searchsorted(end, hits, side="right")          # words of the skipped merges
        at, where = np.unique(at, return_index=True)
        return at, hits[where] - (end - size)[at]

    def encode(self, text: str) -> bytes:
        """ids of one text; the trees of its words are remembered."""
        if not text:
            return b""
        words = self.words(text)
        known = self.known
        nodes = [known.get(w) or self.root(w) for w in words]
        out = [n.ids for n in nodes]
        keys = self.keys(text, len(words))
        if None in out:
            for n in [i for i, ids in enumerate(out) if ids is None]:
                out[n] = self.drawn(words[n], int(keys[n]))
        if self.threshold:
            at, first = self.skipping(nodes, keys)
            for n, i, key in zip(at.tolist(), first.tolist(), keys[at].tolist()):
                out[n] = self.walked(words[n], nodes[n], i, key)
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each ends), as :meth:`encode`: most words are rare, so no trees grow, and new words and
        occurrences that skip merges are merged together. Only the words' own segmentations are remembered."""
        by_text = [self.words(t) if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(by_text))
        of_text = np.cumsum([0, *map(len, by_text)])
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        keys = np.concatenate([self.keys(t, len(ws)) for t, ws in zip(texts, by_text) if ws])
        del by_text
        if len(self.number) >= self.LIMIT:
            self.number, self.own = {}, Segments(1).closed()
        new = [w for w in set(words).difference(self.number) if len(w) <= LONG]
        if new:
            self.number.update(zip(new, itertools.count(len(self.number) + 1)))
            self.own = self.own.followed(self.together(new))
        get, own = self.number.get, self.own
        at = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        seen = at > 0
        m = np.where(seen, own.n_draws[at], 0)
        x = np.repeat(keys, m) + own.draws[spread(own.draws_at[at], m)]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)   # as in skips()
        again = ~seen
        again[np.repeat(np.arange(len(words)), m)[(x ^ (x >> np.uint32(13))) < np.uint64(self.threshold)]] = True
        start, n, ids = own.ids_at[at], own.n_ids[at], own.ids
        again = np.flatnonzero(again)
        if len(again):
            drawn = self.together([words[i] for i in again.tolist()], keys[again])
            start[again], n[again] = drawn.ids_at + len(ids), drawn.n_ids
            ids = np.concatenate([ids, drawn.ids])
        return ids[spread(start, n)], np.append(0, np.cumsum(n))[of_text]

    def decode(self, ids) -> str:
        """The text: the pieces' bytes without the space in front."""
        table = self.bytes
        return b"".join([table[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def pieces(path: str, seed: int, dropout: float) -> Pieces:
    return Pieces(path, seed, dropout)


def encode(spark: SparkSession, docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row."""
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, seed, dropout)
        for b in batches:
            # Texts of so many bytes at a time; a larger one by itself.
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, side="right")))
                part, at = b.slice(at, end - at), end
                ids, ends = p.encode_all(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of encoded rows; null ids are the empty text."""
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, SEED, 0.0)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("ids")
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())]).tolist()
                out = [p.decode(flat[x:y]) for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    plain = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(spark: SparkSession, docs: DataFrame, model: str, **options) -> DataFrame:
    """(doc_id, ids, n_ids, decoded_sha256): the encoded documents, decoded again."""
    back = decode(spark, encode(spark, docs, model, **options), model)
    return back.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

"""Operator 10: SentencePiece encoding and decoding with seeded merge-dropout.

The piece vocabulary is a file of a public tokenizer (``model`` is its path;
it is read on the executors and never trained).  A text is encoded as a BPE
agenda: the candidate merges of a word lie in a heap by score, then position;
the best one is taken first.  Before a merge is done, a hash keyed by (seed,
document id, place of the word in the text, position, piece) decides whether this candidate is skipped; a
skipped candidate is gone, so the word comes out in smaller merge-type pieces.
``dropout=0`` gives the library's own segmentation.

The key makes segmentations repeatable: the same seed, id and text always give
the same pieces, whatever the partitioning or retries, and every occurrence of a
word is cut on its own.  A task remembers only what does not depend on the key: each
word's pieces when nothing is skipped, the candidates that this run meets, and the
pieces for sets of skipped candidates that occurred more than once in a block, where
these sets decide everything.  Which candidates the occurrences of a block skip is
worked out for all of them at once, in numpy, and so are the merges of what is not
remembered (``cut_all``): one merge of every word in each step, the pairs looked up in a
hash table.  Long words and words with letters outside the vocabulary run the agenda one
by one.  Beyond ``WORDS`` words and ``VARIANTS`` sets the memory is emptied, and it goes
with the task.

Decoding is lossless: spaces are the meta piece character, characters outside
the vocabulary are byte pieces, and a literal meta character in the text is
written as bytes as well.

Defined results: a null text is encoded as no pieces and decodes to null; an
empty text as no pieces and decodes to ''.  Repeated rows give repeated
results.  Other columns pass through untouched; ``ids`` replaces a column of
that name.  An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import P1, arrow_map, documents, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
WORDS, VARIANTS = 400_000, 200_000  # that a task remembers
CHECKS = 60                        # candidates of a remembered word; words with more run the agenda each time
SHORT = 24                         # symbols of a word up to which a plain list is faster than a heap
WIDTHS = (4, 6, 8, 11, 16, SHORT)  # words are cut together with others of about their length
NONE = 1 << 30                     # rank of a pair that is no candidate
META = "▁"
LITERAL = "\0" + META                       # a meta character of the text itself, not a space
MASK = (1 << 64) - 1


class Pieces:
    """Vocabulary, agenda encoder and decoder for one (dropout, seed)."""

    def __init__(self, model: str, dropout: float, seed: int):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.bytes_id = [0] * 256
        self.out: list[bytes] = []
        scores, letters = {}, set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.ids[piece], scores[piece] = i, sp.get_score(i)
                self.out.append(piece.replace(META, " ").encode())
                letters.update(piece)
                if META in piece.lstrip(META):
                    raise ValueError("a piece holds a space after a letter: words cannot be encoded apart")
        if letters & {"\n", "\0"}:
            raise ValueError("a piece holds a line end: lines cannot be encoded apart")
        places = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: places[x] for piece, x in scores.items()}       # equal scores share a rank
        self.bar, self.seed = int(dropout * 2.0**32), seed
        self._pairs(letters)
        self.forget()

    def _pairs(self, letters: set[str]) -> None:
        """Symbols by number, and a hash table of the pairs of symbols that merge."""
        names = [*self.ids, *sorted(letters - self.ids.keys())]
        self.symbol = {x: k for k, x in enumerate(names)}
        self.piece = np.array([self.ids.get(x, -1) for x in names], dtype=np.int32)
        self.letter = np.full(0x110000, -1, dtype=np.int64)                 # symbol of a code point; -1: its word is cut alone
        for x in names:
            if len(x) == 1 and x in self.ids and x != META:
                self.letter[ord(x)] = self.symbol[x]
        self.letter[ord(" ")] = self.symbol.get(META, -1)
        get = self.symbol.get
        found = [(a << 32 | b, r, get(x)) for x, r in self.rank.items() for k in range(1, len(x))
                 if (a := get(x[:k])) is not None and (b := get(x[k:])) is not None]
        pair, rank, whole = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        bits = max(8, int(len(pair)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slot_pair = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank, self.slot_whole = np.full(1 << bits, NONE, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        at, left = self._slot(pair), np.arange(len(pair))
        while len(left):
            free = left[self.slot_pair[at[left]] == -1]
            self.slot_pair[at[free]] = pair[free]                           # of several in one slot, one stays
            left = left[self.slot_pair[at[left]] != pair[left]]
            at[left] = at[left] + 1 & (1 << bits) - 1
        self.slot_rank[at], self.slot_whole[at] = rank, whole

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * P1 >> self.shift).astype(np.int64)

    def _candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and whole of each pair of symbols; ``NONE`` where it is no candidate or is
        skipped (without a key none is)."""
        pair = a << 32 | b
        at = self._slot(pair)
        got = self.slot_pair[at]
        more = np.flatnonzero((got != pair) & (got != -1))
        while len(more):
            at[more] = at[more] + 1 & len(self.slot_pair) - 1
            got = self.slot_pair[at[more]]
            more = more[(got != pair[more]) & (got != -1)]
        rank = self.slot_rank[at]                                           # NONE in an empty slot
        if key is not None:
            check = ((place << 20) + rank + 0x9E3779B9).astype(np.uint64)
            rank[(key * check >> np.uint64(31)) & np.uint64(0xFFFFFFFF) < np.uint64(self.bar)] = NONE
        return rank, self.slot_whole[at]

    def cut_all(self, sym: np.ndarray, size: np.ndarray, key: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``cut`` for many words: a row of ``sym`` holds the symbols of a
        word, -1 behind its ``size``.  Pieces of all, one word after the other, and their
        number.  Without keys nothing is skipped, and ``met`` gets rows and candidates."""
        n, width = sym.shape
        place = np.arange(width)
        rank, whole = np.full((n, width), NONE, dtype=np.int64), np.zeros((n, width), dtype=np.int64)

        def candidates(a: np.ndarray, b: np.ndarray, place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = self._candidates(a, b, place, None if key is None else key[rows])
            if met is not None:
                f = np.flatnonzero(got[0] < NONE)
                met.append((rows[f], (place[f] << 20) + got[0][f] + 0x9E3779B9))
            return got

        r, c = np.nonzero(place[:-1] + 1 < size[:, None])
        rank[r, c], whole[r, c] = candidates(sym[r, c], sym[r, c + 1], c, r)
        right, left = np.tile(place + 1, n), np.tile(place - 1, n)          # by row and place, flat
        sym, whole = sym.ravel(), whole.ravel()
        row = np.arange(n)
        while True:
            i = rank.argmin(axis=1)
            going = rank[np.arange(len(row)), i] < NONE
            if not going.all():
                row, rank, i = row[going], rank[going], i[going]
            if not len(row):
                break
            base, line, end = row * width, np.arange(len(row)), size[row]
            at = base + i
            j = right[at]
            sym[at] = whole[at]
            sym[base + j] = -1
            rank[line, j] = NONE
            k = right[base + j]
            right[at] = k
            h = left[at]
            behind, before = np.flatnonzero(k < end), np.flatnonzero(h >= 0)
            left[base[behind] + k[behind]] = i[behind]
            rank[line, i] = NONE
            x = np.concatenate([at[behind], base[before] + h[before]])
            y = np.concatenate([base[behind] + k[behind], at[before]])
            lines = np.concatenate([behind, before])
            p = np.concatenate([i[behind], h[before]])
            rank[lines, p], whole[x] = candidates(sym[x], sym[y], p, row[lines])
        sym = sym.reshape(n, width)
        return self.piece[sym[sym >= 0]], (sym >= 0).sum(axis=1)

    def forget(self) -> None:
        self.number: dict[str, int] = {}                    # word -> number
        self.unit: list[str] = []
        self.plain: list[bytes | None] = []                 # its pieces when nothing is skipped
        self.count = np.zeros(0, np.int64)                  # the candidates this run meets: their number, and all of them
        self.checks = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)                   # the same of the symbols; none of a word that is cut alone
        self.symbols = np.zeros(0, np.int64)
        self.variant: dict[int, bytes | None] = {}          # number << CHECKS | skipped bits -> pieces (None: more to decide)

    def encode(self, text: str, doc_id: int | None = None) -> bytes:
        """Piece ids as little-endian 32-bit integers."""
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        """``encode`` of each text, a block at a time."""
        if len(self.plain) > WORDS or len(self.variant) > VARIANTS:
            self.forget()
        # with the scheme's leading space; cut where no merge can cross
        words = [re.findall(r" *[^ \n]+|\n| +", " " + t) if t else [] for t in texts]
        units = [u for w in words for u in w]
        key = np.concatenate([np.zeros(0, np.uint64), *(self._keys(i, len(w)) for i, w in zip(doc_ids, words, strict=True))])
        self._learn([u for u in dict.fromkeys(units) if u not in self.number])
        word = np.array([self.number[u] for u in units], dtype=np.int64)
        plain = self.plain
        ids = [plain[n] for n in word.tolist()]
        at, known = self._skipping(word, key)
        for places, found in known:
            for i in places:
                ids[i] = found
        size = self.size[word[at]]
        for i in at[size == 0].tolist():
            ids[i] = self._bytes(self.cut(units[i], int(key[i])))
        for few, data, stop in self._cut(word, at, key):
            for i, a, b in zip(few.tolist(), [0, *stop], stop, strict=False):
                ids[i] = data[a:b]
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self._bytes(self.agenda(units[i], int(key[i])))
        out, a = [], 0
        for w in words:
            out.append(b"".join(ids[a:a + len(w)]))
            a += len(w)
        return out

    def _skipping(self, number: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[tuple[list[int], bytes]]]:
        """Occurrences that skip a candidate of their word: those to cut, and groups whose pieces are remembered."""
        start = np.cumsum(self.count) - self.count
        at = np.flatnonzero(self.count[number] > 0) if len(number) else np.zeros(0, np.int64)
        if not len(at):
            return at, []
        n = self.count[number[at]]
        stop = np.cumsum(n)
        bit = np.arange(stop[-1]) - np.repeat(stop - n, n)
        check = self.checks[np.repeat(start[number[at]], n) + bit]
        skipped = (np.repeat(key[at], n) * check >> np.uint64(31)) & np.uint64(0xFFFFFFFF) < np.uint64(self.bar)
        bits = np.add.reduceat(np.where(skipped, np.uint64(1) << bit.astype(np.uint64), np.uint64(0)), stop - n)
        at, bits = at[bits > 0], bits[bits > 0]
        if not len(at):
            return at, []
        word = number[at]
        order = np.lexsort((bits, word))
        at, bits, word = at[order], bits[order], word[order]
        new = np.ones(len(at), bool)
        new[1:] = (word[1:] != word[:-1]) | (bits[1:] != bits[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        open_, known = np.repeat(size == 1, size), []
        again = first[size > 1]
        for a, b, w, x in zip(again.tolist(), (again + size[size > 1]).tolist(), word[again].tolist(), bits[again].tolist(), strict=True):
            name = w << CHECKS | x
            found = self.variant.get(name)
            if found is None and name not in self.variant:
                found = self.variant[name] = self._variant(w, x, self.checks[start[w]:start[w] + self.count[w]].tolist())
            if found is None:
                open_[a:b] = True
            else:
                known.append((at[a:b].tolist(), found))
        return at[open_], known

    def _variant(self, word: int, bits: int, known: list[int]) -> bytes | None:
        """Pieces of a word that skips these of its known candidates; None where the
        run meets others."""
        met: list[int] = []
        ids = self.cut(self.unit[word], 1, met, {c for i, c in enumerate(known) if bits >> i & 1})
        return self._bytes(ids) if set(met) <= set(known) else None

    def _cut(self, word: np.ndarray, at: np.ndarray, key: np.ndarray | None, met: list | None = None) -> Iterator[tuple[np.ndarray, bytes, list[int]]]:
        """Occurrences ``at`` (of words not cut alone), their pieces and where each one's end."""
        start, size = np.cumsum(self.size) - self.size, self.size[word[at]]
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            few = at[(size > low) & (size <= width)]
            if not len(few):
                continue
            n, place = self.size[word[few]], np.arange(width)
            sym = self.symbols[np.minimum(start[word[few]][:, None] + place, len(self.symbols) - 1)]
            seen: list = []
            pieces, count = self.cut_all(np.where(place < n[:, None], sym, -1), n, None if key is None else key[few], None if met is None else seen)
            if met is not None:
                met += [(few[r], c) for r, c in seen]
            yield few, pieces.astype("<i4").tobytes(), (np.cumsum(count) * 4).tolist()

    def _learn(self, units: list[str]) -> None:
        """Remember new words."""
        if not units:
            return
        first = len(self.plain)
        self.number.update(zip(units, range(first, first + len(units)), strict=True))
        size = np.array([len(u) for u in units], dtype=np.int64)
        symbols = self.letter[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        together = (np.minimum.reduceat(symbols, np.cumsum(size) - size) >= 0) & (size <= SHORT)
        self.symbols = np.concatenate([self.symbols, symbols[np.repeat(together, size)]])
        self.size = np.concatenate([self.size, np.where(together, size, 0)])
        self.unit += units
        self.plain += [None] * len(units)
        number, met = np.arange(len(self.plain)), []
        for few, data, stop in self._cut(number, first + np.flatnonzero(together), None, met):
            for i, a, b in zip(few.tolist(), [0, *stop], stop, strict=False):
                self.plain[i] = data[a:b]
        for i in np.flatnonzero(~together).tolist():
            seen: list[int] = []
            ids = self._bytes(self.cut(units[i], 1, seen))
            seen = list(dict.fromkeys(seen)) if self.bar else []
            if len(seen) <= CHECKS:
                self.plain[first + i] = ids
                met.append((np.full(len(seen), first + i), np.array(seen, dtype=np.int64)))
        words, checks = (np.concatenate(x) if self.bar and met else np.zeros(0, np.int64) for x in (tuple(zip(*met, strict=True)) or ((), ())))
        order = np.lexsort((checks, words))
        words, checks = words[order], checks[order]
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (checks[1:] == checks[:-1])
        words, checks = words[~same], checks[~same]
        count = np.bincount(words - first, minlength=len(units))
        for i in np.flatnonzero(count > CHECKS).tolist():
            self.plain[first + i] = None
        few = count <= CHECKS
        self.checks = np.concatenate([self.checks, checks[few[words - first]].astype(np.uint64)])
        self.count = np.concatenate([self.count, np.where(few, count, 0)])

    def cut(self, unit: str, key: int, met: list[int] | None = None, skipped: frozenset[int] | set[int] = frozenset()) -> list[int]:
        """The same as ``agenda``, for short words on plain lists: the best pair is
        found by looking at all of them."""
        word = unit.lstrip(" ")
        sym = [META] * (len(unit) - len(word)) + [c if c != META else LITERAL for c in word]
        if len(sym) > SHORT:
            return self.agenda(unit, key, met, skipped)
        rank, bar, none = self.rank.get, self.bar, 1 << 60
        place = list(range(len(sym)))

        def candidate(i: int) -> int:
            """Rank of the pair that begins at ``i``; ``none`` where it is no candidate."""
            r = rank(sym[i] + sym[i + 1])
            if r is None:
                return none
            c = (place[i] << 20) + r + 0x9E3779B9
            if met is not None:
                met.append(c)
                return none if c in skipped else r
            return r if (key * c >> 31) & 0xFFFFFFFF >= bar else none

        ranks = [candidate(i) for i in range(len(sym) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            sym[i] += sym[i + 1]
            del sym[i + 1], place[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = candidate(i)
            if i:
                ranks[i - 1] = candidate(i - 1)
        return self._named(sym)

    def _named(self, sym: list[str | None]) -> list[int]:
        ids, get = [], self.ids.get
        for s in sym:
            if s is not None:
                i = get(s)
                if i is None:
                    ids += [self.bytes_id[b] for b in (META if s == LITERAL else s).encode("utf-8", "surrogatepass")]
                else:
                    ids.append(i)
        return ids

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<i4").tobytes()

    def keys(self, doc_id: int | None, n: int) -> list[int]:
        return self._keys(doc_id, n).tolist()

    def _keys(self, doc_id: int | None, n: int) -> np.ndarray:
        """An odd 64-bit key for each of the first ``n`` words of a document."""
        first = np.uint64(xxhash.xxh64_intdigest(str(doc_id).encode(), self.seed & MASK))
        return mix(first + np.arange(n, dtype=np.uint64) * P1) | np.uint64(1)

    def agenda(self, unit: str, key: int, met: list[int] | None = None, skipped: frozenset[int] = frozenset()) -> list[int]:
        """Pieces of a word.  With ``met`` the key decides nothing: the candidates
        ``skipped`` are, and all candidates are added to ``met``."""
        rank, bar = self.rank.get, self.bar if met is None else 0
        word = unit.lstrip(" ")
        sym = [META] * (len(unit) - len(word)) + [c if c != META else LITERAL for c in word]
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and left position; it is void when the pair there has another rank by now
        heap = []
        for i in range(n - 1):
            r = rank(sym[i] + sym[i + 1])
            if r is not None and (key * ((i << 20) + r + 0x9E3779B9) >> 31) & 0xFFFFFFFF >= bar:
                heap.append(r << 40 | i)
        pop, push = heapq.heappop, heapq.heappush
        if met is not None:
            met += [((e & 0xFFFFFFFFFF) << 20) + (e >> 40) + 0x9E3779B9 for e in heap]
            if skipped:
                heap = [e for e, c in zip(heap, met, strict=True) if c not in skipped]

            def push(heap: list[int], e: int) -> None:
                c = ((e & 0xFFFFFFFFFF) << 20) + (e >> 40) + 0x9E3779B9
                met.append(c)
                if c not in skipped:
                    heapq.heappush(heap, e)

        heapq.heapify(heap)

        while heap:
            e = pop(heap)
            i = e & 0xFFFFFFFFFF
            j = right[i]
            if sym[i] is None or j >= n:
                continue
            s = sym[i] + sym[j]
            if rank(s) != e >> 40:
                continue
            sym[i], sym[j] = s, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank(s + sym[k])
                if r is not None and (key * ((i << 20) + r + 0x9E3779B9) >> 31) & 0xFFFFFFFF >= bar:
                    push(heap, r << 40 | i)
            k = left[i]
            if k >= 0:
                r = rank(sym[k] + s)
                if r is not None and (key * ((k << 20) + r + 0x9E3779B9) >> 31) & 0xFFFFFFFF >= bar:
                    push(heap, r << 40 | k)
        return self._named(sym)

    def decode(self, ids: bytes) -> str:
        out = self.out
        return b"".join([out[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])[1:].decode("utf-8", "surrogatepass")


def _texts(batch: pa.RecordBatch, id_col: str, text_col: str):
    return zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True)


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL,
           dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``ids array<int>``: the pieces of each whole text."""
    keep = [f for f in docs.schema.fields if f.name != "ids"]
    schema = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model, dropout, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(t.as_py() or "", i) for i, t in _texts(part, id_col, text_col)]
                coded = pieces.encode_all([t for t, _ in rows], [i for _, i in rows])
                offsets = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), ids], names=[f.name for f in schema])

    return arrow_map(docs, run, schema)


def decode(coded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``coded`` with the text of each piece list (null ids: null)."""
    keep = [f for f in coded.schema.fields if f.name != out_col]
    schema = T.StructType([*keep, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model, 0.0, 0)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = [None if x.as_py() is None else pieces.decode(np.asarray(x.values, dtype="<i4").tobytes()) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(text, pa.string())], names=[f.name for f in schema])

    return arrow_map(coded, run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again: doc_id,
    n_bytes, n_pieces, ids_hash (xxhash64 of the id array), lossless."""
    coded = encode(documents(spark, sf_dir, "doc_id", "text"))
    back = decode(coded)
    text = F.coalesce("text", F.lit(""))
    return back.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == text).alias("lossless"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` and the pieces of each text; a text that did not
    come back from its pieces would end the run."""
    back = decode(encode(docs))
    same = F.coalesce("decoded", F.lit("")) == F.coalesce("text", F.lit(""))
    return back.withColumn("ids", F.when(same, F.col("ids")).otherwise(
        F.raise_error(F.lit("a text does not decode to itself")).cast("array<int>"))).drop("decoded")

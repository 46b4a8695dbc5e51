"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a model file span a lattice over the text (spaces written as
U+2581, one put in front). Forward Viterbi scores give the best way to reach
each position; a backward A* search from the end uses them as its heuristic,
which is exact, so the N best segmentations come out in order of score.

Pieces hold U+2581 only in their front run, so every path passes the position
before a run of them: the lattice falls apart there into independent segments
(also around characters that no piece holds). Segments are searched on their
own, results kept in a bounded cache, and the N best sums over the segments are
found by the same best-first search on the segments' losses. This is exact, and
no text is cut off however long it is.

Characters outside the vocabulary become their UTF-8 byte pieces. Raw U+2581 in
a text counts as such a character, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import arrow_map, held, table

MODEL = "piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # an uncovered character scores this much below the lowest piece
CACHE_ITEMS = 250_000  # per generation; two are kept
CACHE_CHARS = 48  # longer segments are searched each time


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Lattice:
    """N-best segmentation over ``pieces`` (piece -> (id, score)); ``byte_ids``
    are the ids of the 256 byte pieces. Encodings are little-endian int32 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], n_best: int = N_BEST):
        self.byte_ids, self.n = byte_ids, n_best
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.packed = {p: np.array([i], dtype="<i4").tobytes() for p, i in self.ids.items()}
        # trie: character -> (score or None, children)
        self.root: dict[str, tuple[float | None, dict]] = {}
        for p, (_, s) in pieces.items():
            node = self.root
            for c in p[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[p[-1]] = (s, node.get(p[-1], (None, {}))[1])
        self.longest = max(map(len, pieces), default=1)
        self.alphabet = set("".join(pieces))
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # id -> text; byte pieces above ASCII as the escapes that "surrogateescape" turns back into bytes
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.text_of |= {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in enumerate(byte_ids)}
        self._cache: dict[str, tuple[float, bytes, float]] = {}
        self._older: dict[str, tuple[float, bytes, float]] = {}
        self._alternatives: dict[str, list[tuple[float, bytes]]] = {}
        self._splitters: dict[frozenset, re.Pattern] = {}

    def _pack(self, pieces: list[str]) -> bytes:
        get = self.packed.get
        return b"".join([get(p) or self._pack_bytes(p) for p in pieces])

    def _forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """Per position: best and second-best score of the paths to it, and where
        the best path's last piece starts (of equal ones the longest piece)."""
        n, low, root = len(s), -np.inf, self.root
        best, second, back = [0.0] + [low] * n, [low] * (n + 1), [0] * (n + 1)
        for i in range(n):
            b1, b2, children = best[i], second[i], root
            for j in range(i, n):
                node = children.get(s[j])
                if node is None:
                    sc = None
                else:
                    sc, children = node
                j1 = j + 1
                if sc is None:
                    if j == i:
                        # a character without a piece is an arc of its own: every position is reached
                        sc = self.unknown
                    elif node is None:
                        break
                    else:
                        continue
                x, old = b1 + sc, best[j1]
                if x > old:
                    y = b2 + sc
                    second[j1] = y if y > old else old
                    best[j1], back[j1] = x, i
                elif x > second[j1]:
                    second[j1] = x
                if node is None:
                    break
        return best, second, back

    def _segment(self, s: str) -> tuple[float, bytes, float]:
        """(best score, encoding, loss of the second best) of an independent segment."""
        best, second, back = self._forward(s)
        j, cuts = len(s), []
        while j:
            cuts.append(s[back[j] : j])
            j = back[j]
        got = (best[-1], self._pack(cuts[::-1]), best[-1] - second[-1])
        return got

    def search(self, s: str) -> list[tuple[float, bytes]]:
        """The N best encodings of a segment by backward A*: a hypothesis reaches
        from a position to the end; its priority is its own score plus the forward
        score of the position, which is what the best completion scores. Ties go
        to the hypothesis further on its way, then to the one found first."""
        got = self._alternatives.get(s)
        if got is not None:
            return got
        best, _, _ = self._forward(s)
        get, longest = self.score.get, self.longest
        found: list[tuple[float, list[str]]] = []
        seq = 0
        heap: list[tuple] = [(-best[-1], len(s), seq, 0.0, None)]
        while heap and len(found) < self.n:
            _, j, _, done, path = heapq.heappop(heap)
            if j == 0:
                cuts: list[str] = []
                while path is not None:
                    piece, path = path
                    cuts.append(piece)
                found.append((done, cuts))
                continue
            for i in range(max(0, j - longest), j):
                sc = get(s[i:j])
                if sc is None:
                    if i < j - 1:
                        continue
                    sc = self.unknown
                seq += 1
                heapq.heappush(heap, (-(best[i] + sc + done), i, seq, done + sc, (s[i:j], path)))
        got = [(sc, self._pack(cuts)) for sc, cuts in found]
        if len(s) <= CACHE_CHARS:
            if len(self._alternatives) >= CACHE_ITEMS // 10:
                self._alternatives.clear()
            self._alternatives[s] = got
        return got

    def segments(self, text: str) -> list[str]:
        """The independent parts of the lattice of a non-empty text, in order."""
        odd = frozenset(set(text) - self.alphabet - {" "} | ({SPACE} & set(text)))
        s = text.replace(" ", SPACE) if SPACE not in odd else text
        if odd:
            rx = self._splitters.get(odd)
            if rx is None:
                if len(self._splitters) > 1000:
                    self._splitters.clear()
                rx = self._splitters[odd] = re.compile("([" + re.escape("".join(sorted(odd))) + "])")
            parts = rx.split(text)
            out: list[str] = []
            for k, p in enumerate(parts):
                if k % 2:
                    # an uncovered character: a part of its own, marked so that a raw U+2581 stays raw
                    out.append("\0" + p)
                else:
                    out.extend(self._words(p.replace(" ", SPACE), k == 0))
            return out
        return self._words(s, True)

    @staticmethod
    def _words(s: str, first: bool) -> list[str]:
        s = SPACE + s if first else s
        if not s:
            return []
        if SPACE + SPACE in s:
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", s)
        head, *rest = s.split(SPACE)
        return ([head] if head else []) + [SPACE + w for w in rest]

    def n_best(self, text: str | None) -> list[tuple[float, bytes]]:
        """Up to N (score, encoding), best first. Null or empty text: one empty encoding of score 0."""
        if not text:
            return [(0.0, b"")]
        parts = self.segments(text)
        miss = self._missing
        got = [self._cache.get(p) or miss(p) for p in parts]
        first = [g[1] for g in got]
        base = sum([g[0] for g in got])
        out = [(base, b"".join(first))]
        if self.n > 1:
            # only the N-1 segments with the least losses can differ from the best in one of the N best
            losses = [g[2] for g in got]
            near = [k for k in heapq.nsmallest(self.n - 1, range(len(parts)), key=losses.__getitem__) if losses[k] < np.inf]
            rows = []
            for k in near:
                alt = [a for a in self.search(parts[k]) if a[1] != first[k]][: self.n - 1]
                rows.append([(0.0, first[k])] + [(got[k][0] - a, b) for a, b in alt])
            for loss, pick in self._combine([[x for x, _ in r] for r in rows]):
                swap = first.copy()
                for k, r, c in zip(near, rows, pick, strict=True):
                    swap[k] = r[c][1]
                out.append((base - loss, b"".join(swap)))
        return out

    def _missing(self, part: str) -> tuple[float, bytes, float]:
        got = self._older.get(part)
        if got is None:
            got = (self.unknown, self._pack_bytes(part[1:]), np.inf) if part[0] == "\0" else self._segment(part)
        if len(part) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_ITEMS:
                self._older, self._cache = self._cache, {}
            self._cache[part] = got
        return got

    def _pack_bytes(self, c: str) -> bytes:
        return np.array([self.byte_ids[b] for b in c.encode("utf-8")], dtype="<i4").tobytes()

    def _combine(self, rows: list[list[float]]):
        """(loss, choice) of the N-1 cheapest choices other than all-best; a choice is one index per segment."""
        start = (0,) * len(rows)
        heap, seen, given = [(0.0, start)], {start}, 0
        while heap and given < self.n:
            loss, pick = heapq.heappop(heap)
            if given:
                yield loss, pick
            given += 1
            for x, own in enumerate(rows):
                if pick[x] + 1 < len(own):
                    nxt = pick[:x] + (pick[x] + 1,) + pick[x + 1 :]
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (loss - own[pick[x]] + own[nxt[x]], nxt))

    def decode(self, encoding: bytes) -> str:
        """The text of an encoding: pieces joined, byte pieces read as UTF-8, the leading space taken off."""
        s = "".join(map(self.text_of.__getitem__, np.frombuffer(encoding, dtype="<i4").tolist()))
        if not s.isascii():
            s = s.encode("utf-8", "surrogateescape").decode("utf-8")
        return s[1:]


def load(path: str | None = None, n_best: int = N_BEST) -> Lattice:
    """A lattice over the normal pieces of a model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model_path())
    size = sp.get_piece_size()
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(size) if i not in special}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    # a piece with U+2581 after another character would cross the cuts between segments
    crossing = [p for p in pieces if SPACE in p.lstrip(SPACE)]
    if crossing:
        raise ValueError(f"{len(crossing)} pieces reach across spaces; this model isn't split by white space")
    return Lattice(pieces, byte_ids, n_best)


def encode(docs: DataFrame, model_path: str | None = None, n_best: int = N_BEST, text_col: str = "text") -> DataFrame:
    """(row, ids, nbest_ids, scores, decoded): the input row as a struct, the best
    encoding of its whole text, all N (best first) with their scores, and the
    best one decoded. Null and empty texts have no ids, one score of 0, and
    decode to the empty text. Repeated rows and clashing columns stay as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(text_col).alias("_text"))

    def build():
        lat = held(("pieces", model_path, n_best), lambda: load(model_path, n_best))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            best = [lat.n_best(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([np.frombuffer(x[0][1], dtype="<i4") for x in best], pa.list_(pa.int32())),
                    pa.array([[np.frombuffer(i, dtype="<i4").tolist() for _, i in x] for x in best], pa.list_(pa.list_(pa.int32()))),
                    pa.array([[s for s, _ in x] for x in best], pa.list_(pa.float64())),
                    pa.array([lat.decode(x[0][1]) for x in best], pa.string()),
                ],
                names=["row", "ids", "nbest_ids", "scores", "decoded"],
            )

        return work

    kind = d.schema["row"].dataType.simpleString()
    return arrow_map(d, build, f"row {kind}, ids array<int>, nbest_ids array<array<int>>, scores array<double>, decoded string")


def summarize(docs: DataFrame, model_path: str | None = None, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, nbest_crc32, scores, round_trip): digests of
    :func:`encode`, made in the task so that the ids needn't leave it. crc32 is
    over little-endian signed 32-bit ids; round_trip says that decoding the
    best encoding gives the text (null: the empty text) back."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def build():
        lat = held(("pieces", model_path, n_best), lambda: load(model_path, n_best))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                best = lat.n_best(t)
                crc = [zlib.crc32(i) for _, i in best]
                ok = lat.decode(best[0][1]) == (t or "")
                for c, v in zip(cols, (len(best[0][1]) // 4, crc[0], crc, [s for s, _ in best], ok), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.bool_())
            return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_pieces", "ids_crc32", "nbest_crc32", "scores", "round_trip"])

        return work

    return arrow_map(d, build, "doc_id long, n_pieces long, ids_crc32 long, nbest_crc32 array<long>, scores array<double>, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(table(spark, sf_dir, "documents"))

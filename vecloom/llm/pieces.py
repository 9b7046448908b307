"""SentencePiece segmentation as a max-plus scan over chunks, for BPE and unigram models.

A segmentation is a path of pieces. A unigram path scores the sum of its pieces. A BPE result is
the one path on which every two successive pieces are what BPE itself makes of their joined
text, so its path scores 0 and every other minus infinity. Both are matrix products in the
max-plus semiring: a chunk of text becomes a matrix from the pieces that may lie across its
left edge to those across its right edge; the products are associative, and once the piece at
each edge is known, every chunk is traced back alone.

Where no piece of the vocabulary joins the two characters beside a position, no piece and no
merge crosses it: such an edge has one state. Between these edges text falls into short segments,
whose paths are kept in memos of bounded size.
"""

from __future__ import annotations

import re

import numpy as np

NONE = -np.inf
SPACE = "▁"
EDGE = (0, 0)  # the state of a position that nothing crosses
Piece = tuple[int, int]  # start and end, or offsets from an edge


class Model:
    """The pieces and scores of a model; kind: "bpe" or "unigram"."""

    def __init__(self, pieces: list[tuple[str, float]], kind: str, byte_ids: dict[int, int], unknown: int = 0, prefix: bool = True, limit: int = 300_000):
        self.pieces = {p: (i, s) for i, (p, s) in enumerate(pieces) if p}
        self.kind, self.byte_ids, self.unknown, self.prefix, self.limit = kind, byte_ids, unknown, prefix, limit
        self.longest = max(map(len, self.pieces))
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.worst = min((s for _, s in self.pieces.values()), default=0.0) - 10
        self.plain_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] or "\n" in p[:-1] for p in self.pieces)
        self.scores = {p: s for p, (_, s) in self.pieces.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, tuple[float, bytes]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs = self._runs()

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are served")
        own = [(p.piece if p.type in (1, 4) else "", p.score) for p in proto.pieces]
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        assert sentencepiece  # the library's own message format is read here
        return cls(own, "bpe" if proto.trainer_spec.model_type == 2 else "unigram", byte_ids, next(i for i, p in enumerate(proto.pieces) if p.type == 2), norm.add_dummy_prefix)

    # the text

    def normal(self, text: str) -> str:
        return ((SPACE if self.prefix and text else "") + text).replace(" ", SPACE)

    def plain(self, ids, strip: bool = True) -> bytes:
        """Decoding: the UTF-8 text of ids; strip: without the space that the model puts first."""
        if not hasattr(self, "_bytes"):
            self._bytes = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()} | {self.unknown: " ⁇ ".encode()}
        out = b"".join(map(self._bytes.__getitem__, ids))
        return out[1:] if strip and self.prefix and out[:1] == b" " else out

    # pieces and their weights

    def ids_of(self, s: str) -> list[int]:
        if s in self.pieces:
            return [self.pieces[s][0]]
        return [self.byte_ids[b] for b in s.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def merge(self, s: str) -> list[str]:
        """Plain BPE of a short string: the best-scored adjacent pair first, the leftmost of equals."""
        return self._merged(list(s), -1) or []

    def fit(self, before: str, piece: str) -> bool:
        """Whether BPE makes just these two pieces of their joined text: it stops at the first merge across."""
        return len(self._merged([*before, *piece], len(before) - 1) or ()) == 2

    def _merged(self, parts: list[str], across: int) -> list[str] | None:
        """parts merged to the end; None once the pair of number `across` would be merged."""
        get = self.scores.get
        score = [get(x + y, NONE) for x, y in zip(parts, parts[1:], strict=False)]
        while score and (best := max(score)) > NONE:
            at = score.index(best)
            if at == across:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            if at:
                score[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(score):
                score[at] = get(parts[at] + parts[at + 1], NONE)
            across -= at < across
        return parts

    def _runs(self) -> re.Pattern | None:
        """The pattern of runs of letters or of others, each with the space before it, if no piece joins the two kinds.

        Characters that would join them count as others. None: the vocabulary doesn't fall apart like this.
        """
        letter = re.compile(r"[^\W\d_]")
        others: set[str] = set()
        kind = lambda c: c not in others and letter.match(c) is not None
        for _ in range(4):
            crossing = {c for pair in self.joined if SPACE not in pair and kind(pair[0]) != kind(pair[1]) for c in pair if kind(c)}
            if not crossing:
                out = "".join(map(re.escape, sorted(others)))
                return re.compile(rf" ?[^\W\d_{out}]+| ?(?:[\W\d_{out}](?<! ))+| ")
            others |= crossing
            if len(others) > 16:
                break
        return None

    def weight(self, before: str | None, piece: str) -> float:
        """The score of entering a piece after another (None: after an edge)."""
        if self.kind == "unigram":
            return self.pieces[piece][1] if piece in self.pieces else self.worst
        key = (before or "", piece)
        if key not in self.fits:
            if len(self.fits) > 4 * self.limit:
                self.fits.clear()
            self.fits[key] = self.fit(before, piece) if before else len(self.merge(piece)) == 1
        return 0.0 if self.fits[key] else NONE

    def crossed(self, s: str, p: int) -> bool:
        """Whether a piece may cross position p, inside s."""
        return 0 < p < len(s) and s[p - 1 : p + 1] in self.joined

    def at(self, s: str, i: int) -> list[int]:
        """The ends of the pieces that start at i; a lone character always is one."""
        out = [i + 1]
        for e in range(i + 2, min(len(s), i + self.longest) + 1):
            if s[i : e - 1] not in self.starts:
                break
            if s[i:e] in self.pieces:
                out.append(e)
        return out

    def edge_states(self, s: str, p: int) -> list[Piece]:
        """The pieces that hold the character before p, as offsets from p."""
        if not self.crossed(s, p):
            return [EDGE]
        return [(i - p, e - p) for i in range(max(0, p - self.longest), p) for e in self.at(s, i) if e >= p]

    def paths(self, s: str, begin: Piece | None, a: int, b: int) -> dict[Piece, tuple[float, Piece | None]]:
        """Best score and predecessor of every piece entered from `begin` (None: an edge at a) that starts before b."""
        best: dict[Piece, tuple[float, Piece | None]] = {}
        ending: dict[int, list[Piece | None]] = {}
        first = a
        if begin is None:
            ending[a] = [None]
        else:
            ending[begin[1]] = [begin]
            first = begin[1]
        for i in range(first, b):
            if i not in ending:
                continue
            for e in self.at(s, i):
                top, back = NONE, None
                for q in ending[i]:
                    w = self.weight(None if q is None else s[q[0] : q[1]], s[i:e])
                    if w > NONE and (score := w + (0.0 if q is None or q == begin else best[q][0])) > top:
                        top, back = score, q
                if top > NONE:
                    best[i, e] = (top, back)
                    ending.setdefault(e, []).append((i, e))
        return best

    def trace(self, best: dict[Piece, tuple[float, Piece | None]], last: Piece, begin: Piece | None) -> list[Piece]:
        out = []
        at: Piece | None = last
        while at is not None and at != begin:
            out.append(at)
            at = best[at][1]
        return out[::-1]

    def segment(self, s: str) -> tuple[float, bytes]:
        """Score and ids of a whole string with edges at both ends."""
        if s not in self.segments:
            best = self.paths(s, None, 0, len(s))
            score, last = max((v[0], k) for k, v in best.items() if k[1] == len(s))
            ids = [i for x, y in self.trace(best, last, None) for i in self.ids_of(s[x:y])]
            if len(s) > 64:
                return score, np.array(ids, "<u4").tobytes()
            if len(self.segments) >= self.limit:
                self.segments.clear()
            self.segments[s] = (score, np.array(ids, "<u4").tobytes())
        return self.segments[s]

    def cuts(self, s: str, a: int, b: int) -> list[int]:
        """The positions from a to b, inclusive, that nothing crosses; those of one segment's middle left out."""
        joined = self.joined
        return [p for p in range(a, b + 1) if not 0 < p < len(s) or s[p - 1 : p + 1] not in joined]

    # whole texts

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers: the scan with one chunk.

        Where no piece goes on into a space, and none joins letters with others, every run of either kind
        with the space before it has edges. Runs' ids are kept in two generations of bounded size.
        """
        if not self.plain_words or self.runs is None or not self.prefix:
            return [self._by_cuts(self.normal(x)) for x in texts]
        cut = [self.runs.findall(" " + x) if x and "  " not in x and SPACE not in x and x[0] != " " else None for x in texts]
        every: set[str] = set()
        for words in cut:
            every.update(words or ())
        new = every.difference(self.words)
        if known := new.intersection(self.older):
            self.words.update((w, self.older[w]) for w in known)
            new -= known
        if len(self.words) + len(new) > self.limit // 2:
            self.older, self.words = self.words, {}
            self.words.update((w, self.older[w]) for w in every.difference(new))
        short = [w for w in new if len(w) < 64]
        long = {w for w in new if len(w) >= 64}
        self.words.update(zip(short, self._many([w.replace(" ", SPACE) for w in short]), strict=True))
        self.words.update((w, self._by_cuts(w.replace(" ", SPACE))) for w in long)
        find = self.words.__getitem__
        out = [self._by_cuts(self.normal(x)) if words is None else b"".join(map(find, words)) for x, words in zip(texts, cut, strict=True)]
        for w in long:
            del self.words[w]
        return out

    def _by_cuts(self, s: str) -> bytes:
        cut = self.cuts(s, 0, len(s)) if s else []
        return b"".join([self.segment(s[x:y])[1] for x, y in zip(cut[:-1], cut[1:], strict=True)])

    def _many(self, segments: list[str]) -> list[bytes]:
        """The ids of many strings with edges at both ends."""
        if self.kind != "bpe":
            return [self.segment(s)[1] if s else b"" for s in segments]
        if not hasattr(self, "_tables"):
            self._tables = _Tables(self)
        out: list[bytes] = []
        for i in range(0, len(segments), 20_000):
            out += self._tables.solve(segments[i : i + 20_000])
        return out

    # chunks: s is a window on the normal text with `longest` characters around [a, b)

    def _ends(self, s: str, a: int, b: int) -> tuple[int | None, int | None]:
        """The first and last positions of a .. b that nothing crosses."""
        first = next((p for p in range(a, b + 1) if not self.crossed(s, p)), None)
        if first is None:
            return None, None
        return first, next(p for p in range(b, a - 1, -1) if not self.crossed(s, p))

    def _row(self, s: str, begin: Piece | None, a: int, b: int, outs: list[Piece]) -> list[float]:
        best = self.paths(s, begin, a, b)
        if outs == [EDGE]:
            if begin is not None and begin[1] == b or begin is None and a == b:
                return [0.0]
            return [max((v[0] for k, v in best.items() if k[1] == b), default=NONE)]
        out = [best[k][0] if (k := (b + x, b + y)) in best else NONE for x, y in outs]
        return [0.0 if begin == (b + x, b + y) else v for v, (x, y) in zip(out, outs, strict=True)]

    def transfer(self, s: str, a: int, b: int) -> np.ndarray:
        """The chunk's matrix, from edge_states(s, a) to edge_states(s, b)."""
        ins, outs = self.edge_states(s, a), self.edge_states(s, b)
        begins = [None if x == EDGE else (a + x[0], a + x[1]) for x in ins]
        h1, h2 = self._ends(s, a, b)
        if h1 is None:
            return np.array([self._row(s, q, a, b, outs) for q in begins])
        left = np.array([self._row(s, q, a, h1, [EDGE]) for q in begins])
        right = np.array([self._row(s, None, h2, b, outs)])
        middle = 0.0
        if self.kind == "unigram":
            cut = self.cuts(s, h1, h2)
            middle = sum(self.segment(s[x:y])[0] for x, y in zip(cut[:-1], cut[1:], strict=True))
        return left + middle + right

    def back(self, s: str, a: int, b: int, entry: Piece, leave: Piece) -> bytes:
        """The ids of the pieces that start in the chunk, given the pieces on its edges."""
        begin = None if entry == EDGE else (a + entry[0], a + entry[1])
        h1, h2 = self._ends(s, a, b)

        def run(q: Piece | None, x: int, y: int, to: Piece) -> bytes:
            if q is not None and (q == (y + to[0], y + to[1]) if to != EDGE else q[1] == y) or q is None and x == y and to == EDGE:
                return b""
            best = self.paths(s, q, x, y)
            last = (y + to[0], y + to[1]) if to != EDGE else max((v[0], k) for k, v in best.items() if k[1] == y)[1]
            return np.array([i for c, d in self.trace(best, last, q) for i in self.ids_of(s[c:d])], "<u4").tobytes()

        if h1 is None:
            return run(begin, a, b, leave)
        cut = self.cuts(s, h1, h2)
        return run(begin, a, h1, EDGE) + b"".join([self.segment(s[x:y])[1] for x, y in zip(cut[:-1], cut[1:], strict=True)]) + (run(None, h2, b, leave) if leave != EDGE else b"")


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairing neighbours: the product is associative."""
    if len(matrices) < 2:
        return list(matrices)
    halves = scan([times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(halves[i // 2] if i % 2 else times(halves[i // 2 - 1], matrices[i]))
    return out


def edges(matrices: list[np.ndarray]) -> list[int]:
    """The state, by number, at every edge of the best path: one more than there are matrices."""
    ahead = scan(matrices)
    out = [int(ahead[-1][0].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int((ahead[k - 1][0] + matrices[k][:, out[-1]]).argmax()))
    return [0, *out[::-1]]


class _Tables:
    """The search for BPE paths of many strings at once, by arrays.

    A BPE prefix has one result, so at each position at most one piece that ends there lies on a
    possible path: the one that fits the piece before it. Positions are taken in order, all
    strings together. Pairs that fit or don't are kept in a table of fixed size.
    """

    MIX = np.uint64(0x9E3779B97F4A7C15)
    PIECE_BITS, PAIR_BITS = 19, 21

    def __init__(self, model: Model):
        self.model = model
        self.text = {i: p for p, (i, _) in model.pieces.items()}
        self.first_unknown = max(self.text) + 1
        self.unknown: dict[int, int] = {}
        known = sorted(set(model.pieces) | model.starts)
        h = np.zeros(len(known), np.uint64)
        for k, p in enumerate(known):
            x = 0
            for c in p:
                x = (x * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            h[k] = x
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        # linear probing with a few steps: every piece and every beginning of one has a place
        self.keys = np.zeros(1 << self.PIECE_BITS, np.uint64)
        self.ids = np.full(1 << self.PIECE_BITS, -1, np.int64)
        self.steps = 0
        for p, x in zip(known, h.tolist(), strict=True):
            at, step = (x * int(self.MIX) & 0xFFFFFFFFFFFFFFFF) >> 64 - self.PIECE_BITS, 0
            while self.keys[at]:
                at, step = (at + 1) & (1 << self.PIECE_BITS) - 1, step + 1
            self.keys[at], self.steps = x, max(self.steps, step)
            self.ids[at] = model.pieces[p][0] if p in model.pieces else -1
        self.pairs = np.full(1 << self.PAIR_BITS, -1, np.int64)
        self.good = np.zeros(1 << self.PAIR_BITS, bool)

    def _lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (h * self.MIX) >> np.uint64(64 - self.PIECE_BITS)
        found, ids = np.zeros(len(h), bool), np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for _ in range(self.steps + 1):
            key = self.keys[at[todo]]
            hit = todo[key == h[todo]]
            found[hit], ids[hit] = True, self.ids[at[hit]]
            todo = todo[(key != h[todo]) & (key != 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64((1 << self.PIECE_BITS) - 1)
        return found, ids

    def _string(self, i: int) -> str:
        return self.text[i] if i in self.text else chr(i - self.first_unknown)

    def _fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece fits the one before it; -1: an edge."""
        key = (before + 1) << 32 | piece
        at = (key.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.PAIR_BITS)
        out = self.good[at]
        miss = np.flatnonzero(self.pairs[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            made = np.zeros(len(new), bool)
            for k, pair in enumerate(new.tolist()):
                p, q = (pair >> 32) - 1, self._string(pair & 0xFFFFFFFF)
                made[k] = len(self.model.merge(q)) == 1 if p < 0 else self.model.fit(self._string(p), q)
            out[miss] = made[back]
            put = (new.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.PAIR_BITS)
            self.pairs[put], self.good[put] = new, made
            won = self.pairs[put] == new
            self.good[put[won]] = made[won]
        return out

    def solve(self, segments: list[str]) -> list[bytes]:
        if not segments:
            return []
        sizes = np.array([len(s) for s in segments])
        flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        stop = np.repeat(np.cumsum(sizes), sizes)
        which = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h, alive = np.zeros(len(flat), np.uint64), np.arange(len(flat))
        begins, ends, ids = [], [], []
        for n in range(1, self.model.longest + 1):
            alive = alive[alive + n <= stop[alive]]
            h[alive] = h[alive] * np.uint64(0x100000001B3) + flat[alive + n - 1] + np.uint64(1)
            found, own = self._lookup(h[alive])
            if n == 1:
                lone = own < 0
                own[lone] = self.first_unknown + flat[alive[lone]].astype(np.int64)
            real = own >= 0
            begins.append(alive[real]), ends.append(place[alive[real]] + n), ids.append(own[real])
            alive = alive[found]
            if not len(alive):
                break
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(ids)
        order = np.argsort(end, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        # position p of string w has the number p + w, so that each string has one more than characters
        last = np.full(len(flat) + len(sizes), -2, np.int64)
        length = np.zeros(len(flat) + len(sizes), np.int64)
        last[np.cumsum(sizes) - sizes + np.arange(len(sizes))] = -1
        bounds = np.searchsorted(end, np.arange(1, int(sizes.max()) + 2))
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.arange(a, z)
            before = last[begin[own] + which[begin[own]]]
            own, before = own[before > -2], before[before > -2]
            own = own[self._fit(before, piece[own])]
            to = begin[own] - place[begin[own]] + end[own] + which[begin[own]]
            last[to], length[to] = piece[own], end[own] - place[begin[own]]
        at = np.cumsum(sizes) + np.arange(len(sizes))
        rows = np.arange(len(sizes))
        got_row, got_piece = [], []
        while len(at):
            p = last[at]
            go = p >= 0
            at, rows, p = at[go], rows[go], p[go]
            got_row.append(rows), got_piece.append(p)
            at = at - length[at]
        row, piece = np.concatenate(got_row), np.concatenate(got_piece)
        back = np.argsort(row[::-1], kind="stable")
        row, piece = row[::-1][back], piece[::-1][back]
        cut = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
        raw = piece.astype("<u4").tobytes()
        strange = set(row[piece >= self.first_unknown].tolist())
        out = [raw[4 * a : 4 * z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        for r in strange:
            own = [i for x in piece[cut[r] : cut[r + 1]].tolist() for i in self.model.ids_of(self._string(x))]
            out[r] = np.array(own, "<u4").tobytes()
        return out

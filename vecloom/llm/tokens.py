"""Token ids of whole texts by a tokenizer file of the `tokenizers` library, piece by piece."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

from .common import turn_to, worker_tables

WORD = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SPACE, LETTER, DIGIT, OTHER, RARE = range(5)


def _classes() -> np.ndarray:
    """The class of each byte of lower-cased text; RARE ones send a text the slow way."""
    out = np.full(256, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[ord("a") : ord("z") + 1] = LETTER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[128:] = RARE
    out[0xC3] = LETTER
    out[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = LETTER  # after C3: the small letters from U+00DF on
    out[[0x27, *range(28, 32)]] = RARE  # an apostrophe may begin a contraction; 1C to 1F are no white space for the library
    return out


class PieceIds:
    """Ids of texts for a lower-casing BPE whose tokens stay within the pieces of its split pattern.

    Such a text's ids are those of its pieces in turn. Texts of ASCII and small Latin letters
    are cut into pieces by arrays: a piece is named by two 64-bit hashes, and a table of fixed
    size leads to its ids. Pieces the table lacks, and all of any other text, go one by one
    through a memo of at most `limit` short pieces to the library. A text with a special
    token's string goes to the library whole. So memory is bounded whatever the texts.
    """

    SLOTS, BLOCK, POOL = 19, 1 << 19, 1 << 21

    def __init__(self, path: str, limit: int = 200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        form = json.loads(self.whole.to_str())
        split, byte_level = form["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in form["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or byte_level["type"] != "ByteLevel":
            raise ValueError("this tokenizer doesn't normalize and split as is assumed here")
        self.special = [t["content"].encode() for t in form["added_tokens"]]
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.bare = Tokenizer.from_str(json.dumps(form | {"added_tokens": [], "normalizer": None, "pre_tokenizer": byte_level}))
        self.memo: dict[str, np.ndarray] = {}
        self.classes = _classes()
        random = np.random.default_rng(1)
        self.tables = [random.integers(0, 1 << 64, 256, np.uint64) for _ in range(2)]
        self.powers, self.inverses = [], []
        for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            for base, to in ((k, self.powers), (pow(k, -1, 1 << 64), self.inverses)):
                steps = np.full(self.BLOCK, base, np.uint64)
                steps[0] = 1
                to.append(np.multiply.accumulate(steps))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((2, 1 << self.SLOTS), np.uint64)
        self.at = np.zeros(1 << self.SLOTS, np.int64)
        self.size = np.zeros(1 << self.SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece, normalized already."""
        find = self.memo.get
        new = list({p for p in pieces if find(p) is None})
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            find, new = self.memo.get, list(set(pieces))
        known: dict[str, np.ndarray] = {}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            known.update(zip(part, (np.array(x.ids, np.uint32) for x in self.bare.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        self.memo.update((p, x) for p, x in known.items() if len(p) <= self.longest)
        return [x if (x := find(p)) is not None else known[p] for p in pieces]

    def _normal(self, text: bytes) -> bytes:
        if text.isascii():
            return text.lower()
        s = text.decode("utf-8", "replace")
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        return s.replace("Σ", "σ").lower().encode()  # the library lower-cases sigma without context

    def packed(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        batch, room = [], self.BLOCK
        for i, text in enumerate(texts):
            if b"<|" in text and any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                continue
            normal = self._normal(text)
            data = np.frombuffer(normal, np.uint8)
            kinds = self.classes[data]
            if len(data) + 1 > self.BLOCK or (kinds == RARE).any() or not self._latin(data):
                own = self._ids(self.split.findall(normal.decode()))
                out[i] = np.concatenate(own) if own else np.zeros(0, np.uint32)
                continue
            if len(data) + 1 > room:
                self._many(batch, out)
                batch, room = [], self.BLOCK
            batch.append((i, data, kinds))
            room -= len(data) + 1
        self._many(batch, out)
        return out

    @staticmethod
    def _latin(data: np.ndarray) -> bool:
        """Whether every byte above 127 belongs to a pair of C3 and a small letter's second byte."""
        high = data > 127
        lead = data == 0xC3
        return bool((high[1:] == (lead[:-1] | lead[1:])).all()) and not (len(data) and (lead[-1] or (high[0] and not lead[0]) or (lead[1:] & lead[:-1]).any()))

    def _many(self, batch: list[tuple], out: list) -> None:
        if not batch:
            return
        if self.used > self.POOL:
            self._clear()
        gap = np.full(1, 32, np.uint8)
        data = np.concatenate([x for _, d, _ in batch for x in (d, gap)])
        kinds = np.concatenate([x for _, _, k in batch for x in (k, np.full(1, SPACE, np.uint8))])
        ends = np.cumsum([len(d) + 1 for _, d, _ in batch])
        begins = np.empty(len(kinds), bool)
        begins[0] = kinds[0] != SPACE
        begins[1:] = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)) & (kinds[1:] != SPACE)
        stops = np.empty(len(kinds), bool)
        stops[:-1] = ((kinds[1:] != kinds[:-1]) | (kinds[:-1] == DIGIT)) & (kinds[:-1] != SPACE)
        stops[-1] = False
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        h = []
        for table, power, inverse in zip(self.tables, self.powers, self.inverses, strict=True):
            total = np.cumsum(table[data] * power[: len(data)])
            low = np.where(first > 0, total[first - 1], np.uint64(0))
            h.append((total[last - 1] - low) * inverse[first] + (last - first).astype(np.uint64))
        slot = ((h[0] ^ (h[0] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero((self.keys[0][slot] != h[0]) | (self.keys[1][slot] != h[1]) | (size == 0))
        if len(miss):
            _, one, back = np.unique(h[0][miss], return_index=True, return_inverse=True)
            pick = miss[one]
            text = data.tobytes()
            ids = self._ids([text[a:z].decode() for a, z in zip(first[pick].tolist(), last[pick].tolist(), strict=True)])
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            base = self.used
            starts = base + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            self._append(flat)
            at[miss], size[miss] = starts[back], sizes[back]
            put = slot[pick]
            self.keys[0][put], self.keys[1][put], self.at[put], self.size[put] = h[0][pick], h[1][pick], starts, sizes
            won = self.keys[0][put] == h[0][pick]  # of pieces that share a slot one stays
            self.keys[1][put[won]], self.at[put[won]], self.size[put[won]] = h[1][pick][won], starts[won], sizes[won]
        run = np.cumsum(size)
        flat = self.pool[np.repeat(at - (run - size), size) + np.arange(run[-1] if len(run) else 0)]
        cut = np.searchsorted(first, ends)
        edges = np.concatenate([[0], np.where(cut > 0, run[cut - 1] if len(run) else 0, 0)])
        for (i, _, _), a, z in zip(batch, edges[:-1], edges[1:], strict=True):
            out[i] = flat[a:z]

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


def piece_ids(path: str) -> PieceIds:
    """One for each Python process: a reused worker keeps its tables until it turns to another operator."""
    turn_to("tokens")
    kept = worker_tables("tokens")
    if path not in kept:
        kept[path] = PieceIds(path)
    return kept[path]

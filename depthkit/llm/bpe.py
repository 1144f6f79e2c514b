"""BPE encoding and decoding: speculate and verify (op 8).

Greedy longest match proposes the tokens of every distinct piece at once.  A proposal is the
BPE encoding exactly if each of its tokens encodes to itself and no adjacent pair would have
merged across its border earlier than BPE formed the two tokens; that test runs over all
adjacent pairs of all pieces in a few vector steps.  Pieces with a failing pair undergo exact
merging, lowest rank first and leftmost on ties.

Pieces are cut as the vocabulary's pre-tokenizer does it.  The vector cutter knows ASCII and
Latin-1 text; texts with other characters, control characters or the strings of special tokens
go, as whole texts, through the tokenizers library, so results are the same for any text.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from depthkit.llm.base import prefix_sums, ragged, raw_hash, mix, ship, span_hashes, text_slices

NONE = np.int64(1) << 40
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Longest piece for the vector path; longer ones are merged exactly, one by one.
LONG = 64
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: Distinct pieces that a Python worker remembers (about 32 MB of tables); it starts anew when they are full.
REMEMBER = 1 << 19

_CLASS = np.array([LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c))
                   else SPACE if regex.match(r"\s", chr(c)) else OTHER for c in range(256)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c
                   for c in range(256)], np.uint8)
_ODD = np.array([c < 32 and c not in (9, 10, 13) or c == 127 or c >= 0xC4 for c in range(256)])


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Lookup:
    """64-bit keys to values >= 0 by open addressing; most lookups are one gather."""

    def __init__(self, room: int):
        size = 1 << (int(np.ceil(np.log2(max(room, 256)))) + 2)
        self.last, self.probes = size - 1, 0
        self.key, self.value = np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> Lookup:
        """Put distinct new keys in."""
        todo, at, probes = np.arange(len(keys)), (keys & np.uint64(self.last)).astype(np.int64), 0
        while len(todo):
            probes += 1
            free = self.value[at] < 0
            t, a = todo[free][::-1], at[free][::-1]
            self.value[a], self.key[a] = values[t], keys[t]
            out = np.ones(len(todo), bool)
            out[free] = self.key[at[free]] != keys[todo[free]]
            todo, at = todo[out], (at[out] + 1) & self.last
        self.probes = max(self.probes, probes)
        return self

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where there is none."""
        at = (keys & np.uint64(self.last)).astype(np.int64)
        got = self.value[at]
        out = np.where(self.key[at] == keys, got, -1)
        open_ = np.flatnonzero((got >= 0) & (out < 0))
        at = at[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (at + 1) & self.last
            got, hit = self.value[at], self.key[at] == keys[open_]
            out[open_[hit]] = got[hit]
            go = (got >= 0) & ~hit
            open_, at = open_[go], at[go]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, as arrays."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.remember = remember
        model = spec["model"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        pre = spec["pre_tokenizer"]
        self.by_words = pre["type"] == "Sequence"
        self.joined = spec["decoder"] is not None
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = dict(model["vocab"])
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.text = [b""] * size
        for s, i in vocab.items():
            self.text[i] = s.encode()
        for s, i in self.specials.items():
            self.text[i] = s.encode()
        back = {s: b for b, s in byte_symbols().items()}
        self.raw = [b""] * size
        final = np.zeros(size, bool)
        for s, i in vocab.items():
            if self.suffix and s.endswith(self.suffix):
                final[i], s = True, s[:-len(self.suffix)]
            self.raw[i] = bytes(back[c] for c in s)
        for s, i in self.specials.items():
            self.raw[i] = s.encode()
        self.size = size
        #: rank of the merge that makes a token (-1: none), and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b[:]]
            pairs[i * size + j] = (r, k)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.merges = pairs
        self.pairs = Lookup(len(pairs)).add(mix(np.fromiter(pairs, np.uint64, len(pairs))), np.array([v[0] for v in pairs.values()]))
        self.made = np.array([v[1] for v in pairs.values()], np.int64)
        #: base symbols of a byte, inside and at the end of a piece
        self.base = np.zeros((2, 256), np.int64)
        for b, s in byte_symbols().items():
            self.base[0, b] = vocab[s]
            self.base[1, b] = vocab[s + self.suffix]
        # tokens that encode to themselves: their own merge is the last, and nothing crosses before it
        made = np.flatnonzero(self.rank >= 0)
        ok = np.ones(size, bool)
        ok[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        ok[list(self.specials.values())] = False
        ids = np.array([i for i in vocab.values() if ok[i] and self.raw[i]], np.int64)
        flat = np.frombuffer(b"".join(self.raw[i] for i in ids), np.uint8)
        lens = np.array([len(self.raw[i]) for i in ids], np.int64)
        ends = np.cumsum(lens)
        key = self._key(raw_hash(prefix_sums(flat), ends - lens, ends), lens, final[ids])
        self.tokens = Lookup(len(key)).add(key, ids)
        self.longest = int(lens.max())
        self.library = None
        self.forget()

    def forget(self) -> None:
        self.seen = None  # the old tables go before new ones are made
        self.seen, self.seen_n, self.flat_n = Lookup(self.remember), 0, 0
        self.memo_flat = np.zeros(1 << 16, np.int32)
        self.memo_start, self.memo_len = np.zeros(self.remember, np.int64), np.zeros(self.remember, np.int32)

    @staticmethod
    def _key(h: np.ndarray, lens: np.ndarray, final: np.ndarray) -> np.ndarray:
        tag = lens.astype(np.uint64) * np.uint64(2) + final.astype(np.uint64)
        return mix(h ^ (tag * np.uint64(0xC2B2AE3D27D4EB4F)))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pairs.find(mix((a * self.size + b).astype(np.uint64)))
        return np.where(got < 0, NONE, got)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE keeps the border between neighbours a and b, for many pairs.

        Undo the later of the two merges again and again; at each step a merge across the
        border must come after what was undone on its side (ties go to the left)."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NONE, np.int64) if limit is None else limit.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.rank_of(x, y) < limit[live]
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of pieces of at most LONG bytes, one merge of every piece a step:
        lowest rank first, leftmost on ties.  Flat ids and their number per piece."""
        n, lens = len(starts), ends - starts
        wide = int(lens.max()) + 1
        at = np.arange(wide)
        inside = at < lens[:, None]
        ids = self.base[0][data[np.minimum(starts[:, None] + at, len(data) - 1)]]
        rows = np.arange(n)
        ids[rows, lens - 1] = self.base[1][data[ends - 1]]
        ids[~inside] = 0
        rank = np.full((n, wide), NONE, np.int64)
        i, j = np.nonzero(inside[:, 1:])
        rank[i, j] = self.rank_of(ids[i, j], ids[i, j + 1])
        count = lens.copy()
        live = rows
        while len(live):
            r, x = rank[live], ids[live]
            k = r.argmin(1)
            m = np.arange(len(live))
            low = r[m, k]
            go = low < NONE
            live, r, x, k, low = live[go], r[go], x[go], k[go], low[go]
            if not len(live):
                break
            m = np.arange(len(live))
            src = at + (at > k[:, None])
            src[:, -1] = wide - 1
            x, r = np.take_along_axis(x, src, 1), np.take_along_axis(r, src, 1)
            x[m, k] = self.made[low]
            count[live] -= 1
            c = count[live]
            r[m, np.minimum(c, wide - 1)] = NONE
            r[m, c - 1] = NONE
            h = np.flatnonzero(k + 1 < c)
            r[h, k[h]] = self.rank_of(x[h, k[h]], x[h, k[h] + 1])
            h = np.flatnonzero(k > 0)
            r[h, k[h] - 1] = self.rank_of(x[h, k[h] - 1], x[h, k[h]])
            ids[live], rank[live] = x, r
        return ids[at < count[:, None]], count

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for one piece of any length."""
        import heapq

        ids = [int(self.base[0, c]) for c in piece[:-1]] + [int(self.base[1, piece[-1]])]
        n, size, merges = len(ids), self.size, self.merges
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (got := merges.get(ids[i] * size + ids[j])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, x, y, new = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or ids[i] != x or ids[nxt[i]] != y:
                continue
            j = nxt[i]
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [ids[i] for i in range(n) if alive[i]]

    def speculate(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for many pieces: flat ids and their number per piece."""
        sums = prefix_sums(data)
        n = len(starts)
        pos, steps, live = starts.copy(), [], np.arange(n)
        while len(live):
            p, e = pos[live], ends[live]
            got = np.full(len(live), -1, np.int64)
            took = np.zeros(len(live), np.int64)
            left = np.arange(len(live))
            for size in range(min(self.longest, int((e - p).max())), 0, -1):
                fit = left[(e[left] - p[left]) >= size]
                if not len(fit):
                    continue
                s = p[fit]
                h = raw_hash(sums, s, s + size)
                final = (s + size == e[fit]) if self.suffix else np.zeros(len(fit), bool)
                ids = self.tokens.find(self._key(h, np.full(len(fit), size), final))
                hit = ids >= 0
                if hit.any():
                    got[fit[hit]], took[fit[hit]] = ids[hit], size
                    left = left[got[left] < 0]
                    if not len(left):
                        break
            steps.append((live, got))
            pos[live] += np.maximum(took, 1)
            live = live[pos[live] < ends[live]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        piece = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=n)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of pieces: speculate, verify, merge what fails."""
        n = len(starts)
        short = np.flatnonzero(ends - starts <= LONG)
        flat, counts_s = self.speculate(data, starts[short], ends[short])
        counts = np.zeros(n, np.int64)
        counts[short] = counts_s
        owner = np.repeat(short, counts_s)
        bad = np.zeros(n, bool)
        bad[owner[flat < 0]] = True
        same = owner[1:] == owner[:-1]
        a, b = flat[:-1][same], flat[1:][same]
        known = (a >= 0) & (b >= 0)
        key, back = np.unique(a[known] * self.size + b[known], return_inverse=True)
        fine = self.compatible(key // self.size, key % self.size)[back]
        bad[owner[1:][same][known][~fine]] = True
        bad[ends - starts > LONG] = True
        redo = np.flatnonzero(bad)
        if not len(redo):
            return flat, counts
        parts, sizes = [], np.zeros(n, np.int64)
        size = ends - starts
        for low, high in ((0, 8), (8, 16), (16, LONG)):
            some = redo[(size[redo] > low) & (size[redo] <= high)]
            for k in range(0, len(some), 1 << 15):
                part = some[k:k + (1 << 15)]
                ids, sizes[part] = self.merge_many(data, starts[part], ends[part])
                parts.append((part, ids))
        for i in redo[size[redo] > LONG]:
            ids = self.merge_long(data[starts[i]:ends[i]].tobytes())
            sizes[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int64)))
        counts[redo] = sizes[redo]
        out = np.empty(int(counts.sum()), np.int64)
        at = np.cumsum(counts) - counts
        keep = np.flatnonzero(~bad)
        out[ragged(at[keep], counts[keep])] = flat[~bad[owner]]
        for part, ids in parts:
            out[ragged(at[part], counts[part])] = ids
        return out, counts

    def encode_text(self, text: str) -> list[int]:
        """A whole text through the tokenizers library."""
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    # ---- texts to pieces ---------------------------------------------------------------
    def pieces(self, data: np.ndarray, offs: np.ndarray):
        """Cut rows into pieces: (bytes, starts, ends, row of each piece, rows for the library)."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return data, z, z, z, z
        cls = _CLASS[data]
        odd = _ODD[data]
        lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        if len(lead):
            cp = ((data[lead] & 3) << 6) | (data[lead + 1] & 63)
            cls[lead] = cls[lead + 1] = _CLASS[cp]
            odd[lead] |= cp <= 0xA0
        if self.by_words:
            low = np.where(data < 128, _LOWER[data & 127], data)
            if len(lead):
                low[lead + 1] = 0x80 | (_LOWER[cp] & 63)
                odd[lead] |= (_LOWER[cp] >> 6) != (cp >> 6)
            data = low
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if n > 1 else np.zeros(0, np.int64)
        slow = np.unique(np.searchsorted(offs, np.concatenate([np.flatnonzero(odd), special]), "right") - 1)
        for r in slow:
            cls[offs[r]:offs[r + 1]] = SPACE
        flag = np.ones(n, bool)
        flag[1:] = cls[1:] != cls[:-1]
        flag[offs[:-1][offs[:-1] < n]] = True
        if self.by_words:
            flag |= (cls == NUMBER) & ((data & 0xC0) != 0x80)
        s = np.flatnonzero(flag)
        e = np.append(s[1:], n)
        c = cls[s]
        row = np.searchsorted(offs, s, "right") - 1
        # contractions: a lone apostrophe takes the first letters of the run that follows
        q = np.flatnonzero((c == OTHER) & (e - s == 1) & (data[s] == 39))
        q = q[q + 1 < len(s)]
        q = q[(c[q + 1] == LETTER) & (row[q + 1] == row[q])]
        if not self.by_words and len(q):
            q = q[~((q > 0) & (c[q - 1] == SPACE) & (row[q - 1] == row[q]) & (data[np.maximum(s[q] - 1, 0)] == 32))]
        if len(q):
            f = data[s[q + 1]]
            g = np.where(e[q + 1] - s[q + 1] > 1, data[np.minimum(s[q + 1] + 1, n - 1)], 0)
            take = np.where(np.isin(f, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            for x, y in (b"re", b"ve", b"ll"):
                take = np.where((f == x) & (g == y), 2, take)
            e[q] += take
            s[q + 1] += take
        if self.by_words:
            keep = (c != SPACE) & (e > s)
            return data, s[keep], e[keep], row[keep], slow
        # white space: its last character goes to the next run if it is a plain space
        if len(slow):
            keep = ~np.isin(row, slow)
            s, e, c, row = s[keep], e[keep], c[keep], row[keep]
        sp = np.flatnonzero(c == SPACE)
        inner = sp[(sp + 1 < len(s))]
        inner = inner[row[inner + 1] == row[inner]]
        plain = data[e[inner] - 1] == 32
        s[inner[plain] + 1] -= 1
        e[inner] -= 1
        alone = inner[~plain]
        s2, e2, r2 = np.concatenate([s, e[alone]]), np.concatenate([e, e[alone] + 1]), np.concatenate([row, row[alone]])
        keep = e2 > s2
        order = np.argsort(s2[keep], kind="stable")
        return data, s2[keep][order], e2[keep][order], r2[keep][order], slow

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Memo row of each piece, encoding the pieces that are new."""
        keys = span_hashes(data, starts, ends)
        rows = self.seen.find(keys)
        miss = np.flatnonzero(rows < 0)
        if not len(miss):
            return rows
        order = np.argsort(keys[miss])
        key = keys[miss][order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        at = miss[order[head]]
        if self.seen_n + len(at) > self.remember:
            self.forget()
            return self.rows_of(data, starts, ends)
        lens = ends[at] - starts[at]
        own = data[ragged(starts[at], lens)]
        stop = np.cumsum(lens)
        ids, counts = self.encode_pieces(own, stop - lens, stop)
        new = self.seen_n + np.arange(len(at))
        self.seen.add(key[head], new)
        rows[miss[order]] = new[np.cumsum(head) - 1]
        self.memo_start[new], self.memo_len[new] = self.flat_n + np.cumsum(counts) - counts, counts
        while self.flat_n + len(ids) > len(self.memo_flat):
            self.memo_flat = np.concatenate([self.memo_flat, np.zeros_like(self.memo_flat)])
        self.memo_flat[self.flat_n:self.flat_n + len(ids)] = ids
        self.flat_n += len(ids)
        self.seen_n += len(at)
        return rows

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows of a slice, and the number of ids of each row."""
        rows = len(offs) - 1
        low, s, e, row, slow = self.pieces(data, offs)
        lens, parts = np.zeros(len(s), np.int64), [np.zeros(0, np.int32)]
        for k in range(0, len(s), self.remember >> 1):  # more than one only for a very long text
            some = slice(k, k + (self.remember >> 1))
            at = s[some][0]
            memo = self.rows_of(low[at:e[some][-1]], s[some] - at, e[some] - at)
            lens[some] = self.memo_len[memo]
            parts.append(self.memo_flat[ragged(self.memo_start[memo], lens[some])])
        flat = np.concatenate(parts)
        counts = np.bincount(row, lens, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        if not len(slow):
            return flat, counts
        raw = data.tobytes()
        own = {int(r): self.encode_text(raw[offs[r]:offs[r + 1]].decode()) for r in slow}
        ends = np.cumsum(counts)
        parts = [np.array(own[r], np.int32) if r in own else flat[ends[r] - counts[r]:ends[r]] for r in range(rows)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids as the library's decode gives it, special tokens included."""
        if not self.joined:
            return b" ".join([self.text[i] for i in ids])
        raw = b"".join([self.raw[i] for i in ids])
        return raw.decode("utf-8", "replace").encode()


_loaded: dict[str, Vocabulary] = {}
_sizes: dict[str, int] = {}


def vocabulary_size(path: str) -> int:
    """Ids of a vocabulary, without its tables: all that the driver needs."""
    if path not in _sizes:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _sizes[path] = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    return _sizes[path]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: int = 1, v: Vocabulary | None = None, limit: int = SLICE):
    """Yield (batch, first row, end row, flat ids, ids per row) for each slice of each batch."""
    v = v or vocabulary(path)
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch.column(text), limit):
            flat, counts = v.encode_slice(data, offs)
            yield batch, lo, hi, flat, counts


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row: BPE ids of its whole text, null texts as empty.

    Rows are independent, so repeated rows and null ids just pass through."""
    ship(df.sparkSession)

    def run(batches):
        for batch, lo, hi, flat, counts in encode_batches(batches, path):
            offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from an array of ids; null arrays give an empty text."""
    ship(df.sparkSession)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again, in one pass over the rows.

    Returns doc_id, n_tokens, ids_sha256 (ids in decimal, joined by one space), decoded_sha256.
    A null or empty text has no ids; both digests are then those of the empty string."""
    ship(df.sparkSession)

    def run(batches):
        v = vocabulary(path)
        number = [str(i).encode() for i in range(v.size)]
        sha = hashlib.sha256
        for batch, lo, hi, flat, counts in encode_batches(batches, path):
            ends = np.cumsum(counts).tolist()
            ids = flat.tolist()
            one, two, at = [], [], 0
            for end in ends:
                own = ids[at:end]
                at = end
                one.append(sha(b" ".join([number[i] for i in own])).hexdigest())
                two.append(sha(v.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())

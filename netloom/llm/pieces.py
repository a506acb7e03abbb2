"""SentencePiece encoding and decoding by batched Viterbi (operator 5).

Texts are cut into words at their spaces (no piece holds a space behind another character), the distinct words of a
batch are encoded together, and their ids are gathered back into texts. All words advance one character at a time,
longest words first, so that words of equal length end together. For each end position the substrings ending there are hashed by
prefix sums and probe the sorted piece keys; the best admissible piece of each word is the maximum over the substrings'
scores and is stored as the back-pointer.

For a unigram model the score is the sum of piece scores. A BPE model has no such sum: there a piece is
admissible behind the best piece of the shorter prefix only if BPE would leave exactly these two neighbours (checked on the
two pieces' merge histories), which singles out one path, and this path is the sequence that BPE's merges give.
Characters without a piece become byte pieces. Words with runs of spaces, whose pieces all have the same score, are merged pair by pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from netloom.llm.common import fresh, small_batches, widened
from netloom.llm.words import chunks, mix, span_hashes

#: Where the driver's box keeps the public vocabulary; a parameter everywhere.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NONE = np.int32(-1)
#: Distinct words that a worker keeps with their ids between batches.
KEPT_WORDS = 400_000
#: Characters from which a word of a BPE model is merged pair by pair.
LONG = 2_000


class Keys:
    """Sorted 64-bit keys with values; a table over the leading bits bounds each probe."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.int32)
        bits = max(8, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.start).max()) if len(keys) else 0
        self.keys = np.append(self.keys, np.zeros(self.deep + 1, np.uint64))
        self.values = np.append(self.values, np.full(self.deep + 1, NONE, np.int32))

    def get(self, wanted: np.ndarray) -> np.ndarray:
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        found = np.where((self.keys[at] == wanted) & (at < end), self.values[at], NONE)
        left = np.flatnonzero((found < 0) & (at + 1 < end))
        step = 1
        while len(left):
            here = at[left] + step
            hit = self.keys[here] == wanted[left]
            found[left[hit]] = self.values[here[hit]]
            step += 1
            left = left[~hit & (at[left] + step < end[left])]
        return found


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), 5)


class Encoder:
    """Tables of one model; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unk: int, kind: str) -> None:
        self.pieces, self.kind, self.unk = pieces, kind, unk
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values() and p}
        self.scores = np.asarray(scores, np.float64)
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = np.array([byte_ids.get(b, unk) for b in range(256)], np.int32)
        self.floor = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0  # an unknown character's score
        self.split_blanks = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.split_lines = not any("\n" in p for p in self.ids)
        # priority of merges: better scores first
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        self.rank = np.full(len(pieces) + 1, 1 << 30, np.int64)
        self.rank[order] = np.arange(len(order))
        counts: dict[float, list[int]] = {}
        for i in order:
            counts.setdefault(scores[i], []).append(i)
        tied = [pieces[i] for same in counts.values() if len(same) > 1 for i in same]
        self.direct_all = kind == "bpe" and any(set(p) != {BLANK} for p in tied)
        self.tied_blanks = kind == "bpe" and bool(tied)
        kept = dict(self.ids)
        if kind == "bpe":
            self._histories()
            kept = {p: i for p, i in self.ids.items() if self.sound[i]}
        texts, at = list(kept), np.zeros(len(kept) + 1, np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        np.cumsum([len(t) for t in texts], out=at[1:])
        with np.errstate(over="ignore"):
            self.keys = Keys(_hash_points(codes, at[:-1], at[1:]), np.array(list(kept.values()), np.int32))
        self.lengths = np.zeros(self.longest + 1, bool)
        self.lengths[[len(t) for t in texts]] = True
        self.memory: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def _histories(self) -> None:
        """For each piece its last merge (left, right); and the pairs that merge."""
        n = len(self.pieces)
        self.left, self.right = np.full(n, NONE, np.int32), np.full(n, NONE, np.int32)
        self.sound = np.zeros(n, bool)
        pairs: list[tuple[int, int, int]] = []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, i))
            parts = self.merged(piece, last=True)
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.sound[i] = True
            elif len(piece) == 1:
                self.sound[i] = True
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        with np.errstate(over="ignore"):
            self.merges = Keys(_pair_key(a, b), c)

    def merged(self, word: str, last: bool = False) -> list[int]:
        """BPE pair by pair, the best score first and the leftmost of equal ones. ``last``: the two parts of the final merge if one piece comes out, else nothing of use."""
        parts: list[str] = list(word)
        n, ids = len(parts), self.ids
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                both = parts[k] + parts[after[k]]
                i = ids.get(both)
                if i is not None:
                    heapq.heappush(heap, (-float(self.scores[i]), k, both, len(parts[k])))

        for k in range(n - 1):
            offer(k)
        left, before = n, []
        while heap:
            _, k, both, cut = heapq.heappop(heap)
            if len(parts[k]) != cut or after[k] >= n or parts[k] + parts[after[k]] != both:
                continue  # one of them has merged meanwhile
            j = after[k]
            if left == 2:
                before = [parts[k], parts[j]]
            parts[k], parts[j], after[k] = both, "", after[j]
            if after[k] < n:
                prior[after[k]] = k
            left -= 1
            offer(k)
            offer(prior[k])
        if last:
            return [ids.get(p, -1) for p in before] if left == 1 else []
        out: list[int] = []
        for p in parts:
            if p:
                out += [ids[p]] if p in ids else self._bytes(p)
        return out

    def _bytes(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode())].tolist() if self.byte_ids.max() != self.unk or self.unk < 0 else [self.unk]

    def stable(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE on the two pieces' text gives back just these two pieces.

        Undoes the merges of both, latest first. The pieces that then face each other across the border stood side by side
        when the merge undone last was due; if they merge before it, BPE would have crossed the border.
        """
        ok = np.ones(len(first), bool)
        todo = np.arange(len(first))
        x, y = first.astype(np.int64), second.astype(np.int64)
        due = np.full(len(first), 1 << 30, np.int64)
        late = np.ones(len(first), bool)  # a right-hand merge of equal rank comes after one across the border
        while len(todo):
            joint = self.merges.get(_pair_key(x, y))
            rank = self.rank[joint]
            cross = (joint >= 0) & ((rank < due) | (late & (rank == due)))
            ok[todo[cross]] = False
            rx = np.where(self.left[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            more = ~cross & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[more], x[more], y[more], rx[more], ry[more]
            of_y = ry >= rx
            due, late = np.where(of_y, ry, rx), of_y
            x, y = np.where(of_y, x, self.right[x]), np.where(of_y, self.left[y], y)
        return ok

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words."""
        lengths = np.array([len(t) for t in texts], np.int64)
        direct = np.array([self.direct_all or (self.tied_blanks and BLANK * 2 in t) for t in texts], bool)
        if self.kind == "bpe":  # a word without end would take a round for each character
            direct |= lengths > LONG
        order = np.argsort(-np.where(direct, 0, lengths), kind="stable")
        many = int((~direct & (lengths > 0)).sum())
        chosen = order[:many]
        out: list[np.ndarray] = []
        if many:
            out.append(self._advance([texts[i] for i in chosen], lengths[chosen]))
        ids, rows = (out[0][:, 1].astype(np.int32), chosen[out[0][:, 0]]) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        extra = [(i, self.merged(texts[i])) for i in order[many:] if lengths[i]]
        if extra:
            ids = np.concatenate([ids, np.concatenate([np.array(e, np.int32) for _, e in extra])])
            rows = np.concatenate([rows, np.repeat([i for i, _ in extra], [len(e) for _, e in extra])])
        sort = np.argsort(rows, kind="stable")
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(rows, minlength=len(texts)), out=bounds[1:])
        return ids[sort], bounds

    def _advance(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """(word, id) rows in order, for words sorted by falling length."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        start = np.zeros(len(texts), np.int64)
        np.cumsum(lengths[:-1], out=start[1:])
        total, inverse = _prefix_sums(codes)
        n, deep = len(texts), int(lengths[0])
        back = np.zeros(len(codes), np.int32)  # length of the best piece ending at each character; 0: an unknown character
        best = np.full(len(codes), NONE, np.int32)
        score = np.zeros(len(codes) if self.kind == "unigram" else 0, np.float64)
        alive = np.searchsorted(-lengths, -np.arange(1, deep + 1), "right")
        for end in range(1, deep + 1):
            m = int(alive[end - 1])
            at = start[:m] + end - 1
            if self.kind == "unigram":
                top = np.full(m, -np.inf)
                for size in range(1, min(end, self.longest) + 1):
                    if not self.lengths[size] and size > 1:
                        continue
                    lo = at + 1 - size
                    found = self.keys.get(mix((total[at + 1] - total[lo]) * inverse[lo], 9))
                    value = np.where(found >= 0, self.scores[found], self.floor if size == 1 else -np.inf)
                    value = value + (score[lo - 1] if end > size else 0.0)
                    better = value > top
                    top = np.where(better, value, top)
                    back[at[better]] = np.where(found[better] >= 0, size, 0)
                    best[at[better]] = found[better]
                score[at] = top
                continue
            open_ = np.arange(m)
            for size in range(min(end, self.longest), 0, -1):
                if not self.lengths[size] or not len(open_):
                    continue
                here = at[open_]
                lo = here + 1 - size
                found = self.keys.get(mix((total[here + 1] - total[lo]) * inverse[lo], 9))
                some = np.flatnonzero(found >= 0)
                if end > size and len(some):
                    last = best[lo[some] - 1]
                    known = np.flatnonzero(last >= 0)  # behind an unknown character any piece may stand
                    ok = np.ones(len(some), bool)
                    ok[known] = self.stable(last[known], found[some[known]])
                    some = some[ok]
                best[here[some]], back[here[some]] = found[some], size
                keep = np.ones(len(open_), bool)
                keep[some] = False
                open_ = open_[keep]
        # trace back all words at once
        rows, position, found_ids, found_rows = np.arange(n), start + lengths - 1, [], []
        while len(rows):
            found_ids.append(best[position].astype(np.int64))
            found_rows.append((rows, position))
            position = position - np.maximum(back[position], 1)
            stay = position >= start[rows]
            rows, position = rows[stay], position[stay]
        ids = np.concatenate(found_ids)
        rows = np.concatenate([r for r, _ in found_rows])
        place = np.concatenate([p for _, p in found_rows])
        order = np.argsort(place, kind="stable")
        ids, rows, place = ids[order], rows[order], place[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = [self._bytes(chr(codes[p])) for p in place[odd]]
            counts = np.ones(len(ids), np.int64)
            counts[odd] = [len(s) for s in spelled]
            rows, wide = np.repeat(rows, counts), np.repeat(ids, counts)
            wide[wide < 0] = np.concatenate([np.array(s, np.int64) for s in spelled])
            ids = wide
        return np.stack([rows, ids], axis=1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of each text of a column; nulls count as empty."""
        flat, counts = [], []
        with np.errstate(over="ignore"):
            for _, _, data, at in chunks(column):
                ids, bounds = self._texts(data, at)
                flat.append(ids)
                counts.append(np.diff(bounds))
        out = np.zeros(len(column) + 1, np.int64)
        np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64), out=out[1:])
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), out

    def _texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Every text gets the space that the model puts in front; a line feed is a word of its own, and
        # a word is any spaces and what follows them.
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        body = np.insert(data, at[full], 32)
        first = at[full] + np.arange(len(full))
        if self.split_blanks:
            blank = body == 32
            head = blank.copy()
            head[1:] &= ~blank[:-1]
            if self.split_lines:
                line = body == 10
                head |= line
                head[1:] |= line[:-1]
            head[first] = True
        else:
            head = np.zeros(len(body), bool)
            head[first] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(body))
        hashes = span_hashes(body, starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids, bounds, slot = self._remembered(unique, body, starts[where], ends[where])
        begin, size = bounds[slot][inverse], (bounds[slot + 1] - bounds[slot])[inverse]
        total = np.zeros(len(inverse) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        gather = np.repeat(begin - total[:-1], size) + np.arange(total[-1])
        ends_of = np.searchsorted(starts, np.append(first[1:], len(body)))
        out = np.zeros(len(at), np.int64)
        out[full + 1] = np.diff(np.append(0, total[ends_of]))
        return ids[gather], np.cumsum(out)

    def _remembered(self, unique: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, bounds, ids = self.memory[0], self.memory[1], self.memory[2]
        place = np.searchsorted(known, unique)
        new = np.ones(len(unique), bool) if not len(known) else known[np.minimum(place, len(known) - 1)] != unique
        if new.any():
            if len(known) + int(new.sum()) > KEPT_WORDS:  # start afresh with this batch's words
                known, bounds, ids, new = known[:0], np.zeros(1, np.int64), ids[:0], np.ones(len(unique), bool)
            raw = body.tobytes()
            texts = [raw[s:e].decode().replace(" ", BLANK) for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            more, more_bounds = self.words(texts)
            keys = np.concatenate([known, unique[new]])
            order = np.argsort(keys, kind="stable")
            sizes = np.concatenate([np.diff(bounds), np.diff(more_bounds)])
            begins = np.concatenate([bounds[:-1], more_bounds[:-1] + len(ids)])
            both = np.concatenate([ids, more])
            sizes, begins = sizes[order], begins[order]
            bounds = np.zeros(len(keys) + 1, np.int64)
            np.cumsum(sizes, out=bounds[1:])
            ids = both[np.repeat(begins - bounds[:-1], sizes) + np.arange(bounds[-1])]
            known = keys[order]
            self.memory = (known, bounds, ids)
        return ids, bounds, np.searchsorted(known, unique)


def _prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from netloom.llm.words import powers

    power, inverse = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64), 33) * power[: len(codes)], out=total[1:])
    return total, inverse


def _hash_points(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, inverse = _prefix_sums(codes)
    return mix((total[ends] - total[starts]) * inverse[starts], 9)


@lru_cache(maxsize=2)
def load(model: str) -> Encoder:
    """Reads a model file with the public library; only tables are taken from it, no encoding."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    scores = [sp.get_score(i) for i in range(n)]
    kind = "unigram" if any(s != int(s) for s in scores[:1000]) else "bpe"
    return Encoder(pieces, scores, special, byte_ids, sp.unk_id(), kind)


@lru_cache(maxsize=2)
def _spellings(model: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every piece, flat, and their bounds."""
    enc = load(model)
    back = {int(i): bytes([b]) for b, i in enumerate(enc.byte_ids) if i != enc.unk}
    texts = [back.get(i, p.replace(BLANK, " ").encode() if p in enc.ids else b"") for i, p in enumerate(enc.pieces)]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def decode(ids: np.ndarray, bounds: np.ndarray, model: str) -> pa.Array:
    """Texts of id sequences, without the space in front; byte pieces are joined as UTF-8."""
    data, at = _spellings(model)
    size = (at[1:] - at[:-1])[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    body = data[np.repeat(at[:-1][ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
    ends = total[bounds]
    texts = [body[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())


def encoded(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, check: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids`` array<int>, ``n_pieces`` long and ``round_trip`` boolean (the ids decode to the text).

    Null and empty texts give an empty array and a true round trip. Columns of these names in ``docs`` are replaced.
    ``model`` must be readable on every executor. Long texts are encoded whole; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    docs = fresh(docs, "piece_ids", "n_pieces", "round_trip")
    names = docs.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(model)
        for batch in batches:
            text = batch.column(where)
            ids, bounds = enc.encode(text)
            if check:
                same = pc.equal(decode(ids, bounds, model), text.fill_null("")).fill_null(False)
            else:
                same = pa.nulls(len(batch), pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(np.diff(bounds)), same], [*names, "piece_ids", "n_pieces", "round_trip"])

    return docs.mapInArrow(run, widened(docs, piece_ids="array<int>", n_pieces="long", round_trip="boolean"))


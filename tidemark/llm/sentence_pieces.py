"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is escaped (spaces become U+2581, one is put before it) and cut into units where no piece can lie across: before a run of
U+2581 that follows something else, and between characters that stand side by side in no piece. Distinct units of one length
advance together, a column at a time: hashes of the substrings that end there, from prefix sums, probe the sorted keys of the
pieces; the best candidate of each unit is a maximum over the lengths, and its length is the back pointer.

Unigram models score a candidate by its piece's score and the best of what stands before. In models of byte-pair type the sum of
scores doesn't decide: the segmentation is the one that merging gives. It is also the one of which all neighbours are stable
(merging the two pieces' characters gives these two pieces again) and each prefix has exactly one, so there a candidate scores 0 if
it is stable beside the last piece of what stands before, and minus infinity otherwise; the maxima find the library's own ids.

A key is 64 bits of a hash, so found pieces are held against the text, and where they differ merging decides (`_search`). Whether
neighbours are stable is found for all pairs at once by going back in time (`_stay_apart`). Models with a normaliser, with
user-defined pieces or with pieces across words raise an error.

Null texts give null ids; empty ones none. Very long texts are encoded whole; repeated rows are encoded each; an empty table gives
no rows. Columns named as what is added are replaced, others may stay. Characters outside the pieces become byte pieces, or the
unknown piece where a model has none. A text that holds U+2581 decodes with spaces in its place, as with the library.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import byte_texts, extend

SPACE = "▁"
#: Units whose ids a task remembers.
MOST_UNITS = 250_000
#: Units up to this length aren't cut further.
WHOLE = 32
#: Units that advance together.
BLOCK = 20_000
_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)
_FILTER_BITS = 21
#: Places of the table that remembers which pairs of pieces are stable.
_PAIR_BITS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def merge(chars: list[str], rank: dict[str, float], parts_of: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Pieces that repeated merging of the best pair, the leftmost of equals, leaves; parts_of takes the last merge down."""
    parts = list(chars)
    while len(parts) > 1:
        best = max(((rank[ab], -i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in rank), default=None)
        if best is None:
            break
        i = -best[1]
        if parts_of is not None and len(parts) == 2:
            parts_of[parts[0] + parts[1]] = (parts[0], parts[1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class PieceModel:
    """The pieces of a model file, with sorted keys for numpy."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.is_bpe = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces across words are not supported")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.characters = {p for p in self.ids if len(p) == 1}
        last_merge: dict[str, tuple[str, str]] = {}
        usable = {p for p in self.ids if not self.is_bpe or merge(list(p), self.score, last_merge) == [p]}
        named = list(self.ids)
        self.sums = np.zeros(len(self.pieces), np.uint64)
        self.sums[list(self.ids.values())] = [self._sum(p) for p in named]
        keys = _mix(self.sums[list(self.ids.values())])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.usable = np.zeros(len(self.pieces), bool)
        self.usable[[self.ids[p] for p in usable]] = True
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.scores = np.array([self.score.get(p, -np.inf) for p in self.pieces])
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.shift = _powers(_BASE, self.longest + 1)[np.minimum(self.lengths, self.longest)]
        # When merging makes each piece, and the two pieces that its last merge joins; characters are there from the start.
        self.made = np.full(len(self.pieces), -1, np.int64)
        self.left, self.right = np.arange(len(self.pieces)), np.arange(len(self.pieces))
        longer = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        self.made[[self.ids[p] for p in longer]] = np.arange(len(longer))
        for p, (a, b) in last_merge.items():
            if p in usable:
                self.left[self.ids[p]], self.right[self.ids[p]] = self.ids[a], self.ids[b]
        # Pieces of which the order of merges isn't plain (equal scores, or made before their parts) are merged one by one.
        times = Counter(self.score[p] for p in longer)
        self.odd = np.zeros(len(self.pieces), bool)
        for i in (self.ids[p] for p in longer):
            a, b = self.left[i], self.right[i]
            self.odd[i] = times[self.score[self.pieces[i]]] > 1 or self.made[a] >= self.made[i] or self.made[b] >= self.made[i] or self.odd[a] or self.odd[b]
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else " ⁇ ".encode() if p.type == 2 else b"" for p in proto.pieces]
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Let go of the units and pairs that a task has seen."""
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.pairs, self.verdicts = np.full(1 << _PAIR_BITS, -1, np.int64), np.zeros(1 << _PAIR_BITS, bool)

    @staticmethod
    def _sum(piece: str) -> int:
        codes = np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)
        return (codes * _powers(_BASE, len(codes))).sum(dtype=np.uint64)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces of these keys, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.filter[keys >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.key_ids[at[hit]]
        return out

    def are_stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces gives the two again."""
        pairs = left << 32 | right
        slot = (_mix(pairs.view(np.uint64)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        out = self.verdicts[slot]
        new = np.flatnonzero(self.pairs[slot] != pairs)
        if len(new):
            odd = self.odd[left[new]] | self.odd[right[new]]
            found, names = np.ones(len(new), bool), self.pieces
            found[~odd] = self._stay_apart(left[new[~odd]], right[new[~odd]])
            found[odd] = [merge([*names[a], *names[b]], self.score) == [names[a], names[b]] for a, b in zip(left[new[odd]].tolist(), right[new[odd]].tolist(), strict=True)]
            out[new], self.pairs[slot[new]], self.verdicts[slot[new]] = found, pairs[new], found
        return out

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """are_stable() for all pairs at once, going back in time: the younger piece is taken apart, and what then stands at the
        border must not make a piece sooner than the merge that was taken back (which, of equals, the left one makes first)."""
        out = np.ones(len(left), bool)
        at, before = np.arange(len(left)), np.full(len(left), np.iinfo(np.int64).max)
        while len(at):
            joined = self.probe(_mix(self.sums[left] + self.shift[left] * self.sums[right]))
            apart = (joined < 0) | (self.made[joined] >= before)
            out[at[~apart]] = False
            undo_left, more = self.made[left] > self.made[right], (self.made[left] >= 0) | (self.made[right] >= 0)
            before = np.where(undo_left, self.made[left], self.made[right] + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
            on = apart & more
            at, before, left, right = at[on], before[on], left[on], right[on]
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = text.replace(" ", SPACE)
        return _UNIT.findall(SPACE + escaped if self.dummy_prefix else escaped)

    def parts(self, unit: str) -> list[str]:
        """The unit cut between characters that no piece joins."""
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.neighbours), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def viterbi(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings one after the other, number of each) of strings of one length made of the pieces' characters."""
        n, m = len(rows[0]), len(rows)
        codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
        sums = np.zeros((n + 1, m), np.uint64)
        sums[1:] = np.cumsum((codes * _powers(_BASE, n)).T, axis=0, dtype=np.uint64)
        back = _powers(_BACK, n)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        step, last = np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int64)
        columns = np.arange(m)
        for e in range(1, n + 1):
            most = min(e, self.longest)
            starts = np.arange(e - most, e)
            ids = self.probe(_mix(((sums[e] - sums[starts]) * back[starts][:, None]).reshape(-1)))
            at = np.flatnonzero(ids >= 0)
            at = at[self.usable[ids[at]]]
            a, c, t = at // m, at % m, ids[at]
            held = best[starts[a], c]
            if self.is_bpe:
                fine, before = held > -np.inf, last[starts[a], c]
                rest = np.flatnonzero(fine & (before >= 0))
                fine[rest] = self.are_stable(before[rest], t[rest])
                a, c, t, value = a[fine], c[fine], t[fine], held[fine]
            else:
                value = held + self.scores[t]
            # The maximum of each column; of equals the longest candidate, which comes first.
            np.maximum.at(best[e], c, value)
            wins = np.flatnonzero(value == best[e, c])[::-1]
            step[e, c[wins]], last[e, c[wins]] = most - a[wins], t[wins]
        at = np.full(m, n)
        pieces = np.full((n, m), -1, np.int64)
        for k in range(n):  # back along the pointers
            active = columns[(at > 0) & (best[at, columns] > -np.inf)]
            if not len(active):
                break
            pieces[n - 1 - k, active] = last[at[active], active]
            at[active] -= step[at[active], active]
        pieces, here = pieces.T, pieces.T >= 0
        return pieces[here], here.sum(axis=1)

    def _character(self, c: str) -> list[int]:
        i = self.ids.get(c)
        if i is not None:
            return [i]
        raw = c.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def _search(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """viterbi(), with its pieces held against the strings: where keys alone agreed, merging (or nothing) decides."""
        ids, sizes = self.viterbi(strings)
        ends = np.cumsum(sizes)
        if "".join(map(self.pieces.__getitem__, ids.tolist())) == "".join(strings) and sizes.all() and (np.add.reduceat(self.lengths[ids], ends - sizes) == len(strings[0])).all():
            return ids, sizes
        parts = []
        for s, e, n in zip(strings, ends.tolist(), sizes.tolist(), strict=True):
            own = ids[e - n : e]
            if "".join(map(self.pieces.__getitem__, own.tolist())) != s:
                if not self.is_bpe:
                    raise RuntimeError("no segmentation of characters that are pieces")
                own = np.array([self.ids[p] for p in merge(list(s), self.score)], np.int64)
            parts.append(own)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def learn(self, units: list[str]) -> None:
        """Find the ids of new units, those of equal length together. Short units of characters that all are pieces go as they
        are; the others are cut first where no piece lies across."""
        by_length: dict[int, list[str]] = {}
        cut: dict[str, list[str]] = {}
        for u in units:
            if len(u) <= WHOLE and self.characters.issuperset(u):
                by_length.setdefault(len(u), []).append(u)
            else:
                cut[u] = self.parts(u)
        whole = {u for strings in by_length.values() for u in strings}
        for p in {p for parts in cut.values() for p in parts if len(p) > 1} - whole:
            by_length.setdefault(len(p), []).append(p)
        names, pools, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for length, strings in sorted(by_length.items()):
            block = max(1, min(BLOCK, 4_000_000 // (length * self.longest)))
            for at in range(0, len(strings), block):
                ids, sizes = self._search(strings[at : at + block])
                names += strings[at : at + block]
                pools.append(ids)
                counts.append(sizes)
        pool, ends = np.concatenate(pools), np.cumsum(np.concatenate(counts))
        if cut:  # their parts are put together behind the others
            place = dict(zip(names, zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), strict=True))
            ids: list[int] = []
            more = []
            for parts in cut.values():
                for p in parts:
                    if len(p) == 1:
                        ids += self._character(p)
                    else:
                        a, b = place[p]
                        ids += pool[a:b].tolist()
                more.append(len(ids))
            ends = np.concatenate([ends, np.array(more, np.int64) + len(pool)])
            pool = np.concatenate([pool, np.array(ids, np.int64)])
        first = len(self.ends) - 1
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.known.update(zip(cut, range(first + len(names), first + len(names) + len(cut)), strict=True))
        self.ends = np.concatenate([self.ends, ends + len(self.pool)])
        self.pool = np.concatenate([self.pool, pool.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each)."""
        split = [self.units(t) for t in texts]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > MOST_UNITS and self.known:
            self.forget()
            new = every
        self.learn(sorted(new))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        sizes = np.diff(self.ends)[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ends[which] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        text_ends = np.append(0, ends)[np.cumsum([0, *map(len, split)])]
        return self.pool[at], np.diff(text_ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text of each run of `sizes` ids."""
        lengths = self.raw_sizes[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.raw_starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.raw[at].tobytes()
        cuts = np.append(0, ends)[np.cumsum(np.append(0, sizes))].tolist()
        texts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [t[1:] if self.dummy_prefix and t[:1] == b" " else t for t in texts]


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with ids and n_tokens; columns of these names are replaced."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        null = np.asarray(batch.column(text).is_null())
        ids, sizes = load(path).encode([b.decode("utf-8", "replace") for b in byte_texts(batch.column(text))])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
        return [lists, pa.array(sizes, pa.int64(), mask=null)]

    return extend(docs, text, {"ids": "array<int>", "n_tokens": "bigint"}, run, keep, after=lambda: load(path).forget())


def decode(encoded: DataFrame, ids: str = "ids", to: str = "decoded", model: str | None = None) -> DataFrame:
    """encoded with the text of the ids in column `to`; null ids give null."""
    path = model or default_model()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != to), f"`{to}` string"])
    others = [c for c in encoded.columns if c != to]

    def run(batches):
        for batch in batches:
            null = np.asarray(batch.column(ids).is_null())
            runs = batch.column(ids).to_pylist()
            flat = np.array([i for r in runs for i in r or ()], np.int64)
            texts = load(path).decode(flat, np.array([len(r or ()) for r in runs], np.int64))
            texts = pa.array([None if n else t.decode("utf-8", "replace") for t, n in zip(texts, null, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), texts], names=[*others, to])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as 4-byte little-endian integers) and round_trip (decoding gives the text)."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces, raws = load(path), byte_texts(batch.column(text))
        null = np.asarray(batch.column(text).is_null())
        ids, sizes = pieces.encode([b.decode("utf-8", "replace") for b in raws])
        raw_ids, cuts = ids.astype("<i4").tobytes(), np.cumsum(np.append(0, 4 * sizes)).tolist()
        digests = [hashlib.sha256(raw_ids[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
        same = [a == b for a, b in zip(pieces.decode(ids, sizes), raws, strict=True)]
        return [pa.array(sizes, pa.int64(), mask=null), pa.array(digests, pa.string(), mask=null), pa.array(same, pa.bool_(), mask=null)]

    return extend(docs, text, {"n_tokens": "bigint", "ids_sha256": "string", "round_trip": "boolean"}, run, keep, after=lambda: load(path).forget())

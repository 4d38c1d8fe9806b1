"""SentencePiece encoding with N-best segmentations, and decoding.

A text is a lattice of vocabulary pieces. No piece of the vocabulary crosses certain places (after a
word, around a digit), so the lattice is a chain of small ones, called units here, which repeat often. Forward
Viterbi scores of all new units of a chunk come from one vectorized pass; a backward pass gives what
the second best segmentation of each costs. The N best of a text differ from its best one only in the
N - 1 units with the least such cost, and only these are searched: A* from the end of the unit, with the forward
scores as exact heuristic, gives their segmentations in order.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelseq.llm.common import expand, narrow, slices
from panelseq.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units that a task remembers; beyond it starts anew.
CACHE_UNITS = 250_000
#: What a character outside the vocabulary scores below the worst piece of one character.
UNKNOWN_PENALTY = 10.0
CHUNK_BYTES = 1 << 20
TABLE_BITS = 20
_KEY = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, scores and a prefix table of a SentencePiece model with byte fallback."""

    def __init__(self, model: bytes) -> None:
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [0] * 256
        self.ids: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = [b""] * m.get_piece_size()
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                value = int(m.id_to_piece(i)[3:-1], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
            elif not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i)):
                piece = m.id_to_piece(i).replace("▁", " ")
                self.ids[piece], self.raw[i] = (i, m.get_score(i)), piece.encode()
        self.unknown = min(s for p, (_, s) in self.ids.items() if len(p) == 1) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.pattern = self._pattern()
        self._table()
        sizes = np.array([len(b) for b in self.raw])
        self.raw_offs = np.concatenate([[0], np.cumsum(sizes)])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def _pattern(self) -> re.Pattern:
        """The finest way of cutting texts into units that leaves every piece in one unit."""
        odd = ""
        for _ in range(2):
            fine = re.compile(rf" *[^\W\d_{odd}]+| *(?:[^\w \n]|[_{odd}])+| +|\d|\n")
            bad = [p for p in self.ids if not fine.fullmatch(p)]
            if not bad:
                return fine
            odd += "".join(re.escape(c) for c in sorted({c for p in bad for c in p if not c.isalpha() and not c.isspace() and not c.isdecimal()}) if c not in odd)
        words = re.compile(r" *[^ \n]+| +|\n")
        return words if all(words.fullmatch(p) for p in self.ids) else re.compile(r"(?s).+")

    def _table(self) -> None:
        """Open addressing over (trie node, character): next node; and the piece at each node."""
        nodes: dict[tuple[int, str], int] = {}
        piece, score = [-1], [0.0]
        for p, (i, s) in self.ids.items():
            at = 0
            for c in p:
                to = nodes.get((at, c))
                if to is None:
                    to = nodes[at, c] = len(piece)
                    piece.append(-1)
                    score.append(0.0)
                at = to
            piece[at], score[at] = i, s
        self.node_piece, self.node_score = np.array(piece), np.array(score)
        size = 1 << max(TABLE_BITS, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        key = np.array([(a << 21) | ord(c) for a, c in nodes], np.uint64)
        to = np.array(list(nodes.values()), np.int64)
        self.table_key, self.table_to = np.full(size, np.uint64(2**64 - 1)), np.full(size, -1)
        at, left = ((key * _KEY) >> self.shift).astype(np.int64), np.arange(len(key))
        while len(left):
            free = self.table_to[at[left]] < 0
            slot, first = np.unique(at[left[free]], return_index=True)
            chosen = left[free][first]
            self.table_key[slot], self.table_to[slot] = key[chosen], to[chosen]
            left = left[self.table_key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie nodes, or -1."""
        key = (node.astype(np.uint64) << np.uint64(21)) | char
        at = ((key * _KEY) >> self.shift).astype(np.int64)
        out, left = np.full(len(key), -1), np.arange(len(key))
        while len(left):
            slot = at[left]
            same = self.table_key[slot] == key[left]
            out[left[same]] = self.table_to[slot[same]]
            more = ~same & (self.table_to[slot] >= 0)
            left = left[more]
            at[left] = (at[left] + 1) & self.mask
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of the id sequences cut at ``offs``; the space put before each text is taken off."""
        _, pos = expand(self.raw_offs[ids], self.raw_offs[ids + 1])
        data = self.raw_flat[pos].tobytes()
        size = np.concatenate([[0], np.cumsum(self.raw_offs[ids + 1] - self.raw_offs[ids])])
        edge = size[offs].tolist()
        return [data[a + 1: z].decode("utf-8", "replace") for a, z in zip(edge[:-1], edge[1:], strict=True)]

    def best_n(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one unit as (score, ids), best first; ties go to longer last pieces."""
        size, edges, forward = len(unit), [[] for _ in range(len(unit) + 1)], [0.0] + [-np.inf] * len(unit)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                found = self.ids.get(unit[start:end])
                if found:
                    edges[end].append((start, found[1], [found[0]]))
            if unit[end - 1] not in self.ids:
                edges[end].append((end - 1, self.unknown, self.fallback(unit[end - 1])))
            forward[end] = max((forward[s] + w for s, w, _ in edges[end]), default=-np.inf)
        out, heap, count = [], [(-forward[size], size, 0, 0.0, None)], 0
        while heap and len(out) < n:
            _, at, _, behind, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, ids))
                continue
            for start, w, ids in edges[at]:
                count += 1
                heapq.heappush(heap, (-(forward[start] + w + behind), start, count, w + behind, (ids, path)))
        return out


class Encoder:
    """Encodes texts chunk by chunk and remembers the units it has met."""

    def __init__(self, vocabulary: Vocabulary, n: int) -> None:
        self.v, self.n = vocabulary, n
        self.lists: dict[str, list] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.second = np.zeros(0), np.zeros(0)
        self.lists.clear()

    def learn(self, units: list[str]) -> None:
        """Best segmentation, its score and the cost of the second best of each new unit, all units at once."""
        v, sizes = self.v, np.array([len(u) for u in units])
        text = "".join(units)
        char = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(units)), sizes)
        stop = np.cumsum(sizes)
        begin = stop - sizes
        at, node, parts, size = np.arange(len(char)), np.zeros(len(char), np.int64), [], 0
        while len(at):
            node = v.step(node, char[at + size])
            if size == 0:
                lone = (node < 0) | (v.node_piece[node] < 0)
                parts.append((at[lone], at[lone] + 1, np.full(lone.sum(), -1), np.full(lone.sum(), v.unknown)))
            size += 1
            piece = np.where(node >= 0, v.node_piece[node], -1)
            hit = piece >= 0
            parts.append((at[hit], at[hit] + size, piece[hit], v.node_score[node[hit]]))
            go = (node >= 0) & (at + size < stop[unit[at]])
            at, node = at[go], node[go]
        start, end, piece, weight = (np.concatenate(z) for z in zip(*parts, strict=True))
        u = unit[start]
        # Each unit has one node more than characters.
        a, z, first, last = start + u, end + u, begin + np.arange(len(units)), stop + np.arange(len(units))
        forward, best = self._viterbi(a, z, end - begin[u], weight, first, len(char) + len(units))
        backward, _ = self._viterbi(z, a, stop[u] - start, weight, last, len(char) + len(units))
        on, at = np.zeros(len(a), bool), last
        while len(at):
            e = best[at]
            on[e] = True
            at = a[e]
            at = at[at != first[unit[start[e]]]]
        loss = forward[last[u]] - (forward[a] + weight + backward[z])
        second = np.full(len(units), np.inf)
        np.minimum.at(second, u[~on], loss[~on])
        path = np.flatnonzero(on)
        path = path[np.argsort(a[path], kind="stable")]
        ids, n_ids = piece[path], np.ones(len(path), np.int64)
        for k in np.flatnonzero(ids < 0):
            n_ids[k] = len(text[start[path[k]]].encode())
        flat = np.repeat(ids, n_ids)
        where = np.cumsum(n_ids) - n_ids
        for k in np.flatnonzero(ids < 0):
            flat[where[k]: where[k] + n_ids[k]] = v.fallback(text[start[path[k]]])
        count = np.bincount(u[path], weights=n_ids, minlength=len(units)).astype(np.int64)
        self.index.update(zip(units, range(len(self.score), len(self.score) + len(units)), strict=True))
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(count)])
        self.score = np.concatenate([self.score, forward[last]])
        self.second = np.concatenate([self.second, np.maximum(second, 0.0)])

    @staticmethod
    def _viterbi(source, target, step, weight, origin, n):
        """Best score from ``origin`` for each node, and the edge that gives it; edges into a node share their step."""
        order = np.lexsort((source, target, step))
        s, t, w, p = source[order], target[order], weight[order], step[order]
        score, edge = np.full(n, -np.inf), np.full(n, -1)
        score[origin] = 0.0
        rounds = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, np.int64)
        for lo, hi in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
            cand, to = score[s[lo:hi]] + w[lo:hi], t[lo:hi]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(cand, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, hi - lo)))
            same = np.flatnonzero(cand == top[group])
            pick = same[np.unique(group[same], return_index=True)[1]]
            score[to[head]] = top
            edge[to[head]] = order[lo + pick]
        return score, edge

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(ids, offsets, scores, alternatives): the best ids of all texts, and what the next best change."""
        find = self.v.pattern.findall
        found = [find(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(found)).difference(self.index)
        if new:
            if len(self.index) + len(new) > CACHE_UNITS:
                self._reset()
                new = set(chain.from_iterable(found))
            self.learn(sorted(new))
        n_units = np.array([len(f) for f in found], np.int64)
        edge = np.concatenate([[0], np.cumsum(n_units)])
        k = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, int(edge[-1]))
        _, pos = expand(self.offs[k], self.offs[k + 1])
        at = np.concatenate([[0], np.cumsum(self.offs[k + 1] - self.offs[k])])
        total = np.concatenate([[0.0], np.cumsum(self.score[k])])
        second = self.second[k]
        more = [self._alternatives(f, second[lo:hi], at[lo: hi + 1] - at[lo])
                for f, lo, hi in zip(found, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        scores = np.array([self.score[k[lo:hi]].sum() for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        return self.ids[pos], at[edge], scores, more

    def _alternatives(self, units: list[str], second: np.ndarray, at: np.ndarray) -> list:
        """The next n - 1 segmentations as {loss, edits}; an edit replaces ``drop`` ids from ``at`` on."""
        m = self.n - 1
        if m <= 0 or not len(units):
            return []
        chosen = np.argsort(second, kind="stable")[:m] if len(second) <= 64 else self._smallest(second, m)
        ways: list = [(0.0, ())]
        for u in chosen.tolist():
            if second[u] == np.inf:
                continue
            known = self.lists.get(units[u])
            if known is None:
                known = self.lists[units[u]] = self.v.best_n(units[u], self.n)
            top = known[0][0]
            ways = sorted(((loss + top - s, edits + (((u, ids),) if j else ())) for loss, edits in ways for j, (s, ids) in enumerate(known)),
                          key=lambda x: x[0])[: self.n]
        return [{"loss": loss, "edits": [{"at": int(at[u]), "drop": int(at[u + 1] - at[u]), "ids": ids} for u, ids in edits]} for loss, edits in ways[1:]]

    @staticmethod
    def _smallest(x: np.ndarray, m: int) -> np.ndarray:
        near = np.flatnonzero(x <= np.partition(x, m - 1)[m - 1])
        return near[np.argsort(x[near], kind="stable")][:m]


_ALTERNATIVES = pa.list_(pa.struct([("loss", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = ("n_pieces bigint, score double, ids array<int>, round_trip boolean, "
          "alternatives array<struct<loss: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>")


def encode(docs: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, score, ids, round_trip, alternatives), one row for each document.

    ``ids`` is the segmentation with the highest sum of piece scores over the text with one space put before it; a
    character outside the vocabulary becomes its UTF-8 byte pieces. Nothing is normalized, so decoding returns the
    text exactly, which ``round_trip`` reports after doing it. ``alternatives`` are the next n - 1
    segmentations: what each loses against the best and which ids it replaces. Of equal scores the best
    takes the longer last piece. Null and empty texts have no pieces, score 0 and no alternatives; repeated
    rows give repeated result rows and an empty table none. ``model`` is a file of the driver; its bytes are broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    proto = spark.sparkContext.broadcast(Path(model).read_bytes())
    rows = narrow(docs, "doc_id", "text")

    def run(batches):
        encoder = Encoder(Vocabulary(proto.value), n)
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, offs, scores, more = encoder.encode(texts)
                back = encoder.v.decode(ids, offs)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(offs)), pa.array(scores),
                    pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids)),
                    pa.array([x == y for x, y in zip(back, texts, strict=True)]), pa.array(more, _ALTERNATIVES),
                ], ["doc_id", "n_pieces", "score", "ids", "round_trip", "alternatives"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of the column ``ids``; null or no ids give an empty text, ids of control pieces nothing."""
    spark = encoded.sparkSession
    ship(spark)
    proto = spark.sparkContext.broadcast(Path(model).read_bytes())
    rows = narrow(encoded, "doc_id", "ids")

    def run(batches):
        v = Vocabulary(proto.value)
        for b in batches:
            lists = b.column("ids").to_pylist()
            offs = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            flat = np.fromiter(chain.from_iterable(x or () for x in lists), np.int64, int(offs[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v.decode(flat, offs), pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of an alternative."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += ids[at: e["at"]] + list(e["ids"])
        at = e["at"] + e["drop"]
    return out + ids[at:]

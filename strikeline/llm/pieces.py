"""SentencePiece encoding by sampling without replacement, and decoding.

The lattice of a text has a node at each character and an edge for each vocabulary piece; a piece of rank r weighs -ln(r + 10), and a character that is
no piece is one edge of its byte pieces. No piece crosses the start of a run of spaces or a line feed, nor, in text without spaces, two characters that stand
side by side in no piece; so the lattice is a chain of small ones, and each distinct one of a chunk is built once. Edges are normalised backwards, so following them from the start draws a segmentation by its weight.

Gumbel top-k: the root gets Gumbel noise; below a node the noise of the children is drawn so that its maximum is the node's own. The best child
inherits the node's value, its siblings get lesser ones, which bound everything below them. A-star search takes the best open sibling next and follows
best children to the end, so segmentations come out distinct, in the order of their perturbed log-probabilities, as k draws without replacement. All
documents of a chunk take a step at once. The noise depends on the row's key, the sample and the place alone.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.vectors import U, chunks, mix, powers, prefix_hash, ragged, short_batches, span_hash, utf8

SAMPLES = 2
#: Bytes of text that a task works on at a time; it takes some 200 bytes for each. Longer units are cut where no piece crosses.
CHUNK, LONG = 1 << 19, 48
CHAR_SIZE = np.repeat(np.array([1, 1, 2, 3, 4]), [128, 64, 32, 16, 16])  # by first byte
FIRST_BYTE, BYTE_RANK, SCALE = 3, 32000.0, 2.7
ALL_BITS = (1 << 64) - 1


def default_model() -> str:
    """The public vocabulary's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _pairs(data: np.ndarray, s: np.ndarray, unit: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring characters of one unit: where the second one starts and ends, and the hash of both."""
    at = np.flatnonzero(((data & 0xC0) != 0x80) & among)
    one, two = at[:-1], at[1:]
    same = unit[one] == unit[two]
    one, two = one[same], two[same]
    end = two + CHAR_SIZE[data[two]]
    return two, end, (s[end] - s[one]) * powers(len(data))[1][one]


@dataclass
class Vocabulary:
    """Pieces as bytes, a space for the space mark; byte pieces are not in `hashes`."""

    hashes: dict[int, tuple[np.ndarray, np.ndarray]]  # by length in bytes: ascending hashes, ids
    prefixes: list[np.ndarray]  # by length in bytes: which high 18 bits occur in hashes of pieces' beginnings
    weight: np.ndarray
    data: np.ndarray
    off: np.ndarray
    pairs: np.ndarray  # ascending hashes of neighbouring characters in pieces

    def __post_init__(self) -> None:
        self.size = np.diff(self.off)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts, by, weight = [], {}, np.zeros(size, np.float32)
        for i in range(size):
            if model.is_byte(i):
                texts.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
                weight[i] = -np.log(BYTE_RANK + 10)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(model.id_to_piece(i).replace("▁", " ").encode())
                weight[i] = -np.log(-model.get_score(i) + 10)
                by.setdefault(len(texts[-1]), []).append(i)
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        s = prefix_hash(data)
        hashes = {}
        for n, ids in by.items():
            ids = np.array(ids)
            h = (s[off[ids + 1]] - s[off[ids]]) * powers(len(data))[1][off[ids]]
            order = np.argsort(h)
            hashes[n] = (h[order], ids[order])
        prefixes = [np.zeros(1 << 18, bool) for _ in range(max(by, default=0) + 1)]
        plain = np.concatenate([ids for _, ids in hashes.values()]) if hashes else np.zeros(0, np.int64)
        for n in range(1, len(prefixes)):
            own = off[plain[np.diff(off)[plain] >= n]]
            prefixes[n][((s[own + n] - s[own]) * powers(len(data))[1][own]) >> U(46)] = True
        plain_bytes = np.zeros(len(data), bool)
        plain_bytes[ragged(off[plain], np.diff(off)[plain])] = True
        at, _, pair = _pairs(data, s, np.repeat(np.arange(size), np.diff(off)), plain_bytes)
        return cls(hashes, prefixes, weight, data, off, np.unique(pair))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the first space, which encoding adds, is taken off."""
        n = self.size[ids]
        return self.data[ragged(self.off[ids], n)].tobytes()[1:]


class Lattice:
    """Chained lattices of the distinct units of a chunk. A unit has a node for each byte and one at its end."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray):
        n, unit = np.diff(off), np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.data = data
        self.base, self.end = off[:-1] + np.arange(len(n)), off[1:] + np.arange(len(n))
        begins = (data & 0xC0) != 0x80
        left = off[1:][unit] - np.arange(len(data))
        at = np.flatnonzero(begins)
        char = np.diff(np.append(at, len(data)))
        chars = np.zeros(len(data), np.int64)
        chars[at] = char
        s, inverse = prefix_hash(data), powers(len(data))[1]
        edge_at, edge_n, edge_id = [], [], []
        own_piece = np.zeros(len(data), bool)
        ends = np.append(begins, True)
        p = at
        for length in range(1, len(vocabulary.prefixes)):
            p = p[left[p] >= length]
            h = (s[p + length] - s[p]) * inverse[p]
            alive = vocabulary.prefixes[length][h >> U(46)]
            p, h = p[alive], h[alive]
            if not len(p):
                break
            if length not in vocabulary.hashes:
                continue
            hashes, ids = vocabulary.hashes[length]
            whole = ends[p + length]
            h, here = h[whole], p[whole]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = hashes[k] == h
            edge_at.append(here[found])
            edge_n.append(np.full(int(found.sum()), length))
            edge_id.append(ids[k[found]])
        for p, length in zip(edge_at, edge_n, strict=True):
            if len(p):
                own_piece[p[chars[p] == length]] = True
        bare = ~own_piece[at]
        edge_at.append(at[bare])
        edge_n.append(char[bare])
        edge_id.append(np.full(int(bare.sum()), -1))
        nodes = len(data) + len(n)
        node_of = np.arange(len(data)) + unit
        self.count = np.zeros(nodes, np.int64)
        for p in edge_at:
            self.count[node_of[p]] += 1
        self.left = np.zeros(nodes, np.int64)
        self.left[node_of] = left
        self.first = np.cumsum(self.count) - self.count
        self.at, self.length, self.id = (np.empty(int(self.count.sum()), np.int64) for _ in range(3))
        free = self.first.copy()
        for p, length, ids in zip(edge_at, edge_n, edge_id, strict=True):  # a position has one edge of each length
            slot = free[node_of[p]]
            free[node_of[p]] += 1
            self.at[slot], self.length[slot], self.id[slot] = p, length, ids
        byte_weight = -np.log(BYTE_RANK + 10)
        w = np.where(self.id >= 0, vocabulary.weight[self.id], byte_weight * self.length)
        src = node_of[self.at]
        self.src, self.to = src, src + self.length
        seen = np.cumsum(begins)
        from_end = (seen[off[1:][unit[at]] - 1] - seen[at]) if len(at) else at
        by_step = np.argsort(from_end, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(from_end[by_step])) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        beta = self._beta(w, node_of[at[by_step]], cuts, nodes)
        self.q = (w + beta[self.to] - beta[src]).astype(np.float32)

    def _beta(self, w: np.ndarray, node: np.ndarray, cuts: np.ndarray, nodes: int) -> np.ndarray:
        """Log of the weight of all ways from each node to its unit's end. node: from the ends backwards, in steps that cuts part."""
        count = self.count[node]
        e = ragged(self.first[node], count)
        to, place = self.to[e], np.concatenate([[0], np.cumsum(count)])
        # sums of plain weights, with a factor for each byte that keeps them near 1
        weight = np.exp(w[e] + SCALE * self.length[e])
        total = np.ones(nodes)
        with np.errstate(over="ignore", under="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = place[a], place[b]
                total[node[a:b]] = np.add.reduceat(weight[x:y] * total[to[x:y]], place[a:b] - x)
        if len(node) and 1e-280 < total.min() and total.max() < 1e280:
            left = np.zeros(nodes)
            left[node] = self.left[node]
            return np.log(total) - SCALE * left
        beta = np.zeros(nodes)  # very long units: sums of logarithms
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, y, begin = place[a], place[b], place[a:b] - place[a]
            v = w[e[x:y]] + beta[to[x:y]]
            top = np.maximum.reduceat(v, begin)
            beta[node[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count[a:b])), begin))
        return beta

def _gumbel(x: np.ndarray) -> np.ndarray:
    """Gumbel noise of counters, which it overwrites."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0x94D049BB133111EB)
    x >>= U(41)
    u = x.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-23)
    np.log(u, out=u)
    np.negative(u, out=u)
    np.log(u, out=u)
    return np.negative(u, out=u)


def _one_of(hit: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The first hit of each group; every group has one."""
    at = np.flatnonzero(hit)
    return at[np.append(True, group[at[1:]] != group[at[:-1]])]


def _bound(value, top, other):
    """The value of a node's child of perturbed log-probability `other`, given the node's value and its best child's."""
    with np.errstate(divide="ignore"):
        v = value - other + np.log1p(-np.exp(np.minimum(other - top, 0)))
    return value - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))


def _next_sibling(lattice: Lattice, edge: int, key: int, step: int, value: float) -> tuple[float, int] | None:
    """Of the siblings of an edge that are worse than it, the best: its value and edge. One node of a few edges, so plain numbers."""
    node = int(lattice.src[edge])
    first, count = int(lattice.first[node]), int(lattice.count[node])
    drawn = []
    for k, q in enumerate(lattice.q[first : first + count].tolist()):
        x = (key + step * 0x632BE59BD9B4E019 + k * 0x9E3779B97F4A7C15) & ALL_BITS
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & ALL_BITS
        x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & ALL_BITS
        drawn.append((q - math.log(-math.log(((x >> 41) + 0.5) * 2.0**-23)), first + k))
    drawn.sort(reverse=True)
    at = [e for _, e in drawn].index(edge) + 1
    if at == count:
        return None
    top, (other, e) = drawn[0][0], drawn[at]
    gap = math.exp(min(other - top, 0.0))
    if gap >= 1.0:
        return value, e
    v = value - other + math.log1p(-gap)
    return value - max(v, 0.0) - math.log1p(math.exp(-abs(v))), e


def _walk(lattice: Lattice, unit: np.ndarray, node: np.ndarray, value: np.ndarray, key: np.ndarray):
    """Best children from each node to the end of its unit. Edges in the order of units and steps, how many each unit has, and the best open sibling
    at each node: unit, step, edge, value."""
    node, end = node.copy(), lattice.end[unit]
    live, step = np.flatnonzero(node != end), 0
    taken, siblings = [(live[:0], live[:0])], [(live[:0], live[:0], live[:0], value[:0])]
    while len(live):
        c = lattice.count[node[live]]
        edge = lattice.first[node[live]].copy()
        many = np.flatnonzero(c > 1)
        if len(many):
            own, n = live[many], c[many]
            begin = np.cumsum(n) - n
            group, at = np.repeat(np.arange(len(own)), n), np.arange(int(n.sum()))
            e = at + (edge[many] - begin)[group]
            counter = (key[own] + U(step * 0x632BE59BD9B4E019 % (1 << 64)) - begin.astype(U) * U(0x9E3779B97F4A7C15))[group]
            counter += at.astype(U) * U(0x9E3779B97F4A7C15)
            g = _gumbel(counter)
            g += lattice.q[e]
            top = np.maximum.reduceat(g, begin)
            best = _one_of(g == top[group], group)
            edge[many] = e[best]
            g[best] = -np.inf
            second = np.maximum.reduceat(g, begin)
            pick = _one_of(g == second[group], group)
            siblings.append((own, np.full(len(own), step), e[pick], _bound(value[own], top.astype(float), second.astype(float))))
        taken.append((live, edge))
        node[live] = lattice.to[edge]
        live = live[node[live] != end[live]]
        step += 1
    who, edges = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(who, kind="stable")
    return edges[order], np.bincount(who, minlength=len(unit)), [np.concatenate(x) for x in zip(*siblings, strict=True)]


def _best(doc: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each document."""
    left, found = value.copy(), []
    for _ in range(k if len(doc) else 0):
        top = np.full(int(doc.max()) + 1, -np.inf)
        np.maximum.at(top, doc, left)
        at = np.flatnonzero((left == top[doc]) & (left > -np.inf))
        found.append(at)
        left[at] = -np.inf
    return np.concatenate(found) if found else doc[:0]


def segmentations(vocabulary: Vocabulary, buf: np.ndarray, off: np.ndarray, seeds: np.ndarray, k: int):
    """For each text, up to k (ids, log-probability, perturbed value, log of the inclusion score), best perturbed value first."""
    n_docs = len(off) - 1
    full = np.flatnonzero(np.diff(off) > 0)
    out: list[list[tuple]] = [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] if a == b else [] for a, b in zip(off[:-1], off[1:], strict=True)]
    if not len(full):
        return out
    # a space before each text; units begin at texts, at runs of spaces and around line feeds
    size = np.diff(off)[full] + 1
    new = np.concatenate([[0], np.cumsum(size)])
    data = np.full(new[-1], 32, np.uint8)
    data[ragged(new[:-1] + 1, size - 1)] = buf
    start = np.zeros(len(data), bool)
    start[1:] = ((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)
    start[new[:-1]] = True
    s = prefix_hash(data)
    begin = np.flatnonzero(start)
    size = np.diff(np.append(begin, len(data)))
    if (size > LONG).any():
        at, _, pair = _pairs(data, s, np.repeat(np.arange(len(size)), size), np.repeat(size > LONG, size))
        found = vocabulary.pairs[np.minimum(np.searchsorted(vocabulary.pairs, pair), len(vocabulary.pairs) - 1)] == pair if len(vocabulary.pairs) else np.zeros(len(pair), bool)
        start[at[~found]] = True
        begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(data))
    _, one, unit = np.unique(span_hash(s, begin, end), return_index=True, return_inverse=True)
    lengths = (end - begin)[one]
    lattice = Lattice(vocabulary, data[ragged(begin[one], lengths)], np.concatenate([[0], np.cumsum(lengths)]))
    first = np.searchsorted(begin, new[:-1])
    count = np.diff(np.append(first, len(begin)))
    doc = np.repeat(np.arange(len(full)), count)
    word = np.arange(len(begin)) - first[doc]
    seed = mix(seeds[full].astype(np.int64).view(U))
    root = _gumbel(seed.copy()).astype(float)
    key = lambda d, sample, w: mix(seed[d] + U(sample * 0xD6E8FEB86659FD93 % (1 << 64)) + w.astype(U))

    paths: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in full]  # per document: edges, the word of each
    values: list[list[float]] = [[v] for v in root.tolist()]
    heaps: list[list[tuple]] = [[] for _ in full]

    def extend(sample: int, d: np.ndarray, w: np.ndarray, node: np.ndarray, value: np.ndarray, heads: dict[int, tuple]) -> None:
        units, keys = unit[first[d] + w], key(d, sample, w)
        edges, steps, (who, step, edge, bound) = _walk(lattice, units, node, value, keys)
        place = np.cumsum(steps) - steps
        words = np.repeat(w, steps)
        docs, at = np.unique(d, return_index=True)
        cut = np.append(place, len(edges))[np.append(at, len(d))]
        for x, a, b in zip(docs.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            he, hw = heads.get(x, (edges[:0], words[:0]))
            paths[x].append((np.concatenate([he, edges[a:b]]), np.concatenate([hw, words[a:b]])))
        lead = np.zeros(len(full), np.int64)
        lead[docs] = [len(heads[x][0]) if x in heads else 0 for x in docs.tolist()]
        begins = np.zeros(len(full), np.int64)
        begins[docs] = cut[:-1]
        top = _best(d[who], bound, k)
        for i in top.tolist():
            x = int(d[who[i]])
            heapq.heappush(heaps[x], (-float(bound[i]), len(paths[x]) - 1, int(lead[x] + place[who[i]] - begins[x] + step[i]), int(edge[i]), int(keys[who[i]]), int(step[i])))

    extend(0, doc, word, lattice.base[unit], root[doc], {})
    for sample in range(1, k):
        d, w, node, value, heads = [], [], [], [], {}
        for x, heap in enumerate(heaps):
            if len(paths[x]) < sample or not heap:
                continue
            bound, path, j, edge, own_key, step = heapq.heappop(heap)
            if (more := _next_sibling(lattice, edge, own_key, step, values[x][path])) is not None:
                heapq.heappush(heap, (-more[0], path, j, more[1], own_key, step))
            edges, words = paths[x][path]
            at = int(words[j])
            heads[x] = (np.append(edges[:j], edge), np.append(words[:j], at))
            values[x].append(-bound)
            rest = np.arange(at, count[x])
            d.append(np.full(len(rest), x))
            w.append(rest)
            node.append(np.append(lattice.to[edge], lattice.base[unit[first[x] + rest[1:]]]))
            value.append(np.full(len(rest), -bound))
        if not d:
            break
        extend(sample, *(np.concatenate(x) for x in (d, w, node, value)), heads)

    every = [edges for own in paths for edges, _ in own]
    size = np.array([len(e) for e in every])
    edges = np.concatenate(every)
    bare = lattice.id[edges] < 0
    n = np.where(bare, lattice.length[edges], 1)
    ids = np.repeat(lattice.id[edges], n)
    ids[np.repeat(bare, n)] = FIRST_BYTE + lattice.data[ragged(lattice.at[edges[bare]], n[bare])]
    ids = ids.astype(np.int32)
    begin = np.cumsum(size) - size
    log_ps = np.add.reduceat(lattice.q[edges].astype(float), begin).tolist()
    cut = np.append(0, np.cumsum(np.add.reduceat(n, begin))).tolist()
    at = 0
    for x, i in enumerate(full.tolist()):
        threshold = -heaps[x][0][0] if heaps[x] else -math.inf
        for value in values[x][: len(paths[x])]:
            over = log_ps[at] - threshold
            inclusion = 0.0 if over > 5 else over if over < -30 else math.log(-math.expm1(-math.exp(over)))
            out[i].append((ids[cut[at] : cut[at + 1]], log_ps[at], float(value), inclusion))
            at += 1
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("long")).alias("seed"))


def _flat(found: list[list[tuple]]) -> tuple[pa.Array, pa.Array, pa.ListArray, list[pa.Array]]:
    """Of all segmentations of a chunk, text by text: the text's place, the sample's number, the ids as slices of one array, and the three values."""
    flat = [s for x in found for s in x]
    off = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([s[0] for s in flat])))
    own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
    return own, pa.array([j for x in found for j in range(len(x))], pa.int32()), ids, [pa.array([s[c] for s in flat], pa.float64()) for c in (1, 2, 3)]


def encode(docs: DataFrame, samples: int = SAMPLES, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct sampled segmentations of every text.

    Returns up to `samples` rows per row of docs: doc_id, sample (0, 1, ...), ids, log_prob (of the segmentation), perturbed (its perturbed
    log-probability) and log_inclusion (log of the chance that the threshold, the next perturbed value, lets it in). A text of fewer segmentations
    gets them all. Null or empty texts have one of no ids. Noise depends on doc_id, so repeated rows get equal samples; a null id is a key too; other columns
    are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            found = segmentations(vocabulary.value, *utf8(batch.column("text")), batch.column("seed").to_numpy(), samples)
            own, number, ids, rest = _flat(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), number, ids, *rest], names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns of encoded and `text`, read from `ids`; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))
    own = encoded.select(*[encoded[f"`{c}`"] for c in encoded.columns if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.value.decode(np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return own.mapInArrow(run, own.select("*", F.lit("").alias("text")).schema)


def digests(vocabulary: Vocabulary, batch: pa.RecordBatch, samples: int) -> pa.RecordBatch:
    """The rows of encode_digests of a chunk (doc_id, text, seed). All its ids are decoded at once, and stay one array."""
    buf, off = utf8(batch.column("text"))
    own, number, ids, rest = _flat(segmentations(vocabulary, buf, off, batch.column("seed").to_numpy(), samples))
    values, cut = ids.values.to_numpy(), ids.offsets.to_numpy()
    size = vocabulary.size[values]
    back = vocabulary.data[ragged(vocabulary.off[values], size)].tobytes()
    place = np.append(0, np.cumsum(size))[cut].tolist()
    text, begin = buf.tobytes(), off.tolist()
    same = [back[a + 1 : b] == text[begin[i] : begin[i + 1]] for i, a, b in zip(own.to_pylist(), place[:-1], place[1:], strict=True)]  # but for the first space, which encoding adds
    raw, at = memoryview(values.astype("<i4").tobytes()), (4 * cut.astype(np.int64)).tolist()
    sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(own), number, pa.array(np.diff(cut).astype(np.int64)), pa.array(sha, pa.string()), pa.array(same, pa.bool_()), *rest, ids],
        names=["doc_id", "sample", "n_pieces", "ids_sha256", "round_trip", "log_prob", "perturbed", "log_inclusion", "ids"],
    )


def encode_digests(docs: DataFrame, samples: int = SAMPLES, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with n_pieces and ids_sha256 (of little-endian 32-bit ids) before the other columns, whether decoding gives the text back, and the ids last."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            yield digests(vocabulary.value, batch, samples)

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, sample int, n_pieces long, ids_sha256 string, round_trip boolean, log_prob double, perturbed double, log_inclusion double, ids array<int>"
    )


def op9_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document: their ids, and whether these decode to the text."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

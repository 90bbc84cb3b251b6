"""SentencePiece encoding and decoding with a merge-type prefix table.

For every prefix of a text the table holds the last token of that prefix's unique
encoding. A token that ends there is that token exactly if it is compatible with the
last token of the prefix before it: merging the two alone leaves the two. Ids are
recovered backwards from the table, so a text of any length takes linear time and no
merge queue.

No piece has a space mark after another character, so a text falls apart before each
run of marks. The parts of a block of texts that were not seen lately are encoded
together: NumPy walks the trie of the vocabulary from all their characters at once,
then fills the table one prefix length after the other. Long parts and those with
characters that no piece has are encoded alone, by an Aho-Corasick automaton.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BLOCK_CHARS = 1 << 20  # texts encoded together
LONG_PART = 64
REMEMBERED_CHARS = 3_000_000  # of parts, in each of two generations
PAIR_BITS = 20

codecs.register_error("tidemark-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def read_model(path: str) -> dict:
    """The vocabulary and settings of a ``.model`` file as plain values."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        content = f.read()
    model.ParseFromString(content)
    norm, train = model.normalizer_spec, model.trainer_spec
    kinds = {p.type for p in model.pieces}
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that keep texts as they are can be used")
    if train.model_type != train.BPE or not train.byte_fallback or kinds - {1, 2, 3, 6} or train.treat_whitespace_as_suffix:
        raise ValueError("only merge-type models with byte fallback can be used")
    return {
        "digest": hashlib.sha256(content).digest(),
        "pieces": [(p.piece, p.score, p.type) for p in model.pieces],
        "prefix": norm.add_dummy_prefix,
        "begin": train.bos_id, "end": train.eos_id, "unknown": train.unk_surface,
    }


class Hashed:
    """Whole numbers from 0 up to whole numbers from 0 up, by open addressing."""

    def __init__(self, bits: int):
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.keys[at[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.values[at[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there; all go if more than half would be taken."""
        if 2 * (self.n + len(keys)) > self.mask:
            self.keys[:], self.n = -1, 0
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place the last is in
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask


class Codec:
    def __init__(self, model: dict):
        self.prefix, self.begin, self.end = model["prefix"], model["begin"], model["end"]
        self.ids, self.scores, self.bytes_at = {}, {}, [0] * 256
        self.surface, self.marked = [], set()
        for i, (piece, score, kind) in enumerate(model["pieces"]):
            text = b""
            if kind == 1:
                self.ids[piece], self.scores[piece] = i, score
                text = piece.replace(MARK, " ").encode()
                if piece.startswith(MARK):
                    self.marked.add(i)
            elif kind == 6:
                byte = int(piece[3:5], 16)
                self.bytes_at[byte] = i
                text = bytes([byte])
            elif kind == 2:
                text = model["unknown"].encode()
            self.surface.append(text)
        self.controls = {i for i, (_, _, kind) in enumerate(model["pieces"]) if kind == 3}
        self.names = [piece for piece, _, _ in model["pieces"]]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.names = [piece for piece, _, _ in model["pieces"]]
        self.longest = max(map(len, self.ids), default=0)
        self.histories: dict[int, tuple | None] = {}
        self.pairs = Hashed(PAIR_BITS)
        self._make_trie()
        self.parts, self.older, self.held = {}, {}, 0

    def _make_trie(self) -> None:
        """Child of a node by the class of a character, and the piece of a node (or -1)."""
        self.classes = np.zeros(0x110000, np.int64)
        alphabet = sorted(set("".join(self.ids)))
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        nodes, edges = {"": 0}, {}
        for piece in self.ids:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    edges[nodes[piece[: n - 1]] << 24 | int(self.classes[ord(piece[n - 1])])] = nodes[piece[:n]]
        self.children = Hashed((4 * len(edges) + 4).bit_length())
        self.children.put(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.piece_at = np.full(len(nodes), -1, np.int32)
        for piece, i in self.ids.items():
            self.piece_at[nodes[piece]] = i

    def history(self, piece: int) -> tuple | None:
        """How plain merging (best score first, leftmost of equals) makes a piece.

        The scores of its merges in order, and its first and last symbol before each
        merge and at the end; none if merging its characters does not give the piece.
        """
        if piece in self.histories:
            return self.histories[piece]
        symbols, scores, first, last = list(self.names[piece]), [], [], []
        while True:
            first.append(symbols[0])
            last.append(symbols[-1])
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            scores.append(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        made = (scores, first, last) if len(symbols) == 1 else None
        self.histories[piece] = made
        return made

    def _compatible(self, key: int) -> bool:
        """Whether two tokens stay as they are side by side; no left one is the start.

        The two are merged in step, best score first, until nothing is left to merge;
        they differ from each on its own only if a pair across the border comes first.
        """
        left, right = (key >> 32) - 1, key & 0xFFFFFFFF
        b = self.history(right)
        if b is None or left < 0:
            return b is not None
        a = self.history(left)
        m, n, i, j = len(a[0]), len(b[0]), 0, 0
        while True:
            across = self.scores.get(a[2][i] + b[1][j])
            x = a[0][i] if i < m else None
            y = b[0][j] if j < n else None
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is not None and (y is None or x >= y):
                i += 1
            elif y is not None:
                j += 1
            else:
                return True

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        known = self.pairs.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            own = np.fromiter(map(self._compatible, new.tolist()), np.int32, len(new))
            self.pairs.put(new, own)
            known[known < 0] = own[np.searchsorted(new, keys[known < 0])]
        return known > 0

    def encode_alone(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a part of any length, with any characters."""
        last = [0] * (len(text) + 1)  # id + 1 of the last token of each prefix; 0: none ends there
        size = [1] * (len(text) + 1)
        known: dict[int, bool] = {}
        for end, (piece, n) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            key = last[end - n] << 32 | piece
            if key not in known:
                known[key] = self._compatible(key)
            if known[key]:
                last[end], size[end] = piece + 1, n
        ids, i = [], len(text)
        while i:
            if last[i]:
                ids.append(last[i] - 1)
            else:  # a character that no piece has stands alone
                ids += [self.bytes_at[b] for b in reversed(text[i - 1].encode())]
            i -= size[i]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode_together(self, parts: list[str]) -> list[bytes]:
        """The same for many parts of at most ``LONG_PART`` characters."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, first = self.classes[codes], np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(parts)), sizes)
        offset = np.arange(len(kinds)) - first[part]
        room = sizes[part] - offset
        at, node, found = np.arange(len(kinds)), np.zeros(len(kinds), np.int64), []
        for n in range(1, self.longest + 1):
            node = self.children.get(node << 24 | kinds[at + (n - 1)]).astype(np.int64)
            piece = self.piece_at[node]
            hit = (node >= 0) & (piece >= 0)
            found.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
            on = (node >= 0) & (room[at] > n)
            at, node = at[on], node[on]
        at, n, piece = (np.concatenate(x) for x in zip(*found))
        end = offset[at] + n
        order = np.argsort(end.astype(np.uint8), kind="stable")
        row, n, piece = part[at][order], n[order], piece[order].astype(np.int64)
        width = int(sizes.max()) + 1
        cuts = np.searchsorted(end[order], np.arange(width + 1))
        last = np.zeros((len(parts), width), np.int64)
        size = np.ones((len(parts), width), np.int64)
        for i in range(1, width):
            r, k, p = (x[cuts[i] : cuts[i + 1]] for x in (row, n, piece))
            ok = self.compatible(last[r, i - k] << 32 | p)
            last[r[ok], i] = p[ok] + 1
            size[r[ok], i] = k[ok]
        ids, ascii_ids = np.full((len(parts), width), -1, np.int64), np.array(self.bytes_at[:128])
        r, i, alone = np.arange(len(parts)), sizes.copy(), np.zeros(len(parts), bool)
        while len(r):
            token, n = last[r, i], size[r, i]
            i = i - n
            ids[r, i] = token - 1
            lone = np.flatnonzero(token == 0)  # characters that no piece has; most are ASCII, one byte each
            code = codes[first[r[lone]] + i[lone]]
            ids[r[lone], i[lone]] = ascii_ids[np.minimum(code, 127)]
            alone[r[lone[code > 127]]] = True
            r, i = r[i > 0], i[i > 0]
        there = ids >= 0
        flat = ids[there].astype("<u4").tobytes()
        ends = (4 * np.cumsum(there.sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for x in np.flatnonzero(alone).tolist():
            out[x] = self.encode_alone(parts[x])
        return out

    def _cut(self, text: str) -> list[str]:
        """Parts of a text; a part without a space mark stands for one that begins with it."""
        if not text:
            return []
        plain = self.prefix and self.splits and MARK not in text and "  " not in text
        if plain and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.splits or text[0] != MARK:
            return [text]
        return re.findall(f"{MARK}+[^{MARK}]*", text)

    def _learn(self, parts: set[str]) -> None:
        """Have ``parts`` in the memory."""
        if self.held > REMEMBERED_CHARS:
            self.parts, self.older, self.held = {}, self.parts, 0
        short = []
        for x in parts.difference(self.parts):
            self.held += len(x) + 4
            if x in self.older:
                self.parts[x] = self.older[x]
            elif len(x) < LONG_PART:
                short.append(x)
            else:
                self.parts[x] = self.encode_alone(x if MARK in x else MARK + x)
        if short:
            self.parts.update(zip(short, self.encode_together([x if x[0] == MARK else MARK + x for x in short])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without begin and end, each id as 4 little-endian bytes."""
        out, at = [], 0
        while at < len(texts):
            block, held = [], 0
            while at < len(texts) and held < BLOCK_CHARS:
                block.append(texts[at])
                held += len(texts[at])
                at += 1
            if self.prefix or not self.splits:
                cut = list(map(self._cut, block))
                self._learn(set().union(*cut))
                out += [b"".join(map(self.parts.__getitem__, x)) for x in cut]
            else:
                out += [self.encode_alone(t.replace(" ", MARK)) for t in block]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: controls vanish, byte runs are UTF-8, one first mark goes."""
        drop = 0
        if self.prefix:
            first = next((i for i in ids if i not in self.controls), None)
            drop = first in self.marked
        runs, at = [], 0
        if not self.controls.isdisjoint(ids[1:-1]):  # a control ends a run of bytes
            for i, n in enumerate(ids):
                if n in self.controls:
                    runs.append(ids[at:i])
                    at = i + 1
        runs.append(ids[at:])
        text = "".join(b"".join(map(self.surface.__getitem__, r)).decode("utf-8", "tidemark-each-byte") for r in runs)
        return text[drop:]


_codecs: dict[bytes, Codec] = {}


def codec_of(broadcast) -> Codec:
    """One per Python worker and model, so later tasks find parts encoded."""
    model = broadcast.value
    if model["digest"] not in _codecs:
        _codecs[model["digest"]] = Codec(model)
    return _codecs[model["digest"]]


def encode_documents(
    docs: DataFrame, model: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", digests: bool = False
) -> DataFrame:
    """All columns of ``docs`` plus the ids (begin and end included) and their decoding.

    ``ids`` is a binary column of little-endian unsigned 32-bit integers and
    ``decoded`` the text they stand for; with ``digests`` they are ``n_tokens,
    ids_sha256, decoded_sha256`` instead of them and of the text, made in the same
    pass so that neither leaves the task. ``model`` is the path of the file on the driver; its vocabulary
    is broadcast (32,000 pieces, 1 MB). A null text counts as empty: begin and end
    alone. Texts are encoded whole at any length. Column names of ``docs`` may
    clash with anything but the new names; rows may repeat; an empty table gives an
    empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_model(model))
    columns = docs.columns
    at = columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec)
        begin, end = codec.begin.to_bytes(4, "little"), codec.end.to_bytes(4, "little")
        for batch in batches:
            coded = [begin + x + end for x in codec.encode([t or "" for t in batch.column(at).to_pylist()])]
            texts = [codec.decode(memoryview(c).cast("I").tolist()) for c in coded]
            if digests:
                arrays = [
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ]
            else:
                arrays = [pa.array(coded, pa.binary()), pa.array(texts, pa.string())]
            held = [c for i, c in enumerate(batch.columns) if i != at or not digests]
            yield pa.RecordBatch.from_arrays([*held, *arrays], names=names)

    # with digests the texts stay in the task too
    kept = [f for i, f in enumerate(plain.schema) if i != at or not digests]
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    names = [f.name for f in kept] + made
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    out = plain.mapInArrow(run, f"{kinds}, {new}")
    given = [F.col(f.name).alias(columns[int(f.name[1:])]) for f in kept]
    if digests:
        return out.select(*given, *made)
    return out.select(*given, F.col("ids").alias(ids), F.col("decoded").alias(decoded))

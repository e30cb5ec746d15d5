"""SentencePiece encoding and decoding that keeps the source bytes of every piece.

Texts are normalised as the model's compiled character map says: at each place the longest entry
of its double-array trie replaces what it matches, any other character stays.  Every normalised character
carries the byte of the source where its replacement began, so a piece, a run of normalised
characters, is a span of source bytes, and the spans of a text's pieces lie edge to edge.

A merge can't join characters that stand beside each other in no piece of the model; there the
normalised text is cut into chunks.  Each distinct chunk is merged once (and kept, within bounds);
ids, spans and decoded bytes of whole slices of documents are then gathered with numpy.  A long chunk is
merged in windows, cut between tokens that stay beside each other: a sequence of tokens is a
tokenisation exactly when each adjacent pair is.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

SLICE_BYTES = 2 << 20
#: Distinct chunks, and the bytes of their keys, that a worker keeps between slices; results don't depend on it.
MAX_CHUNKS, MAX_KEY_BYTES = 1 << 19, 32 << 20
#: Characters of a chunk that are merged at once, and tokens at a window's end that the next window makes anew.
WINDOW, TAIL = 4_096, 8
MARK = "▁"
_MARK = ord(MARK)
#: Stands for the end of a document among the normalised characters.
_STOP = 0x110000


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message; of numbers with a fixed width the bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, message[at : at + size]
            at += size


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("boardmill-bytewise", _bytewise)


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over bytes, and the replacements that its leaves point to."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob, "<u4", 1)[0]) if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if blob else np.zeros(0, np.int64)
        self.texts = blob[4 + size :]
        if b"  " in self.texts:
            raise ValueError("character maps with replacements that hold two spaces aren't supported")

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest entry at each place (0: none), which ends at ``end`` at most, and its replacement's place."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        rows, node, depth = np.arange(len(at)), np.full(len(at), int(self._offset(self.units[0]))), 0
        while len(rows):
            inside = at[rows] + depth < end[rows]
            rows, node = rows[inside], node[inside]
            byte = data[at[rows] + depth].astype(np.int64)
            node ^= byte
            unit = self.units[node]
            fits = unit & (1 << 31 | 0xFF) == byte
            rows, node, unit = rows[fits], node[fits], unit[fits]
            node ^= self._offset(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[rows[leaf]] = depth
            value[rows[leaf]] = self.units[node[leaf]] & ((1 << 31) - 1)
        return length, value

    def replacement(self, place: int) -> str:
        return self.texts[place : self.texts.index(b"\0", place)].decode()


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, model: bytes):
        trainer: dict[int, int | bytes] = {}
        spec: dict[int, int | bytes] = {}
        pieces = []
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b""), float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]), piece.get(3, 1)))
            elif field in (2, 3):
                (trainer if field == 2 else spec).update(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not spec.get(5, 1) or any(kind in (4, 5) for *_, kind in pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.map = CharacterMap(spec.get(2, b""))
        self.end_id = trainer.get(42, 2)
        self.rank = {text.decode(): (-score, k) for k, (text, score, kind) in enumerate(pieces) if kind == 1}
        self.byte_ids = [0] * 256
        surfaces = []
        for k, (text, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(text[3:5], 16)] = k
            surfaces.append({1: text.replace(MARK.encode(), b" "), 2: trainer.get(44, " ⁇ ".encode()), 6: bytes([int(text[3:5], 16)]) if kind == 6 else b""}.get(kind, b""))
        self.led = np.array([kind == 1 and text.startswith(MARK.encode()) for text, _, kind in pieces])
        self.surface_size = np.array([len(s) for s in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        chars = sorted({c for piece in self.rank for c in piece})
        self.alphabet = np.array([ord(c) for c in chars], np.uint32)
        if len(chars) >= 1 << 16:
            raise ValueError("too many characters")
        self.char_class = np.zeros(_STOP + 1, np.uint16)  # 0: in no piece
        self.char_class[self.alphabet] = np.arange(1, len(chars) + 1)
        side = len(chars) + 1
        self.beside = np.zeros(side * side, bool)  # class x class: somewhere beside each other in a piece
        known = {c: k + 1 for k, c in enumerate(chars)}
        self.beside[[known[a] * side + known[b] for piece in self.rank for a, b in zip(piece, piece[1:])]] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets the chunks."""
        self.chunks: dict[bytes | int, int] = {}
        self.key_bytes = 0
        self.token_ids, self.token_chars = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.first = np.zeros(1025, np.int64)  # tokens of chunk k: first[k] .. first[k + 1]

    def merge(self, text: str) -> list[str]:
        """The tokens of a text: of adjacent pairs that make a piece the best-ranked merges first, the leftmost of equals."""
        rank, parts = self.rank, list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        agenda = [(rank[p], k, p) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, k, made = heapq.heappop(agenda)
            j = after[k] if parts[k] else -1
            if j < 0 or len(parts[k]) + len(parts[j]) != len(made) or parts[k] + parts[j] != made:
                continue
            parts[k], parts[j] = made, ""
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (p := parts[a] + parts[b]) in rank:
                    heapq.heappush(agenda, (rank[p], a, p))
        return [p for p in parts if p]

    def tokens(self, text: str) -> list[str]:
        """The same in windows, so that the time is linear and the memory bounded."""
        out, at, width = [], 0, WINDOW
        while True:
            parts = self.merge(text[at : at + width])
            if out:
                pair = (out[-1], parts[0])
                if pair not in self.pairs:
                    self.pairs[pair] = self.merge(pair[0] + pair[1]) == [*pair]
                if not self.pairs[pair]:  # these two wouldn't stay apart: begin one token earlier, and see further
                    at -= len(out.pop())
                    width *= 2
                    continue
            if at + width >= len(text):
                return out + parts
            settled = parts[: max(1, len(parts) - TAIL)]
            out += settled
            at += sum(map(len, settled))
            width = WINDOW

    def learn(self, keys: list[bytes | int]) -> np.ndarray:
        """The number of each chunk: classes of its characters, or a single character that is in no piece."""
        out = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            found = self.chunks.get(key)
            if found is None:
                if isinstance(key, int):
                    ids = [self.byte_ids[b] for b in chr(key).encode()]
                    chars = [0] * (len(ids) - 1) + [1]
                else:
                    text = self.alphabet[np.frombuffer(key, np.uint16).astype(np.int64) - 1].tobytes().decode("utf-32-le")
                    ids, chars = [], []
                    for p in self.tokens(text):
                        if p in self.rank:
                            ids.append(self.rank[p][1])
                            chars.append(len(p))
                        else:  # a character that only occurs inside longer pieces
                            raw = p.encode()
                            ids += [self.byte_ids[b] for b in raw]
                            chars += [0] * (len(raw) - 1) + [1]
                found = self.chunks[key] = len(self.chunks)
                self.key_bytes += 8 if isinstance(key, int) else len(key)
                at = int(self.first[found])
                while at + len(ids) > len(self.token_ids):
                    self.token_ids, self.token_chars = (np.concatenate([x, np.zeros_like(x)]) for x in (self.token_ids, self.token_chars))
                if found + 2 > len(self.first):
                    self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                self.token_ids[at : at + len(ids)], self.token_chars[at : at + len(ids)] = ids, chars
                self.first[found + 1] = at + len(ids)
            out[k] = found
        return out

    def _decoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, the byte where each begins, and each document's first character (n + 1); a bad byte is one U+FFFD."""
        inner = offs[(offs > 0) & (offs < len(data))]
        try:
            if len(inner) and ((data[inner] & 0xC0) == 0x80).any():
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "a document begins inside a character")
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            bad = None
        except UnicodeDecodeError:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            bad = (codes >= 0xDC80) & (codes <= 0xDCFF)
            codes[bad] = 0xFFFD
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        if bad is not None:
            size[bad] = 1
        begin = np.cumsum(size) - size
        return codes, begin, np.searchsorted(begin, offs)

    def normalise(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised characters of all documents, each document's last one _STOP; their source bytes; each one's document."""
        codes, source, first = self._decoded(data, offs)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        if len(self.map.units) and len(codes):
            length, value = self.map.longest(data, source, offs[doc + 1])
            hits = np.flatnonzero(length)
            ends = source[hits] + length[hits]
            if (source[hits[1:]] < ends[:-1]).any():  # entries that begin inside the one before don't count
                kept, last = [], -1
                for k, (a, b) in enumerate(zip(source[hits].tolist(), ends.tolist(), strict=True)):
                    if a >= last:
                        kept.append(k)
                        last = b
                hits, ends = hits[kept], ends[kept]
            distinct, which = np.unique(value[hits], return_inverse=True)
            texts = [self.map.replacement(int(p)) for p in distinct]
            sizes = np.array([len(t) for t in texts], np.int64)
            place = np.cumsum(sizes) - sizes
            flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            after = np.searchsorted(source, ends)  # the first character behind each entry
            count = np.ones(len(codes), np.int64)
            covered = np.zeros(len(codes) + 1, np.int64)
            np.add.at(covered, hits, 1)
            np.add.at(covered, after, -1)
            count[np.cumsum(covered)[:-1] > 0] = 0
            count[hits] = sizes[which]
            origin = np.repeat(np.arange(len(codes)), count)
            out = codes[origin]
            target = np.cumsum(count) - count
            out[textkit.ranges(target[hits], sizes[which])] = flat[textkit.ranges(place[which], sizes[which])]
            codes, source, doc = out, source[origin], doc[origin]
        stop = offs[1:].astype(np.int64)
        if self.squeeze and len(codes):
            space = codes == 32
            led = np.r_[True, space[:-1] | (doc[1:] != doc[:-1])]
            kept = ~(space & led)
            codes, source, doc = codes[kept], source[kept], doc[kept]
            blank = (codes == 32) | (codes == _MARK)
            solid = np.full(len(offs) - 1, -1)
            solid[doc[~blank]] = np.flatnonzero(~blank)  # the last of each document
            # what stands behind the last other character goes; if all are blank, all
            gone = np.arange(len(codes)) > solid[doc]
            lead = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (doc[1:] != doc[:-1])])
            stop[doc[lead]] = source[lead]
            codes, source, doc = codes[~gone], source[~gone], doc[~gone]
        docs = len(offs) - 1
        first = np.searchsorted(doc, np.arange(docs + 1))
        filled = np.flatnonzero(np.diff(first)) if self.prefix else np.zeros(0, np.int64)
        # a mark before each document that isn't empty, and a stop behind each one
        where = np.r_[first[filled], first[1:]]
        codes = np.where(codes == 32, _MARK, codes)
        order = np.argsort(np.r_[first[filled] * 2 + 1, first[1:] * 2], kind="stable")  # at one place the stop of the document before comes first
        where = where[order]
        codes = np.insert(codes, where, np.r_[np.full(len(filled), _MARK), np.full(docs, _STOP)][order])
        source = np.insert(source, where, np.r_[source[first[filled]], stop][order])
        doc = np.insert(doc, where, np.r_[filled, np.arange(docs)][order])
        return codes, source, doc

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents, the source byte in its document where each begins, and each document's first id (n + 1).

        A document's last id is the end id; it begins where the text ends as far as it was encoded,
        and the spans of the others go from their beginning to the next one's.
        """
        if len(self.chunks) > MAX_CHUNKS or self.key_bytes > MAX_KEY_BYTES:
            self.reset()
        codes, source, doc = self.normalise(data, offs)
        classes = self.char_class[codes]
        side = len(self.alphabet) + 1
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.beside[classes[:-1].astype(np.int64) * side + classes[1:]]
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(codes)]
        number = np.empty(len(starts), np.int64)
        lead = codes[starts]
        text = np.flatnonzero(classes[starts] > 0)
        raw = classes.view(np.uint8)
        a, b = 2 * starts[text], 2 * ends[text]
        hashes = textkit.span_hash(raw, a, b)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        names = self.learn([raw[x:y].tobytes() for x, y in zip(a[one].tolist(), b[one].tolist(), strict=True)])
        number[text] = names[which]
        twin = one[which]
        same = b - a == (b - a)[twin]
        same[same] = textkit.equal_spans(raw, a[same], a[twin][same], (b - a)[same])
        for k in np.flatnonzero(~same).tolist():  # equal hashes of different chunks
            number[text[k]] = self.learn([raw[a[k] : b[k]].tobytes()])[0]
        alone = np.flatnonzero((classes[starts] == 0) & (lead != _STOP))
        distinct, which = np.unique(lead[alone], return_inverse=True)
        number[alone] = self.learn(distinct.tolist())[which]
        stops = lead == _STOP
        number[stops] = 0
        count = np.where(stops, 1, self.first[number + 1] - self.first[number])
        token = textkit.ranges(self.first[number], count)
        item = np.repeat(np.arange(len(starts)), count)
        at_stop = stops[item]
        ids = np.where(at_stop, self.end_id, self.token_ids[token])
        chars = np.where(at_stop, 1, self.token_chars[token])  # items lie edge to edge, so do their tokens
        begin = source[np.minimum(np.cumsum(chars) - chars, len(source) - 1)] if len(source) else source
        owner = doc[starts][item]
        return ids.astype(np.int32), (begin - offs[owner]).astype(np.int32), np.searchsorted(owner, np.arange(len(offs)))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded UTF-8 of each document, all in one array, and its bounds (n + 1)."""
        sizes = self.surface_size[ids]
        begin = self.surface_at[ids].copy()
        if self.prefix or self.squeeze:
            # the mark of the first token that stands for text isn't part of it, of all leading ones with the second setting
            shown = np.flatnonzero(sizes)
            docs = np.searchsorted(first, shown, "right") - 1
            lead = shown[np.r_[True, docs[1:] != docs[:-1]][: len(shown)]]
            while len(lead := lead[self.led[ids[lead]]]):
                sizes[lead] -= 1
                begin[lead] += 1
                if not self.squeeze:
                    break
                lead = lead[(sizes[lead] == 0) & (lead + 1 < first[np.searchsorted(first, lead, "right")])] + 1
        data = self.surface[textkit.ranges(begin, sizes)]
        total = np.r_[0, np.cumsum(sizes)]
        bounds = total[first]
        # bytes on both sides of a token without text make no character together
        silent = np.flatnonzero(self.surface_size[ids] == 0)
        inner = silent[~np.isin(silent + 1, first)]
        try:
            if len(inner):
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "tokens without text between others")
            data.tobytes().decode()
        except UnicodeDecodeError:
            raw, cuts = data.tobytes(), np.unique(np.r_[first, inner])
            texts = [raw[a:b].decode("utf-8", "boardmill-bytewise").encode() for a, b in zip(total[cuts[:-1]].tolist(), total[cuts[1:]].tolist(), strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)][np.searchsorted(cuts, first)]
        return data, bounds


_loaded: dict[str, PieceCodec] = {}


def load(model_file: str) -> PieceCodec:
    if model_file not in _loaded:
        with open(model_file, "rb") as f:
            _loaded[model_file] = PieceCodec(f.read())
    return _loaded[model_file]


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, ids, begins, decoded) of every row.

    ``ids`` ends with the model's end id.  Piece k was made from the bytes begins[k] to
    begins[k + 1] of the text (of a character spelled as several byte pieces the last has its
    bytes, the others none), and ``decoded`` is the text that the ids stand for.  A null text
    counts as empty: the end id alone.  Repeated rows are encoded each, null ids stay.  A byte that isn't
    part of a character is read as U+FFFD.  Other columns are ignored.  ``model_file``
    must be readable at the same path on every executor.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_file)
        for rows, offs, data in textkit.slices(batches, text_col, SLICE_BYTES):
            ids, begins, first = codec.encode(data, offs)
            text, bounds = codec.decode(ids, first)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (ids, begins)]
            out = pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)), pa.array(np.diff(offs)), *lists, out], [id_col, "n_bytes", "ids", "begins", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, n_bytes long, ids array<int>, begins array<int>, decoded string")

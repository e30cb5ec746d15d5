"""Token counts by a compiled finite-state transducer.

The piece table of a byte-fallback BPE model is compiled, lazily, into a deterministic
transducer.  A state holds what the future can depend on: the longest suffix read that is a
proper prefix of a piece, and for every place in it from which a longer piece may start the last
token of the tokenisation that ends there and how many tokens it lags behind.  Each transition carries the
number of tokens it adds (negative when a merge takes tokens back).  The construction rests on
two facts about merge-ranked BPE: every prefix of a tokenisation is the tokenisation of its own
text, and a sequence of tokens is a tokenisation exactly when every adjacent pair is.

Texts run as many lanes at once through the dense transition table.  A lane is a chunk: it
starts where no piece can span (before a run of spaces, beside a fallback character), so its
state map is constant and chunk maps compose by a prefix sum of their counts.  Chunks longer
than ``LANE_CHARS`` are cut further.  The map of such a lane, from entry state to exit state and
count, is made for the entries that can occur: one from a run over the characters before it, every
exit of the lane before, and, where that doesn't settle soon, every exit seen in its chunk.  Then the maps are composed by doubling: after k steps each entry
knows the exit and count 2**k lanes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

LANE_CHARS = 256
#: The table is rebuilt when it would hold more states than this; results don't depend on it.
MAX_STATES = 250_000
_MARK = "▁"


class PieceTransducer:
    """Counts tokens as sentencepiece does for a BPE model with byte fallback and no normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        probe = "ﬁ  Ａe\u0301 x"
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.rank) or model.normalize(probe) != (" " + probe).replace(" ", _MARK):
            raise ValueError("only models without a normaliser and without pieces across words are counted")
        self.prefixes = {p[:k] for p in self.rank for k in range(len(p))}
        self.max_len = max(map(len, self.rank), default=1)
        self.own: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chars = sorted({c for p in self.rank for c in p if c in self.rank})
        self.char_class = np.zeros(0x110000, np.int32)  # 0: no piece, bytes instead
        for k, c in enumerate(self.chars):
            self.char_class[ord(c)] = k + 1
        self.char_class[0x20] = self.char_class[ord(_MARK)]
        self.mark = int(self.char_class[0x20])
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[str, tuple[tuple[int, str, int], ...]]] = [("", ((0, "", 0),))]
        self.ids = {self.states[0]: 0}
        self.columns: dict[int, int] = {}
        self.column_of = np.full(len(self.chars) + 1, -1, np.int32)
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text: the best-ranked adjacent pair merges first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank]
            if not found:
                break
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, before: str, token: str) -> bool:
        if token not in self.own:
            self.own[token] = self.merge(token) == [token]
        if not self.own[token] or not before:
            return self.own[token]
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = self.merge(before + token) == [before, token]
        return self.pairs[key]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the tokens added; built once for each state and character."""
        suffix, back = self.states[state]  # (characters before the end, last token there, count there)
        grown, width = suffix + char, len(suffix)
        for before, token_before, count_before in back:
            token = grown[width - before :]
            if token in self.rank and self.follows(token_before, token):
                break
        else:
            raise AssertionError("every character of a chunk is a piece")
        count = count_before + 1
        # only places from which a longer piece may still start matter to the future
        reach = [(b + 1, t, c - count) for b, t, c in back if grown[width - b :] in self.prefixes]
        new = (grown[len(grown) - reach[0][0] :] if reach else "", (*reach, (0, token, 0)))
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
            if len(self.states) > len(self.next):
                more = min(len(self.next), 32_768)
                self.next = np.concatenate([self.next, np.full_like(self.next[:more], -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit[:more])])
        return self.ids[new], count

    def fill(self, states: np.ndarray, classes: np.ndarray) -> None:
        """Builds the transitions of these (state, column) pairs that are missing."""
        width = self.next.shape[1]
        names = {v: k for k, v in self.columns.items()}
        for key in np.unique(states.astype(np.int64) * width + classes).tolist():
            s, c = divmod(key, width)
            after, count = self.step(s, self.chars[names[c] - 1])
            self.next[s, c], self.emit[s, c] = after, count

    def to_columns(self, classes: np.ndarray) -> np.ndarray:
        got = self.column_of[classes]
        if (got < 0).any():
            for c in np.unique(classes[got < 0]).tolist():
                self.columns[c] = len(self.columns)
                self.column_of[c] = self.columns[c]
            while len(self.columns) > self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)], axis=1)
            got = self.column_of[classes]
        return got

    def run(self, columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each lane columns[starts : starts + lengths] from its entry state."""
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, count = entry[order].astype(np.int32), np.zeros(len(order), np.int64)
        live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
        for k, n in enumerate(live.tolist()):
            s, c = state[:n], columns[at[:n] + k]
            after = self.next[s, c]
            if (lacking := after < 0).any():
                self.fill(s[lacking], c[lacking])
                after = self.next[s, c]
            count[:n] += self.emit[s, c]
            state[:n] = after
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def chunks(self, columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The count of each chunk.  Long chunks run as several lanes whose state maps are composed."""
        pieces = np.maximum(1, -(-lengths // LANE_CHARS))
        owner = np.repeat(np.arange(len(starts)), pieces)
        within = textkit.ranges(np.zeros(len(starts), np.int64), pieces)
        lane = starts[owner] + within * LANE_CHARS
        size = np.minimum(LANE_CHARS, lengths[owner] - within * LANE_CHARS)
        entry = np.zeros(len(lane), np.int32)
        inner = np.flatnonzero(within > 0)
        if len(inner):
            entry[inner] = self.run(columns, lane[inner] - 64, np.full(len(inner), 64), np.zeros(len(inner), np.int32))[0]
        goes_on = np.r_[within[1:] > 0, False]
        # the maps: (lane, entry state) as one number, with exit and count; exits are entries of the next lane
        keys, exits, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.arange(len(lane), dtype=np.int64) << 32 | entry
        rounds = 0
        while len(new):
            own = new >> 32
            out, n = self.run(columns, lane[own], size[own], (new & 0xFFFFFFFF).astype(np.int32))
            keys, exits, counts = np.r_[keys, new], np.r_[exits, out], np.r_[counts, n]
            onward = goes_on[own]
            new = np.setdiff1d(own[onward] + 1 << 32 | out[onward].astype(np.int64), keys)
            rounds += 1
            if rounds > 2 and len(new):  # all lanes of the chunk at once, so that states don't pass from lane to lane
                chunk, state = np.unique(np.stack([owner[new >> 32], new & 0xFFFFFFFF]), axis=1)
                first_lane = np.cumsum(pieces) - pieces
                lanes = textkit.ranges(first_lane[chunk] + 1, pieces[chunk] - 1)
                new = np.setdiff1d(lanes.astype(np.int64) << 32 | np.repeat(state, pieces[chunk] - 1), keys)
        order = np.argsort(keys)
        keys, exits, counts = keys[order], exits[order], counts[order]
        own = keys >> 32
        after = np.where(goes_on[own], np.searchsorted(keys, own + 1 << 32 | exits), len(keys))
        after, counts = np.r_[after, len(keys)], np.r_[counts, 0]  # the last one stands for the end of a chunk
        for _ in range(int(pieces.max() - 1).bit_length() if len(pieces) else 0):
            counts, after = counts + counts[after], after[after]
        return counts[np.searchsorted(keys, np.flatnonzero(within == 0).astype(np.int64) << 32)]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) > MAX_STATES:
            self.reset()
        # a space before each text, as the model adds one; an empty text has no token
        codes = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 if t else 0 for t in texts], out=bounds[1:])
        n = len(codes)
        if not n:
            return np.zeros(len(texts), np.int64)
        classes = self.char_class[codes]
        alone = classes == 0
        space = classes == self.mark
        begin = ~alone
        begin[1:] &= (space[1:] & ~space[:-1]) | alone[:-1]
        begin[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begin)
        edge = begin | alone
        edges = np.r_[np.flatnonzero(edge), n]
        lengths = edges[np.searchsorted(edges, starts, "right")] - starts
        columns = np.zeros(n, np.int32)
        columns[~alone] = self.to_columns(classes[~alone])
        total = np.zeros(n + 1, np.int64)
        total[1:][alone] = 1 + (codes[alone] > 0x7F) + (codes[alone] > 0x7FF) + (codes[alone] > 0xFFFF)
        total[1:][starts] += self.chunks(columns, starts, lengths)
        np.cumsum(total, out=total)
        return total[bounds[1:]] - total[bounds[:-1]]


_loaded: dict[str, PieceTransducer] = {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.

    ``model_file`` must be readable at the same path on every executor.  A null text counts as
    empty (0 bytes, 0 tokens).  Repeated rows are counted each.  Other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _loaded:
            _loaded[model_file] = PieceTransducer(model_file)
        machine = _loaded[model_file]
        for rows, offs, data in textkit.slices(batches, text_col):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ids = rows.column(rows.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(machine.count(texts))], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
